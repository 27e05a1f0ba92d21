"""Mixing sources to target weights by Pareto order sampling.

*Targets.* The sources, in code point order and null last, have weights 1, 2, 3, 1, 2, 3, ... and
share the words of the whole corpus by weight. A target stops at ``MAX_COPIES`` times its source's
size; the excess is shared again by weight until no target is above. That is one level ``x`` with
``target = min(3 size, x weight)``, found by a running sum over the sources in order of ``3 size / weight``.

*Expected copies.* A document of a source is due ``c = min(3, k p)`` copies, where ``p`` is its preference
and ``k`` makes the expected words equal the target (again by a running sum, over at most 1,000
distinct preferences of a source). The preference is 1,000 up to ``REFERENCE`` words and falls with
the square root of the length beyond, so that very long documents do not fill a source's budget.

*Whole copies* ``floor(c)`` are certain. *The rest* ``f = c - floor(c)`` is drawn by Pareto order
sampling: documents are ranked by ``(u / (1 - u)) / (f / (1 - f))``, ``u`` being a hash of the seed, the
id and the text, and the first ones that together come nearest to the words still due are taken.
The cut in that order is found by a histogram of the ranks for each source (4,096 bins, then 4,096
parts of the bin that holds the cut) and a running sum in the last part alone, so no task sorts a
source, however many rows one source has.

Edge cases: null texts and texts without words have size 0 and are never taken; null is a source
of its own; rows with the same id and text get the same draw and are taken or left together, and
of several such draws at the cut all or none are in; a source whose documents have no words has target 0;
an empty table gives an empty result; other input columns are not read by ``plan`` and are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, n_words, stored

MAX_COPIES = 3
CYCLE = 3  # weights 1 .. CYCLE, repeating
REFERENCE = 1000
SEED = 7
BITS, STEP = 48, 12
PREFIX = "__mix_"


def draw(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on seed, id and text alone."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(2 ** 48)


def preference(size: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.sqrt(F.lit(float(REFERENCE)) / F.greatest(size, F.lit(REFERENCE)).cast("double"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, size) rows; one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", (F.row_number().over(by_name) - 1) % CYCLE + 1)
    order = Window.orderBy(MAX_COPIES * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything),
        "capped": F.coalesce(F.sum(MAX_COPIES * F.col("source_size")).over(done), F.lit(0)),
        "gone_w": F.coalesce(F.sum("w").over(done), F.lit(0))})
    level = (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("gone_w"))
    fits = level * F.col("w") <= MAX_COPIES * F.col("source_size")
    s = s.withColumn("level", F.max(F.when(fits, level)).over(everything))
    return s.select("source", "source_size", F.least(
        MAX_COPIES * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.lit(float("inf")))).alias("target"))


def _factors(rows: DataFrame) -> DataFrame:
    """source, source_size, target, k of each source."""
    target = stored(targets(rows), "mix-targets")
    by = Window.partitionBy("source").orderBy(F.desc("p"))
    g = rows.where("size > 0").groupBy("source", "p").agg(F.sum("size").alias("words"))
    g = g.join(target.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    g = g.withColumn("capped", F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = g.withColumn("rest", F.sum(F.col("p") * F.col("words")).over(
        Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    k = (F.col("target") - MAX_COPIES * F.col("capped")) / F.col("rest")
    g = g.groupBy("source").agg(F.max_by(k, F.when(k * F.col("p") <= MAX_COPIES + 1e-9, F.col("p"))).alias("k"))
    g = g.withColumnRenamed("source", "s")
    return target.join(g, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _copies(k: Column, size: Column, p: Column) -> Column:
    c = F.least(F.lit(float(MAX_COPIES)), F.coalesce(k, F.lit(0.0)) * p)
    c = F.when(F.abs(c - F.round(c)) < 1e-9, F.round(c)).otherwise(c)
    return F.when(size > 0, c).otherwise(F.lit(0.0))


def _rank(u: Column, f: Column) -> Column:
    """Pareto rank as an integer of ``BITS`` bits that grows with random odds / inclusion odds."""
    q = (u / (1 - u)) / (f / (1 - f))
    return F.floor(q / (1 + q) * float(2 ** BITS)).cast("long")


def _cuts(lottery: DataFrame, due: DataFrame) -> DataFrame:
    """source, cut: the lottery's rows with rank <= cut come nearest to the words due.

    ``lottery``: source, rank, size. ``due``: source, due (words).
    """
    left, open_rows = due, lottery
    for shift in (BITS - STEP, BITS - 2 * STEP, 0):
        bins = open_rows.groupBy("source", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        bins = bins.join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        w = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumns({"upto": F.sum("words").over(w), "due": F.col("due").cast("double")})
        before = F.col("upto") - F.col("words")
        if not shift:  # the bins are ranks
            good = (F.col("upto") <= F.col("due")) | (F.col("upto") - F.col("due") <= F.col("due") - before)
            return bins.groupBy("source").agg(F.coalesce(F.max(F.when(good, F.col("bin"))), F.min("bin") - 1).alias("cut"))
        edge = bins.groupBy("source").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("due"), F.col("bin"))), F.max("bin")).alias("bin"),
            F.max("due").alias("all_due"), F.coalesce(F.max(F.when(F.col("upto") < F.col("due"), F.col("upto"))), F.lit(0)).alias("below"),
            F.max("upto").alias("most"), F.max(F.struct("bin", "words")).alias("last"))
        edge = stored(edge.select("source", "bin", F.when(F.col("most") < F.col("all_due"), F.col("all_due") - F.col("most") + F.col("last.words"))
                                  .otherwise(F.col("all_due") - F.col("below")).alias("due")), "mix-edge")
        left = edge.select("source", "due")
        open_rows = join_checked(open_rows, edge.withColumnRenamed("source", "s"),
                                 open_rows.source.eqNullSafe(F.col("s")) & (F.shiftright("rank", shift) == F.col("bin")),
                                 "inner").select("source", "rank", "size")
    raise AssertionError


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """key, size, source, source_size, target, copies, u of every row of ``docs``; ``copies`` is how often it is taken."""
    t = F.col(f"`{text}`")
    rows = stored(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), n_words(t).alias("size"),
                              draw(F.col(f"`{key}`"), t, seed).alias("u")), "mix-rows").withColumn("p", preference(F.col("size")))
    factors = stored(_factors(rows), "mix-factors").withColumnRenamed("source", "s")
    due = join_checked(rows, factors, rows.source.eqNullSafe(factors.s)).drop("s")
    due = due.withColumn("c", _copies(F.col("k"), F.col("size"), F.col("p"))).withColumn("f", F.col("c") - F.floor("c"))
    due = due.withColumn("rank", F.when(F.col("f") > 0, _rank(F.col("u"), F.col("f"))))
    sums = due.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.floor("c") * F.col("size")).alias("certain"))
    words = stored(sums.select("source", (F.col("target") - F.col("certain")).alias("due")), "mix-due")
    cuts = stored(_cuts(due.where("rank is not null").select("source", "rank", "size"), words), "mix-cuts").withColumnRenamed("source", "s")
    out = join_checked(due, cuts, due.source.eqNullSafe(cuts.s))
    return out.select(F.col("key").alias(key), "size", "source", "source_size", "target", (
        F.floor("c") + F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0)).cast("long").alias("copies"), "u")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0 to ``MAX_COPIES`` times).

    The copies are found again by id and draw, both of which are functions of the row.
    """
    taken = plan(docs, key, text, source, seed).select(
        F.col(key).alias(PREFIX + "key"), F.col("u").alias(PREFIX + "u"), F.col("copies").alias(PREFIX + "copies")).where(F.col(PREFIX + "copies") > 0)
    own = docs.withColumn(PREFIX + "draw", draw(F.col(f"`{key}`"), F.col(f"`{text}`"), seed))
    taken = taken.distinct()
    both = own.join(taken, own[f"`{key}`"].eqNullSafe(taken[PREFIX + "key"]) & (own[PREFIX + "draw"] == taken[PREFIX + "u"]))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return both.withColumn(PREFIX + "n", F.explode(F.sequence(F.lit(1), F.col(PREFIX + "copies").cast("int")))).select(*names)
