"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each document has a vector of transformed statistics (``FEATURES``), kept as one array of integers (units of 1 / ``UNIT``). For every
language and source the minimum covariance determinant is estimated: the mean and covariance of the three quarters of the rows
whose covariance has the least determinant. From three starts (medians with median deviations; the same centre with the
covariance of the rows' directions; mean and covariance of all rows) two concentration steps are taken, each the mean and covariance of the
three quarters nearest by Mahalanobis distance; the start with the least determinant goes on until its determinant falls no more.
The consistency factor lowers distances whose median is above that of chi-square with as many degrees of freedom as features (the three quarters
vary less than all rows); it never raises them, which would undo the floors. A document is rejected beyond the 99.99 % point of that chi-square, or where a base rule fails (fewer than 10 words, or more than 20 % of the words in
repeated five-word windows).

Groups with fewer than ``MIN_GROUP`` rows that pass the base rules are judged by the estimate of their language, and languages with fewer by that of
all rows, however few: these estimates take part in the same steps where any group needs them, so every row that passes the
base rules has a distance. Shares are of counts with some typical text added (``SMOOTH`` characters, for one), so those of short texts vary no more than those of
long ones.

Each step is one aggregate over the stored vectors: counts, sums and products for each group, start and bin of
distance, combined before the shuffle, so a group that holds a third of all rows
sends a bounded number of rows from each task. The three quarters are the bins up to the one that reaches them. Sums are
of integers and the same in any order. The variances have a floor (in ``FEATURES``), which keeps
statistics that are zero in most documents from making the matrix singular. Means and inverse covariances are one array each, the inverse and the determinant come
from the sweeps of one ``aggregate``.

Edge cases: a null text has no words and fails the base rules; null languages and sources are
groups of their own; repeated rows count as often as they occur and get equal verdicts; where no row passes the base rules there is no estimate and none is
needed (distance 0); an empty table gives an empty result; other input columns are not read by ``verdicts`` and are kept by ``kept_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import BROADCAST_BYTES, WORD, join_checked, stored, whole

MIN_WORDS, MAX_REPEAT_PCT, GRAM = 10, 20, 5
UNIT = 256
SMOOTH = 100
#: name -> (expression over the statistics, least standard deviation)
FEATURES = {
    "length": ("ln(n_words + 50)", 0.5),
    "word_length": (f"ln((word_chars + {SMOOTH}) / (n_words + {SMOOTH / 5}))", 0.1),
    "symbols": (f"ln(1 + 100 * n_symbols / (word_chars + {SMOOTH}))", 0.3),
    "repeats": ("ln(1 + 100 * n_repeat_words / (n_words + 30))", 1.5),
    "stutter": ("ln(1 + 100 * n_stutter / (n_words + 20))", 0.5),
    "dup_lines": ("ln(1 + 100 * n_dup_lines / (n_lines + 5))", 1.5),
    "upper": (f"ln(1 + 100 * (n_upper + {0.03 * SMOOTH}) / (word_chars + {SMOOTH}))", 0.2),
    "marks": (f"ln(1 + 100 * (n_marks + {0.04 * SMOOTH}) / (word_chars + {SMOOTH}))", 0.3),
}
NAMES = tuple(FEATURES)
FLOORS = [floor for _, floor in FEATURES.values()]
P = len(NAMES)
MEDIAN, CUTOFF = 7.344, 31.828  # the middle and the 99.99 % point of chi-square with P = 8 degrees of freedom
SHARE = 0.75
FIRST_STEPS, MOST_STEPS = 2, 30
FALLS = 1e-6  # a determinant's logarithm that falls by less has settled
MIN_GROUP = 50
DIRECTION = 1 << 15  # units of a direction's entry
COARSE = 16  # bins of a unit of log distance
MODEL_BYTES = 1024  # of a row of the model, at most
PREFIX = "__q_"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stutter")
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _without(text: Column, kept: str) -> Column:
    """Number of characters of a class: the length once all others are gone."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that are found twice or more (windows are compared by 64-bit hash)."""
    def grams(h):
        last = F.size(h) - GRAM
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[h[i + j] for j in range(GRAM)])))

    def covered(at):  # ascending window starts
        steps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(GRAM), at[i + 1] - p)).otherwise(F.lit(GRAM)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s):  # windows in order of their hashes
        twice = F.filter(F.transform(s, lambda x, i: F.when(
            ((i > 0) & (s[F.greatest(i - 1, F.lit(0))].g == x.g)) | ((i + 1 < F.size(s)) & (s[F.least(i + 1, F.size(s) - 1)].g == x.g)), x.i)),
            lambda p: p.isNotNull())
        return let(F.array_sort(twice), covered)

    def count(g):
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, repeated))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), count)).cast("long")


def stutter(words: Column) -> Column:
    """Words that are equal to the word before, but for case and the marks around them."""
    def count(w):
        again = F.filter(w, lambda x, i: (i > 0) & (F.get(w, F.greatest(i - 1, F.lit(0))) == x))
        return F.size(again).cast("long")
    return let(F.transform(words, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?")))), count)


def statistics(text: Column) -> Column:
    """STRUCT of ``STATS`` of a text."""
    def of(t, w, lines):
        chars = F.length(F.array_join(w, ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
            _without(t, "#*$%&|<>").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
            _without(t, "A-Z").alias("n_upper"), _without(t, ".!?,;:").alias("n_marks"), stutter(w).alias("n_stutter"))
    return let(whole(text), lambda t: let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: let(
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda lines: of(t, w, lines))))


def with_statistics(docs: DataFrame, text: str, lang: str, source: str, *kept: str) -> DataFrame:
    """``kept`` columns of ``docs`` and, with ``PREFIX``, language, source, statistics, vector ``x`` and base verdict."""
    df = docs.select(*[F.col(f"`{c}`").alias(c) for c in kept], F.col(f"`{lang}`").alias(LANG),
                     F.col(f"`{source}`").alias(SOURCE), statistics(F.col(f"`{text}`")).alias(PREFIX + "s"))
    df = df.withColumns({PREFIX + c: F.col(f"{PREFIX}s.{c}") for c in STATS}).drop(PREFIX + "s")

    def feature(expression):
        for c in STATS:
            expression = expression.replace(c, PREFIX + c)
        return F.expr(f"cast(round({UNIT} * ({expression})) as bigint)")
    n, r = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    return df.withColumns({X: F.array(*[feature(e) for e, _ in FEATURES.values()]),
                           PREFIX + "base_failed": (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PCT * n)})


LANG, SOURCE, X, D2 = (PREFIX + c for c in ("lang", "source", "x", "d2"))
# what an estimate holds: mean, inverse covariance (below and on the diagonal), logarithm of the determinant
MODEL = ("m", "p", "logdet")


def _on(left: DataFrame, right: DataFrame, small: bool | None, how: str) -> DataFrame:
    """Join by language and source, nulls being values."""
    other = right.withColumnsRenamed({LANG: "lang_m", SOURCE: "source_m"})
    on = F.col(LANG).eqNullSafe(F.col("lang_m")) & F.col(SOURCE).eqNullSafe(F.col("source_m"))
    joined = join_checked(left, other, on, how) if small is None else left.join(F.broadcast(other) if small else other, on, how)
    return joined.drop("lang_m", "source_m")


def _d2() -> Column:
    """Squared distance of X from the mean ``m`` by the inverse covariance ``p``."""
    gap = [F.get(X, F.lit(i)) / UNIT - F.get("m", F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for t, (i, j) in enumerate(PAIRS):
        total = total + gap[i] * gap[j] * F.get("p", F.lit(t)) * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _inverse(cov: Column) -> Column:
    """STRUCT<p, logdet> of a covariance given by its lower half: one sweep for each pivot."""
    at = {ij: t for t, ij in enumerate(PAIRS)}
    full = F.transform(F.array(*[F.lit(at[max(i, j), min(i, j)]) for i in range(P) for j in range(P)]), lambda t: F.get(cov, t))

    def sweep(s, k):
        def entry(v, t):
            i, j = F.floor(t / P).cast("int"), (t % P).cast("int")
            pivot = F.get(s.a, k * P + k)
            return F.when((i == k) & (j == k), -1 / pivot).when((i == k) | (j == k), v / pivot).otherwise(
                v - F.get(s.a, i * P + k) * F.get(s.a, k * P + j) / pivot)
        return F.struct(F.transform(s.a, entry).alias("a"), (s.logdet + F.ln(F.get(s.a, k * P + k))).alias("logdet"))

    start = F.struct(full.alias("a"), F.lit(0.0).alias("logdet"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), start, sweep), lambda s: F.struct(
        F.transform(F.array(*[F.lit(i * P + j) for i, j in PAIRS]), lambda t: -F.get(s.a, t)).alias("p"), s.logdet.alias("logdet")))


def _estimate(df: DataFrame, mean: Column, cov: Column, *keys: str) -> DataFrame:
    """keys, m, p, logdet from arrays of means and of covariances (lower half), in units of the features."""
    return df.select(*keys, mean.alias("m"), cov.alias("c")).withColumn("i", _inverse(F.col("c"))).select(*keys, "m", "i.p", "i.logdet")


def _bin(d2: Column, parts: int = 64) -> Column:
    return F.floor(parts * F.log1p(F.least(d2, F.lit(1e15)))).cast("int")


def _members(rows: DataFrame) -> DataFrame:
    """lang, source, k, own: the estimates that a group's rows take part in, and the one (``own``) that judges them. Stored."""
    sizes = rows.groupBy(LANG, SOURCE).agg(F.count(F.lit(1)).alias("n"))
    in_lang, anywhere = Window.partitionBy(LANG), Window.partitionBy(F.lit(0))  # a row for each group
    sizes = sizes.withColumn("n_lang", F.sum("n").over(in_lang))
    sizes = sizes.withColumn("level", F.when(F.col("n") >= MIN_GROUP, 2).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(0))
    sizes = sizes.withColumns({"lang_too": F.max(F.col("level") == 1).over(in_lang), "all_too": F.max(F.col("level") == 0).over(anywhere)})
    name = F.struct(F.lit(2).alias("level"), F.col(LANG).alias("l"), F.col(SOURCE).alias("s"))
    kind = "struct<level:int,l:string,s:string>"
    lang = F.struct(F.lit(1).alias("level"), F.col(LANG).alias("l"), F.lit(None).cast("string").alias("s"))
    every = F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("s"))
    takes = F.filter(F.array(*[F.when(c, x.cast(kind)) for c, x in ((F.col("level") == 2, name), (F.col("lang_too"), lang), (F.col("all_too"), every))]),
                     lambda x: x.isNotNull())
    out = sizes.select(LANG, SOURCE, "level", F.explode(takes).alias("name"))
    return stored(out.select(LANG, SOURCE, F.dense_rank().over(Window.orderBy("name")).alias("k"), (F.col("name.level") == F.col("level")).alias("own")),
                  "quality-members")


def _sums(*keys: str):
    """Aggregates: n, sums and products of X."""
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get(X, F.lit(i))) for i in range(P)]).alias("s"),
            F.array(*[F.sum(F.get(X, F.lit(i)) * F.get(X, F.lit(j))) for i, j in PAIRS]).alias("ss")]


def _from_sums(df: DataFrame, *keys: str) -> DataFrame:
    """Estimate from n, s and ss."""
    mean = F.transform("s", lambda v: v / F.col("n") / UNIT)
    df = df.withColumn("mean", mean)
    cov = F.array(*[F.get("ss", F.lit(t)) / F.col("n") / (UNIT * UNIT) - F.get("mean", F.lit(i)) * F.get("mean", F.lit(j)) + (FLOORS[i] ** 2 if i == j else 0.0)
                    for t, (i, j) in enumerate(PAIRS)])
    return _estimate(df, F.col("mean"), cov, *keys)


def _starts(rows: DataFrame, members: DataFrame, small: bool) -> DataFrame:
    """k, start, m, p, logdet of three starts for every estimate. Stored."""
    each = _on(rows, members.select(LANG, SOURCE, "k"), small, "inner")
    centre = stored(each.groupBy("k").agg(F.array(*[F.percentile(F.get(X, F.lit(i)), F.lit(0.5)) for i in range(P)]).alias("med")), "quality-median")
    near = _on(rows, members.select(LANG, SOURCE, "k").join(centre, "k"), small, "inner")
    spread = near.groupBy("k").agg(F.max("med").alias("med"), F.array(*[
        F.greatest(F.percentile(F.abs(F.get(X, F.lit(i)) - F.get("med", F.lit(i))), F.lit(0.5)) * 1.4826, F.lit(FLOORS[i] * UNIT)) for i in range(P)]).alias("mad"))
    spread = stored(spread, "quality-spread")
    near = _on(rows, members.select(LANG, SOURCE, "k").join(spread, "k"), small, "inner")
    gap = F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda i: (F.get(X, i) - F.get("med", i)) / F.get("mad", i))
    unit = let(gap, lambda z: let(F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, v: a + v * v)), lambda r: F.transform(
        z, lambda v: F.when(r > 0, F.round(DIRECTION * v / r)).otherwise(F.lit(0.0)).cast("bigint"))))
    near = near.withColumn("u", unit)
    sums = stored(near.groupBy("k").agg(F.max("med").alias("med"), F.max("mad").alias("mad"), *_sums(), F.array(*[
        F.sum(F.get("u", F.lit(i)) * F.get("u", F.lit(j))) for i, j in PAIRS]).alias("uu")), "quality-start-sums")
    mid, mad = F.transform("med", lambda v: v / UNIT), F.transform("mad", lambda v: v / UNIT)
    sums = sums.withColumns({"mid": mid, "mad": mad})
    plain = F.array(*[F.get("mad", F.lit(i)) * F.get("mad", F.lit(j)) * (1.0 if i == j else 0.0) for i, j in PAIRS])
    turned = F.array(*[F.get("mad", F.lit(i)) * F.get("mad", F.lit(j)) * (P * F.get("uu", F.lit(t)) / F.col("n") / DIRECTION ** 2 + (0.1 if i == j else 0.0))
                       for t, (i, j) in enumerate(PAIRS)])
    parts = [_estimate(sums, F.col("mid"), plain, "k"), _estimate(sums, F.col("mid"), turned, "k"), _from_sums(sums, "k")]
    out = None
    for i, part in enumerate(parts):
        part = part.select("k", F.lit(i).alias("start"), *MODEL)
        out = part if out is None else out.unionByName(part)
    return stored(out, "quality-starts")


def _step(rows: DataFrame, members: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """The estimates of ``model`` (k, start, ..) after one concentration step. Stored."""
    near = _on(rows, members.select(LANG, SOURCE, "k").join(model.select("k", "start", "m", "p"), "k"), small, "inner")
    bins = near.groupBy("k", "start", _bin(_d2(), COARSE).alias("bin")).agg(*_sums())
    w = Window.partitionBy("k", "start")
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    half = bins.where(F.col("upto") - F.col("n") < SHARE * F.col("all"))  # up to the bin that reaches the share
    total = half.groupBy("k", "start").agg(
        F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(P)]).alias("s"),
        F.array(*[F.sum(F.get("ss", F.lit(t))) for t in range(len(PAIRS))]).alias("ss"), F.sum("n").alias("n"))
    return stored(_from_sums(total, "k", "start"), "quality-step")


def fit(rows: DataFrame) -> DataFrame:
    """lang, source, m, p, scale: the estimate that judges each group, of a stored ``with_statistics`` table."""
    rows = rows.where(~F.col(PREFIX + "base_failed")).select(LANG, SOURCE, X)
    members = _members(rows)
    small = members.count() * 3 * MODEL_BYTES <= BROADCAST_BYTES
    model = _starts(rows, members, small)
    for _ in range(FIRST_STEPS):
        model = _step(rows, members, model, small)
    best = model.groupBy("k").agg(F.min_by(F.struct("start", *MODEL), F.struct("logdet", "start")).alias("b"))
    model, done = stored(best.select("k", "b.*"), "quality-best"), None
    for _ in range(MOST_STEPS):
        then = model.select("k", *[F.col(c).alias(c + "_0") for c in MODEL])
        both = _step(rows, members, model, small).join(then, "k")
        falls = F.col("logdet") < F.col("logdet_0") - FALLS
        both = stored(both.select("k", "start", falls.alias("falls"), *[F.when(falls, F.col(c)).otherwise(F.col(c + "_0")).alias(c) for c in MODEL]), "quality-next")
        settled = both.where(~F.col("falls")).drop("falls")
        done = settled if done is None else done.unionByName(settled)
        model = both.where("falls").drop("falls")
        if model.isEmpty():
            break
    else:
        done = done.unionByName(model)
    model = stored(done, "quality-settled")
    own = members.where("own").select(LANG, SOURCE, "k").join(model.select("k", "m", "p"), "k")
    # the scale is of all rows of an estimate, the language's among them
    near = _on(rows, members.select(LANG, SOURCE, "k").join(model.select("k", "m", "p"), "k"), small, "inner")
    h = near.groupBy("k", _bin(_d2()).alias("bin")).count()
    w = Window.partitionBy("k")
    h = h.withColumns({"upto": F.sum("count").over(w.orderBy("bin")), "n": F.sum("count").over(w)})
    scale = h.groupBy("k").agg(F.min(F.when(F.col("upto") >= 0.5 * F.col("n"), F.col("bin"))).alias("bin"))
    scale = scale.select("k", F.greatest(F.expm1((F.col("bin") + 1) / 64) / MEDIAN, F.lit(1.0)).alias("scale"))
    return stored(own.join(scale, "k").drop("k"), "quality-model")


def judged(rows: DataFrame, model: DataFrame) -> DataFrame:
    """A ``with_statistics`` table with ``far`` (scaled squared distance) and ``kept``."""
    out = _on(rows, model, None, "left")
    far = F.coalesce(_d2() / F.col("scale"), F.lit(0.0))
    return out.withColumn(PREFIX + "far", far).withColumn(PREFIX + "kept", ~F.col(PREFIX + "base_failed") & (F.col(PREFIX + "far") <= CUTOFF))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, the statistics, base_failed, distance (scaled, squared; 0 without an estimate), kept of every row."""
    rows = stored(with_statistics(docs, text, lang, source, key), "quality-rows")
    out = judged(rows, fit(rows))
    return out.select(key, *[F.col(PREFIX + c).alias(c) for c in STATS[:5]], F.col(PREFIX + "base_failed").alias("base_failed"),
                      F.col(PREFIX + "far").alias("distance"), F.col(PREFIX + "kept").alias("kept"))


def kept_rows(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.

    Rows and statistics are written once; the estimates read the vectors alone, the verdicts filter the same rows.
    """
    columns = {c: f"{PREFIX}c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])
    rows = stored(with_statistics(named, columns[text], columns[lang], columns[source], *columns.values()), "quality-rows")
    out = judged(rows, fit(rows)).where(F.col(PREFIX + "kept"))
    return out.select(*[F.col(n).alias(c) for c, n in columns.items()])
