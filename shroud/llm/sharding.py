"""A uniform shuffle into shards of exact sizes, by a communication matrix.

The rows are written once to the shared folder with their partition and their place in it, so both stay what they are
when a task runs again. Runs of ``RUN`` places of a partition are the sources. The matrix says how many rows of each source go to
each shard; a uniform shuffle's matrix is a multivariate hypergeometric draw whose margins are the sources' and the shards' sizes. It is
drawn in two steps: the driver draws for blocks of sources (one row for each ``BLOCK`` sources), and each block
draws for its own sources in a task. Then

1. each source is permuted locally; ranks below the first shard's count go to shard 0, the next to shard 1, and so on;
2. the rows are exchanged, in cells of about ``CELL_BYTES`` of text, several for each shard;
3. each shard is permuted again: a row's slot is a keyed permutation of its place in the shard (the rows that earlier sources
   send there, and its rank among its own source's), so neighbours from one source end anywhere in the shard.

Shards differ by at most one row (law ``rows``). The permutation of a shard is a Feistel network of ``ROUNDS`` rounds on the next power
of four, walked on until a slot below the size is found: a bijection that each row computes for itself, so no task
holds a shard. Every draw is seeded by ``seed`` and the place it belongs to: a task that runs again gives the same rows.

Sizes of cells: rows are dealt to cells by slot, which is random, so a group of copies, a source or a key that holds a third of
the rows spreads over all of them.

Edge cases: a null text has no bytes and the checksum of an empty one; null ids, repeated rows and equal texts are rows like others (each has its
own slot); with fewer rows than shards some shards are empty; an empty table gives an empty result; columns of the input are kept by
``shuffled``, whatever their names, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, small_batches, stored

SHARDS = 24
SEED = 20240
RUN = 1 << 16
BLOCK = 1024
CELL_BYTES = 32 << 20
ROUNDS = 8
LAW = "rows"
_PART, _RUN, _AT = "__part", "__run", "__at"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- draws ------------------------------------------------------------------------------
def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` balls drawn from ``good + bad`` are good, for sizes of any order.

    The probabilities around the mode follow from its neighbours' by ratios; beyond twelve standard deviations they
    are below the precision of a double.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    all_ = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (all_ + 2)))
    spread = math.sqrt(n * (good / all_) * (bad / all_) * ((all_ - n) / max(1, all_ - 1)))
    reach = int(12 * spread) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))  # log p(k + 1) - log p(k)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], "right").clip(0, high - low))


def row_of_matrix(rng: np.random.Generator, left: list[int], n: int) -> list[int]:
    """How many of ``n`` rows go to each shard, where ``left`` places of each are free (multivariate hypergeometric)."""
    out, rest = [], sum(left)
    for free in left:
        rest -= free
        x = hypergeometric(rng, free, rest, n)
        out.append(x)
        n -= x
    return out


def matrix(rng: np.random.Generator, sizes: list[int], shards: list[int]) -> list[list[int]]:
    """Row sums ``sizes``, column sums ``shards`` (of the same total), as a uniform shuffle of the rows would give."""
    left, out = list(shards), []
    for n in sizes:
        out.append(row_of_matrix(rng, left, n))
        left = [a - b for a, b in zip(left, out[-1])]
    return out


def even(rows: int, shards: int) -> list[int]:
    """Sizes of the shards: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(place: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, element by element: equal keys and sizes give one bijection."""
    place, size, key = (np.asarray(x).astype(np.uint64) for x in (place, size, key))
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2)).astype(np.uint64)  # of each half
    bits = np.where(np.uint64(1) << (bits + bits) < size, bits + np.uint64(1), bits)
    half = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = place.copy(), np.arange(len(place))
    while len(todo):
        b, h, k = bits[todo], half[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & h
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right + _mix(k + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF))) & h)
        out[todo] = left << b | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


# --- Spark ------------------------------------------------------------------------------
def _sources(rows: DataFrame) -> DataFrame:
    """part, run, n, bytes of every source of a placed table."""
    return rows.groupBy(_PART, _RUN).agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("bytes"))


def communication(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, run, n, counts (rows to each shard) and before (rows that earlier sources send to each shard); stored.

    ``sources`` (part, run, n) is stored; the driver sees sums of ``BLOCK`` sources only.
    """
    spark = sources.sparkSession
    block = F.floor((F.col(_PART) * 131 + F.col(_RUN)) / BLOCK).cast("long")  # any split of the sources will do
    blocked = sources.withColumn("block", block)
    sums = blocked.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()
    total = even(sum(b["n"] for b in sums), shards)
    drawn = matrix(np.random.default_rng([seed, 0]), [b["n"] for b in sums], total)
    before, start = [], [0] * shards
    for counts in drawn:
        before.append(start)
        start = [a + b for a, b in zip(start, counts)]
    vectors = spark.createDataFrame([(b["block"], c, s) for b, c, s in zip(sums, drawn, before)], "block long, counts array<long>, before array<long>")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([_PART, _RUN])
        rng = np.random.default_rng([seed, 1, int(group["block"].iloc[0])])
        counts = matrix(rng, group["n"].tolist(), [int(x) for x in group["counts"].iloc[0]])
        start = np.cumsum([group["before"].iloc[0], *counts], axis=0)[:-1]
        return pd.DataFrame({_PART: group[_PART], _RUN: group[_RUN], "n": group["n"], "counts": counts, "before": start.tolist()})

    joined = blocked.join(F.broadcast(vectors), "block")
    return stored(joined.groupBy("block").applyInPandas(draw, f"{_PART} long, {_RUN} long, n long, counts array<long>, before array<long>"), "shard-matrix")


def shuffled(docs: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with shard and slot (long, gapless from 0 in each shard), exchanged into cells of the shards and sorted by slot."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    place = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)  # the id holds the partition above 33 bits of the place in it
    rows = docs.select(*kept, size.alias("__bytes"), place.alias("__id"))
    rows = rows.select("*", F.shiftright("__id", 33).alias(_PART), F.floor(F.col("__id").bitwiseAND(low) / RUN).alias(_RUN),
                       F.col("__id").bitwiseAND(low).alias(_AT)).drop("__id")
    rows = stored(rows, "shard-rows")
    sources = stored(_sources(rows), "shard-sources")
    whole = sources.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("k")).first()
    sizes = np.array(even(whole["n"] or 0, shards), np.int64)
    sent = communication(sources, shards, seed)
    cells = max(1, math.ceil((whole["bytes"] or 0) / shards / CELL_BYTES))  # of each shard
    cell_rows = max(1, math.ceil((whole["n"] or 0) / shards / cells))

    @F.pandas_udf("shard int, slot long")
    def deal(part: pd.Series, run: pd.Series, at: pd.Series, n: pd.Series, counts: pd.Series, before: pd.Series) -> pd.DataFrame:
        part, run, n = (x.to_numpy(np.int64) for x in (part, run, n))
        name = part.astype(np.uint64) << np.uint64(20) ^ run.astype(np.uint64)
        rank = permuted(at.to_numpy(np.int64) % RUN, n, _mix(name + np.uint64(seed)))
        upto = np.cumsum(np.stack(counts.to_numpy()), axis=1)
        shard = (rank[:, None] >= upto).sum(axis=1)
        row = np.arange(len(rank))
        first = np.where(shard > 0, upto[row, np.maximum(shard - 1, 0)], 0)
        place = np.stack(before.to_numpy())[row, shard] + rank - first
        slot = permuted(place, sizes[shard], _mix((shard + 1).astype(np.uint64) + np.uint64(seed << 8)))
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    small = (whole["k"] or 0) * (16 * shards + 64) <= BROADCAST_BYTES  # beyond: a plain join of the rows with their source's line
    dealt = rows.join(F.broadcast(sent) if small else sent, [_PART, _RUN])
    dealt = dealt.withColumn("__to", deal(_PART, _RUN, _AT, "n", "counts", "before"))
    out = dealt.select(*[f"c{i}" for i in range(len(columns))], F.col("__to.shard").alias("shard"), F.col("__to.slot").alias("slot"))
    cell = (F.col("shard") * cells + F.least(F.floor(F.col("slot") / cell_rows), F.lit(cells - 1))).cast("int")
    out = out.withColumn("__cell", cell).repartitionById(shards * cells, "__cell").sortWithinPartitions("shard", "slot")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "shard", "slot")


def write_shards(docs: DataFrame, folder: str, text: str = "text", shards: int = SHARDS, seed: int = SEED) -> None:
    """Write ``folder/shard=N/`` with the rows of each shard in order of their slots within each file."""
    shuffled(docs, text, shards, seed).write.partitionBy("shard").parquet(folder)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``) of every row, from the exchanged rows."""
    rows = shuffled(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), "t", shards, seed)
    return rows.select(F.col("k").alias(key), (F.coalesce(F.octet_length("t"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce("t", F.lit("")).cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
