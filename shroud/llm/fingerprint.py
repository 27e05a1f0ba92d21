"""Document fingerprints by content-defined chunking.

A gear hash (32 bits, so a window of 32 bytes) runs over the UTF-8 bytes of a text. A chunk ends where the
hash's top bits are zero: ``HARD`` bits up to the normal size of ``NORMAL`` bytes, ``EASY`` bits after it,
not before ``LEAST`` and at ``MOST`` at the latest, which keeps the chunks near the normal size. Boundaries
depend on the bytes around them alone, so an insertion moves the chunks near it and no others. The fingerprint is the set of
the chunks' digests (64 bits) with their lengths, in ascending order: ``digest:length,...``. The likeness of
a fingerprint to another is the share of its chunks' length that the other holds too (containment).

``compare`` holds each text against an edited one (its second half replaced by the beginning of the
next text) and against the next text, in ascending order of ids. Rows are dealt into blocks of
neighbouring ids by explicit bounds (approximate quantiles of the ids; of the ties of an id that fills more than a block, and
a draw among equal rows that do); each block also gets a
copy of the next block's first row, so one shuffle brings each text to its neighbour, and a task, one for each block,
streams through its sorted rows.

Edge cases: a null text is an empty one; an empty text has an empty fingerprint, which contains and is
contained in nothing but an empty one (likeness 1 of two empty ones, else 0); rows are ordered by id (null first; the least long has null's place), then by
the digest of the text, so repeated rows are neighbours; one row is its own next; an empty table gives an
empty result; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole

LEAST, NORMAL, MOST = 32, 96, 384
HARD, EASY = 8, 5
BLOCK_ROWS = 4096
MAX_BLOCKS = 100_000

#: One pseudo-random number for each byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' numbers, each shifted by its distance."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = h[:-k] << np.uint32(k)
        h[k:] = h[k:] + shifted
    return h


def chunks(raw: bytes) -> list[bytes]:
    """The chunks of a text's bytes."""
    n = len(raw)
    if not n:
        return []
    h = gear(np.frombuffer(raw, np.uint8))
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY))) + 1  # a chunk may end after these bytes
    hard = easy[h[easy - 1] < np.uint32(1 << (32 - HARD))].tolist()
    easy = easy.tolist()
    out, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        while i < len(hard) and hard[i] < start + LEAST:
            i += 1
        end = hard[i] if i < len(hard) and hard[i] <= start + NORMAL else 0
        if not end:
            while j < len(easy) and easy[j] <= start + NORMAL:
                j += 1
            end = min(easy[j] if j < len(easy) else n, start + MOST, n)
        out.append(raw[start:end])
        start = end
    if start < n:
        out.append(raw[start:])
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Digest -> length of a text's chunks."""
    return {xxhash.xxh3_64_intdigest(c): len(c) for c in chunks(text.encode("utf-8", "surrogatepass"))}


def written(fp: dict[int, int]) -> str:
    return ",".join(f"{d:016x}:{fp[d]}" for d in sorted(fp))


def parsed(text: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in text.split(","))} if text else {}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of ``a``'s length in chunks that ``b`` holds."""
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else float(not b)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: written(fingerprint(t)))
    return docs.select(F.col(f"`{key}`").alias(key), of(whole(F.col(f"`{text}`"))).alias("fingerprint"))


NONE = -(1 << 63)  # stands for a null id where blocks are cut


class Bounds:
    """Cuts between blocks in the order of (id, tie, draw): a row's block is the number of cuts before it.

    An id that fills more than a block is cut by its ties, and a tie that does (one text, repeated) by a draw: its rows are equal, so any split
    of them will do.
    """

    def __init__(self, cuts: list[tuple[int, int, int]]):
        self.k, self.tie, self.draw = (np.array([c[i] for c in sorted(cuts)], np.int64) for i in range(3))

    def block(self, k: np.ndarray, tie: np.ndarray, draw: np.ndarray) -> np.ndarray:
        out, end = np.searchsorted(self.k, k, "left"), np.searchsorted(self.k, k, "right")
        for i in np.unique(out[end > out]).tolist():  # ids that hold a cut
            rows = np.flatnonzero((out == i) & (end > out))
            stop = int(end[rows[0]])
            own, ties = self.tie[i:stop], tie[rows]
            first, last = np.searchsorted(own, ties, "left"), np.searchsorted(own, ties, "right")
            at = first.copy()
            for f in np.unique(first[last > first]).tolist():
                same = np.flatnonzero((first == f) & (last > first))
                at[same] = f + np.searchsorted(self.draw[i:stop][f:int(last[same[0]])], draw[rows[same]], "left")
            out[rows] = i + at
        return out.astype(np.int32)


_LAST = (1 << 63) - 1


def _quantiles(rows: DataFrame, column: str, n: int) -> list[int]:
    """n - 1 approximate quantiles of a column, repeated where one value holds several."""
    shares = [i / n for i in range(1, n)]
    return (rows.agg(F.percentile_approx(column, shares, max(10_000, 10 * n))).first()[0] or []) if n > 1 else []


def _bounds(rows: DataFrame) -> Bounds:
    """Cuts between blocks of about ``BLOCK_ROWS`` rows, ``MAX_BLOCKS`` blocks at most (beyond, blocks grow). ``rows`` has k and tie."""
    blocks = min(MAX_BLOCKS, math.ceil(rows.count() / BLOCK_ROWS))
    cuts = []
    for near, n in Counter(_quantiles(rows, "k", blocks)).items():
        if n == 1:
            cuts.append((near, _LAST, _LAST))  # rows of the id itself come before the cut
            continue
        # quantiles are taken as doubles, so the id that holds several is looked up among those of the same double
        k = rows.where(F.col("k").cast("double") == float(near)).groupBy("k").count().orderBy(F.desc("count"), "k").first()["k"]
        own = rows.where(F.col("k") == k).withColumn("part", F.shiftright("tie", 11))  # exact as a double
        cuts.append((k, _LAST, _LAST))
        for part, m in Counter(_quantiles(own, "part", n)).items():
            least, most = own.where(F.col("part") == part).agg(F.min("tie"), F.max("tie")).first() if m > 1 else (0, 1)
            if least == most:  # one text, repeated
                cuts += [(k, least, _LAST), *((k, least, -(1 << 63) + ((i << 64) // m)) for i in range(1, m))]
            else:
                cuts.append((k, (part << 11) + 2047, _LAST))
    return Bounds(cuts)


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    small_batches(docs.sparkSession)
    t = whole(F.col(f"`{text}`"))
    own = F.col(f"`{key}`").cast("long")  # without nulls, which pandas would turn into floats
    rows = docs.select(own.isNotNull().alias("known"), F.coalesce(own, F.lit(NONE)).alias("k"), F.xxhash64(t).alias("tie"), t.alias("text"))
    bounds = _bounds(rows.select("k", "tie"))

    @F.pandas_udf("int")
    def block_of(k: pd.Series, tie: pd.Series, draw: pd.Series) -> pd.Series:
        return pd.Series(bounds.block(*(x.to_numpy(np.int64) for x in (k, tie, draw))))

    rows = rows.withColumn("block", block_of("k", "tie", F.xxhash64(F.monotonically_increasing_id())))
    # the first row of each block, by id and tie alone: at most one for each block
    heads = rows.groupBy("block").agg(F.min(F.struct("known", "k", "tie")).alias("h")).orderBy("block").collect()
    to = {h.block: heads[i - 1].block for i, h in enumerate(heads)}  # the first block's head goes to the last block
    head = {(h.block, *h.h) for h in heads}

    @F.pandas_udf("array<int>")
    def goes_to(block: pd.Series, known: pd.Series, k: pd.Series, tie: pd.Series) -> pd.Series:
        every = zip(block.tolist(), known.tolist(), k.tolist(), tie.tolist())
        return pd.Series([[x[0], to[x[0]]] if x in head else [x[0]] for x in every], dtype=object)

    dealt = rows.withColumn("to", goes_to("block", "known", "k", "tie"))
    dealt = dealt.select("known", "k", "tie", "text", F.posexplode("to").alias("extra", "to"))
    number = {h.block: i for i, h in enumerate(heads)}  # blocks without rows get no task

    @F.pandas_udf("int")
    def task_of(block: pd.Series) -> pd.Series:
        return block.map(number).astype(np.int32)

    dealt = dealt.repartitionById(max(1, len(heads)), task_of("to")).sortWithinPartitions("to", "extra", "known", "k", "tie")

    def each(batches):
        last = None  # (block, key, text, fingerprint) of the row that waits for its next one
        closed = None  # the block whose extra row has come; further extras are copies of it
        for batch in batches:
            out = []
            for known, k, text_, extra, block in zip(batch["known"], batch["k"], batch["text"], batch["extra"], batch["to"]):
                if extra and closed == block:
                    continue
                mine = fingerprint(text_)
                if last is not None and last[0] == block:
                    own = last[2]
                    new = edited(own, text_)
                    changed = fingerprint(new)
                    out.append((last[1], len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(last[3]),
                                written(changed), likeness(last[3], changed), likeness(last[3], mine)))
                last = None if extra else (block, int(k) if known else None, text_, mine)
                closed = block if extra else None
            out = pd.DataFrame(out, columns=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], dtype=object)
            out["k"] = pd.array(out["k"].tolist(), "Int64")
            yield out.astype({"n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    out = dealt.mapInPandas(each, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.col("k").alias(key), *out.columns[1:])
