"""Near duplicates by DartMinHash signatures and a banded join.

*Signature.* The elements of a document are its five-word shingles, weighted ``1 + log2(count) / 8``. Each
element has a region as wide as its weight, on which hashed darts land in order of rank, as
a Poisson process: the next dart of a unit of width comes ``-ln(u)`` after the last, ``u`` being a hash of element, unit and
number. A dart beside the region (its hashed place is beyond the weight) does not count. Each dart falls on
one of ``COORDINATES`` coordinates, and the signature holds the earliest dart of each. Only darts below a rank of about
``k (ln k + 2) / total weight`` are thrown, so a long document costs little more than one dart test for
each element; where a coordinate stays empty, the rank limit is doubled. Two documents share
a coordinate with the probability of their weighted Jaccard similarity.
Links are tested by the plain similarity of the sets, so a text with repeated shingles has the bands of a second signature
too, with unit weights (that of a text without repeats is the same for both weights).

*Join.* Equal texts are one node, known by their digest. Nodes meet in the buckets of ``BANDS`` bands of ``ROWS``
coordinates (a pair of similarity 0.8 misses all of them once in 1,500 times). In each bucket all members are compared with one, the member that
meets most others in all its buckets. Links are pairs whose sets of shingles have a Jaccard
similarity of ``THRESHOLD`` or more, computed exactly. Classes are the connected components of the links. Then the members of different classes
that still share a bucket are compared with each other: all of them in buckets of up to ``SMALL`` members, and in larger
buckets all that an exact prefix filter on the sets of shingles leaves (``_by_prefix``), which drops no pair of similarity
``THRESHOLD``. So no link between two members of a bucket is missed, and the pairs stay far below the square of a group's members where most of them
differ by more than the threshold.

Edge cases: texts without words (also null) are linked to nothing and get classes of their own; texts
of one to four words are one shingle; repeated rows share a class; a class is known by its smallest
id, which is null if none of its rows has an id; rows with the same id and different texts are different nodes; an empty
table gives an empty result; other input columns are not read by ``classes`` and are kept by ``one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, small_batches, stored, whole

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
COORDINATES = BANDS * ROWS
SMALL = 32
PREFIX = "__nd_"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53


def shingles(text: str) -> np.ndarray:
    """Hashes of the five-word windows of a text, in order; one for a shorter text, none without words."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return _mix(np.array([np.sum(h * _ODD[:len(h)]) + np.uint64(len(h))], np.uint64))
    n = len(h) - SHINGLE + 1
    out = h[:n] * _ODD[0]
    for j in range(1, SHINGLE):
        out += h[j:j + n] * _ODD[j]
    return _mix(out)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, for distinct elements with positive weights."""
    layers = np.ceil(weights).astype(np.int64)
    unit = np.repeat(elements, layers)
    layer = np.arange(len(unit)) - np.repeat(np.cumsum(layers) - layers, layers)
    room = np.repeat(weights, layers) - layer  # the part of the unit that is inside the region
    seed = _mix(unit ^ (layer.astype(np.uint64) * _ODD[2]))
    limit = k * (math.log(k) + 2) / float(weights.sum())
    while True:
        dart = _mix(seed + _ODD[0])
        rank = -np.log(_unit(dart))
        now = np.flatnonzero(rank < limit)
        number, last = 1, rank[now]
        darts, ranks, rooms = [dart[now]], [last], [room[now]]
        while len(now):  # the next few darts of the units whose last one was below the limit
            few = int(limit + 2 * math.sqrt(limit)) + 2
            dart = _mix(seed[now, None] + np.arange(number + 1, number + few + 1, dtype=np.uint64) * _ODD[0])
            rank = last[:, None] - np.cumsum(np.log(_unit(dart)), 1)
            below = rank < limit
            darts.append(dart[below])
            ranks.append(rank[below])
            rooms.append(np.repeat(room[now], below.sum(1)))
            more = below[:, -1]
            now, last, number = now[more], rank[more, -1], number + few
        dart, rank = np.concatenate(darts), np.concatenate(ranks)
        inside = _unit(_mix(dart ^ _ODD[3])) <= np.concatenate(rooms)
        dart, rank = dart[inside], rank[inside]
        latest_first = np.argsort(-rank, kind="stable")
        dart = dart[latest_first]
        at = (_mix(dart ^ _ODD[4]) % np.uint64(k)).astype(np.int64)
        first, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        first[at], hit[at] = dart, True  # of several darts the last one, which is the earliest, remains
        if hit.all():
            return first
        limit *= 2


def _bands(s: np.ndarray) -> np.ndarray:
    s, out = s.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = _mix(out * _ODD[0] + s[:, j])
    return out


def buckets(text: str) -> np.ndarray | None:
    """Hashes of the bands of a text's signature, and of the one with unit weights where a shingle is repeated."""
    every = shingles(text)
    if not len(every):
        return None
    element, count = np.unique(every, return_counts=True)
    out = _bands(signature(element, 1 + np.log2(count) / 8))
    if len(element) < len(every):
        out = np.unique(np.concatenate([out, _bands(signature(element, np.ones(len(element))))]))
    return out.view(np.int64)


def bucket_hashes(text: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([buckets(t) for t in texts], dtype=object)
    return of(text)


def shingle_set(text: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(t)).view(np.int64) for t in texts], dtype=object)
    return of(text)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(whole(text)))


# --- links ------------------------------------------------------------------------------
def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests whose sets of shingles are similar enough."""
    a = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(
        both >= THRESHOLD * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links lead to. Labels spread over links and are then followed, until none changes."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "near-labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        near = edges.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        new = labels.join(near, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stored(new.join(ahead, "label").select("node", F.least("label", "far").alias("label"), "old"), "near-labels")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _star(entries: DataFrame) -> DataFrame:
    """Pairs of each bucket's members with the one that meets most others, as far as their classes differ.

    ``entries``: bucket, digest, label (the digest itself at first), n.
    """
    met = entries.groupBy("digest").agg(F.sum("n").alias("met"))
    seen = entries.join(met, "digest")
    hub = seen.groupBy("bucket").agg(F.max(F.struct("met", "digest", "label")).alias("hub"))
    hub = hub.select("bucket", F.col("hub.digest").alias("hub"), F.col("hub.label").alias("in"))
    return seen.select("bucket", "digest", "label").join(hub, "bucket").where(F.col("in") != F.col("label")).select(
        F.least("hub", "digest").alias("a"), F.greatest("hub", "digest").alias("b")).distinct()


def _mixed(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, digest, label, n (members) of the buckets with members of several classes."""
    own = entries.select("bucket", "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    own = own.withColumn("label", F.coalesce("label", "digest"))
    several = own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"))
    return own.join(several.where("x != y").select("bucket", "n"), "bucket")


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs of members of a small bucket that are in different classes."""
    few = mixed.where(F.col("n") <= SMALL)
    a = few.select("bucket", F.col("digest").alias("a"), F.col("label").alias("la"))
    b = few.select("bucket", F.col("digest").alias("b"), F.col("label").alias("lb"))
    return a.join(b, "bucket").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).select("a", "b")


def _by_prefix(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of members of large buckets that are in different classes and may be similar enough.

    An exact prefix filter. Shingles have one order, the rarest among the members first. With at least ``least`` common
    shingles, two sets have one in common among the first ``size - least + 1`` of each; ``least`` is THRESHOLD * size for the
    larger set, and 2 * THRESHOLD / (1 + THRESHOLD) * size for the smaller. At the first common one enough others must follow in both.
    """
    members = mixed.where(F.col("n") > SMALL).select("digest", "label").distinct()
    own = sets.join(members, "digest").select("digest", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    own = stored(own, "near-shingles")
    shared = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("x"), F.max("label").alias("y"))
    shared = shared.where("held > 1").select("shingle", "held", (F.col("x") != F.col("y")).alias("mixed"))
    ranked = own.join(shared, "shingle").groupBy("digest", "label", "size").agg(
        F.sort_array(F.collect_list(F.struct("held", "shingle", "mixed"))).alias("ranked"))
    unique = F.col("size") - F.size("ranked")  # shingles of one member alone come first and meet nothing
    first = lambda share: F.col("size") - F.ceil(share * F.col("size") - 1e-6) + 1
    ranked = ranked.withColumns({"unique": unique, "probed": first(THRESHOLD), "indexed": first(2 * THRESHOLD / (1 + THRESHOLD))})
    ranked = ranked.where("probed > unique").withColumn("ranked", F.expr("slice(ranked, 1, cast(probed - unique as int))"))
    at = ranked.select("digest", "label", "size", "unique", "indexed", F.posexplode("ranked").alias("i", "s")).where("s.mixed")
    at = at.select(F.col("s.shingle").alias("shingle"), "digest", "label", "size", "indexed", (F.col("unique") + F.col("i")).alias("place"))
    at = stored(at, "near-prefixes")
    short = at.where("place < indexed").select("shingle", *[F.col(c).alias(c + "_s") for c in ("digest", "label", "size", "place")])
    after = F.least(F.col("size") - F.col("place"), F.col("size_s") - F.col("place_s"))  # with the shingle itself
    pairs = at.join(short, "shingle").where(
        (F.col("label") != F.col("label_s")) & (F.struct("size_s", "digest_s") < F.struct("size", "digest"))
        & (F.col("size_s") >= THRESHOLD * F.col("size") - 1e-6)
        & (after >= THRESHOLD / (1 + THRESHOLD) * (F.col("size") + F.col("size_s")) - 1e-6))
    return pairs.select(F.least("digest", "digest_s").alias("a"), F.greatest("digest", "digest_s").alias("b"))


def _linked(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """node, label: the classes among the members of the buckets."""
    tested = stored(_star(entries.withColumn("label", F.col("digest"))), "near-pairs")
    links = stored(_verified(tested, sets), "near-links")
    labels = components(links)
    mixed = stored(_mixed(entries, labels), "near-mixed")
    pairs = _across(mixed).union(_by_prefix(mixed, sets))
    pairs = stored(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
    more = stored(_verified(pairs, sets), "near-links")
    return labels if more.isEmpty() else components(links.union(more))


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, digest of every row; digest, first (its smallest id), copies, class_id of every text)."""
    small_batches(docs.sparkSession)
    t = F.col(f"`{text}`")
    rows = stored(docs.select(F.col(f"`{key}`").alias("key"), digest(t).alias("digest"), bucket_hashes(whole(t)).alias("buckets")), "near-rows")
    texts = stored(rows.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"),
                                              F.first("buckets").alias("buckets")), "near-texts")
    posted = texts.select("digest", F.explode("buckets").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = stored(posted.join(shared, "bucket"), "near-entries")
    met = stored(entries.select("digest").distinct(), "near-met").withColumnRenamed("digest", "met")
    again = docs.select(digest(t).alias("digest"), whole(t).alias("text"))
    again = join_checked(again, met, F.col("digest") == F.col("met"), "left_semi")
    sets = stored(again.withColumn("shingles", shingle_set(F.col("text"))).groupBy("digest").agg(F.first("shingles").alias("shingles")), "near-sets")
    labels = _linked(entries, sets).withColumnRenamed("node", "digest")
    named = texts.select("digest", "first", "copies").join(labels, "digest", "left")
    groups = named.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    named = named.join(groups, "label", "left").select(
        "digest", "first", "copies", F.col("label"), F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("least")).alias("class_id"))
    return rows.select("key", "digest", F.col("buckets").isNotNull().alias("worded")), stored(named, "near-classes")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the smallest key of the class; the row's own for a text without words) of every row."""
    rows, named = nodes(docs, key, text)
    return rows.join(named.select("digest", "class_id"), "digest", "left").select(
        F.col("key").alias(key), F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("key")).alias("class_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; rows without words all stay.

    Rows that go are marked by id and digest; the marks are broadcast where they are small, so the
    texts are shuffled only where they are not. Of several equal rows with that id one stays.
    """
    rows, named = nodes(docs, key, text)
    stays = named.groupBy(F.coalesce("label", "digest").alias("of")).agg(F.min(F.struct("first", "digest")).alias("s"))
    stays = stays.select(F.col("s.digest").alias("digest"), F.lit(True).alias("stays"))
    same = rows.where("worded").groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"))
    same = same.join(named.select("digest", "first"), "digest").join(stays, "digest", "left")
    goes = F.col("stays").isNull() | ~F.col("key").eqNullSafe(F.col("first"))
    marks = stored(same.select(F.col("key").alias(PREFIX + "key"), F.col("digest").alias(PREFIX + "digest"), goes.alias(PREFIX + "goes"),
                               (F.col("n") > 1).alias(PREFIX + "repeated")).where(F.col(PREFIX + "goes") | F.col(PREFIX + "repeated")), "near-marks")
    own = docs.withColumn(PREFIX + "own", digest(F.col(f"`{text}`")))
    out = join_checked(own, marks, F.col(f"`{key}`").eqNullSafe(F.col(PREFIX + "key")) & (F.col(PREFIX + "own") == F.col(PREFIX + "digest")))
    out = out.where(~F.coalesce(F.col(PREFIX + "goes"), F.lit(False)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    repeated = F.coalesce(F.col(PREFIX + "repeated"), F.lit(False))
    once = out.where(repeated).dropDuplicates([PREFIX + "key", PREFIX + "digest"])
    return out.where(~repeated).select(*names).union(once.select(*names))
