"""The shuffle into shards: exact sizes, permutations, uniformity, retries."""

import zlib
from collections import Counter

import numpy as np
import pytest

from shroud.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot int, n long, c0 string, __part int"


def rows(n=500):
    out = [(i if i % 7 else None, None if i % 11 == 0 else "" if i % 13 == 0 else "same text" if i % 3 else f"text {i} é", "s", 1, i, "c", 2) for i in range(n)]
    return out + [out[1]] * 5


def check(got, n, shards):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("n,parts,shards", [(505, 7, 24), (505, 1, 24), (5, 3, 24), (505, 40, 3), (1, 1, 2)])
def test_report(spark, n, parts, shards):
    table = rows(500)[:n] if n <= 500 else rows(500)
    got = sharding.report(spark.createDataFrame(table, SCHEMA).repartition(parts), shards=shards).collect()
    check(got, len(table), shards)
    order = lambda x: sorted(x, key=lambda r: tuple((v is None, v) for v in r))
    assert order((r.doc_id, r.size, r.text_crc32) for r in got) == order(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in table)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_rows_stay_whole(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = sharding.shuffled(docs, shards=4)
    assert got.columns == ["doc_id", "text", "n", "c0", "__part", "shard", "slot"]
    assert sorted((r.n, r.text or "", r.c0) for r in got.collect()) == sorted((r[4], r[1] or "", r[5]) for r in rows())


def test_small_sources_and_blocks(spark, monkeypatch):
    """Many sources in many blocks of the matrix, several cells for each shard."""
    for name, value in (("RUN", 8), ("BLOCK", 3), ("CELL_BYTES", 200)):
        monkeypatch.setattr(sharding, name, value)
    check(sharding.report(spark.createDataFrame(rows(900), SCHEMA).repartition(9), shards=5).collect(), 905, 5)


def test_joined_matrix(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_BYTES", 0)
    check(sharding.report(spark.createDataFrame(rows(300), SCHEMA).repartition(4)).collect(), 305, 24)


def test_empty(spark):
    assert sharding.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_evaluated_twice_is_the_same(spark):
    """The result's tasks can run again: a second evaluation gives every row the same shard and slot."""
    out = sharding.report(spark.createDataFrame(rows(), SCHEMA).repartition(6))
    assert sorted(map(str, out.collect())) == sorted(map(str, out.repartition(3).collect()))


def test_files(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).drop("shard", "slot")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    check(back.select("shard", "slot").collect(), 505, 6)
    assert sorted(r.n for r in back.collect()) == sorted(r[4] for r in rows())


def test_hypergeometric_law():
    """Draws against the exact law, for small and for large numbers."""
    from math import comb, sqrt
    rng = np.random.default_rng(2)
    for good, bad, n in ((7, 5, 6), (3, 40, 10), (1, 1, 1), (30, 2, 20)):
        got = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(20_000))
        for k in range(n + 1):
            p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n) if k <= good and n - k <= bad else 0
            assert abs(got[k] / 20_000 - p) < 5 * sqrt(p * (1 - p) / 20_000) + 1e-9
    good, bad, n = 2_000_000_000, 48_000_000_000, 60_000_000
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(2_000)], float)
    sd = sqrt(n * 0.04 * 0.96 * (1 - n / (good + bad)))
    assert abs(x.mean() - n * 0.04) < 5 * sd / sqrt(2_000) and abs(x.std() / sd - 1) < 0.1


def test_matrix_margins():
    rng = np.random.default_rng(4)
    sizes = [0, 5, 100, 1, 30]
    m = sharding.matrix(rng, sizes, sharding.even(sum(sizes), 7))
    assert [sum(r) for r in m] == sizes and [sum(c) for c in zip(*m)] == sharding.even(sum(sizes), 7)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation(size):
    at = np.arange(size)
    for key in (0, 1, 1 << 63):
        got = sharding.permuted(at, np.full(size, size), np.full(size, key, np.uint64))
        assert sorted(got.tolist()) == at.tolist()


def test_places_are_uniform():
    """Over many keys each element reaches each place as often as any other, and neighbours part."""
    size, keys = 12, 24_000
    place = np.tile(np.arange(size), keys)
    got = sharding.permuted(place, np.full(size * keys, size), np.repeat(np.arange(keys, dtype=np.uint64) * np.uint64(7919), size)).reshape(keys, size)
    want = keys / size
    counts = np.array([np.bincount(got[:, i], minlength=size) for i in range(size)])
    assert ((counts - want) ** 2 / want).sum() < 121 + 6 * np.sqrt(2 * 121)
    follows = np.bincount((got[:, 1] - got[:, 0]) % size, minlength=size)[1:]
    assert ((follows - keys / 11) ** 2 / (keys / 11)).sum() < 10 + 6 * np.sqrt(20)


def test_shards_are_uniform(spark):
    """Over many seeds a row reaches every shard alike."""
    docs = spark.createDataFrame([(i, "x") for i in range(8)], "doc_id long, text string").repartition(2)
    seen = Counter()
    for seed in range(24):
        for r in sharding.report(docs, shards=4, seed=seed).select("doc_id", "shard").collect():
            seen[r.shard, r.doc_id] += 1
    assert len(seen) >= 30 and max(seen.values()) <= 16
