"""Whitening against numpy's dense solvers."""

import math

import numpy as np
import pytest

from shroud.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string"


def triangle(a):
    r = np.linalg.qr(a, mode="r")
    return np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])


def cases():
    rng = np.random.default_rng(3)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    yield "random", triangle(rng.standard_normal((400, 48)))
    yield "graded", triangle(rng.standard_normal((400, 40)) * 10.0 ** -np.arange(40))
    yield "rank 5", triangle(rng.standard_normal((400, 5)) @ rng.standard_normal((5, 32)))
    yield "few rows", triangle(rng.standard_normal((7, 24)))
    yield "all equal", 3 * turn(32)
    yield "pairs", triangle(turn(32) @ np.diag(np.repeat(np.arange(1.0, 17), 2)) @ turn(32))
    yield "clusters", triangle(turn(48) @ np.diag(1 + np.repeat([0, 1e-12, 1e-7], 16) * rng.random(48)) @ turn(48))
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 20.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield "Wilkinson", np.linalg.cholesky(wilkinson).T
    yield "diagonal", np.diag([1.0, 0, 2, 0])
    yield "zero", np.zeros((4, 4))
    yield "one", np.array([[-2.0]])
    yield "small", 1e-140 * triangle(rng.standard_normal((50, 8)))


@pytest.mark.parametrize("name,r", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_solver(name, r):
    values, v = bidiagonal.singular(r)
    want = np.linalg.svd(r, compute_uv=False)
    scale = max(want[0], 1e-300)
    assert np.abs(np.sqrt(values) - want).max() <= 1e-13 * scale
    assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-10
    assert np.abs(np.linalg.norm(r / scale @ v, axis=0) - want / scale).max() < 1e-13
    if scale > 1e-100:
        gap = (r / scale).T @ (r / scale @ v) - v * (values / scale ** 2)
        assert np.abs(gap).max() < 1e-12


def test_graded_values_keep_their_digits():
    """dqds finds small singular values of a bidiagonal matrix to many digits, where forming B^T B would lose them."""
    diagonal, beside = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    got = np.sqrt(bidiagonal.dqds(diagonal ** 2, beside ** 2))
    product = math.prod(got.tolist())
    assert abs(product / math.prod(diagonal.tolist()) - 1) < 1e-12  # the determinant
    assert abs(got[-1] / np.linalg.svd(np.diag(diagonal) + np.diag(beside, 1), compute_uv=False)[0] - 1) < 1e-14


def table():
    rng = np.random.default_rng(11)
    mix = rng.standard_normal((12, 12)) * (0.9 ** np.arange(12))
    vecs = [(rng.standard_normal(12) @ mix * 0.1).astype(np.float32).tolist() for _ in range(300)]
    rows = [(i, v, 1, 9, "x") for i, v in enumerate(vecs)]
    rows += [rows[3], rows[3], (None, vecs[4], None, None, None), (None, None, None, None, None), (400, None, 1, 1, "x"), (401, [], 1, 1, "x"),
             (402, [0.5] * 11 + [None], 1, 1, "x"), (403, [0.5] * 11 + [float("nan")], 1, 1, "x"), (404, [float("inf")] * 12, 1, 1, "x"),
             (405, [1.0] * 5, 1, 1, "x")]
    return rows


def brute(rows, components=8):
    good = [(k, v) for k, v, *_ in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all()]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [k for k, _ in good], n, deviation, centred @ v[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()


def test_whitened(spark):
    rows = table()
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    keys, n, deviation, white, explained = brute(rows)
    assert len(got) == 8 * len(keys) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    order = {}
    for r in got:
        order.setdefault((-1 if r.vec_id is None else r.vec_id, r.component), []).append(r)
    sign = np.ones(8)
    for k, d, w in zip(keys, deviation, white):
        here = [order[(-1 if k is None else k, c)][0] for c in range(1, 9)]
        if k == 0:
            sign = np.sign([r.whitened for r in here]) * np.sign(w)
        assert all(r.deviation == d for r in here)
        np.testing.assert_allclose([r.whitened for r in here] * sign, w, rtol=0, atol=1e-8)
        np.testing.assert_allclose([r.explained for r in here], explained, rtol=1e-9)
    assert 0 < got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1
    counts = [len(order[(3, c)]) for c in range(1, 9)]
    assert counts == [3] * 8  # repeated rows


@pytest.mark.parametrize("vecs,lines", [([], 0), ([None, []], 0), ([[1.0, 2.0, 3.0]], 3), ([[1.0, 2.0, 3.0]] * 4, 12), ([[1.0] * 9, [2.0] * 9], 16)])
def test_without_variance(spark, vecs, lines):
    got = whitening.whitened(spark.createDataFrame([(1, v, 0, 0, "") for v in vecs], SCHEMA)).collect()
    assert len(got) == lines
    assert all(math.isfinite(r.whitened) and math.isfinite(r.explained) and math.isfinite(r.identity_error) for r in got)
    if lines == 16:  # one direction has all variance
        assert {round(r.whitened, 9) for r in got if r.component == 1} in ({-1.0, 1.0}, ) and got[0].explained == pytest.approx(1)
        assert {r.whitened for r in got if r.component > 1} == {0.0} and got[0].identity_error < 1e-9


def test_whole_table(spark):
    from shroud.llm.queries import all_queries
    got = all_queries()["op11_qd_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    raw = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert len(got) == 8 * len(raw) and got["identity_error"].max() < 1e-10
    x = np.floor(1024 * np.array([r.embedding for r in raw], np.float64)) + 100_000
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    first = got[got["vec_id"] == raw[0].vec_id].sort_values("component")
    np.testing.assert_allclose(first["explained"], e[:8] / e.sum(), rtol=1e-9)
    np.testing.assert_allclose(np.abs(first["whitened"]), np.abs((x[0] - x.mean(axis=0)) @ np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :8]) / np.sqrt(e[:8]), atol=1e-7)
