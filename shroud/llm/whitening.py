"""Whitening of embeddings by a bidiagonal qd solver.

Entries become integers, ``floor(1024 * c) + 100000``, so that sums, centred rows (``n * x - S``) and their squares are exact. Each task
reduces its centred rows block by block to a triangle R (QR of the last R over the next block); triangles are stacked and reduced by
sixteens until one is left, whose R^T R is n times the covariance. That one matrix, of the size of a vector squared, is solved
(``bidiagonal.singular``): Householder bidiagonal form, dqds, twisted factorisations. The covariance itself is never formed, which
would square its condition. The directions, at most ``COMPONENTS`` of them, go back to the tasks.

No task holds more than a block of rows and R, no shuffle moves more than the triangles, and copies of a vector are rows like others.

Edge cases: rows whose vector is null or has null or non-finite entries are dropped, and so are vectors of another length than most (the
longer of two that are as frequent), which have no place in the sums; entries beyond +-2^40 count as such;
repeated rows and ids and null ids count each; ``deviation`` is null where it does not fit a long; a component without variance (one
row, equal rows, fewer rows than entries) has ``whitened`` 0 and is left out of ``identity_error``, which is 0 where no component
has any; fewer entries than components give as many components as entries; no rows left give an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import EPS, singular
from .common import ship, stored

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
MOST = float(1 << 40)
FAN = 16
MAX_ENTRIES = 4096  # of a vector: R takes 8 * MAX_ENTRIES^2 bytes


def vectors(batch: pa.RecordBatch, name: str = "vec") -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The rows of a batch by length: (rows, x as long, one line a row) for every length, without rows that are dropped."""
    column = batch.column(name)
    entries = column.flatten()  # of the rows that are not null
    length = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    length = np.where(there, length, 0)
    c = entries.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are nan
    end = np.cumsum(length)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    good = there & (length > 0) & (bad[end] == bad[end - length])
    out = []
    for size in np.unique(length[good]).tolist():
        rows = np.flatnonzero(good & (length == size))
        at = (end - length)[rows][:, None] + np.arange(size)
        out.append((rows, np.floor(SCALE * np.clip(c[at], -MOST, MOST)).astype(np.int64) + OFFSET))
    return out


def _sums(df: DataFrame) -> tuple[int, int, np.ndarray]:
    """(entries of a vector, n, sums) of the rows that remain: a line for each length and task, added by Spark."""
    def add(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in vectors(batch):
                n, s = total.get(x.shape[1], (0, 0))
                total[x.shape[1]] = n + len(rows), s + x.sum(axis=0)
        for size, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
                                              pa.array(s, pa.int64())], ["size", "at", "n", "s"])

    parts = stored(df.mapInArrow(add, "size int, at int, n long, s long"), "whitening-sums")
    best = parts.where("at = 0").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, 0, np.zeros(0, np.int64)
    if best["size"] > MAX_ENTRIES:
        raise ValueError(f"vectors of more than {MAX_ENTRIES} entries")
    sums = parts.where(F.col("size") == best["size"]).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    return best["size"], best["n"], np.array([r["s"] for r in sums], np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once: n * x - S is exact."""
    return (n * x - sums) / n


def _reduced(stack: np.ndarray) -> np.ndarray:
    """R of a QR, square: with zero lines below where there are fewer rows than columns."""
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((stack.shape[1] - len(r), stack.shape[1]))])


def _triangle(df: DataFrame, size: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of all centred rows."""
    def own(batches):
        r = np.zeros((size, size))
        some = False
        for batch in batches:
            for _, x in vectors(batch):
                if x.shape[1] == size:
                    r, some = _reduced(np.vstack([r, centred(x, n, sums)])), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def join(batches):
        r = np.zeros((size, size))
        for batch in batches:
            for raw in batch.column("r").to_pylist():
                r = _reduced(np.vstack([r, np.frombuffer(raw).reshape(size, size)]))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    parts = stored(df.mapInArrow(own, "r binary"), "whitening-triangles")
    left = parts.count()
    while left > 1:
        left = (left + FAN - 1) // FAN
        parts = stored(parts.repartition(left).mapInArrow(join, "r binary"), "whitening-triangles")
    return np.frombuffer(parts.first()["r"]).reshape(size, size)


class Directions:
    """What a whitening needs: n, sums, eigenvalues (falling) and, as columns, unit directions of the covariance."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, directions: np.ndarray):
        self.n, self.sums, self.values, self.directions = n, sums, values, directions
        self.trace = float(values.sum())
        # below this a variance is rounding alone
        self.has_variance = values > self.trace * (8 * EPS * max(1, len(values))) ** 2
        self.scaled = np.where(self.has_variance, directions / np.sqrt(np.where(self.has_variance, values, 1.0)), 0.0)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.scaled[:, :components]


def fit(df: DataFrame, vec: str = "embedding") -> Directions | None:
    """Directions of all rows that remain; None without rows."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{vec}`").cast("array<double>").alias("vec"))
    size, n, sums = _sums(rows)
    if not n:
        return None
    values, directions = singular(_triangle(rows, size, n, sums))
    return Directions(n, sums, values / n, directions)


def _identity_error(rows: DataFrame, model: Directions, components: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, among components with variance.

    Each task gives its count, mean and centred products; these are joined by the means' distances.
    """
    k, size = components, len(model.sums)

    def own(batches):
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for own_rows, x in vectors(batch):
                if x.shape[1] != size:
                    continue
                w = model.whitened(x, k)
                m, at = len(own_rows), w.mean(axis=0)
                gap = at - mean
                products = products + (w - at).T @ (w - at) + np.outer(gap, gap) * (n * m / (n + m))
                mean, n = mean + gap * (m / (n + m)), n + m
        if n:
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([n] * (k * k)), pa.array(mean[i]), pa.array(mean[j]), pa.array(products.ravel())],
                                             ["i", "j", "n", "mi", "mj", "p"])

    parts = stored(rows.mapInArrow(own, "i long, j long, n long, mi double, mj double, p double"), "whitening-check")
    means = parts.where("i = j").groupBy("i").agg((F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("m"))
    means = [r["m"] for r in means.orderBy("i").collect()]
    at = F.array(*[F.lit(float(m)) for m in means])
    entry = (F.sum(F.col("p") + F.col("n") * (F.col("mi") - F.get(at, F.col("i").cast("int"))) * (F.col("mj") - F.get(at, F.col("j").cast("int")))) / F.sum("n"))
    error = 0.0
    for r in parts.groupBy("i", "j").agg(entry.alias("c")).collect():  # components squared
        if model.has_variance[r["i"]] and model.has_variance[r["j"]]:
            error = max(error, abs(r["c"] - (r["i"] == r["j"])))
    return error


def whitened(df: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a line for each row that remains and each component."""
    own = F.col(f"`{key}`").cast("long").alias("key")
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, vec)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = df.select(own, F.col(f"`{vec}`").cast("array<double>").alias("vec"))
    size, k = len(model.sums), min(components, len(model.sums))
    error = _identity_error(rows.select("vec"), model, k)
    explained = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)

    def project(batches):
        for batch in batches:
            for at, x in vectors(batch):
                if x.shape[1] != size:
                    continue
                gap = model.n * x - model.sums
                deviation = (gap * gap).sum(axis=1)
                fits = (gap.astype(np.float64) ** 2).sum(axis=1) < 2.0 ** 63 * (1 - 1e-9)
                m = len(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(deviation, k), mask=~np.repeat(fits, k)), pa.array(model.whitened(x, k).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
