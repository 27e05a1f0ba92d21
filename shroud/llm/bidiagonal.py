"""Singular values and right singular vectors of a square matrix: Householder bidiagonal form, dqds, twisted factorisations.

``bidiagonalise`` turns R into U B V^T with an upper bidiagonal B. ``dqds`` finds the eigenvalues of B^T B from the squares of B's
entries (``q`` on the diagonal, ``e`` beside it) by differential quotient-difference steps, which add and divide positive numbers
only, with Laguerre's shift: a bound that no eigenvalue lies below, so a step keeps all ``q`` positive but for rounding
(then it is taken again with a smaller shift). ``vectors`` solves for each eigenvalue by the factorisations of B^T B - x I from above
and from below, joined at the row where the residual is least (the twist). Vectors of eigenvalues that agree to ``CLOSE`` are
made orthogonal to one another.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = np.finfo(np.float64).tiny
CLOSE = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of B, where r = U B V^T."""
    a = np.array(r, np.float64)
    n = a.shape[1]
    v_all = np.eye(n)

    def reflector(x):
        """v of length sqrt(2) with (I - v v^T) x on the first axis; None for a zero vector."""
        scale = np.abs(x).max(initial=0.0)
        if scale == 0.0:
            return None
        v = x / scale
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        return v * (math.sqrt(2.0) / np.linalg.norm(v))

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v = reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, v)
                v_all[:, k + 1:] -= np.outer(v_all[:, k + 1:] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v_all


def _laguerre(q: list[float], e: list[float]) -> float:
    """A lower bound of the least eigenvalue, from the traces of the inverse and of its square."""
    n = len(q)
    p = [0.0] * n  # 1 / p[k] is the inverse's diagonal
    p[-1] = q[-1]
    for k in range(n - 2, -1, -1):
        p[k] = p[k + 1] * (q[k] / (e[k] + p[k + 1]))
    least = min(p)
    if least <= 0.0:
        return 0.0
    s1 = s2 = beside = 0.0  # of the inverse times the least p
    for k in range(n):
        x = least / p[k]
        s1 += x
        s2 += x * x * (1.0 + 2.0 * beside)
        if k < n - 1:
            beside = e[k] / q[k] * (1.0 + beside)
    if not math.isfinite(s2):
        return least / s1
    return least * n / (s1 + math.sqrt(max(0.0, (n - 1) * (n * s2 - s1 * s1))))


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; None if the shift was above the least eigenvalue."""
    d, new_q, new_e = q[0] - shift, [], []
    if d < 0.0:
        return None
    for k in range(len(e)):
        x = d + e[k]
        if x <= 0.0:
            x = TINY
        ratio = q[k + 1] / x
        new_q.append(x)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        if not d >= 0.0:
            return None
    new_q.append(d)
    return new_q, new_e


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, ascending, of B^T B, where q and e are the squares of B's diagonal and superdiagonal."""
    found: list[float] = []
    scale = max(max(q.tolist(), default=0.0), max(e.tolist(), default=0.0))
    least = max(TINY, scale * TINY / EPS)
    todo = [([max(x, least) for x in q.tolist()], e.tolist(), 0.0)]
    while todo:
        q_, e_, at = todo.pop()
        if len(q_) <= 1:
            found += [at + x for x in q_]
            continue
        cut = next((k for k in range(len(e_)) if e_[k] <= EPS * EPS * (at + min(q_[k], q_[k + 1]))), None)
        if cut is not None:
            todo += [(q_[:cut + 1], e_[:cut], at), (q_[cut + 1:], e_[cut + 1:], at)]
            continue
        if 1.5 * q_[0] < q_[-1]:  # small values belong at the end
            q_, e_ = q_[::-1], e_[::-1]
        shift = _laguerre(q_, e_) * (1.0 - 4 * len(q_) * EPS)
        if at + shift == at:
            shift = 0.0
        done = _step(q_, e_, shift)
        while done is None:
            shift = shift / 2 if shift > EPS * EPS * at and shift > least else 0.0
            done = _step(q_, e_, shift)
        todo.append(([max(x, 0.0) for x in done[0]], done[1], at + shift))
    return np.array(sorted(found))


def _stationary(d: np.ndarray, low: np.ndarray, x: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(D, L, s) with L D L^T = (low d low^T) - x I."""
    n = len(d)
    new_d, new_low, s = np.empty(n), np.empty(max(0, n - 1)), np.empty(n)
    s[0] = -x
    for k in range(n - 1):
        new_d[k] = d[k] + s[k] or TINY
        new_low[k] = d[k] * low[k] / new_d[k]
        s[k + 1] = new_low[k] * low[k] * s[k] - x
        if not math.isfinite(s[k + 1]):
            s[k + 1] = math.copysign(1 / TINY, s[k + 1]) if s[k + 1] == s[k + 1] else -x
    new_d[-1] = d[-1] + s[-1] or TINY
    return new_d, new_low, s


def twisted(d: np.ndarray, low: np.ndarray, x: float) -> np.ndarray:
    """The unit vector that the twisted factorisation of low d low^T - x I gives for an eigenvalue next to x."""
    n = len(d)
    if n == 1:
        return np.ones(1)
    _, down, s = _stationary(d, low, x)
    up, p = np.empty(n - 1), np.empty(n)
    p[-1] = d[-1] - x
    for k in range(n - 2, -1, -1):
        below = d[k] * low[k] * low[k] + p[k + 1] or TINY
        t = d[k] / below
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - x
    gamma = np.abs(s + p + x)
    r = int(np.nanargmin(gamma))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    if not np.isfinite(z).all():
        z = np.nan_to_num(z, nan=0.0, posinf=1e150, neginf=-1e150)
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def _solve(d: np.ndarray, low: np.ndarray, x: float, b: np.ndarray) -> np.ndarray:
    """(low d low^T - x I)^-1 b up to its length."""
    new_d, new_low, _ = _stationary(d, low, x)
    y = b.copy()
    for k in range(len(d) - 1):
        y[k + 1] -= new_low[k] * y[k]
        if abs(y[k + 1]) > 1e100:
            y *= 1e-100
    y = y / np.where(np.abs(new_d) < EPS * EPS * np.abs(d).max(), EPS * EPS * np.abs(d).max(), new_d)
    for k in range(len(d) - 2, -1, -1):
        y[k] -= new_low[k] * y[k + 1]
        if abs(y[k]) > 1e100:
            y *= 1e-100
    return y / np.abs(y).max()


def _block(diagonal: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of B^T B for a B without zeros."""
    values = dqds(diagonal * diagonal, beside * beside)[::-1]
    d, low = diagonal * diagonal, beside / diagonal[:-1]
    out = np.empty((len(values), len(values)))
    first = 0
    for j, x in enumerate(values):
        if j and values[j - 1] - x > CLOSE * values[j - 1]:
            first = j
        z = twisted(d, low, x)
        near = out[:, first:j]
        if j > first:
            rng = np.random.default_rng(j)
            for attempt in range(6):
                z = z - near @ (near.T @ z)
                size = np.linalg.norm(z)
                if size > 0.5:
                    break
                # too close to the vectors before it: two steps of inverse iteration from elsewhere
                z = rng.standard_normal(len(z)) if size < 1e-3 else z / size
                for _ in range(2):
                    z = z - near @ (near.T @ z)
                    z = _solve(d, low, x * (1 + 4 * EPS), z / np.linalg.norm(z))
                    z /= np.linalg.norm(z)
            z = z - near @ (near.T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return values, out


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squares of the singular values, falling; right singular vectors as columns) of a square matrix."""
    n = r.shape[1]
    scale = np.abs(r).max(initial=0.0)
    if scale == 0.0:
        return np.zeros(n), np.eye(n)
    diagonal, beside, v = bidiagonalise(r / scale)
    norm = max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0))
    # entries that rounding cannot tell from zero: beside the diagonal they cut B into blocks, on it they stay just above zero
    least = 8 * EPS * norm
    diagonal = np.where(np.abs(diagonal) < least, np.copysign(least, diagonal), diagonal)
    beside = np.where(np.abs(beside) < least, 0.0, beside)
    cuts = [0, *(np.flatnonzero(beside == 0.0) + 1).tolist(), n]
    values, vectors = np.empty(n), np.zeros((n, n))
    for i, j in zip(cuts, cuts[1:]):
        values[i:j], vectors[i:j, i:j] = _block(diagonal[i:j], beside[i:j - 1])
    order = np.argsort(-values, kind="stable")
    return values[order] * scale * scale, v @ vectors[:, order]
