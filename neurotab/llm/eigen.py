"""Leading eigenpairs of a small symmetric matrix (the covariance of d dimensions).

Householder reflections bring the matrix to tridiagonal form.  The number of
negative pivots of T - x (a Sturm count) is the number of eigenvalues below x,
so bisection finds any of them to the last bit, whatever the others are.
Inverse iteration gives the vectors; those of eigenvalues that lie close
together are kept orthogonal to each other as they are iterated.  The matrix
is d x d whatever the number of rows, so this runs on the driver.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
# eigenvalues nearer than this share of the largest form one cluster
CLUSTER = 1e-3
ROUNDS = 6


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflection vectors (unit; empty: none) of
    a symmetric matrix: T = H_k .. H_1 A H_1 .. H_k with H = I - 2 v v^T."""
    a = np.array(a, np.float64)
    n, vectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x).max()
        if size == 0 or not x[1:].any():
            vectors.append(np.empty(0))
            continue
        x /= size  # else squares of tiny entries underflow
        norm = np.linalg.norm(x)
        x[0] += np.copysign(norm, x[0])
        v = x / np.linalg.norm(x)
        vectors.append(v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        q = p - (v @ p) * v
        block -= 2 * (np.outer(v, q) + np.outer(q, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm * size, x[0])
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), vectors


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each of ``x``."""
    x = np.asarray(x, np.float64)
    tiny = EPS * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(np.float64).tiny) ** 2
    count, pivot = np.zeros(x.shape, np.int64), np.ones(x.shape)
    for k in range(len(d)):
        pivot = d[k] - x - (e[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < np.sqrt(tiny) * EPS, -np.sqrt(tiny) * EPS - np.finfo(np.float64).tiny, pivot)
        count += pivot < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of all at once."""
    n = len(d)
    radius = np.r_[np.abs(e), 0] + np.r_[0, np.abs(e)]
    low, high = np.full(k, (d - radius).min()), np.full(k, (d + radius).max())
    high += EPS * np.abs(high) + np.finfo(np.float64).tiny
    below = n - 1 - np.arange(k)  # the wanted value has that many below it
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        left = sturm_count(d, e, middle) > below
        high = np.where(left, middle, high)
        low = np.where(left, low, middle)


def factored(d: np.ndarray, e: np.ndarray, x: float, floor: float) -> tuple:
    """LU factors of T - x with row exchanges."""
    n = len(d)
    u, v, w, swap, ratio = d - x, np.r_[e, 0.0], np.zeros(n), np.zeros(n, bool), np.zeros(n)
    for k in range(n - 1):
        if abs(e[k]) > abs(u[k]):
            swap[k] = True
            ratio[k] = u[k] / e[k]
            u[k], v[k], u[k + 1], w[k], v[k + 1] = e[k], u[k + 1], v[k] - ratio[k] * u[k + 1], v[k + 1], -ratio[k] * v[k + 1]
        else:
            u[k] = u[k] if abs(u[k]) > floor else floor
            ratio[k] = e[k] / u[k]
            u[k + 1] -= ratio[k] * v[k]
    u[-1] = u[-1] if abs(u[-1]) > floor else floor
    return u, v, w, swap, ratio


def solved(factors: tuple, b: np.ndarray) -> np.ndarray:
    u, v, w, swap, ratio = factors
    x, n = b.copy(), len(b)
    for k in range(n - 1):
        if swap[k]:
            x[k], x[k + 1] = x[k + 1], x[k]
        x[k + 1] -= ratio[k] * x[k]
    for k in range(n - 1, -1, -1):
        x[k] -= (v[k] * x[k + 1] if k + 1 < n else 0) + (w[k] * x[k + 2] if k + 2 < n else 0)
        x[k] /= u[k]
    return x


def vectors_of(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse iteration;
    inside a cluster each is kept orthogonal to the ones before it."""
    n, rng = len(d), np.random.default_rng(0)
    scale = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0)) or 1.0
    out = np.empty((n, len(values)))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * scale:
            first = k
        # equal shifts would give equal vectors
        shift = min(value, shift - 2 * EPS * scale) if k > first else value
        factors = factored(d, e, shift, EPS * scale)
        x = rng.standard_normal(n)
        for _ in range(ROUNDS):
            for _ in range(2):  # twice, so that what rounding leaves goes as well
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x = solved(factors, x / np.linalg.norm(x))
            x /= np.abs(x).max()
        x /= np.linalg.norm(x)
        for _ in range(2):  # vectors of other clusters differ by rounding only
            x -= out[:, :k] @ (out[:, :k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and their unit vectors (columns)."""
    k = min(k, len(a))
    scale = float(np.abs(a).max(initial=0))
    if not k or not scale:
        return np.zeros(k), np.eye(len(a))[:, :k]
    d, e, reflections = tridiagonal(np.asarray(a, np.float64) / scale)
    values = leading_values(d, e, k)
    x = vectors_of(d, e, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        if len(v):
            x[i + 1:] -= 2 * np.outer(v, v @ x[i + 1:])
    x /= np.linalg.norm(x, axis=0)
    return values * scale, x
