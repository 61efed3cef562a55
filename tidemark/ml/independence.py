"""Tests of conditional independence beyond partial correlation, on a bounded sample of rows.

gpdc: x and y are freed of z by Gaussian-process regression, the distance correlation of what is left is tested by
permutations. cmi_knn: conditional mutual information from nearest neighbours, tested by permutations of x among rows
that are near in z. Both compare all pairs of the sample, so its size is a parameter.

Defined cases: rows with a missing value are left out; fewer than ten rows, or a constant x or y, are independent (p = 1).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SAMPLE_ROWS, SHUFFLES = 500, 200


def _clean(x: np.ndarray, y: np.ndarray, z: np.ndarray, rng: np.random.Generator, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    z = z.reshape(len(x), -1)
    ok = ~(np.isnan(x) | np.isnan(y) | np.isnan(z).any(axis=1))
    x, y, z = x[ok], y[ok], z[ok]
    if len(x) > rows:
        i = np.sort(rng.choice(len(x), rows, replace=False))
        x, y, z = x[i], y[i], z[i]
    if len(x) < 10 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    scale = lambda a: (a - a.mean(axis=0)) / np.where(a.std(axis=0) > 0, a.std(axis=0), 1.0)
    return scale(x), scale(y), scale(z)


def _distances(a: np.ndarray) -> np.ndarray:
    a = a.reshape(len(a), -1)
    return np.sqrt(np.maximum(((a[:, None] - a[None]) ** 2).sum(axis=2), 0))


def _left_over(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """What Gaussian-process regression on z leaves of y; width and noise by the likelihood over a small grid."""
    if not z.shape[1]:
        return y
    d2, best = _distances(z) ** 2, None
    for width in (0.3, 1.0, 3.0, 10.0):
        k = np.exp(-d2 / (2 * width**2 * z.shape[1]))
        lam, q = np.linalg.eigh(k)
        qy = q.T @ y
        for noise in (0.01, 0.1, 0.5, 1.0):
            s = np.maximum(lam, 0) + noise
            a = float((qy**2 / s).mean())  # the scale of the kernel is known in closed form
            like = -0.5 * (len(y) * np.log(a) + np.log(s).sum())
            if best is None or like > best[0]:
                best = (like, y - q @ (np.maximum(lam, 0) / s * qy))
    return best[1]


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    a, b = (d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean() for d in (_distances(x), _distances(y)))
    v = float(np.sqrt((a * a).mean() * (b * b).mean()))
    return float(np.sqrt(max((a * b).mean(), 0) / v)) if v > 0 else 0.0


def gpdc(x: np.ndarray, y: np.ndarray, z: np.ndarray, shuffles: int = SHUFFLES, rows: int = SAMPLE_ROWS, seed: int = 42) -> tuple[float, float]:
    """(distance correlation given z, p-value)."""
    rng = np.random.default_rng(seed)
    c = _clean(x, y, z, rng, rows)
    if c is None:
        return 0.0, 1.0
    x, y = _left_over(c[0], c[2]), _left_over(c[1], c[2])
    a, b = (d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean() for d in (_distances(x), _distances(y)))
    own = float((a * b).mean())
    more = 0
    for _ in range(shuffles):
        i = rng.permutation(len(x))
        more += float((a[np.ix_(i, i)] * b).mean()) >= own
    return distance_correlation(x, y), (more + 1) / (shuffles + 1)


def _digamma(n: np.ndarray) -> np.ndarray:
    """At whole numbers: partial sums of 1/k."""
    top = int(n.max())
    h = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, top))]) - 0.5772156649015329
    return h[n - 1]


def _cmi(x: np.ndarray, dy: np.ndarray, dz: np.ndarray | None, k: int) -> float:
    dx = np.abs(x[:, None] - x[None])
    xyz = np.maximum(dx, dy) if dz is None else np.maximum(np.maximum(dx, dy), dz)
    np.fill_diagonal(xyz, np.inf)
    eps = np.partition(xyz, k - 1, axis=1)[:, k - 1 : k]
    count = lambda d: np.maximum((d < eps).sum(axis=1), 1)  # noqa: E731  (the row itself is in it)
    if dz is None:
        return float(_digamma(np.array([k]))[0] + _digamma(np.array([len(x)]))[0] - (_digamma(count(dx)) + _digamma(count(dy))).mean())
    return float(_digamma(np.array([k]))[0] + (_digamma(count(dz)) - _digamma(count(np.maximum(dx, dz))) - _digamma(count(np.maximum(dy, dz)))).mean())


def cmi_knn(x: np.ndarray, y: np.ndarray, z: np.ndarray, shuffles: int = SHUFFLES, rows: int = SAMPLE_ROWS, near: float = 0.1, close: int = 5, seed: int = 42) -> tuple[float, float]:
    """(conditional mutual information, p-value). near: neighbours as a share of the rows; close: rows a value may move to."""
    rng = np.random.default_rng(seed)
    c = _clean(x, y, z, rng, rows)
    if c is None:
        return 0.0, 1.0
    x, y, z = (np.argsort(np.argsort(v, axis=0, kind="stable"), axis=0, kind="stable").astype(float) for v in c)  # ranks: margins do not matter
    k, n = max(1, int(near * len(x))), len(x)
    dy = np.abs(y[:, None] - y[None])
    dz = np.abs(z[:, None] - z[None]).max(axis=2) if z.shape[1] else None
    own, more = _cmi(x, dy, dz, k), 0
    friends = None if dz is None else np.argsort(dz, axis=1, kind="stable")[:, : close + 1]
    for _ in range(shuffles):
        if friends is None:
            i = rng.permutation(n)
        else:  # each row takes the value of a row near in z, each value once where that is possible
            i, used = np.empty(n, int), np.zeros(n, bool)
            for r in rng.permutation(n):
                f = rng.permutation(friends[r])
                free = f[~used[f]]
                i[r] = free[0] if len(free) else f[-1]
                used[i[r]] = True
        more += _cmi(x[i], dy, dz, k) >= own
    return own, (more + 1) / (shuffles + 1)


TESTS: dict[str, Callable] = {"GPDC": gpdc, "CMIknn": cmi_knn}
