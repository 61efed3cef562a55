"""Univariate ARIMA by the conditional sum of squares: order by AIC, updates with new values, summaries.

Candidates of all orders are estimated by two regressions (a long autoregression stands for the unknown shocks, whose
lags then are regressors); the best of them is refined by Gauss-Newton steps on the shocks' own recursion.

Defined cases: missing values are left out; a constant or very short series is forecast by its last value, an empty one
by 0. Estimates that are not stationary or not invertible are shrunk until they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Arima:
    p: int
    d: int
    q: int
    const: float
    ar: tuple[float, ...]
    ma: tuple[float, ...]
    sigma2: float
    aic: float
    n: int
    values: tuple[float, ...] = ()  # the last p differenced values, latest last
    shocks: tuple[float, ...] = ()  # the last q shocks
    levels: tuple[float, ...] = ()  # the last value of the series and of each lower difference

    def forecast(self, steps: int = 5) -> list[float]:
        z, e = list(self.values), list(self.shocks)
        out = []
        for _ in range(steps):
            v = self.const + sum(a * z[-j] for j, a in enumerate(self.ar, 1)) + sum(b * e[-j] for j, b in enumerate(self.ma, 1))
            z.append(v)
            e.append(0.0)
            out.append(v)
        f = np.array(out)
        for last in reversed(self.levels):  # back to levels
            f = last + np.cumsum(f)
        return [float(v) for v in f] if len(self.levels) == self.d else [0.0] * steps

    def update(self, new: np.ndarray) -> Arima:
        """The same model after further values: its parameters stay, its state moves on."""
        z, e, levels = list(self.values), list(self.shocks), list(self.levels)
        for v in np.asarray(new, float)[~np.isnan(new)].tolist():
            for k in range(self.d):  # differences of the new value
                levels[k], v = v, v - levels[k]
            expected = self.const + sum(a * z[-j] for j, a in enumerate(self.ar, 1)) + sum(b * e[-j] for j, b in enumerate(self.ma, 1))
            z, e = [*z, v][-max(1, self.p) :], [*e, v - expected][-max(1, self.q) :]
        return replace(self, n=self.n + int((~np.isnan(np.asarray(new, float))).sum()), values=tuple(z), shocks=tuple(e), levels=tuple(levels))

    def summary(self) -> dict:
        names = {"const": self.const, **{f"ar{j}": v for j, v in enumerate(self.ar, 1)}, **{f"ma{j}": v for j, v in enumerate(self.ma, 1)}}
        return {"order": (self.p, self.d, self.q), "aic": self.aic, "sigma2": self.sigma2, "n": self.n, "parameters": names}


def _stable(c: np.ndarray) -> np.ndarray:
    """Coefficients of 1 - c1 L - c2 L^2 ... shrunk until all roots lie outside the unit circle."""
    for _ in range(200):
        k = len(c)
        if not k or np.abs(np.linalg.eigvals(np.vstack([c, np.eye(k)[:-1]]))).max() < 0.999:
            return c
        c = c * 0.98 ** np.arange(1, k + 1)
    return np.zeros_like(c)


def _shocks(z: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """The recursion's shocks; those before the first p values are 0."""
    base = z[p:] - b[0] - sum((b[j] * z[p - j : len(z) - j] for j in range(1, p + 1)), np.zeros(len(z) - p))
    if not q:
        return base
    theta, e = b[p + 1 :][::-1].tolist(), [0.0] * q
    for v in base.tolist():
        e.append(v - sum(t * w for t, w in zip(theta, e[-q:], strict=True)))
    return np.array(e[q:])


def _refine(z: np.ndarray, b: np.ndarray, p: int, q: int, steps: int = 8) -> np.ndarray:
    best = float((_shocks(z, b, p, q) ** 2).sum())
    for _ in range(steps):
        e = _shocks(z, b, p, q)
        h = 1e-5
        j = np.stack([(_shocks(z, b + h * np.eye(len(b))[k], p, q) - e) / h for k in range(len(b))], axis=1)
        move, *_ = np.linalg.lstsq(j, -e, rcond=None)
        for scale in (1.0, 0.5, 0.1):
            c = b + scale * move
            c[1 : p + 1], c[p + 1 :] = _stable(c[1 : p + 1]), -_stable(-c[p + 1 :])
            s = float((_shocks(z, c, p, q) ** 2).sum())
            if s < best * (1 - 1e-9):
                b, best = c, s
                break
        else:
            break
    return b


def fit_arima(y: np.ndarray, max_p: int = 5, max_q: int = 5, max_d: int = 2) -> Arima:
    """Differenced while that lowers the variance; p and q by AIC over all orders."""
    y = np.asarray(y, float)
    y = y[~np.isnan(y)]
    if len(y) < 3 * max(max_p, max_q) + max_d + 5 or np.ptp(y) == 0:
        last = float(y[-1]) if len(y) else 0.0
        return Arima(0, 0, 0, last, (), (), 0.0, 0.0, len(y))
    d, z = 0, y
    levels = []
    while d < max_d and np.var(np.diff(z)) < np.var(z):
        levels.append(float(z[-1]))
        z, d = np.diff(z), d + 1
    m = min(max(2 * (max_p + max_q), 10), len(z) // 4) if max_q else 0
    lag = lambda v, k, at: v[at - k : len(v) - k]
    e = np.zeros(len(z))
    if m:
        x = np.column_stack([np.ones(len(z) - m)] + [lag(z, k, m) for k in range(1, m + 1)])
        b, *_ = np.linalg.lstsq(x, z[m:], rcond=None)
        e[m:] = z[m:] - x @ b
    at = m + max(max_p, max_q)
    if len(z) - at < max_p + max_q + 2:
        max_q, at = 0, max_p
    n, best = len(z) - at, None
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            x = np.column_stack([np.ones(n)] + [lag(z, k, at) for k in range(1, p + 1)] + [lag(e, k, at) for k in range(1, q + 1)])
            b, *_ = np.linalg.lstsq(x, z[at:], rcond=None)
            s = float(((z[at:] - x @ b) ** 2).sum())
            aic = n * np.log(max(s / n, 1e-300)) + 2 * (p + q + 1)
            if best is None or aic < best[0] - 1e-9:
                best = (aic, p, q, b)
    aic, p, q, b = best
    b[1 : p + 1], b[p + 1 :] = _stable(b[1 : p + 1]), -_stable(-b[p + 1 :])
    if q:
        b = _refine(z, b, p, q)
    r = _shocks(z, b, p, q)
    return Arima(p, d, q, float(b[0]), tuple(b[1 : p + 1].tolist()), tuple(b[p + 1 :].tolist()), float((r**2).mean()), float(aic), len(y), tuple(z[-max(1, p) :].tolist()), tuple(r[-max(1, q) :].tolist()), tuple(levels))
