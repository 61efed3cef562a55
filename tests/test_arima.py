import numpy as np
import pytest

from tidemark.ml.arima import fit_arima


def series(ar=(), ma=(), n=1500, seed=1, d=0):
    g = np.random.default_rng(seed)
    e, z = g.normal(size=n), np.zeros(n)
    for t in range(5, n):
        z[t] = e[t] + sum(a * z[t - j] for j, a in enumerate(ar, 1)) + sum(b * e[t - j] for j, b in enumerate(ma, 1))
    for _ in range(d):
        z = np.cumsum(z)
    return z


def test_moving_average_terms_are_found():
    m = fit_arima(series(ma=(0.6,)), 0, 5, 0)
    assert m.q >= 1 and m.ma[0] == pytest.approx(0.6, abs=0.1) and m.sigma2 == pytest.approx(1, abs=0.1)
    m = fit_arima(series(ar=(0.7,), ma=(0.4,)), 1, 1, 0)
    assert (m.p, m.q) == (1, 1) and m.ar[0] == pytest.approx(0.7, abs=0.1) and m.ma[0] == pytest.approx(0.4, abs=0.12)


def test_forecasts_follow_the_recursion():
    z = series(ar=(0.8,), n=800)
    m = fit_arima(z, 1, 0, 0)
    f, v = m.forecast(3), z[-1]
    for k in range(3):
        v = m.const + m.ar[0] * v
        assert f[k] == pytest.approx(v)
    walk = series(n=800, d=1) + 0.5 * np.arange(800)
    m = fit_arima(walk)
    assert m.d == 1 and m.forecast(10)[-1] - walk[-1] == pytest.approx(5, abs=2.5)


@pytest.mark.parametrize("d", [0, 1, 2])
def test_update_equals_a_longer_history(d):
    z = series(ar=(0.5,), ma=(0.3,), n=600, d=d)
    m = fit_arima(z[:580])
    u = m.update(z[580:])
    k = len(m.levels)
    w = np.diff(z, n=k) if k else z
    assert u.n == 600 and u.values[-1] == pytest.approx(w[-1]) and u.levels == pytest.approx([float((np.diff(z, n=i) if i else z)[-1]) for i in range(k)])
    assert set(u.summary()["parameters"]) == {"const", *[f"ar{i + 1}" for i in range(m.p)], *[f"ma{i + 1}" for i in range(m.q)]}


def test_edge_cases():
    assert fit_arima(np.array([])).forecast(2) == [0.0, 0.0] and fit_arima(np.array([3.0, np.nan])).forecast(1) == [3.0] and fit_arima(np.full(99, 2.0)).forecast(5)[-1] == 2.0
