import numpy as np
import pandas as pd
import pytest

from tidemark.ml import causal, independence as ind


@pytest.mark.parametrize("test", [ind.gpdc, ind.cmi_knn])
def test_dependence_that_correlation_misses(test):
    g = np.random.default_rng(3)
    z = g.normal(size=(300, 1))
    x, y = z[:, 0] + 0.5 * g.normal(size=300), z[:, 0] ** 2 + 0.3 * g.normal(size=300)
    none = np.empty((300, 0))
    assert test(x, x**2 + 0.2 * g.normal(size=300), none, shuffles=99)[1] <= 0.02
    assert test(g.normal(size=300), g.normal(size=300), none, shuffles=99)[1] > 0.05
    assert test(x, y, none, shuffles=99)[1] <= 0.05 < test(x, y, z, shuffles=99)[1]  # they depend through z only
    assert test(np.ones(300), y, z) == (0.0, 1.0) and test(x[:5], y[:5], z[:5]) == (0.0, 1.0)
    x[0] = np.nan
    assert test(x, y, none, shuffles=9, rows=100)[1] <= 1


def test_distance_correlation():
    x = np.arange(50.0)
    assert ind.distance_correlation(x, 3 * x + 1) == pytest.approx(1.0) and ind.distance_correlation(x, np.ones(50)) == 0


@pytest.mark.parametrize("test", ["GPDC", "CMIknn"])
def test_lagged_links_by_rows(spark, test):
    g = np.random.default_rng(5)
    x = g.normal(size=260)
    y = np.r_[0.0, 1.5 * np.abs(x[:-1])] + 0.2 * g.normal(size=260)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": pd.bdate_range("2020-01-01", periods=260).date, "x": x, "y": y}))
    got = {(a, k): p for a, b, k, p, _ in causal.pcmci(df, ["x", "y"], tau_max=1, test=test, targets=["y"], shuffles=49)}
    assert got["x", 1] <= 0.02 < got["y", 1]
    with pytest.raises(ValueError):
        causal.pcmci(df, ["x", "y"], test="Other")
