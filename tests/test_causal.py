import math

import numpy as np
import pandas as pd
import pytest

from tidemark.ml import causal


def lagged(m, lags):
    return np.column_stack([m[lags - k : len(m) - k] for k in range(lags + 1)])


def test_parents_equal_those_of_one_test_after_another():
    """The shared residual covariances against a partial correlation from the inverse of each test's own matrix."""
    g = np.random.default_rng(0)
    m = g.normal(size=(500, 6))
    for i in range(2, 500):
        m[i, 0] += 0.5 * m[i - 1, 1] + 0.3 * m[i - 1, 0]
        m[i, 2] += 0.4 * m[i - 2, 0]
    m[:, 5] = 1.0  # a constant column
    cols, z = list("abcdef"), lagged(m, 6)
    names = [(c, k) for k in range(7) for c in cols]
    cov, at, n = np.cov(z, rowvar=False), {k: i for i, k in enumerate(names)}, len(z)

    def plain(t):
        cand = [(c, k) for k in (1, 2, 3) for c in cols]
        s = {q: abs(causal._partial(cov, at[q], at[t, 0], [], n)[0]) for q in cand}
        d = 0
        while True:
            cand.sort(key=lambda q: (-s[q], q))
            keep = []
            for q in cand:
                r, p = causal._partial(cov, at[q], at[t, 0], [at[o] for o in cand if o != q][:d], n)
                s[q] = min(s[q], abs(r))
                if p <= 0.1:
                    keep.append(q)
            cand = keep
            if len(cand) <= d:
                return cand
            d += 1

    assert all(plain(t) == causal._parents(n, cov, at, t, cols, 1, 3, 0.1, None) for t in cols[:5])
    links = {(a, b, k): p for a, b, k, p, _ in causal._links(n, cov, names, cols, cols[:3], 1, 3, 0.1, None)}
    strong = {x for x, p in links.items() if p < 1e-6}
    assert strong == {("b", "a", 1), ("a", "a", 1), ("a", "c", 2)}
    assert not any(math.isnan(p) for p in links.values())


def test_selection_is_saved_and_loaded(spark, tmp_path):
    x = pd.DataFrame({"feature": list("abcd"), "causal": True, "min_pval": [0.01, 0.02, 0.03, 0.04], "best_lag": 1})
    p = pd.DataFrame({"feature": list("abcd"), "causal": True, "pval": [0.004, 0.003, 0.002, 0.001], "val": 0.1, "best_lag": 2})
    s = causal.select_features(spark.createDataFrame(x), spark.createDataFrame(p))
    causal.save_selection(causal.selection_record(s, "AAA", "intersection"), str(tmp_path / "r"))
    assert causal.load_features(spark, str(tmp_path / "r"), "AAA") == ["d", "c", "b", "a"]
    assert causal.load_selection(spark, str(tmp_path / "r")).first().n_features == 4
    with pytest.raises(ValueError):
        causal.load_features(spark, str(tmp_path / "r"), "BBB")
