import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.ml import boosting as b


def data(n=600, m=5, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, m))
    return x, np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + 0.1 * g.normal(size=n)


def test_one_tree_is_the_best_split_of_brute_force():
    x, y = data(200, 3)
    p = b.Params(rounds=1, rate=1.0, depth=1, leaves=2, least_rows=20, rows=1, columns=1, l1=0.5, l2=2.0)
    t = b.fit(x, y, p=p).trees[0]
    g = y.mean() - y
    s = lambda v: (max(abs(v.sum()) - 0.5, 0)) ** 2 / (len(v) + 2.0)
    gain, f, at = max((s(g[x[:, f] <= c]) + s(g[x[:, f] > c]) - s(g), -f, -c) for f in range(3) for c in np.unique(x[:, f])[:-1] if 20 <= (x[:, f] <= c).sum() <= 180)
    assert (t.feature[0], t.at[0]) == (-f, -at) and t.gain[0] == pytest.approx(gain)
    left = g[x[:, -f] <= -at]
    assert t.value[t.left[0]] == pytest.approx(-math.copysign(max(abs(left.sum()) - 0.5, 0), left.sum()) / (len(left) + 2.0))


@pytest.mark.parametrize("p", [b.LEAF_WISE, b.LEVEL_WISE])
def test_fit(p):
    x, y = data()
    xv, yv = data(300, seed=2)
    m = b.fit(x, y, xv, yv, p)
    assert ((m.predict(xv) - yv) ** 2).mean() < 0.15 * yv.var() and m.importances[:3].sum() > 0.9
    assert all(((t.feature < 0).sum() <= 31 if p.leaves else True) for t in m.trees) and len(m.trees) <= 500
    again = b.Trees.from_json(m.to_json())
    assert (again.predict(xv) == m.predict(xv)).all()
    noise = b.fit(x, np.random.default_rng(3).normal(size=len(x)), xv, np.random.default_rng(4).normal(size=len(xv)), p)
    assert len(noise.trees) < 60  # stopped after fifty rounds without gain, and cut back


def test_contributions_equal_shapley_values_of_brute_force():
    x, y = data(150, 4)
    m = b.fit(x, y, p=b.Params(rounds=4, rate=0.5, depth=3, leaves=6, least_rows=5))

    def expect(t, row, known, node=0):
        f = t.feature[node]
        if f < 0:
            return t.value[node]
        a, c = int(t.left[node]), int(t.right[node])
        if f in known:
            return expect(t, row, known, a if row[f] <= t.at[node] else c)
        return (t.cover[a] * expect(t, row, known, a) + t.cover[c] * expect(t, row, known, c)) / t.cover[node]

    c, mean = m.contributions(x[:5])
    for i in range(5):
        for f in range(4):
            others = [k for k in range(4) if k != f]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * sum(expect(t, x[i], {*s, f}) - expect(t, x[i], set(s)) for t in m.trees) for r in range(4) for s in itertools.combinations(others, r))
            assert c[i, f] == pytest.approx(want, abs=1e-9)
    assert c.sum(axis=1) + mean == pytest.approx(m.predict(x[:5]))


def test_edge_cases():
    x, y = data(50, 3)
    x = x[:, :2]
    assert (b.fit(x[:0], y[:0]).predict(x) == 0).all()
    assert b.fit(np.ones((50, 2)), y).predict(x) == pytest.approx(np.full(50, y.mean()))
    many = np.repeat(np.arange(1000.0)[:, None], 2, axis=1)
    assert np.corrcoef(b.fit(many, np.arange(1000.0), p=b.Params(rounds=50, rate=0.3)).predict(many), np.arange(1000))[0, 1] > 0.99


def test_on_frames(spark):
    x, y = data(400, 3)
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(y=y, symbol="A", date=range(400), v=[i >= 300 for i in range(400)])
    df = spark.createDataFrame(pdf)
    m = b.fit_models(df, ["f0", "f1", "f2"], "y", "v", {"a": b.Params(rounds=40, rate=0.2), "z": b.Params(rounds=40, rate=0.2, leaves=0)})
    s = b.score(df, ["f0", "f1", "f2"], m)
    assert s.filter(F.abs(F.col("a") - F.col("y")) < 0.8).count() > 300 and s.filter(F.abs(F.col("z") - F.col("y")) < 0.8).count() > 300
    d = b.drivers(df, ["f0", "f1", "f2"], m["a"], 2).collect()
    assert len(d) == 400 and sum(r.causal_drivers[0].feature == "f0" for r in d) > 200
    assert b.bounded(df, ("symbol", "date"), 100).count() in range(60, 150) and b.bounded(df, ("symbol", "date"), 400).count() == 400
    assert b.fit_models(df.limit(0), ["f0", "f1", "f2"], "y", "v", {"a": b.LEAF_WISE})["a"].trees == []


def test_search_improves_on_its_first_trials(spark):
    x, y = data(300, 3)
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(y=y, symbol="A", date=range(300), v=[i >= 200 for i in range(300)])
    got = b.search(spark.createDataFrame(pdf), ["f0", "f1", "f2"], "y", "v", b.Params(rounds=5), trials=30, at_once=10)
    assert len(got) == 30 and got[0][1] >= got[-1][1] and all(b.SPACE[k][0] <= v <= b.SPACE[k][1] for t, _ in got for k, v in t.items())
    rng = np.random.default_rng(0)
    done = [({"q": v}, -((v - 0.7) ** 2)) for v in rng.random(40)]
    assert np.mean([abs(t["q"] - 0.7) for t in b.propose(done, {"q": (0.0, 1.0, "float")}, 20, rng)]) < 0.15
