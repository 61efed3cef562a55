import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.ml import sequence as q


def test_gradients_equal_differences():
    s = q.Settings(hidden=3, dropout=0.0)
    m, r = q.Lstm(2, s), np.random.default_rng(1)
    m.p = [a.astype("float64") for a in m.p]
    x, y = r.normal(size=(4, 5, 2)), r.normal(size=4)
    _, grads = m.gradients(x, y)
    for a, g in zip(m.p, grads, strict=True):
        flat = a.reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            was = flat[k]
            flat[k] = was + 1e-5
            up = m.gradients(x, y)[0]
            flat[k] = was - 1e-5
            down = m.gradients(x, y)[0]
            flat[k] = was
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)


def test_it_learns_what_lies_some_rows_back(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=900)
    pdf = pd.DataFrame({"symbol": "A", "date": [dt.date(2015, 1, 1) + dt.timedelta(i) for i in range(900)], "x": x, "z": g.normal(size=900), "y": 3 + 2 * np.roll(x, 3), "v": [i >= 700 for i in range(900)]})
    df = w.sequences(spark.createDataFrame(pdf), ["x", "z"], 6)
    m = q.fit_sequences(df, 2, "y", "v", q.Settings(hidden=16, epochs=30, dropout=0.1, rate=5e-3))
    p = q.score(df, q.Lstm.from_json(m.to_json())).join(df.select("date", "y", "v"), "date").filter("v")
    assert p.count() == 200 and p.select(F.corr("lstm", "y")).first()[0] > 0.8
    assert q.fit_sequences(df.limit(0), 2, "y", "v").predict(np.zeros((2, 6, 2), "float32")).shape == (2,)
    assert q._array(pd.Series([[[1.0, None], [float("nan"), 2.0]]]), 2).tolist() == [[[1.0, 0.0], [0.0, 2.0]]]
