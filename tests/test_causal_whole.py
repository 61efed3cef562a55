import numpy as np
import pandas as pd

from tidemark.ml import causal
from tidemark.ml.models import Ensemble
from tidemark.operators import features
from tidemark.plans import pipeline, reference

DIR = "/root/testdata/sf0.001"


def test_every_feature_of_the_matrix_is_tested(spark):
    m = pipeline.matrix(spark, DIR)
    assert set(features.ALL) == set(m.columns) - {"symbol", "date", "open", "high", "low", "close", "volume", "log_return_5d", "excess_return_5d"} and len(features.ALL) == 73
    got = reference.QUERIES["cau_granger"](spark, DIR).collect()
    assert {r.feature for r in got} == set(features.ALL)
    e = Ensemble(["f"], "y")
    assert (e.rounds, e.depth) == (500, 6)


def test_selection_is_by_symbol(spark):
    g = np.random.default_rng(3)
    x = {s: g.normal(size=(400, 2)) for s in "AB"}
    rows = []
    for s, drives in (("A", 0), ("B", 1)):
        y = np.r_[0.0, 0.8 * x[s][:-1, drives]] + 0.3 * g.normal(size=400)
        rows.append(pd.DataFrame({"symbol": s, "date": pd.bdate_range("2015-01-01", periods=400).date, "f0": x[s][:, 0], "f1": x[s][:, 1], "y": y}))
    df = spark.createDataFrame(pd.concat(rows))
    s = causal.select_features(causal.granger(df, ["f0", "f1"], "y"), causal.pcmci_by_symbol(df, ["f0", "f1", "y"], "y"))
    assert {(r.symbol, r.feature) for r in s.collect()} == {("A", "f0"), ("B", "f1")}
