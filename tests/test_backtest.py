import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.ml import backtest
from tidemark.ml.models import Ensemble
from tidemark.operators.scoring import score_texts

REGIMES = [("early", "2015-01-01", "2015-06-30"), ("late", "2017-01-01", "2017-12-31"), ("after", "2030-01-01", "2030-12-31")]


def make():
    return Ensemble(["f1"], "y", rounds=3, depth=2)


@pytest.fixture(scope="module")
def matrix(spark):
    g = np.random.default_rng(7)
    x = pd.DataFrame({"symbol": "A", "date": pd.bdate_range("2014-01-01", periods=1100).date, "f1": g.normal(size=1100)}).assign(y=lambda d: 0.4 * d.f1 + 0.05 * g.normal(size=1100))
    return spark.createDataFrame(x).persist()


def test_regimes(matrix):
    r = {x.regime: x for x in backtest.regime_backtest(matrix, {"m": make}, REGIMES).collect() if x.model == "m"}
    assert set(r) == {"early", "late"} and all(x.directional_accuracy > 0.7 for x in r.values())


def test_a_random_variant_stands_beside_the_others(matrix):
    r = {(x.model, x.regime): x.directional_accuracy for x in backtest.regime_backtest(matrix, {"all": make, "one": make}, REGIMES).collect()}
    assert set(r) == {(m, g) for m in ("all", "one", "random") for g in ("early", "late")} and 0.3 < r["random", "late"] < 0.7


def test_the_best_window_is_promoted(spark, matrix, tmp_path):
    due, scores = backtest.retrain(matrix, make, dt.date(2017, 1, 1), dt.date(2018, 3, 1), str(tmp_path), step_months=6)
    best = spark.read.json(str(tmp_path / "best")).first()
    assert due and best.score == max(scores.values()) and scores[int(best.path.split("=")[-1])] == best.score
    assert backtest.promoted(spark, str(tmp_path)).predict(matrix).count() == 1100


def test_walk_forward_and_retrain(matrix):
    w = backtest.walk_forward(matrix, make, train_years=3, step_months=12).collect()
    assert w and all(x.n >= 60 for x in w)
    assert backtest.retrain(matrix, make, dt.date(2018, 1, 1), dt.date(2018, 3, 1)) == (False, {})
    due, scores = backtest.retrain(matrix, make, dt.date(2017, 1, 1), dt.date(2018, 3, 1), step_months=12)
    assert due and scores
    assert backtest.walk_forward(matrix.limit(0), make) is None


def test_routing(matrix):
    m = matrix.withColumns({"vix_level": F.when(F.col("date") < "2016-01-01", 10.0).otherwise(25.0), "vix_change_1d": F.lit(0.0), "yield_spread": F.lit(1.0), "sp500_return_1d": F.lit(0.1), "vol_regime": F.lit(0.0)})
    e = backtest.RegimeEnsembles(make, {"bull": "late"}).fit(matrix, REGIMES)
    n = {r.routed_to: r["count"] for r in e.predict(m).groupBy("routed_to").count().collect()}
    assert set(n) == {"all", "late"} and sum(n.values()) == 1100


def test_model_scores(spark):
    df = spark.createDataFrame([("up up",), (None,), ("x" * 5000,)], "t string")
    got = [r.score for r in score_texts(df, "t", lambda: lambda texts: [len(t) / 1000 for t in texts], batch=2).collect()]
    assert got == [0.005, 0.0, 0.512] and score_texts(df, "t").first().score == 1.0


def test_cli(spark, tmp_path):
    cli.main(["/root/testdata/sf0.001", str(tmp_path)])
    m = spark.read.parquet(str(tmp_path / "matrix"))
    assert m.count() >= 200 and "log_return_5d" not in m.columns and spark.read.json(str(tmp_path / "dropped_columns")).count() > 5
    cli.main(["/root/testdata/sf0.001", str(tmp_path), "--live", "2024-02-07"])
    assert spark.read.parquet(str(tmp_path / "live")).count() > 0
