"""Window functions against pandas, and the properties of features, scores, models, checks, sources and streams."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon, scalars, stats
from tidemark.functions import windows as w
from tidemark.ml import causal, evaluate, models
from tidemark.operators import cleaning, features, panel, quality
from tidemark.plans.pipeline import Config
from tidemark.sources import files
from tidemark.streaming import daily

DAYS = pd.bdate_range("2018-01-01", periods=300)


@pytest.fixture(scope="module")
def series():
    g = np.random.default_rng(42)
    close = 100 + np.cumsum(g.normal(0, 0.5, 300))
    x = pd.DataFrame({"symbol": "A", "date": DAYS.date, "open": close * 0.99, "high": close * 1.02, "low": close * 0.97, "close": close, "volume": g.integers(1_000_000, 5_000_000, 300).astype(float)})
    return x


@pytest.fixture(scope="module")
def prices(spark, series):
    return spark.createDataFrame(series).persist()


def close_to(df, column, want):
    got = [r[column] for r in df.select("date", column).orderBy("date").collect()]
    want = [None if pd.isna(v) else v for v in want]
    assert [g is None for g in got] == [v is None for v in want]
    assert all(v is None or abs(g - v) <= 1e-9 * max(1, abs(v)) for g, v in zip(got, want))


def test_windows_equal_pandas(spark, series):
    holes = series.assign(c=series.close.where(series.index % 7 != 3))
    df = w.with_position(spark.createDataFrame(holes.astype({"c": object}).where(holes.notna(), None)).withColumn("c", F.col("c").cast("double")))
    c, v = holes.c, series.close
    cases = {
        "a": (w.roll_mean("c", 5, 2), c.rolling(5, min_periods=2).mean()), "b": (w.roll_std("c", 10, 4), c.rolling(10, min_periods=4).std()), "s": (w.roll_sum("close", 20), v.rolling(20).sum()), "m": (w.roll_mean("close", 20), v.rolling(20).mean()),
        "r": (w.roll_rank("close", 60, 20), v.rolling(60, min_periods=20).rank(pct=True)), "f": (w.fill_forward("c", 1), c.ffill(limit=1)), "g": (w.fill_backward("c"), c.bfill()), "k": (w.cum_sum("c"), c.cumsum()), "d": (w.diff("close", 5), v.diff(5)), "p": (w.pct_change("close", 10), v.pct_change(10)),
        "beta": (w.roll_beta("close", "volume", 60), v.rolling(60).cov(series.volume) / series.volume.rolling(60).var()), "slope": (w.roll_slope("close", 5), v.rolling(5).apply(lambda x: np.polyfit(range(5), x, 1)[0])),
    }
    df = df.withColumns({k: x for k, (x, _) in cases.items()})
    for k, (_, want) in cases.items():
        close_to(df, k, want)


def test_ewm_equals_pandas_with_gaps(spark, series):
    c = series.close.where(series.index % 5 != 2)
    c[:3] = np.nan
    df = spark.createDataFrame(series.assign(c=c.astype(object).where(c.notna(), None))).withColumn("c", F.col("c").cast("double"))
    df = w.ewm(df, [("e", "c", 2 / 13, 1), ("g", "c", 1 / 14, 14)])
    close_to(df, "e", c.ewm(span=12, adjust=False).mean())
    close_to(df, "g", c.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean())


def test_growth_survives_total_losses(spark):
    r = [0.1, -0.5, -1.5, 0.2, -1.0, 0.3]
    df = spark.createDataFrame([("A", dt.date(2020, 1, i + 1), x) for i, x in enumerate(r)], "symbol string, date date, r double")
    got = [x.g for x in df.withColumn("g", w.cum_growth("r")).orderBy("date").collect()]
    assert np.allclose(got, np.cumprod(1 + np.array(r)))


def test_technical_properties(prices):
    x = features.technical(prices).dropna(subset=[*features.TECHNICAL, "log_return_5d"])
    r = x.toPandas()
    assert 200 < len(r) < 300 and r.rsi_14.between(0, 100).all() and (r[["volatility_10d", "volatility_20d", "atr_14"]] > 0).all().all() and (r.bb_upper >= r.bb_lower).all()
    assert set(features.TECHNICAL) <= set(x.columns) and np.isfinite(r[features.TECHNICAL].to_numpy()).all()


def test_sentiment_columns_are_always_the_same(spark, prices):
    a = features.sentiment(prices.select("symbol", "date", F.lit(0.1).alias("avg_sentiment"), F.lit(2).alias("article_count")))
    assert set(a.columns) == {"symbol", "date", *features.SENTIMENT} == set(features.no_sentiment(prices).columns)


def test_earnings_decay_and_staleness(spark, prices):
    e = spark.createDataFrame([("A", DAYS[10].date(), 10.0)], "symbol string, date date, surprise_pct double")
    r = {x.date: x for x in features.earnings(prices, e).collect()}
    assert r[DAYS[9].date()].earnings_surprise == 0 and r[DAYS[9].date()].days_since_earnings is None and r[DAYS[10].date()].earnings_drift_signal == 0.1 and r[DAYS[10].date()].beat_miss == 1
    assert math.isclose(r[DAYS[20].date()].earnings_drift_signal, 0.1 * (1 - 14 / 30)) and r[DAYS[55].date()].earnings_surprise == 0.0 and r[DAYS[53].date()].earnings_surprise == 0.1
    late = {x.date: x for x in features.earnings(prices, e, publication_lag_days=7).collect()}
    assert late[DAYS[14].date()].earnings_surprise == 0 and late[DAYS[15].date()].earnings_surprise == 0.1


def test_implied_volatility_interpolates_at_the_money(spark):
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    rows = [(d(3), "call", 100.0, 9.0)] + [(d(20), k, s, v) for k in ("call", "put") for s, v in ((90.0, 0.9), (101.0, 0.2))] + [(d(40), k, 100.0, 0.4) for k in ("call", "put")]
    r = features.implied_volatility(spark.createDataFrame(rows, files.CHAIN), 100.0, "2024-01-01").first()
    assert math.isclose(r.iv_30d, 0.3) and math.isclose(r.iv_60d, 0.4)


def test_scalars(spark):
    df = spark.createDataFrame([("^A=B-C.D", "21-01-2008", "x", None, 3.0), ("q", "1-01-19", "2.5", float("inf"), -9.0)], "f string, d string, n string, v double, c double")
    r = df.select(scalars.safe_filename("f").alias("f"), scalars.day_first_date("d").alias("d"), scalars.number("n").alias("n"), scalars.finite("v").alias("v"), scalars.clip("c", -3, 1).alias("c"), scalars.flag(F.col("v") > 1).alias("g")).collect()
    assert [tuple(x) for x in r] == [("A_B_C_D", dt.date(2008, 1, 21), None, None, 1.0, 0.0), ("q", dt.date(2019, 1, 1), 2.5, None, -3.0, 1.0)]


def test_lexicon(spark):
    texts = {"Profit beats record": 1.0, "risk risk PROFIT": 0.0, "a decline": -1.0, "": 0.0, None: 0.0, "nothing here": 0.0}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexicon.lexicon_score("t").alias("s"), lexicon.extended_score(F.lit("lawsuit")).alias("x"))
    assert {r.t: r.s for r in df.collect()} == texts and {r.x for r in df.collect()} == {-1.0}


def test_tail_probabilities():
    for k, x in zip((1, 2, 3, 4, 5), (3.841459, 5.991465, 7.814728, 9.487729, 11.070498)):
        assert abs(stats.chi2_sf(x, k) - 0.05) < 1e-6
    assert abs(stats.t_two_sided(2.228139, 10) - 0.05) < 1e-6 and abs(stats.t_two_sided(1.959964, 1e7) - 0.05) < 1e-5 and stats.chi2_sf(0, 3) == 1.0


def planted(n=300):
    g = np.random.default_rng(42)
    x1, x2 = g.normal(size=n), g.normal(size=n)
    return pd.DataFrame({"symbol": "A", "date": pd.bdate_range("2018-01-01", periods=n).date, "x1": x1, "x2": x2, "y": 0.5 * np.roll(x1, 1) + 0.3 * g.normal(size=n)})


def test_planted_causes_are_found(spark, tmp_path):
    df = spark.createDataFrame(planted())
    g = causal.granger(df, ["x1", "x2"], "y")
    r = {x.feature: x for x in g.collect()}
    assert r["x1"].causal and r["x1"].best_lag == 1 and r["x2"].min_pval > 0.01
    links = causal.pcmci(df, ["x1", "x2", "y"])
    into = causal.links_into(df, links, "y")
    p = {x.feature: x for x in into.collect()}
    assert p["x1"].causal and p["x1"].best_lag == 1 and not p["x2"].causal
    sel = causal.select_features(g.drop("symbol"), into)
    assert [x.feature for x in sel.collect()] == ["x1"]
    with pytest.raises(ValueError):
        causal.selection_record(sel, "A", "intersection")
    files.write_records(causal.selection_record(sel, "A", "union", least=1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n_features == 1
    assert causal.graph_matrix(df, links).count() == 3
    with pytest.raises(ValueError):
        causal.pcmci(df, ["x1"], test="Unknown")  # GPDC and CMIknn exist now: test_independence


def preds(spark, p, t):
    return spark.createDataFrame([("A", d.date(), float(a), float(b)) for d, a, b in zip(DAYS, p, t)], "symbol string, date date, y_pred double, y_true double")


def test_scores(spark):
    t = np.random.default_rng(1).normal(0, 0.01, 200)
    good, bad = evaluate.metrics(preds(spark, t, t)).first(), evaluate.metrics(preds(spark, -t, t)).first()
    assert good.directional_accuracy == 1 and bad.directional_accuracy == 0 and good.rmse == 0 and good.r2 == 1 and good.max_drawdown == 0 and bad.max_drawdown < 0 and good.sharpe > 0 > bad.sharpe
    r = -np.abs(t)
    eq = pd.Series(1 + r).cumprod()
    assert math.isclose(bad.max_drawdown, ((eq - eq.cummax()) / eq.cummax()).min(), rel_tol=1e-9)
    assert 0.45 < evaluate.random_baseline(preds(spark, t, t), 100).first().mean_accuracy < 0.55
    assert evaluate.metrics(preds(spark, [], [])).count() == 0
    assert evaluate.best_threshold(evaluate.threshold_sweep(preds(spark, t, t))).first().accuracy == 1.0


def test_walk_forward_windows():
    x = evaluate.walk_forward_windows(dt.date(2010, 11, 30), dt.date(2014, 3, 31))
    assert x[0] == (0, dt.date(2013, 11, 30), dt.date(2014, 2, 28)) and x[-1] == (1, dt.date(2014, 2, 28), dt.date(2014, 3, 31))


def test_split_scale_and_ridge(spark):
    g = np.random.default_rng(3)
    x = pd.DataFrame({"symbol": "A", "date": DAYS.date, "a": g.normal(size=300), "b": g.normal(size=300)}).assign(y=lambda d: 0.3 * d.a - 0.2 * d.b + 1)
    df = spark.createDataFrame(x)
    assert {r.part: r["count"] for r in models.chronological_split(df, ["a"]).groupBy("part").count().collect()} == {"train": 210, "validation": 45, "test": 45}
    s = {r.feature: r for r in models.fit_scaler(df, ["a"]).collect()}
    assert math.isclose(s["a"].scale, x.a.std(ddof=0)) and models.fit_scaler(df, ["a"], "robust").first().center == pytest.approx(x.a.median())
    wts, b = models.fit_ridge(df, ["a", "b"], "y", alpha=1e-9)
    assert wts["a"] == pytest.approx(0.3, abs=1e-6) and wts["b"] == pytest.approx(-0.2, abs=1e-6) and b == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        models.checked_weights({"a": 0.4})


def test_ensemble_and_direction(spark, tmp_path):
    g = np.random.default_rng(4)
    x = pd.DataFrame({"symbol": "A", "date": DAYS.date, "f1": g.normal(size=300), "f2": g.normal(size=300)}).assign(y=lambda d: 0.3 * d.f1 + 0.05 * g.normal(size=300))
    df = spark.createDataFrame(x)
    e = models.Ensemble(["f1", "f2"], "y", rounds=8, depth=3).fit(df)
    p = e.predict(df)
    acc = evaluate.metrics(p.select("symbol", "date", F.col("predicted_return").alias("y_pred"), F.col("actual_return").alias("y_true"))).first().directional_accuracy
    assert acc > 0.8 and models.importance(e.a, ["f1", "f2"])[0][0] == "f1"
    e.save(str(tmp_path / "m"))
    again = models.Ensemble.load(spark, str(tmp_path / "m")).predict(df)
    assert again.join(p, ["symbol", "date"]).filter(F.abs(again.predicted_return - p.predicted_return) > 1e-12).count() == 0
    m = models.fit_direction(df, ["f1", "f2"], "y")
    assert models.predict_direction(m, df, ["f1", "f2"]).filter("(p_up >= 0.5) = (y >= 0)").count() > 250
    rec = models.prediction_record(p.withColumns({"close": F.lit(100.0), "f1": F.lit(1.0), "volatility_10d": F.lit(None).cast("double"), "volatility_20d": F.lit(0.3), "volatility_30d": F.lit(0.3)}), ["f1"]).first()
    assert rec.lower_band < rec.predicted_price < rec.upper_band and rec.causal_drivers[0].feature == "f1"


def test_autoregression():
    assert models.fit_ar(np.full(50, 2.0))[3] == 2.0
    g, y = np.random.default_rng(5), [0.0]
    for _ in range(400):
        y.append(0.8 * y[-1] + g.normal())
    p, d, _, f = models.fit_ar(np.array(y))
    assert p >= 1 and abs(f) < 10 and models.fit_ar(np.array([]))[3] == 0.0


def test_cleaning(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(i), 1.0, float(i), None if i < 5 else 2.0 * i, None if i == 50 else 1.0 * i) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, date date, one double, x double, holes double, few double")
    m, keep, report = cleaning.clean_training(df, ["one", "x", "holes", "few", "x"], leakage=["absent"])
    assert keep == ["x", "few"] and m.count() == 115 and m.filter("few is null").count() == 0 and report.count() == 4
    assert cleaning.clean_live(df, ["holes", "new"]).filter("holes is null or new != 0").count() == 0
    assert cleaning.clean_conservative(df, ["holes"], allow_backfill=False).orderBy("date").first().holes == pytest.approx(np.median([2.0 * i for i in range(5, 120)]))
    with pytest.raises(ValueError):
        cleaning.require_rows(df, 200)


def test_quality(spark, prices):
    bad = prices.withColumn("close", F.when(F.col("date") == DAYS[5].date(), -1.0).otherwise(F.col("close"))).drop("volume")
    r = {(x.check, x.column): x for x in quality.check_prices(bad, as_of="2025-01-01").collect()}
    assert not r["non_positive", "close"].passed and not r["missing_column", "volume"].passed and not r["stale", "date"].passed and r["row_count", "*"].passed
    with pytest.raises(ValueError, match="non_positive"):
        quality.enforce(quality.check_prices(bad))
    assert [x.check for x in quality.check_prices(prices.limit(0)).collect()] == ["empty"]
    quality.enforce(quality.check_macro(prices.select("symbol", "date", "close")))
    assert quality.check_matrix(prices, "close").count() > 0 and quality.check_any(prices).count() > 0


def test_sources_and_sinks(spark, tmp_path, prices, monkeypatch):
    monkeypatch.setenv("MY_KEY", "k")
    (tmp_path / "c.json").write_text('{"a": "${MY_KEY}", "b": "${NOT_SET_AT_ALL}"}')
    assert files.read_config(str(tmp_path / "c.json")) == {"a": "k", "b": ""}
    (tmp_path / "n.json").write_text("\n".join(json.dumps(x) for x in ({"datetime": 86399, "headline": "Profit beats"}, {"datetime": 86400, "headline": "risk"}, {"datetime": 10})))
    d = features.daily_news(files.read_news(spark, str(tmp_path / "n.json")), days=panel.spine(files.read_news(spark, str(tmp_path / "n.json"))))
    assert [(r.article_count, r.avg_sentiment) for r in d.orderBy("date").collect()] == [(2, 0.5), (1, -1.0)]
    (tmp_path / "e.json").write_text(json.dumps({"period": "2020-03-31", "actual": 3.0, "estimate": 2.0}))
    assert files.read_reports(spark, str(tmp_path / "e.json")).first().surprise_pct == 50.0
    files.write_matrix(prices, str(tmp_path / "m"), "_cleaned")
    assert spark.read.parquet(str(tmp_path / "m_cleaned")).count() == 300 and files.feature_columns(prices) == ["open", "high", "low", "close", "volume"]
    assert files.fetch_windows(spark, "2020-01-01", "2020-03-01").count() == 2 and files.live(prices, str(DAYS[-1].date()), 10).count() == 8
    assert files.promote(spark, {"a": 0.5, "b": 0.6}, str(tmp_path / "best")) == "b"
    with pytest.raises(Exception, match="(?i)path"):
        files.read(spark, str(tmp_path / "absent.csv"), files.PRICES).count()
    assert Config().extra_tail_rows == 5


def test_stream_drops_what_the_watermark_passed(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    for i, rows in enumerate([[("A", t(1), 1.0), ("A", t(1, 5), 3.0)], [("A", t(9), 5.0)], [("A", t(9, 2), 5.5)], [("A", t(1, 6), 99.0), ("A", t(9, 1), 6.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    s = daily.landed(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema, 1)
    got = []
    q = daily.refresh(daily.daily_bars(s, "k", "ts", "v", "1 day"), str(tmp_path / "ck"), lambda b, _: got.extend(b.collect()))
    q.awaitTermination()
    assert [(r.date, r.open, r.close, r.n) for r in got] == [(dt.date(2024, 1, 1), 1.0, 3.0, 2)]
