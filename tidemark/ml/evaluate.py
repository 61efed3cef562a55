"""Scores of predictions (symbol, date, y_pred, y_true), regimes, walk-forward windows, thresholds, monitoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import label_ranges

COST_BPS, RISK_FREE, DAYS = 10.0, 0.04, 252
# The default regimes, first and last day included.
US_REGIMES = [("bull", "2010-01-01", "2019-12-31"), ("covid_crash", "2020-01-01", "2020-06-30"), ("recovery", "2020-07-01", "2021-12-31"), ("rate_hike", "2022-01-01", "2022-12-31"), ("ai_bull", "2023-01-01", "2025-12-31")]


def position(c: str = "y_pred") -> Column:
    return F.when(F.col(c) >= 0, 1.0).otherwise(-1.0)


def directional_accuracy(p: Column, t: Column) -> Column:
    return F.avg(((p >= 0) == (t >= 0)).cast("int"))


def metrics(preds: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """All scores per group, with one window pass for the drawdown and one aggregation.

    Zero counts as up; the first peak of the equity is its first value; costs enter the Sharpe ratio only.
    """
    by = list(by)
    x = preds.dropna(subset=["y_pred", "y_true"]).withColumn("_r", position() * F.col("y_true"))
    run = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # a loss of everything (1 + r <= 0) keeps its sign and its zero
    f = 1 + F.col("_r")
    size = F.exp(F.sum(F.when(f != 0, F.ln(F.abs(f))).otherwise(0.0)).over(run))
    sign = F.when(F.sum((f < 0).cast("int")).over(run) % 2 == 1, -1.0).otherwise(1.0)
    x = x.withColumn("_eq", F.when(F.sum((f == 0).cast("int")).over(run) > 0, 0.0).otherwise(size * sign))
    x = x.withColumn("_dd", F.try_divide(F.col("_eq") - F.max("_eq").over(run), F.max("_eq").over(run)))
    e, net = F.col("y_true") - F.col("y_pred"), F.col("_r") - COST_BPS / 10_000
    sd, sst = F.stddev_samp(net), F.var_pop("y_true") * F.count("*")
    a = x.groupBy(*by).agg(
        F.count("*").alias("n"), directional_accuracy(F.col("y_pred"), F.col("y_true")).alias("directional_accuracy"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.coalesce(1 - F.try_divide(F.sum(e * e), F.when(sst > 0, sst)), F.lit(0.0)).alias("r2"), F.avg(F.abs(e) / (F.abs("y_true") + 1e-8)).alias("mape"),
        F.coalesce(F.try_divide(F.avg(net - RISK_FREE / DAYS), F.when(sd > 0, sd)), F.lit(0.0)).alias("_s"), F.min("_dd").alias("max_drawdown"), (F.avg("_r") * DAYS).alias("_year"),
    )
    return a.select(*by, "n", "directional_accuracy", "rmse", "mae", "r2", "mape", (F.col("_s") * DAYS**0.5).alias("sharpe"), "max_drawdown", F.coalesce(F.try_divide("_year", F.nullif(F.abs("max_drawdown"), F.lit(0.0))), F.lit(0.0)).alias("calmar"))


def regime_metrics(preds: DataFrame, regimes=US_REGIMES) -> DataFrame:
    return metrics(label_ranges(preds, regimes), ("regime",))


def regime_stats(df: DataFrame, regimes=US_REGIMES, candidates: Sequence[str] = ("log_return_5d", "log_return_1d")) -> DataFrame:
    """(regime, n_rows, first, last, mean, std, min, max) of the first candidate column that exists."""
    c = next(c for c in candidates if c in df.columns)
    x = label_ranges(df, regimes).groupBy("regime").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), *[F.round(f(c), 4).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))])
    return x


def pre_regime_train(df: DataFrame, start: str, embargo_rows: int = 1) -> DataFrame:
    """Rows up to the regime's start, less each symbol's last `embargo_rows`."""
    x = df.filter(F.col("date") <= F.lit(start).cast("date"))
    return x.withColumn("_t", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("_t") > embargo_rows).drop("_t")


def add_months(d: dt.date, k: int) -> dt.date:
    m = d.month - 1 + k
    y, m = d.year + m // 12, m % 12 + 1
    last = (dt.date(y + (m == 12), m % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(y, m, min(d.day, last))


def walk_forward_windows(first: dt.date, last: dt.date, train_years: int = 3, step_months: int = 3) -> list[tuple[int, dt.date, dt.date]]:
    """(window, train end, test end): expanding training up to the train end, tests in (train end, test end]."""
    out, end = [], add_months(first, 12 * train_years)
    while end < last:
        test = min(add_months(end, step_months), last)
        out.append((len(out), end, test))
        end = add_months(end, step_months)
    return out


def walk_forward_sizes(df: DataFrame, windows: Sequence[tuple[int, dt.date, dt.date]], least_train: int = 200, least_test: int = 60) -> DataFrame:
    """(window, train_rows, test_rows, used): conditional sums in one pass instead of a join per window."""
    n = [x for w, e, t in windows for x in (F.count_if(F.col("date") <= F.lit(e)).alias(f"a{w}"), F.count_if((F.col("date") > F.lit(e)) & (F.col("date") <= F.lit(t))).alias(f"b{w}"))]
    rows = [F.struct(F.lit(w).alias("window"), F.col(f"a{w}").alias("train_rows"), F.col(f"b{w}").alias("test_rows"), ((F.col(f"a{w}") >= least_train) & (F.col(f"b{w}") >= least_test)).alias("used")) for w, *_ in windows]
    return df.agg(*n).select(F.inline(F.array(*rows)))


def threshold_sweep(preds: DataFrame, span: float = 0.02, points: int = 81) -> DataFrame:
    """(threshold, accuracy) over a grid, in-sample: one aggregation with a column per point."""
    grid = [round(-span + 2 * span * i / (points - 1), 10) for i in range(points)]
    p, t = F.col("y_pred"), F.col("y_true")
    a = preds.dropna(subset=["y_pred", "y_true"]).agg(*[F.avg(((p >= g) == (t >= 0)).cast("int")).alias(f"a{i}") for i, g in enumerate(grid)])
    return a.select(F.inline(F.array(*[F.struct(F.lit(g).alias("threshold"), F.col(f"a{i}").alias("accuracy")) for i, g in enumerate(grid)])))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold of the highest accuracy."""
    return sweep.agg(F.max(F.struct("accuracy", (-F.col("threshold")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def monitor(preds: DataFrame, rows: int = 252, alarm: float = 0.60) -> DataFrame:
    """Accuracy of each symbol's last rows, and whether it calls for the fallback."""
    x = preds.dropna(subset=["y_pred", "y_true"]).withColumn("_t", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("_t") <= rows)
    a = x.groupBy("symbol").agg(F.count("*").alias("n"), directional_accuracy(F.col("y_pred"), F.col("y_true")).alias("accuracy"))
    return a.withColumn("mode", F.when(F.col("accuracy") < alarm, "momentum_fallback").otherwise("model"))


def random_baseline(preds: DataFrame, trials: int = 1000, seed: int = 42) -> DataFrame:
    """(mean_accuracy, std_accuracy) of random signs: a hashed sign per row and trial. One pass adds up the hits of all
    trials in place, and only these sums are shuffled."""
    t = preds.dropna(subset=["y_true"]).select(F.xxhash64("symbol", "date", F.lit(seed)).alias("h"), (F.col("y_true") >= 0).alias("up"))

    def hits(batches):
        n, total = 0, np.zeros(trials, "int64")
        salt = (np.arange(1, trials + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))[None]
        for b in batches:
            h, up = b.h.to_numpy("int64").view("uint64")[:, None], b.up.to_numpy(bool)[:, None]
            for k in range(0, len(b), 2000):
                z = (h[k : k + 2000] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                total += (((z >> np.uint64(63)) == 0) == up[k : k + 2000]).sum(axis=0)
            n += len(b)
        yield pd.DataFrame({"n": [n], "hits": [total.tolist()]})

    x = t.mapInPandas(hits, "n long, hits array<long>").select("n", F.posexplode("hits").alias("trial", "hits"))
    x = x.groupBy("trial").agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("a"))
    return x.agg(F.avg("a").alias("mean_accuracy"), F.stddev_pop("a").alias("std_accuracy"))


def comparison(m: DataFrame, model: str = "model", regime: str = "regime", names: Sequence[str] = (), value: str = "directional_accuracy") -> DataFrame:
    """Models by regimes, as formatted percentages."""
    return m.groupBy(model).pivot(regime, list(names) or None).agg(F.first(F.format_number(F.col(value) * 100, 2)))
