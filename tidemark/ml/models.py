"""Chronological splits, scaling, boosted trees, autoregression, ridge stacking, and the prediction record."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip
from tidemark.ml import arima, boosting
from tidemark.runtime import cut

# Fallback weights of the blend, and the quantile of its band.
WEIGHTS = {"trees_a": 0.50, "trees_b": 0.35, "arima": 0.15}
BAND = 1.645


def chronological_split(df: DataFrame, columns: Sequence[str], train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Complete rows with `part` (train, validation, test) by position within the symbol; bounds are floor(n * ratio)."""
    s = Window.partitionBy("symbol")
    x = df.dropna(subset=list(columns)).withColumn("_i", F.row_number().over(s.orderBy("date")) - 1).withColumn("_n", F.count(F.lit(1)).over(s))
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + validation))
    return x.withColumn("part", F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "validation").otherwise("test")).drop("_i", "_n")


def fit_scaler(train: DataFrame, features: Sequence[str], kind: str = "standard") -> DataFrame:
    """(feature, center, scale): mean and population deviation, or median and interquartile range; scale 0 becomes 1."""
    if kind == "standard":
        pairs = [(F.avg(c), F.stddev_pop(c)) for c in features]
    elif kind == "robust":
        pairs = [(F.percentile(c, 0.5), F.percentile(c, 0.75) - F.percentile(c, 0.25)) for c in features]
    else:
        pairs = [(F.lit(0.0) + 0 * F.count("*"), F.lit(1.0) + 0 * F.count("*")) for _ in features]
    agg = [x.alias(f"{p}{i}") for i, (m, s) in enumerate(pairs) for p, x in (("m", m), ("s", s))]
    return train.agg(*agg).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("center"), F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0).alias("scale")) for i, c in enumerate(features)])))


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    s = {r.feature: (r.center, r.scale) for r in scaler.collect()}  # a row per feature
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(k) for c, (m, k) in s.items()})


def with_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def importance(model: boosting.Trees, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.importances.tolist(), strict=True), key=lambda p: (-p[1], p[0]))


def fit_ar(y: np.ndarray, max_p: int = 5, max_d: int = 2, steps: int = 5) -> tuple[int, int, float, float]:
    """(p, d, AIC, forecast): fit_arima without moving-average terms."""
    m = arima.fit_arima(y, max_p, 0, max_d)
    return m.p, m.d, m.aic, m.forecast(steps)[-1]


def ar_forecasts(train: DataFrame, target: str, steps: int = 5, max_p: int = 5, max_q: int = 5, max_d: int = 2) -> DataFrame:
    """(symbol, p, d, q, aic, forecast): the last step's forecast stands for all later rows. A group is one series."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = arima.fit_arima(pdf.sort_values("date")["y"].to_numpy(float), max_p, max_q, max_d)
        return pd.DataFrame([(*key, m.p, m.d, m.q, m.aic, m.forecast(steps)[-1])], columns=["symbol", "p", "d", "q", "aic", "forecast"])

    return train.select("symbol", "date", F.col(target).alias("y")).groupBy("symbol").applyInPandas(run, "symbol string, p int, d int, q int, aic double, forecast double")


def fit_ridge(df: DataFrame, inputs: Sequence[str], target: str, alpha: float = 1.0) -> tuple[dict[str, float], float]:
    """(weights, intercept) of a ridge on standardised inputs, given back for the raw ones: one aggregation, a small solve."""
    k = len(inputs)
    c = [*inputs, target]
    agg = [F.count("*").alias("n")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(c)] + [F.covar_pop(c[i], c[j]).alias(f"c{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    r = df.dropna(subset=c).agg(*agg).first()
    n = r["n"]
    if not n:
        return dict.fromkeys(inputs, 0.0), 0.0
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    sd = np.sqrt(np.diag(cov)[:k])
    sd[sd == 0] = 1.0
    z = cov[:k, :k] / np.outer(sd, sd) * n
    w = np.linalg.solve(z + alpha * np.eye(k), cov[:k, k] / sd * n) / sd
    return dict(zip(inputs, w.tolist(), strict=True)), float(r[f"m{k}"] - sum(w[i] * r[f"m{i}"] for i in range(k)))


def blend(weights: dict[str, float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, v in weights.items():
        out = out + F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(v))
    return out


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    return weights


def daily_volatility() -> Column:
    """The first present positive annual volatility, per day; .02 without any."""
    return F.coalesce(*[F.when(F.col(c) > 0, F.col(c) / 252**0.5) for c in ("volatility_10d", "volatility_20d", "volatility_30d")], F.lit(0.02))


def prediction_record(df: DataFrame, drivers: Sequence[str] = (), horizon: int = 5, model: str = "ensemble") -> DataFrame:
    """Price, band, direction, confidence and the five strongest drivers of rows with predicted_return and close."""
    r, v = F.col("predicted_return"), daily_volatility() * horizon**0.5
    p = F.col("close") * F.exp(r)
    d = F.array(*[F.struct(F.abs(F.col(c)).alias("weight"), F.lit(c).alias("feature"), F.col(c).alias("value"), F.when(F.col(c) >= 0, "positive").otherwise("negative").alias("impact")) for c in drivers]) if drivers else F.array().cast("array<struct<weight:double,feature:string,value:double,impact:string>>")
    return df.select("symbol", "date", r, F.col("close").alias("current_price"), p.alias("predicted_price"), F.when(r >= 0, "UP").otherwise("DOWN").alias("direction"), clip(0.5 + F.abs(r) / F.nullif(v, F.lit(0.0)) / 4, 0.3, 0.9).alias("confidence"), (F.col("close") * F.exp(r - BAND * v)).alias("lower_band"), (F.col("close") * F.exp(r + BAND * v)).alias("upper_band"), F.slice(F.reverse(F.array_sort(d)), 1, 5).alias("causal_drivers"), F.lit(model).alias("model"), F.lit(horizon).alias("horizon_days"))


# The levels of the detector.
def detect_regime() -> Column:
    """A regime from the state of the market; missing inputs take their neutral values."""
    c = lambda n, v: F.coalesce(F.col(n), F.lit(v))
    vix = c("vix_level", 20.0)
    return F.when((vix > 30) & (c("vix_change_1d", 0.0) > 2), "crisis").when(c("yield_spread", 1.0) < -0.1, "rate_hike").when((c("vol_regime", 0.0) > 0.7) & (vix > 25), "recovery").when((vix < 20) & (c("sp500_return_1d", 0.0) > 0), "bull").otherwise("neutral")


def fit_direction(df: DataFrame, inputs: Sequence[str], target: str):
    """A logistic classifier of the direction, classes weighted to balance."""
    x = with_vector(df.withColumn("label", (F.col(target) >= 0).cast("double")), inputs)
    n = {r.label: r["count"] for r in x.groupBy("label").count().collect()}
    w = F.when(F.col("label") == 1, sum(n.values()) / (2 * n.get(1.0, 1))).otherwise(sum(n.values()) / (2 * n.get(0.0, 1)))
    return LogisticRegression(weightCol="weight", maxIter=100).fit(x.withColumn("weight", w))


def predict_direction(model, df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return model.transform(with_vector(df, inputs)).withColumn("p_up", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


class Ensemble:
    """Two tree learners and an autoregression on the training part, stacked on the validation part.

    Features are scaled once. The trees are fitted on about `sample_rows` rows at most (boosting.bounded), the ridge, the
    scaler and the autoregressions on all.
    """

    def __init__(self, features: Sequence[str], target: str, rounds: int = 500, depth: int = 6, sample_rows: int = boosting.SAMPLE_ROWS):
        self.features, self.target, self.rounds, self.depth, self.sample_rows = list(features), target, rounds, depth, sample_rows

    def fit(self, matrix: DataFrame) -> Ensemble:
        x = cut(chronological_split(matrix, [*self.features, self.target]).select("symbol", "date", "part", self.target, *self.features))
        self.scaler = cut(fit_scaler(x.filter("part = 'train'"), self.features))
        z = apply_scaler(x, self.scaler).withColumn("is_validation", F.col("part") == "validation").withColumn("y", F.col(self.target))
        two = {n: replace(p, rounds=self.rounds, depth=self.depth) for n, p in (("a", boosting.LEAF_WISE), ("b", boosting.LEVEL_WISE))}
        got = boosting.fit_models(z.filter("part != 'test'"), self.features, "y", "is_validation", two, rows=self.sample_rows)
        self.a, self.b = got["a"], got["b"]
        v = self._raw(z.filter("part = 'validation'"), ar_forecasts(x.filter("part = 'train'"), self.target))
        self.weights, self.intercept = fit_ridge(v, list(WEIGHTS), "y")
        self.ar = cut(ar_forecasts(x.filter("part != 'test'"), self.target))
        return self

    def _raw(self, z: DataFrame, ar: DataFrame) -> DataFrame:
        out = boosting.score(z, self.features, {"trees_a": self.a, "trees_b": self.b})
        return out.join(ar.select("symbol", F.col("forecast").alias("arima")), "symbol", "left")

    def _scaled(self, df: DataFrame) -> DataFrame:
        y = F.col(self.target) if self.target in df.columns else F.lit(None).cast("double")
        keep = df.withColumn("y", y.cast("double")).dropna(subset=self.features).select("symbol", "date", "y", *[F.col(c).cast("double") for c in self.features])
        return apply_scaler(keep, self.scaler)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self._raw(self._scaled(df), self.ar).withColumn("predicted_return", blend(self.weights, self.intercept))
        return out.select("symbol", "date", "trees_a", "trees_b", "arima", "predicted_return", (F.col("predicted_return") >= 0).cast("int").alias("direction_pred"), F.col("y").alias("actual_return"))

    def drivers(self, df: DataFrame, most: int = 5) -> DataFrame:
        """(symbol, date, causal_drivers): the features of the largest contributions to the leaf-wise trees' prediction,
        with their scaled values; a feature that the rows lack is 0."""
        have = df.withColumns({c: F.lit(0.0) for c in self.features if c not in df.columns})
        return boosting.drivers(self._scaled(have), self.features, self.a, most).select("symbol", "date", "causal_drivers")

    def save(self, path: str) -> None:
        self.ar.write.mode("overwrite").parquet(f"{path}/ar")
        self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
        about = {"features": self.features, "target": self.target, "weights": self.weights, "intercept": self.intercept}
        rows = [(json.dumps(about), self.a.to_json(), self.b.to_json())]
        self.ar.sparkSession.createDataFrame(rows, "about string, trees_a string, trees_b string").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        r = spark.read.parquet(f"{path}/about").first()
        about = json.loads(r.about)
        e = cls(about["features"], about["target"])
        e.a, e.b = boosting.Trees.from_json(r.trees_a), boosting.Trees.from_json(r.trees_b)
        e.ar, e.scaler = spark.read.parquet(f"{path}/ar"), spark.read.parquet(f"{path}/scaler")
        e.weights, e.intercept = about["weights"], about["intercept"]
        return e


def tune(matrix: DataFrame, features: Sequence[str], target: str, trials: int = 100, **kw) -> list[tuple[dict, float]]:
    """Parameters of the leaf-wise trees by directional accuracy on the validation part, best first."""
    x = chronological_split(matrix, [*features, target]).filter("part != 'test'").withColumn("is_validation", F.col("part") == "validation")
    return boosting.search(x, features, target, "is_validation", trials=trials, **kw)
