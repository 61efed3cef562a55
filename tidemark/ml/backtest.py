"""Backtests that train: by regime, walking forward, retraining, and ensembles per regime with routing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.ml import evaluate
from tidemark.ml.models import Ensemble, detect_regime
from tidemark.runtime import cut
from tidemark.sources.files import promote

Make = Callable[[], Ensemble]


def _scored(e: Ensemble, test: DataFrame) -> DataFrame:
    return e.predict(test).select("symbol", "date", F.col("predicted_return").alias("y_pred"), F.col("actual_return").alias("y_true"))


def _rows(df: DataFrame, at_most: int) -> int:
    return df.limit(at_most).count()


def regime_backtest(matrix: DataFrame, variants: dict[str, Make], regimes=evaluate.US_REGIMES, least_test: int = 60, least_train: int = 200, embargo_rows: int = 1) -> DataFrame:
    """(model, regime, scores): each variant trained on the rows before a regime and scored within it.

    Regimes with too few rows are left out. A variant `random` of hashed signs stands beside the others. Predictions are
    materialised per run, so that runs stay independent.
    """
    out = None
    for name, start, end in regimes:
        train, test = evaluate.pre_regime_train(matrix, start, embargo_rows), matrix.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        if _rows(test, least_test) < least_test or _rows(train, least_train) < least_train:
            continue
        for model, make in variants.items():
            p = cut(_scored(make().fit(train), test).select(F.lit(model).alias("model"), F.lit(name).alias("regime"), "*"))
            out = p if out is None else out.unionByName(p)
    if out is None:
        return None
    sign = F.when(F.xxhash64("symbol", "date", F.lit(42)) >= 0, 1.0).otherwise(-1.0)
    chance = out.filter(F.col("model") == next(iter(variants))).withColumns({"model": F.lit("random"), "y_pred": sign * F.abs("y_true")})
    return evaluate.metrics(out.unionByName(chance), ("model", "regime"))


def walk_forward(matrix: DataFrame, make: Make, train_years: int = 3, step_months: int = 3, least_train: int = 200, least_test: int = 60) -> DataFrame | None:
    """(window, scores): expanding training, tests right after it; windows with too few rows are skipped."""
    lo, hi = matrix.agg(F.min("date"), F.max("date")).first()
    if lo is None:
        return None
    w = evaluate.walk_forward_windows(lo, hi, train_years, step_months)
    if not w:
        return None
    used = {r.window for r in evaluate.walk_forward_sizes(matrix, w, least_train, least_test).collect() if r.used}
    out = None
    for i, end, test_end in w:
        if i in used:
            train, test = matrix.filter(F.col("date") <= F.lit(end)), matrix.filter((F.col("date") > F.lit(end)) & (F.col("date") <= F.lit(test_end)))
            p = cut(_scored(make().fit(train), test).withColumn("window", F.lit(i)))
            out = p if out is None else out.unionByName(p)
    return None if out is None else evaluate.metrics(out, ("window",))


def retrain(matrix: DataFrame, make: Make, last_trained: dt.date, as_of: dt.date, path: str | None = None, step_months: int = 3, limit_months: int = 6) -> tuple[bool, dict[int, float]]:
    """(whether it was due, accuracy per window on the window that follows); models are saved under path/window=N."""
    if evaluate.add_months(last_trained, limit_months) >= as_of:
        return False, {}
    lo, hi = matrix.agg(F.min("date"), F.max("date")).first()
    scores = {}
    for i, end, test_end in evaluate.walk_forward_windows(lo, hi, 3, step_months):
        e = make().fit(matrix.filter(F.col("date") <= F.lit(end)))
        test = matrix.filter((F.col("date") > F.lit(end)) & (F.col("date") <= F.lit(test_end)))
        r = _scored(e, test).agg(evaluate.directional_accuracy(F.col("y_pred"), F.col("y_true"))).first()[0]
        if r is not None:
            scores[i] = r
            if path:
                e.save(f"{path}/window={i}")
    if path and scores:
        promote(matrix.sparkSession, {f"{path}/window={i}": v for i, v in scores.items()}, f"{path}/best")
    return True, scores


def promoted(spark: SparkSession, path: str) -> Ensemble:
    """The model that the last retraining under the path promoted: that of the best window."""
    return Ensemble.load(spark, spark.read.json(f"{path}/best").first().path)


class RegimeEnsembles:
    """One ensemble per regime with enough rows, and one for all; rows go to the ensemble of their detected regime.

    `names` maps what the detector says to the regimes trained; what is not mapped or not trained goes to all.
    """

    def __init__(self, make: Make, names: dict[str, str], least_rows: int = 200):
        self.make, self.names, self.least_rows = make, names, least_rows

    def fit(self, matrix: DataFrame, regimes=evaluate.US_REGIMES) -> RegimeEnsembles:
        self.all = self.make().fit(matrix)
        self.by: dict[str, Ensemble] = {}
        for name, start, end in regimes:
            x = matrix.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            if _rows(x, self.least_rows) >= self.least_rows:
                self.by[name] = self.make().fit(x)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        to = F.create_map(*[F.lit(v) for kv in self.names.items() for v in kv]) if self.names else F.create_map()
        x = df.withColumn("_to", F.coalesce(F.try_element_at(to, detect_regime()), F.lit(""))) if self.names else df.withColumn("_to", F.lit(""))
        out = self.all.predict(x.filter(~F.col("_to").isin(*self.by) if self.by else F.lit(True))).withColumn("routed_to", F.lit("all"))
        for name, e in self.by.items():
            out = out.unionByName(e.predict(x.filter(F.col("_to") == name)).withColumn("routed_to", F.lit(name)))
        return out


def compare(results: DataFrame, models: Sequence[str] = ()) -> DataFrame:
    """Directional accuracy of models by regimes, as percentages."""
    return evaluate.comparison(results if not models else results.filter(F.col("model").isin(*models)))
