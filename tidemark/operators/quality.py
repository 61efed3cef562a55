"""Data-quality suites: all counters of a suite are one aggregation, its findings are rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as w

COLUMNS = "check string, severity string, column string, value double, passed boolean"


def _absent(df: DataFrame, required: Sequence[str], severity: str) -> list[tuple]:
    return [("missing_column", severity, c, 1.0, False) for c in required if c not in df.columns]


def run_suite(
    df: DataFrame,
    required: Sequence[str] = (),
    missing_severity: str = "error",
    max_null: float | None = 0.05,
    least_rows: int | None = 200,
    max_gap_days: int | None = 10,
    stale_after: int | None = None,
    as_of: str | None = None,
    positive: Sequence[str] = (),
    max_change: tuple[str, float] | None = None,
    volume: str | None = None,
    bounded: tuple[str, float, float] | None = None,
    no_infinite: bool = False,
    no_constant: bool = False,
) -> DataFrame:
    """(check, severity, column, value, passed). An empty table yields the one error `empty`."""
    spark = df.sparkSession
    has = [c for c in required if c in df.columns]
    numeric = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    x, agg, out = df, [F.count("*").alias("n")], []

    def add(check: str, severity: str, column: str, value: Column, passed) -> None:
        name = f"_v{len(out)}"
        agg.append(value.cast("double").alias(name))
        out.append(F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(column).alias("column"), F.coalesce(name, F.lit(0.0)).alias("value"), passed(F.coalesce(F.col(name), F.lit(0.0))).alias("passed")))

    if "date" in df.columns and "symbol" in df.columns:
        if max_gap_days is not None:
            x = x.withColumn("_gap", F.datediff("date", w.lag("date")))
        if max_change and max_change[0] in df.columns:
            x = x.withColumn("_change", F.abs(w.pct_change(max_change[0])))
    if max_null is not None:
        for c in has or numeric:
            add("null_ratio", "error", c, F.avg(F.col(c).isNull().cast("double")), lambda v: v <= max_null)
        total = sum((F.sum(F.col(c).isNull().cast("long")) for c in has or numeric), F.lit(0))
        add("any_null", "warning", "*", total, lambda v: v == 0)
    if least_rows is not None:
        add("row_count", "error", "*", F.count("*"), lambda v: v >= least_rows)
    if "_gap" in x.columns:
        add("date_gap", "warning", "date", F.max("_gap"), lambda v: v <= max_gap_days)
    if stale_after is not None and as_of:
        add("stale", "warning", "date", F.datediff(F.lit(as_of).cast("date"), F.max("date")), lambda v: v <= stale_after)
    for c in positive:
        if c in df.columns:
            add("non_positive", "error", c, F.count_if(F.col(c) <= 0), lambda v: v == 0)
    if "_change" in x.columns:
        add("large_change", "warning", max_change[0], F.count_if(F.col("_change") > max_change[1]), lambda v: v == 0)
    if volume and volume in df.columns:
        add("zero_volume", "warning", volume, F.count_if(F.col(volume) <= 0), lambda v: v == 0)
    if bounded and bounded[0] in df.columns:
        add("out_of_bounds", "error", bounded[0], F.count_if(~F.col(bounded[0]).between(bounded[1], bounded[2])), lambda v: v == 0)
    if no_infinite:
        for c in numeric:
            add("infinite", "error", c, F.count_if(F.abs(c) == float("inf")), lambda v: v == 0)
    if no_constant:
        for c in numeric:
            add("constant", "warning", c, F.min(c).eqNullSafe(F.max(c)).cast("int"), lambda v: v == 0)
    fixed = _absent(df, required, missing_severity)
    if "date" in df.columns and dict(df.dtypes)["date"] != "date":
        fixed.append(("date_type", "error", "date", 1.0, False))
    absent = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("check", "severity", "column", "value", "passed"), r, strict=True)]) for r in fixed]) if fixed else None
    empty = F.array(F.struct(F.lit("empty").alias("check"), F.lit("error").alias("severity"), F.lit("*").alias("column"), F.lit(0.0).alias("value"), F.lit(False).alias("passed")))
    rows = F.array(*out) if out else None
    rows = absent if rows is None else rows if absent is None else F.concat(absent, rows)
    if rows is None:
        return spark.createDataFrame([], COLUMNS)
    return x.agg(*agg).select(F.inline(F.when(F.col("n") == 0, empty).otherwise(rows)))


def check_prices(df: DataFrame, as_of: str | None = None) -> DataFrame:
    return run_suite(df, ("open", "high", "low", "close", "volume"), stale_after=30, as_of=as_of, positive=("open", "high", "low", "close"), max_change=("close", 0.5), volume="volume")


def check_macro(df: DataFrame, as_of: str | None = None) -> DataFrame:
    return run_suite(df, ("close",), stale_after=30, as_of=as_of)


def check_sentiment(df: DataFrame) -> DataFrame:
    return run_suite(df, ("article_count", "avg_sentiment"), "warning", max_gap_days=None, bounded=("avg_sentiment", -1.0, 1.0))


def check_matrix(df: DataFrame, target: str) -> DataFrame:
    return run_suite(df, (target,), max_null=0.01, no_infinite=True, no_constant=True)


def check_any(df: DataFrame) -> DataFrame:
    return run_suite(df, least_rows=None, max_gap_days=None)


def enforce(report: DataFrame) -> DataFrame:
    """Raises with all failed errors joined."""
    bad = report.filter("severity = 'error' and not passed").collect()  # a row per check and column
    if bad:
        raise ValueError("; ".join(f"{r.check}({r.column})={r.value:g}" for r in bad))
    return report
