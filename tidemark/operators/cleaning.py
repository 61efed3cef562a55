"""Cleaning of feature matrices whose schema depends on their values: profile in one pass, then project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.scalars import finite


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, nulls, null_ratio, is_constant): one aggregation over all columns. Constant: at most one value."""
    agg = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        agg += [F.sum(F.col(c).isNull().cast("long")).alias(f"_u{i}"), (F.min(c).eqNullSafe(F.max(c))).alias(f"_k{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), F.coalesce(f"_u{i}", F.lit(0).cast("long")).alias("nulls"), F.coalesce(F.try_divide(f"_u{i}", F.col("n")), F.lit(0.0)).alias("null_ratio"), F.col(f"_k{i}").alias("is_constant")) for i, c in enumerate(columns)])
    return df.agg(*agg).select(F.inline(rows))


def drop_tail(df: DataFrame, k: int) -> DataFrame:
    """Without the last k rows of each symbol."""
    return df if k <= 0 else df.withColumn("_t", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("_t") > k).drop("_t")


def clean_training(df: DataFrame, features: Sequence[str], leakage: Sequence[str] = (), tail: int = 5, max_null: float = 0.01) -> tuple[DataFrame, list[str], DataFrame]:
    """(matrix, kept features, report): leakage columns, the tail, sparse and constant columns go, then nulls become 0."""
    feats = [c for c in dict.fromkeys(features) if c not in leakage and c in df.columns]
    x = drop_tail(df.drop(*leakage), tail)
    report = profile(x, feats).withColumn("dropped", (F.col("null_ratio") > max_null) | F.col("is_constant"))
    keep = [r["column"] for r in report.filter("not dropped").select("column").collect()]  # one row per column
    keep = [c for c in feats if c in set(keep)]
    others = [c for c in x.columns if c not in feats]
    return x.select(*others, *keep).fillna(0.0, keep), keep, report


def clean_live(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nothing is dropped; nulls become 0, absent features are added as 0."""
    return df.select(*[c for c in df.columns if c not in features], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


def clean_conservative(df: DataFrame, columns: Sequence[str], allow_backfill: bool = True) -> DataFrame:
    """Infinite values are missing; gaps are filled forward, then (optionally, with later values) backward, then by
    the symbol's exact median."""
    x = df.withColumns({c: finite(c) for c in columns})
    x = x.withColumns({c: w.fill_forward(c) for c in columns})
    if allow_backfill:
        x = x.withColumns({c: w.fill_backward(c) for c in columns})
    m = df.groupBy("symbol").agg(*[F.percentile(finite(c), 0.5).alias(f"_m_{c}") for c in columns])
    return x.join(m, "symbol", "left").withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def require_rows(df: DataFrame, least: int = 200) -> DataFrame:
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows after engineering; at least {least} are needed")
    return df
