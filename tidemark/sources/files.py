"""Sources with explicit schemas, and sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.scalars import substitute_env, surprise

PRICES = "symbol string, date date, open double, high double, low double, close double, volume double"
MACRO = "symbol string, date date, close double"
SENTIMENT = "symbol string, date date, avg_sentiment double, article_count long"
NEWS = "datetime long, headline string"
REPORTS = "period date, actual double, estimate double, surprisePercent double"
CHAIN = "expiry date, kind string, strike double, iv double"


def read(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "csv", columns: Sequence[str] | None = None) -> DataFrame:
    """Landed files under an explicit schema. A missing path raises; columns not in the schema are skipped."""
    r = spark.read.schema(schema).option("mode", "PERMISSIVE")
    df = r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """(date, headline) of JSON items with epoch seconds, in UTC whatever the session's zone."""
    x = spark.read.schema(NEWS).json(path)
    return x.select(F.date_from_unix_date(F.floor(F.coalesce("datetime", F.lit(0)) / 86_400).cast("int")).alias("date"), F.coalesce("headline", F.lit("")).alias("headline"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema(REPORTS).json(path)
    return x.select(F.col("period").alias("date"), F.col("actual").alias("actual_eps"), F.col("estimate").alias("estimate_eps"), surprise("actual", "estimate", "surprisePercent").alias("surprise_pct"))


def fetch_windows(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """(start, end) of the windows in which a range is fetched; the next begins a day after the one before."""
    s = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval {days + 1} days)) as start")
    return s.withColumn("end", F.least(F.date_add("start", days), F.lit(end).cast("date")))


def live(df: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return df.filter((F.col("date") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("date") <= F.lit(as_of).cast("date")))


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("symbol", "date")) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def write_matrix(df: DataFrame, path: str, suffix: str = "") -> None:
    """The matrix partitioned by symbol, so that a reader of one symbol prunes the rest."""
    df.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").parquet(path + suffix)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_config(path: str) -> dict:
    """A JSON or YAML configuration (by the file's ending) with ${NAME} taken from the environment."""
    with open(os.path.expanduser(path)) as f:
        text = substitute_env(f.read())
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("a YAML configuration needs the yaml package; use JSON") from e
    return yaml.safe_load(text) or {}


def promote(spark: SparkSession, candidates: dict[str, float], pointer: str) -> str:
    """Points at the best-scored of several saved runs."""
    best = min(candidates, key=lambda k: (-candidates[k], k))
    spark.createDataFrame([(best, candidates[best])], "path string, score double").coalesce(1).write.mode("overwrite").json(pointer)
    return best
