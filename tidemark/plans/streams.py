"""Queries that run a stream to its end and give its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import ensure_checkpoint_dir
from tidemark.sources.tables import table
from tidemark.streaming import daily

QUERIES: dict = {}
SQL: dict[str, str] = {}


def stream_daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """Everything that has landed, through a watermarked stream; state and table lie in the shared folder."""
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = daily.daily_bars(daily.landed(spark, f"{d}/event[s].parquet", schema), "event_type", "ts", "value", "2 days")
    daily.run_to_table(stream, f"{at}/state", f"{at}/table")
    return daily.latest(spark, f"{at}/table").select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "n")


QUERIES["stream_daily_bars"] = stream_daily_bars
SQL["stream_daily_bars"] = "select event_type as symbol, strftime(ts, '%Y-%m-%d') as date, arg_min(value, struct_pack(t := ts, v := value)) as open, max(value) as high, min(value) as low, arg_max(value, struct_pack(t := ts, v := value)) as close, count(*) as n from events group by 1, 2"
