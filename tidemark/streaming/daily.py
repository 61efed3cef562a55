"""Daily bars and news from event streams, and the refresh of features by micro-batches.

Daily totals are updated until the watermark passes the day, whose state is then released; rows later than the watermark
are dropped by Spark, and the batch operators correct them (operators.rolling_state). Windows of rows are not available on streams, so features
are refreshed per micro-batch for the touched symbols only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def daily_bars(events: DataFrame, key: str, at: str, value: str, late: str = "1 day") -> DataFrame:
    """(symbol, date, open, high, low, close, n) per key and day of a stream (or a batch) of readings."""
    ts = F.col(at).cast("timestamp")
    x = events.select(F.col(key).alias("symbol"), ts.alias("ts"), F.col(value).alias("v"))
    x = x.withWatermark("ts", late) if events.isStreaming else x
    a = x.groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.min(F.struct("ts", "v")).alias("o"), F.max("v").alias("high"), F.min("v").alias("low"), F.max(F.struct("ts", "v")).alias("c"), F.count("*").alias("n"))
    return a.select("symbol", F.to_date("w.start").alias("date"), F.col("o.v").alias("open"), "high", "low", F.col("c.v").alias("close"), "n")


def refresh(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]):
    """Runs `step` on every micro-batch of what is there, then stops."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def run_to_table(stream: DataFrame, checkpoint: str, path: str, mode: str = "update") -> None:
    """Everything that has landed, aggregated to a Parquet table of changes; `latest` reads it.

    A batch writes the days it changed only, to its own folder, so a batch that is repeated replaces itself. The state
    of days that the watermark has passed is released. In append mode days are written once, when they close.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def latest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The rows of a table of changes as the last batch left them, reduced before the shuffle."""
    t = spark.read.parquet(path)
    rest = [c for c in t.columns if c not in (*keys, "batch")]
    return t.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])
