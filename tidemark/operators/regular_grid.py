"""Irregular readings onto a regular daily grid, filled by carrying the last reading forward.

Each source is cut into shards of a fixed number of days. A shard's first and last reading are summarised; a prefix
scan over the summaries carries the last reading before each shard (and the first after it) over its boundaries;
then all shards fill independently. Rows are reduced to one per source and day before anything is shuffled by
source, so a source is never larger than its calendar and a shard never larger than shard_days.

Defined cases: a null source is a source of its own; rows without a day are dropped. Days before the first reading
have no value (filled_from is null). A day is `missing` if no row of it has a reading. An empty table gives no grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_DAYS = 256


def fill_grid(daily: DataFrame, source: str, day: str, value: str, weekdays_only: bool = False, shard_days: int = SHARD_DAYS, bounds: DataFrame | None = None) -> DataFrame:
    """(source, on_day, value, missing, filled_from, next_day) for every day of each source's span.

    daily: at most one row per source and day; value null: no reading. The span is that of daily's rows, or of
    bounds(source, first_day, last_day).
    """
    x = daily.select(F.col(source).alias("source"), F.unix_date(day).alias("n"), F.col(value).alias("value")).filter("n is not null")
    x = x.withColumn("shard", F.floor(F.col("n") / shard_days))
    shards = x.groupBy("source", "shard").agg(
        F.min("n").alias("lo"),
        F.max("n").alias("hi"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("n", "value"))).alias("first"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("n", "value"))).alias("last"),
    )
    # prefix scan over the boundary states: a row per source and shard
    w = Window.partitionBy("source").orderBy("shard")
    ends = Window.partitionBy("source")
    s = shards.select(
        "source",
        "shard",
        F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("ahead"),
        F.lead("shard").over(w).alias("next_shard"),
        F.min("lo").over(ends).alias("lo"),
        F.max("hi").over(ends).alias("hi"),
        F.coalesce("last", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("out"),
    )
    # shards without any row take the state of the one before them
    s = s.select("source", "lo", "hi", F.explode(F.sequence("shard", F.coalesce(F.col("next_shard") - 1, F.col("shard")))).alias("to"), "shard", "carry", "ahead", "out", "next_shard")
    s = s.select("source", F.col("to").alias("shard"), "lo", "hi", F.when(F.col("to") == F.col("shard"), F.col("carry")).otherwise(F.col("out")).alias("carry"), "ahead")
    start, end = F.greatest(F.col("lo"), (F.col("shard") * shard_days).cast("int")), F.least(F.col("hi"), (F.col("shard") * shard_days + shard_days - 1).cast("int"))
    grid = s.withColumn("n", F.explode(F.sequence(start, end)))
    if weekdays_only:
        grid = grid.filter(F.pmod(F.col("n") + 3, F.lit(7)) < 5)  # day 0 was a Thursday
    # readings of a weekend still carry over, so they join in as rows without a place on the grid
    g = grid.select("source", "shard", "n", "carry", "ahead", F.lit(True).alias("on_grid"))
    r = x.select("source", "shard", "n", F.lit(None).cast(s.schema["carry"].dataType).alias("carry"), F.lit(None).cast(s.schema["ahead"].dataType).alias("ahead"), F.lit(False).alias("on_grid"), "value")
    both = g.withColumn("value", F.lit(None).cast(r.schema["value"].dataType)).unionByName(r)
    merged = both.groupBy("source", "shard", "n").agg(F.max("on_grid").alias("on_grid"), F.max("carry").alias("carry"), F.max("ahead").alias("ahead"), F.max("value").alias("value"))
    inside = Window.partitionBy("source", "shard").orderBy("n")
    here = F.when(F.col("value").isNotNull(), F.struct("n", "value"))
    carried = F.coalesce(F.last(here, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.last("carry", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.max("carry").over(Window.partitionBy("source", "shard")))
    later = F.coalesce(F.first(here, True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.max("ahead").over(Window.partitionBy("source", "shard")))
    out = merged.select("source", "n", "on_grid", carried.alias("c"), later.alias("l")).filter("on_grid")
    # a day is missing if what it shows was carried to it, or nothing was
    missing = F.coalesce(F.col("c.n") < F.col("n"), F.lit(True)).alias("missing")
    return out.select("source", F.date_from_unix_date("n").alias("on_day"), F.col("c.value").alias("value"), missing, F.date_from_unix_date("c.n").alias("filled_from"), F.date_from_unix_date("l.n").alias("next_day"))


def last_of_day(df: DataFrame, source: str, at_us: Column, value: str, tie: str) -> DataFrame:
    """(source, on_day, value): the day's last reading that is neither null nor NaN, ties by the largest `tie`;

    days whose rows hold no reading are left out.
    """
    v = F.col(value).cast("double")
    x = df.select(F.col(source).alias("source"), at_us.alias("us"), F.col(tie).alias("tie"), v.alias("value")).filter(v.isNotNull() & ~F.isnan(v) & F.col("us").isNotNull())
    day = F.date_from_unix_date(F.floor(F.col("us") / 86_400_000_000).cast("int"))
    return x.groupBy("source", day.alias("on_day")).agg(F.max(F.struct("us", "tie", "value")).alias("m")).select("source", "on_day", F.col("m.value").alias("value"))
