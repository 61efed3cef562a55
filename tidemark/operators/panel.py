"""Panels: one row per symbol and day, and the joins that align them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite
from tidemark.functions.times import day_of, epoch_us


def bars(prices: DataFrame) -> DataFrame:
    """(symbol, date, open, high, low, close, volume): of a day the row with the smallest bar_id whose close is a price.

    Missing highs and lows are made from open and close, a missing or impossible volume is 0. Reduced by a partial
    aggregation before the shuffle.
    """
    c = finite("close")
    rows = prices.withColumn("_day", day_of(epoch_us(prices, "date"))).filter((c > 0) & F.col("_day").isNotNull())
    best = rows.groupBy("symbol", "_day").agg(F.min(F.struct("bar_id", c.alias("c"), finite("open").alias("o"), finite("high").alias("h"), finite("low").alias("l"), finite("volume").alias("v"))).alias("b"))
    close, open_ = F.col("b.c"), F.coalesce("b.o", "b.c")
    return best.select(
        "symbol", F.col("_day").alias("date"), open_.alias("open"),
        F.coalesce("b.h", F.greatest(open_, close) * 1.005).alias("high"), F.coalesce("b.l", F.least(open_, close) * 0.995).alias("low"),
        close.alias("close"), F.when(F.col("b.v") >= 0, F.col("b.v")).otherwise(0.0).alias("volume"),
    )


def daily_last(readings: DataFrame, value: str = "close", tie: str = "reading_id") -> DataFrame:
    """(symbol, date, close): the day's last finite reading."""
    v = finite(value)
    x = readings.select("symbol", epoch_us(readings, "date").alias("us"), F.col(tie).alias("tie"), v.alias("v")).filter("v is not null and us is not null")
    return x.groupBy("symbol", day_of(F.col("us")).alias("date")).agg(F.max(F.struct("us", "tie", "v")).alias("m")).select("symbol", "date", F.col("m.v").alias("close"))


def market(panel: DataFrame) -> DataFrame:
    """(date, close): the mean close of all symbols, summed exactly."""
    return panel.groupBy("date").agg((F.sum(F.col("close").cast("decimal(20,6)")).cast("double") / F.count("close")).alias("close"))


def align(calendar: DataFrame, series: DataFrame, column: str, name: str) -> DataFrame:
    """The series (date, column) on each symbol's own calendar, carried forward; values on other days are lost.

    The series has one row a day, so it is broadcast: its size is that of the calendar.
    """
    x = calendar.join(F.broadcast(series.select("date", F.col(column).alias(name))), "date", "left")
    return x.withColumn(name, F.last(name, True).over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def spine(df: DataFrame, day: str = "date") -> DataFrame:
    """(date): every calendar day between the first and the last."""
    return df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("date"))


def last_event(rows: DataFrame, events: DataFrame, fields: list[str], lag_days: int = 0, on: str = "symbol") -> DataFrame:
    """rows with `event` (struct of date and fields): the latest event on or before the row's day.

    Events and rows are one sorted sequence, so the join is a single window over a union, without a range condition.
    """
    e = events.select(on, F.date_add("date", lag_days).alias("date"), F.struct("date", *fields).alias("_e"), F.lit(0).alias("_o"))
    r = rows.withColumn("_e", F.lit(None).cast(e.schema["_e"].dataType)).withColumn("_o", F.lit(1))
    w = Window.partitionBy(on).orderBy("date", "_o", "_e").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(e, allowMissingColumns=True).withColumn("event", F.last("_e", True).over(w)).filter("_o = 1").drop("_e", "_o")


def label_ranges(rows: DataFrame, ranges: list[tuple[str, str, str]], other: str = "other", day: str = "date", out: str = "regime") -> DataFrame:
    """Adds the name of the last range in the list that holds the day (both ends included).

    The ranges are configuration, a handful of rows, and become one expression.
    """
    label: Column = F.lit(other)
    for name, start, end in ranges:
        label = F.when(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(name)).otherwise(label)
    return rows.withColumn(out, label)


def wide(panel: DataFrame, names: list[str], value: str, key: str = "symbol") -> DataFrame:
    """(date, one column per name): full outer alignment of series as one aggregation instead of many joins."""
    return panel.groupBy("date").pivot(key, names).agg(F.first(value))
