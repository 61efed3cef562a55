"""Instants as integers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 UTC. Timestamps without a zone are UTC; dates are their midnight."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        second = (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
        return F.unix_date(c.cast("date")).cast("long") * DAY_US + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second
    return F.unix_date(c.cast("date")).cast("long") * DAY_US


def day_of(us: Column) -> Column:
    """The UTC day of an instant, as a date."""
    return F.date_from_unix_date(F.floor(us / F.lit(DAY_US)).cast("int"))
