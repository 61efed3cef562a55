import datetime as dt

import pytest

from tidemark.functions.times import epoch_us
from tidemark.operators import regular_grid as g

DAY = dt.date(2024, 1, 1)  # a Monday


def rows(df):
    return {(r.source, (r.on_day - DAY).days): (r.value, r.missing, None if r.filled_from is None else (r.filled_from - DAY).days) for r in df.collect()}


@pytest.mark.parametrize("shard", [2, 7, 500])
def test_fill_over_shards(spark, shard):
    data = [("A", 0, None), ("A", 1, 5.0), ("A", 9, 7.0), ("A", 20, None), ("B", 3, 1.0), (None, 4, 2.0), ("A", None, 1.0)]
    df = spark.createDataFrame([(s, None if d is None else DAY + dt.timedelta(d), v, 1, "x") for s, d, v in data], "source string, on_day date, value double, n int, shard string")
    got = rows(g.fill_grid(df, "source", "on_day", "value", shard_days=shard))
    want = {("A", 0): (None, True, None), ("B", 3): (1.0, False, 3), (None, 4): (2.0, False, 4)}
    want |= {("A", d): (5.0, d != 1, 1) for d in range(1, 9)} | {("A", d): (7.0, d != 9, 9) for d in range(9, 21)}
    assert got == want


@pytest.mark.parametrize("shard", [3, 500])
def test_weekdays_carry_weekend_readings(spark, shard):
    df = spark.createDataFrame([("A", DAY, 1.0), ("A", DAY + dt.timedelta(5), 2.0), ("A", DAY + dt.timedelta(8), 3.0)], "source string, on_day date, value double")
    got = rows(g.fill_grid(df, "source", "on_day", "value", weekdays_only=True, shard_days=shard))
    assert got == {("A", 0): (1.0, False, 0), **{("A", d): (1.0, True, 0) for d in range(1, 5)}, ("A", 7): (2.0, True, 5), ("A", 8): (3.0, False, 8)}


def test_last_reading_of_a_day(spark):
    t = dt.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame([(1, "A", t, 1.0), (2, "A", t, 2.0), (3, "A", t + dt.timedelta(hours=1), float("nan")), (4, "A", None, 9.0), (5, "B", t, None)], "id long, symbol string, date timestamp, close double")
    assert [(r.source, r.value) for r in g.last_of_day(df, "symbol", epoch_us(df, "date"), "close", "id").collect()] == [("A", 2.0)]


def test_empty(spark):
    df = spark.createDataFrame([], "source string, on_day date, value double")
    assert g.fill_grid(df, "source", "on_day", "value").count() == 0


def test_found_days_come_from_the_carry(spark):
    df = spark.createDataFrame([("A", DAY, 1.0), ("A", DAY + dt.timedelta(8), 3.0)], "source string, on_day date, value double")
    plan = g.fill_grid(df, "source", "on_day", "value").filter("missing").select("source", "on_day")._jdf.queryExecution().optimizedPlan().toString()
    assert "carry" in plan and "last(" in plan
