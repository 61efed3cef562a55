import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import rolling_state as rs

SCHEMA = "symbol string, date date, article_count long, sentiment_score double, loaded_at timestamp, entity string, n int, version int"


def frame(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, None if d is None else t0.date() + dt.timedelta(d), a, x, None if at is None else t0 + dt.timedelta(hours=at), "clash", 5, 9) for s, d, a, x, at in rows], SCHEMA)


def brute(rows):
    held = {}
    for s, d, a, x, at in rows:
        if d is not None:
            x = None if x is not None and x != x else x
            k = (at is not None, at or 0, a is not None, a or 0, x is not None, x or 0)
            if (s, d) not in held or k > held[s, d][0]:
                held[s, d] = (k, a, x)
    out = {}
    for s in {s for s, _ in held}:
        days = [d for t, d in held if t == s]
        for d in range(min(days), max(days) + 1):
            for k in rs.WINDOWS:
                w = [held[s, e] for e in range(d - k + 1, d + 1) if (s, e) in held]
                xs = [h[2] for h in w if h[2] is not None]
                out[s, d, k] = (sum(h[1] or 0 for h in w), round(sum(xs) / len(xs), 9) if xs else None)
    return out


def collected(df):
    base = dt.date(2024, 1, 1)
    return {(r.entity, (r.on_day - base).days, k): (r[f"articles_{k}"], None if r[f"mean_score_{k}"] is None else round(r[f"mean_score_{k}"], 9)) for r in df.collect() for k in rs.WINDOWS}


def test_history_with_corrections_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice(["A", "B", None]), r.randrange(50), r.choice([None, 0, 3, 8]), r.choice([None, 0.25, -0.5, float("nan")]), r.randrange(999)) for _ in range(120)]
    rows += [("A", None, 1, 1.0, 1), ("C", 5, 2, 0.5, None), ("C", 5, 3, 0.5, 4), ("C", 5, 3, 0.5, 4)]
    df = rs.rolling_state(frame(spark, rows))
    assert collected(df) == brute(rows)
    touched = df.groupBy("version").count().collect()
    assert {1, 2} <= {t.version for t in touched}  # days no correction touches keep version 1
    on = {(r.entity, r.n): r.version for r in df.filter("entity = 'C'").collect()}
    assert list(on.values()) == [2]


def test_corrections_touch_only_their_windows(spark):
    days = spark.createDataFrame([("A", d, 1, 0) for d in range(100)], "entity string, n int, articles long, scored long").withColumn("score", F.lit(0).cast(rs.EXACT))
    state = rs.build(days)
    change = spark.createDataFrame([("A", 40, 5, 0)], "entity string, n int, articles long, scored long").withColumn("score", F.lit(0).cast(rs.EXACT))
    new = rs.correct(state, change, 7)
    assert sorted(r.n for r in new.filter("version = 7").collect()) == list(range(40, 70))
    rows = {r.n: r for r in new.collect()}
    assert rows[42].articles_3 == 8 and rows[43].articles_3 == 3 and rows[69].articles_30 == 35 and rows[70].articles_30 == 30


def test_advance_equals_rebuilding(spark):
    make = lambda n: spark.createDataFrame([("A", d, d % 4, 0) for d in range(n)], "entity string, n int, articles long, scored long").withColumn("score", F.lit(0).cast(rs.EXACT))
    arrivals = make(41).filter("n = 40").drop("n")
    got = rs.advance(rs.build(make(40)), arrivals, 40, 2).first()
    want = rs.build(make(41)).filter("n = 40").first()
    assert all(got[f"articles_{k}"] == want[f"articles_{k}"] for k in rs.WINDOWS)


def test_day_by_day_equals_the_whole(spark):
    """A state kept by advance alone, from the first day on, against the one built at once."""
    r = random.Random(5)
    rows = [(e, d, r.randrange(5), r.choice([0, 1])) for e in "AB" for d in range(40) if r.random() < 0.6 or d == 0]
    daily = spark.createDataFrame(rows, "entity string, n int, articles long, scored long").withColumn("score", F.lit(1).cast(rs.EXACT))
    state = rs.build(daily.filter("n = 0"))
    for d in range(1, 9):
        state = state.unionByName(rs.advance(state, daily.filter(f"n = {d}").drop("n"), d, 1))
    key = lambda df: sorted((x.entity, x.n, *[x[f"{m}_{k}"] for m in rs.MEASURES for k in rs.WINDOWS]) for x in df.filter("n < 9").collect())
    marks = daily.filter("n < 9").unionByName(daily.filter("n = 0").withColumns({"n": F.lit(9), "articles": F.lit(0).cast("long")}))
    assert key(state) == key(rs.build(marks))


def test_empty(spark):
    assert rs.rolling_state(frame(spark, [])).count() == 0
