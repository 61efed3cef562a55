import datetime as dt
import random

import pytest

from tidemark.llm import nearest as n

T0 = dt.datetime(2024, 1, 1)
L, R = "report_id long, symbol string, date timestamp, b long, key string, cid long", "bar_id long, symbol string, date timestamp, t long, n long"


def run(spark, left, right, tol=3_600_000_000):
    us = lambda t: None if t is None else T0 + dt.timedelta(microseconds=t)
    a = spark.createDataFrame([(i, s, us(t), 1, "x", 2) for i, s, t in left], L)
    b = spark.createDataFrame([(i, s, us(t), 1, 2) for i, s, t in right], R)
    got = n.nearest(a, b, tol, "report_id", "bar_id", "symbol", "symbol", "date", "date").collect()
    assert len({r.report_id for r in got}) == len(got)
    return {r.report_id: r.bar_id for r in got}


def brute(left, right, tol=3_600_000_000):
    key = lambda s: s.strip().upper()
    out = {}
    for i, s, t in left:
        c = [(abs(u - t), u, j) for j, r, u in right if s is not None and r is not None and t is not None and u is not None and key(r) == key(s) and abs(u - t) <= tol]
        if c:
            out[i] = min(c)[2]
    return out


@pytest.mark.parametrize("direct", [1, 2, 64])
def test_against_brute_force_with_a_hot_bucket(spark, direct, monkeypatch):
    monkeypatch.setattr(n, "DIRECT", direct)
    monkeypatch.setattr(n, "FAN", 16)
    r = random.Random(5)
    # a third of the rows lies within one bucket of one entity, some within the same millisecond
    times = lambda k: [r.choice([r.randrange(10**12), 5 * 10**11 + r.randrange(10**9), 5 * 10**11 + r.randrange(1000)]) for _ in range(k)]
    right = [(i, r.choice([" a", "A ", "b", None]), t) for i, t in enumerate(times(160))]
    left = [(i, r.choice(["A", "B ", "c", None]), t) for i, t in enumerate(times(90))] + [(900, "A", None), (901, "a", right[0][2])]
    assert run(spark, left, right) == brute(left, right)


def test_ties_edges_and_repeats(spark):
    h = 3_600_000_000
    right = [(5, "A", 10 * h), (4, "A", 10 * h), (9, "A", 12 * h), (7, "B", 0)]
    left = [(1, "A", 11 * h), (2, "A", 11 * h), (3, "A", 9 * h), (4, "A", 9 * h - 1), (5, "A", 13 * h), (6, "A", 13 * h + 1), (7, "B", -h), (8, "B", -h - 1)]
    assert run(spark, left, right) == {1: 4, 2: 4, 3: 4, 5: 9, 7: 7} == brute(left, right)


def test_empty(spark):
    assert run(spark, [], [(1, "A", 0)]) == {} == run(spark, [(1, "A", 0)], [])
