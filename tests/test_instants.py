import datetime as dt
import zoneinfo

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions.zones import clock_changes
from tidemark.operators import instants


def utc(*a):
    return (dt.datetime(*a, tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


CASES = [
    ("21-01-2008", "NY", utc(2008, 1, 21, 5)), (" 1-21-08\t", "NYm", utc(2008, 1, 21, 5)), ("13-01-2008", "NYm", None), ("1-02-19", "", None),
    ("2008-01-24 22:01:55 EST", "NY", utc(2008, 1, 25, 3, 1, 55)), ("2008-01-25 13:30:38 UTC", "NY", utc(2008, 1, 25, 13, 30, 38)), ("2008-01-25 13:30:38 gmt", None, utc(2008, 1, 25, 13, 30, 38)),
    ("1201058927535", None, utc(2008, 1, 23, 3, 28, 47, 535000)), ("1548057990671961", "NY", 1548057990671961), ("1200928241", "NY", utc(2008, 1, 21, 15, 10, 41)), ("1548057990671961999", "NY", 1548057990671961),
    ("2008-01-23T03:12-05:00", "NY", utc(2008, 1, 23, 8, 12)), ("2008-02-06T19:52:55-03:30", "NY", utc(2008, 2, 6, 23, 22, 55)), ("Mon, 21 Jan 2019 02:17:15 +0000", "NY", utc(2019, 1, 21, 2, 17, 15)),
    ("2008-01-21T06:24:34.735278489Z", "NY", utc(2008, 1, 21, 6, 24, 34, 735278)), ("20080121T135047Z", "NY", utc(2008, 1, 21, 13, 50, 47)), ("20080124 1409", "NY", utc(2008, 1, 24, 19, 9)), ("20080123", "NY", utc(2008, 1, 23, 5)),
    ("Jan 28, 2008 12:31 AM", "NY", utc(2008, 1, 28, 5, 31)), ("Jan 28, 2008 12:31 PM", "NY", utc(2008, 1, 28, 17, 31)), ("February 25, 2008", "NY", utc(2008, 2, 25, 5)), ("5 Mar 2008", "NY", utc(2008, 3, 5, 5)), ("21/1/19 5:47pm", "NY", utc(2019, 1, 21, 22, 47)),
    ("2008-03-09T02:41:34", "NY", None), ("2008-11-02T01:30:00", "NY", utc(2008, 11, 2, 5, 30)), ("2019-02-29", "NY", None), ("2020-02-29", "NY", utc(2020, 2, 29, 5)), ("2019-13-45", "NY", None), ("2021-06-31T10:00:00Z", "NY", None),
    ("2019-01-01 24:00:00", "NY", None), ("2019-01-01 13:00 PM", "NY", None), ("yesterday", "NY", None), ("", "NY", None), (None, "NY", None), ("--", "NY", None), ("12-2020", "NY", None), ("9" * 5000, "NY", None), ("21-01/2008", "NY", None), ("1969-12-31T23:59:59.5Z", None, -500000),
]


def test_forms(spark):
    feeds = spark.createDataFrame([("ny", "America/New_York", "dmy"), ("nym", "America/New_York", "mdy"), ("NY", "America/New_York", "dmy")], "feed string, tz_name string, day_order string")
    rows = spark.createDataFrame([(i, t, f and f" {f.lower()} ", "clash", "z", 0) for i, (t, f, _) in enumerate(CASES)], "id int, date string, feed string, tz_name string, day_order string, utc_us int")
    got = {r.id: r.utc_us for r in instants.normalise_instants(rows, feeds).collect()}
    assert {i: got[i] for i in got} == {i: w for i, (_, _, w) in enumerate(CASES)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2199, 1, 1)), min_size=1, max_size=60))
def test_day_arithmetic(spark, times):
    df = spark.createDataFrame([(i, t.isoformat() + "Z") for i, t in enumerate(times)], "id int, date string")
    got = {r.id: r.utc_us for r in instants.parse_instants(df, "date", None, None).collect()}
    assert got == {i: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for i, t in enumerate(times)}


def test_a_filter_does_not_multiply_the_plan(spark):
    df = spark.createDataFrame([("2020-01-01", "UTC", "dmy")], "date string, z string, o string")
    plan = instants.parse_instants(df, "date", "z", "o").filter("utc_us is not null")._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 50_000


ZONES = ["America/Sao_Paulo", "America/Havana", "America/St_Johns", "Asia/Beirut", "Africa/Casablanca", "Australia/Lord_Howe", "Europe/Chisinau", "Europe/Dublin", "Pacific/Apia", "UTC"]


def test_local_times_around_all_clock_changes(spark):
    """Every half hour around each change of ten zones, and the dates themselves, against the zone database directly."""
    rows, want = [], {}
    for name in ZONES:
        z = zoneinfo.ZoneInfo(name)
        for t, before, _ in clock_changes(name)[1]:
            if not 1_199_145_600 <= t < 1_735_689_600:
                continue
            middle = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t + before)
            for k in range(-6, 7):
                local = (middle + dt.timedelta(minutes=30 * k)).replace(second=0, microsecond=250_000)
                u = local.replace(tzinfo=z, fold=0).astimezone(dt.UTC)
                want[len(rows)] = (u - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1) if u.astimezone(z).replace(tzinfo=None) == local else None
                rows.append((len(rows), local.isoformat(), name))
            day = middle.replace(hour=0, minute=0, second=0, microsecond=0)
            u = day.replace(tzinfo=z, fold=0).astimezone(dt.UTC)
            back = u.astimezone(z).replace(tzinfo=None)
            if name != "Pacific/Apia":  # it skipped a whole day
                assert back.date() == day.date()
                want[len(rows)] = (u - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
                rows.append((len(rows), day.date().isoformat(), name))
    assert len(rows) > 3000
    df = spark.createDataFrame(rows, "id int, date string, z string")
    got = {r.id: r.utc_us for r in instants.parse_instants(df, "date", "z", None).collect()}
    assert {i: (rows[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_numeric_abbreviations_mean_the_zone_itself(spark):
    zone = "America/Sao_Paulo"  # 2018-02-17 23:30 occurs twice, 2018-11-04 has no midnight
    cases = [("2018-02-17 23:30:00 -03", utc(2018, 2, 18, 1, 30)), ("2018-02-17 23:30:00 -02", utc(2018, 2, 18, 1, 30)), ("2018-02-17 23:30:00-03:00", utc(2018, 2, 18, 2, 30)), ("2018-02-17 23:30:00 +05", utc(2018, 2, 17, 18, 30)), ("2018-06-01 10:00:00 -03", utc(2018, 6, 1, 13)), ("2018-11-04", utc(2018, 11, 4, 3)), ("2018-11-04 00:30", None)]
    df = spark.createDataFrame([(i, t, zone) for i, (t, _) in enumerate(cases)] + [(99, "2018-06-01 10:00", "No/Such")], "id int, date string, z string")
    got = {r.id: r.utc_us for r in instants.parse_instants(df, "date", "z", None).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)} | {99: None}


def test_empty(spark):
    rows = spark.createDataFrame([], "date string, feed string")
    feeds = spark.createDataFrame([], "feed string, tz_name string, day_order string")
    assert instants.normalise_instants(rows, feeds).count() == 0
