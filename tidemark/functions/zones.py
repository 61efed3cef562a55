"""Clock rules of time zones as a table, so that local times become instants by integer arithmetic alone.

The rules come from the driver's zone database, once: all executors use the same version of it, whatever their JVMs
hold. The table has a row per zone and local year, so its size is bounded by the zone database (some 600 zones).
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1900, 2100
_UTC, _EPOCH = dt.timezone.utc, dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_STEP = dt.timedelta(days=7)  # no zone changes its clock twice within a week


def _offset(zone: zoneinfo.ZoneInfo, t: dt.datetime) -> int:
    return int(t.astimezone(zone).utcoffset().total_seconds())


@functools.lru_cache(maxsize=1024)
def clock_changes(name: str) -> tuple[int, tuple[tuple[int, int, int], ...]]:
    """(first offset, ((second of the change in UTC, offset before, offset after), ...)) of a zone, in seconds."""
    zone = zoneinfo.ZoneInfo(name)
    t, end = dt.datetime(FIRST_YEAR - 1, 12, 1, tzinfo=_UTC), dt.datetime(LAST_YEAR + 1, 2, 1, tzinfo=_UTC)
    first = now = _offset(zone, t)
    found = []
    while t < end:
        after = _offset(zone, t + _STEP)
        if after != now:
            lo, hi = t, t + _STEP
            while hi - lo > dt.timedelta(seconds=1):
                mid = lo + dt.timedelta(seconds=(hi - lo) // dt.timedelta(seconds=1) // 2)
                lo, hi = (mid, hi) if _offset(zone, mid) == now else (lo, mid)
            found.append(((hi - _EPOCH) // dt.timedelta(seconds=1), now, after))
            now = after
        t += _STEP
    return first, tuple(found)


def year_rules(name: str) -> list[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """(zone, local year, offset at its start, the year's changes as (local second before, local second after, offset
    after)). A change whose skipped or repeated hour reaches into the year belongs to it."""
    offset, changes = clock_changes(name)
    out = []
    for y in range(FIRST_YEAR, LAST_YEAR + 1):
        lo, hi = ((dt.datetime(v, 1, 1, tzinfo=_UTC) - _EPOCH) // dt.timedelta(seconds=1) for v in (y, y + 1))
        mine = [(t + a, t + b, b) for t, a, b in changes if max(t + a, t + b) > lo and min(t + a, t + b) < hi]
        start = next((a for t, a, b in changes if max(t + a, t + b) > lo), changes[-1][2] if changes else offset)
        out.append((name, y, start, mine))
    return out


def rules_table(spark: SparkSession, names: list[str]) -> tuple[DataFrame, int]:
    """((zone, year, off0, before1, after1, off1, ...) in microseconds, the most changes of a year)."""
    rows = [r for n in sorted(set(names)) for r in year_rules(n)]
    slots = max([len(m) for *_, m in rows], default=0)
    flat = [(z, y, o * 1_000_000, *[v for k in range(slots) for v in ([x * 1_000_000 for x in m[k]] if k < len(m) else [None] * 3)]) for z, y, o, m in rows]
    schema = "zone string, year int, off0 long" + "".join(f", before{k} long, after{k} long, off{k} long" for k in range(1, slots + 1))
    return spark.createDataFrame(flat, schema), slots


def known_zones(df: DataFrame, zone: str) -> list[str]:
    """The distinct names in use that the zone database has: a list bounded by the database."""
    known = sorted(zoneinfo.available_timezones())
    return [r[0] for r in df.filter(F.col(zone).isin(known)).select(zone).distinct().collect()]


def earliest_instant(local: Column, slots: int, skipped_is_end: Column) -> Column:
    """The earlier instant of a local time under the joined rules; null if the clock skipped it, or, where
    skipped_is_end holds, the moment of the change."""
    out = None
    for k in range(slots + 1):
        off = F.col(f"off{k}")
        if k:
            out = out.when(local < F.col(f"after{k}"), F.when(skipped_is_end, F.col(f"after{k}") - off))
        here = F.col(f"before{k + 1}").isNull() | (local < F.col(f"before{k + 1}")) if k < slots else F.lit(True)
        out = F.when(here, local - off) if out is None else out.when(here, local - off)
    return out


def latest_instant(local: Column, slots: int) -> Column:
    """The later instant of a local time that occurs twice, else its only one (meaningless for skipped ones)."""
    out = None
    for k in range(slots + 1):
        off = F.col(f"off{k}")
        here = F.col(f"before{k + 1}").isNull() | (local < F.least(f"before{k + 1}", f"after{k + 1}")) if k < slots else F.lit(True)
        out = F.when(here, local - off) if out is None else out.when(here, local - off)
    return out
