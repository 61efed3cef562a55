"""Trailing totals per entity and calendar day, kept as a versioned daily state.

The state has a row per entity and day, also for days without activity, with the totals of each trailing window.
A day's total is yesterday's plus the day's arrivals less the amount that expires (the one of n days ago). Over a
history (`build`) that is one sorted pass per entity: a running sum of arrivals less expiries. `advance` takes the
state one day further by joining yesterday's totals with the day's arrivals and the expiring amounts, and reads
no more than the last days of the state. `rolling_state` builds all days but the newest and advances to that one.

Versions: a late or changed row is a correction. In `build` a day's amounts are those of the version that holds, and
`version` is 1 plus the number of corrected days among those that the longest window holds; `correct` applies further
corrections to a state: it adds the differences to the days whose windows hold them and gives these a new version, all
other rows stay as they are.

Rows are reduced to one per entity and day before the first shuffle by entity, so that an entity has no more rows
than its calendar has days, however many rows arrived.

Defined cases: of several rows of an entity and day the one with the latest load time holds (ties: the largest
values; a null load time is the earliest). Null amounts count as nothing; a mean over a window without scores is
null. NaN and infinite scores are no scores; scores are held to eight decimals. Rows without a day are dropped; a null entity is an entity of its own. Empty tables
give an empty state.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (3, 5, 7, 30)
#: Summed per window: articles, scores, and the number of days with a score.
MEASURES = ("articles", "score", "scored")
#: Scores are summed as decimals, so that adding and later subtracting an amount leaves nothing behind.
EXACT = "decimal(20,8)"


def versions(df: DataFrame, entity: str, day: str, fields: list[str], loaded: str) -> DataFrame:
    """(entity, n, first, last): of each entity and day the first version that arrived and the one that holds."""
    clean = [F.nanvl(F.col(f), F.lit(None)).alias(f) if dict(df.dtypes)[f] in ("double", "float") else F.col(f) for f in fields]
    row = F.struct(F.col(loaded).alias("at"), *clean)
    return df.filter(F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity"), F.unix_date(F.col(day).cast("date")).alias("n")).agg(F.min(row).alias("first"), F.max(row).alias("last"))


def _amounts(side: str, articles: str, score: str) -> dict[str, Column]:
    a, s = F.col(f"{side}.{articles}"), F.col(f"{side}.{score}").try_cast(EXACT)
    return {"articles": F.coalesce(a, F.lit(0)).cast("long"), "score": F.coalesce(s, F.lit(0)).cast(EXACT), "scored": s.isNotNull().cast("long")}


def build(daily: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The state from daily(entity, n, articles, score, scored, and, if there are corrections, corrected: 0 or 1).

    One shuffle by entity. A day without a row follows from the row before it, so there is no join with a calendar.
    Further columns are carried along, null on days without a row (has_row).
    """
    extra = [c for c in daily.columns if c not in ("entity", "n", "corrected", *MEASURES)]
    x = daily if "corrected" in daily.columns else daily.withColumn("corrected", F.lit(0))
    w = Window.partitionBy("entity").orderBy("n")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", F.min("n").over(run).alias("lo"), F.max("n").over(Window.partitionBy("entity")).alias("hi"), F.lead("n").over(w).alias("next"))
    x = x.withColumn("day", F.explode(F.sequence("n", F.coalesce(F.col("next") - 1, F.col("n")))))
    here = F.col("day") == F.col("n")
    amounts = [F.when(here, F.col(m)).otherwise(F.lit(0)).cast(x.schema[m].dataType).alias(m) for m in (*MEASURES, "corrected")]
    x = x.select("entity", F.col("day").alias("n"), "lo", "hi", here.alias("has_row"), *amounts, *[F.when(here, F.col(c)).alias(c) for c in extra])
    expiring = {(m, k): F.coalesce(F.lag(m, k).over(w), F.lit(0)) for k in windows for m in MEASURES} | {("corrected", max(windows)): F.coalesce(F.lag("corrected", max(windows)).over(w), F.lit(0))}
    x = x.withColumns({f"_{m}_{k}": F.col(m) - e for (m, k), e in expiring.items()})
    x = x.withColumns({f"{m}_{k}": F.sum(f"_{m}_{k}").over(run) for m, k in expiring})
    x = x.withColumn("version", (F.col(f"corrected_{max(windows)}") + 1).cast("int"))
    return x.drop("corrected", f"corrected_{max(windows)}", *[c for c in x.columns if c.startswith("_")])


def correct(state: DataFrame, changes: DataFrame, version: int, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The state after changes(entity, n, articles, score, scored), given as differences to what the state holds.

    Only the days n .. n + longest window - 1 of changed entities are recomputed. Days must lie in the state's span.
    """
    longest = max(windows)
    hit = changes.select("entity", F.explode(F.sequence("n", F.col("n") + longest - 1)).alias("on"), "n", *MEASURES)
    age = F.col("on") - F.col("n")
    sums = [F.sum(F.when(age < k, F.col(m)).otherwise(0)).alias(f"d_{m}_{k}") for k in windows for m in MEASURES]
    own = [F.sum(F.when(age == 0, F.col(m)).otherwise(0)).alias(f"d_{m}") for m in MEASURES]
    delta = hit.groupBy("entity", F.col("on").alias("n")).agg(*sums, *own)
    names = [*MEASURES, *[f"{m}_{k}" for k in windows for m in MEASURES]]
    s, dd = state.alias("s"), delta.alias("d")
    x = s.join(dd, F.col("s.entity").eqNullSafe(F.col("d.entity")) & (F.col("s.n") == F.col("d.n")), "left")
    touched = F.col("d.n").isNotNull()
    return x.select(
        F.col("s.entity").alias("entity"), F.col("s.n").alias("n"), "lo", "hi",
        *[F.when(touched, F.col(f"s.{c}") + F.col(f"d_{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in names],
        F.when(touched, F.lit(version)).otherwise(F.col("version")).alias("version"),
        *[F.col(f"s.{c}") for c in state.columns if c not in ("entity", "n", "lo", "hi", "version", *names)],
    )


def advance(state: DataFrame, arrivals: DataFrame, day: int, version: int = 1, windows: tuple[int, ...] = WINDOWS, idle: bool = True) -> DataFrame:
    """The rows of `day` (days since 1970): yesterday's totals, plus today's arrivals, less the expiring amounts.

    arrivals(entity, articles, score, scored, ...) has at most a row per entity; its further columns are carried along.
    Entities of the state without arrivals get a row too, unless idle is false. Only the days of the state that the
    longest window holds are read. Append the result to the state.
    """
    old = state.filter(F.col("n").between(day - max(windows), day - 1))
    gone = [F.sum(F.when(F.col("n") == day - k, F.col(m)).otherwise(0)).alias(f"gone_{m}_{k}") for k in windows for m in MEASURES]
    last = [F.max(F.when(F.col("n") == day - 1, F.col(f"{m}_{k}"))).alias(f"had_{m}_{k}") for k in windows for m in MEASURES]
    before = old.groupBy("entity").agg(F.min("lo").alias("lo"), *gone, *last).alias("b")
    extra = [c for c in arrivals.columns if c not in ("entity", *MEASURES)]
    a = arrivals.withColumn("arrived", F.lit(True)).alias("a")
    x = before.join(a, F.col("b.entity").eqNullSafe(F.col("a.entity")), "full" if idle else "right")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = [(zero(f"had_{m}_{k}") + zero(f"a.{m}") - zero(f"gone_{m}_{k}")).alias(f"{m}_{k}") for k in windows for m in MEASURES]
    return x.select(F.coalesce("b.entity", "a.entity").alias("entity"), F.lit(day).alias("n"), F.coalesce("lo", F.lit(day)).alias("lo"), F.lit(day).alias("hi"), F.coalesce("arrived", F.lit(False)).alias("has_row"), *[zero(f"a.{m}").alias(m) for m in MEASURES], *[F.col(f"a.{c}") for c in extra], *totals, F.lit(version).alias("version"))


def rolling_state(df: DataFrame, entity: str = "symbol", day: str = "date", articles: str = "article_count", score: str = "sentiment_score", loaded: str = "loaded_at", keep: tuple[str, ...] = (), windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The state of a whole table: built up to the day before its newest, then advanced to that one.

    keep: further columns of the row that holds, null on days without a row; `has_row` tells these apart.
    """
    held = lambda x: versions(x, entity, day, [articles, score, *keep], loaded)
    new, old = _amounts("last", articles, score), _amounts("first", articles, score)
    changed = (new["articles"] != old["articles"]) | (new["score"] != old["score"]) | (new["scored"] != old["scored"])
    rows = [*[c.alias(m) for m, c in new.items()], changed.cast("int").alias("corrected"), F.col(f"last.{score}").alias("day_score"), *[F.col(f"last.{c}").alias(c) for c in keep]]
    daily = lambda x: held(x).select("entity", "n", *rows)
    newest = df.agg(F.max(F.col(day).cast("date"))).first()[0]
    state = build(daily(df), windows)
    if newest is not None:
        at = (newest - dt.date(1970, 1, 1)).days
        # yesterday's totals follow from the rows of twice the longest window: a filter that reaches the scan
        recent = df.filter(F.col(day) >= F.lit(newest - dt.timedelta(2 * max(windows))).cast(df.schema[day].dataType))
        first = df.filter(F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.unix_date(F.min(F.col(day).cast("date"))).alias("lo")).alias("f")
        today = daily(df.filter(F.col(day) >= F.lit(newest).cast(df.schema[day].dataType))).drop("n", "corrected")
        live = advance(build(daily(recent), windows), today, at, windows=windows, idle=False).alias("l")
        live = live.join(first, F.col("l.entity").eqNullSafe(F.col("f.entity"))).select(*[F.col("f.lo") if c == "lo" else F.col(f"l.{c}").alias(c) for c in state.columns])
        state = state.filter(F.col("n") < at).unionByName(live)
    means = {f"mean_score_{k}": F.when(F.col(f"scored_{k}") > 0, F.col(f"score_{k}").cast("double") / F.col(f"scored_{k}")) for k in windows} | {f"mean_articles_{k}": F.col(f"articles_{k}") / k for k in windows}
    return state.withColumns(means).withColumn("on_day", F.date_from_unix_date("n"))
