"""The feature pipeline: panels to a merged, filled matrix, for training or live use. One lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import features, panel
from tidemark.runtime import cut
from tidemark.sources.tables import table


#: Configuration: the series of the tables that plays each part of the wide matrix. The tables' symbols are invented.
ROLE_SYMBOLS = {"vix": "^SOBA0", "tnx": "^CILU2", "irx": "^ZUVA2", "dxy": "HEQE4-Y.QB", "gold": "VARO0=F", "oil": "FUZI3=F", "sp500": "^BITA5", "fund1": "XIGI1-Y.QB", "fund2": "BOJA0-Y.QB", "fund3": "CAHA3-Y.QB", "fund4": "GAKO1-Y.QB", "fund5": "JONE7-Y.QB"}


@dataclass(frozen=True)
class Config:
    target: str = "excess_return_5d"
    horizon: int = 5
    fill_limit: int = 5
    extra_tail_rows: int = 5
    max_null: float = 0.01
    least_rows: int = 200
    publication_lag_days: int = 0
    market: str = "us"
    leakage: tuple[str, ...] = ("log_return_5d",)
    roles: Mapping[str, str] = field(default_factory=lambda: dict(ROLE_SYMBOLS))


def with_roles(macro: DataFrame, roles: Mapping[str, str] | Sequence[str] = features.ROLES) -> DataFrame:
    """The macro series that play a part, named by it; `roles` maps parts to symbols, whatever other symbols there are.

    A bare sequence of parts gives them to the first symbols in order, as the SQL beside the queries does: then a new
    symbol moves the parts. All symbols are in `views()["series"]`.
    """
    if isinstance(roles, Mapping):
        plays = F.create_map(*[F.lit(v) for role, symbol in roles.items() for v in (symbol, role)])
        return macro.filter(F.col("symbol").isin(*roles.values())).select(F.try_element_at(plays, F.col("symbol")).alias("symbol"), "date", "close")
    first = macro.select("symbol").distinct().orderBy("symbol").limit(len(roles)).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("symbol")))
    named = first.withColumn("_role", F.element_at(F.array(*map(F.lit, roles)), F.col("_n").cast("int")))
    return macro.join(F.broadcast(named), "symbol").select(F.col("_role").alias("symbol"), "date", "close")


def views(spark: SparkSession, d: str, roles: Mapping[str, str] | Sequence[str] = features.ROLES, materialise: bool = False) -> dict[str, DataFrame]:
    """The panels. materialise: bars and series, which many families read, are computed once (a row per symbol and day)."""
    keep = cut if materialise else lambda df: df
    bars = keep(panel.bars(table(spark, d, "prices")))
    series = keep(panel.daily_last(table(spark, d, "macro")))
    s = table(spark, d, "sentiment")
    held = s.groupBy("symbol", "date").agg(F.max(F.struct("loaded_at", "article_count", F.nanvl("sentiment_score", F.lit(None)).alias("score"))).alias("r"))
    news = held.select("symbol", "date", F.coalesce("r.score", F.lit(0.0)).alias("avg_sentiment"), F.coalesce("r.article_count", F.lit(0)).alias("article_count"))
    e = table(spark, d, "earnings")
    pct = F.nanvl("surprise_pct", F.lit(None))
    events = e.filter(F.col("date").isNotNull() & pct.isNotNull()).groupBy(F.upper(F.trim("symbol")).alias("symbol"), F.col("date").cast("date").alias("date")).agg(F.min(F.struct("report_id", pct.alias("p"))).alias("r")).select("symbol", "date", F.col("r.p").alias("surprise_pct"))
    return {"bars": bars, "series": series, "macro": with_roles(series, roles), "news": news, "events": events, "market": panel.market(bars)}


def matrix(spark: SparkSession, d: str, cfg: Config = Config(), live: bool = False) -> DataFrame:
    """(symbol, date, all features, targets). Live keeps the days whose target lies in the future."""
    v = views(spark, d, cfg.roles, materialise=True)
    calendar = v["bars"].select("symbol", "date")
    vix = v["macro"].filter("symbol = 'vix'").select("date", "close")
    own = features.price_families(v["bars"], cut(v["market"]), vix, cfg.horizon)
    if not live:
        own = own.dropna(subset=[*features.TECHNICAL, "excess_return_5d"])
    return features.merge(
        own, features.earnings(calendar, v["events"], publication_lag_days=cfg.publication_lag_days), features.sentiment(v["news"]),
        by_date=F.broadcast(features.macro(v["macro"])), fill=[*features.MACRO, *features.SENTIMENT], limit=cfg.fill_limit,
    )
