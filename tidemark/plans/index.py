"""The matrix of the index files: their prices, valuations and score, and the headlines' sentiment, per index and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.lexicon import extended_score
from tidemark.functions.times import day_of
from tidemark.operators import cleaning, features, instants, schema_drift
from tidemark.plans import problems
from tidemark.runtime import cut
from tidemark.sources.tables import table

#: Configuration: how a field is named in headers; names that a rename links to one of them count too.
FIELDS = {
    "open": ("open", "open_price", "first price"), "close": ("close", "close_price", "last", "settle"),
    "volume": ("volume", "vol", "volume_sh", "shares traded", "total_qty"), "pe": ("p/e", "pe_ratio", "per", "price_earnings"),
    "pb": ("p/b", "pb_ratio", "price_book"), "vix": ("vix", "impliedvol", "fear_gauge", "vol_index"),
    "sentiment_score": ("sentiment_score", "sent", "score_daily", "mood"),
}
FILL = 5


def rows(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, date, amounts of FIELDS, file): one row per index and day of the one table of the files.

    file is the era of the index's file that the score comes from (else of the row's latest file): scales differ by it.
    """
    heads, c = problems._files(spark, d)
    found = cut(schema_drift.changes(heads, c))
    names = cut(schema_drift.canonical_names(found))
    known = {n: n for v in FIELDS.values() for n in v} | {r.name: r.canonical for r in names.filter(F.col("name").isin(*[n for v in FIELDS.values() for n in v])).collect()}  # the names of FIELDS
    t = schema_drift.one_table(c, found, names)
    cell = {f: F.coalesce(*[F.when(u["amount"].isNotNull() & ~F.isnan(u["amount"]), u) for n in dict.fromkeys(known[n] for n in v) for u in [F.try_element_at("fields", F.lit(n))]]) for f, v in FIELDS.items()}
    x = t.select(F.col("index_symbol").alias("symbol"), F.try_to_date("on_day", "yyyy-MM-dd").alias("date"), *[u["amount"].alias(f) for f, u in cell.items()], F.coalesce(cell["sentiment_score"]["from_file"], "file_no").alias("_no"))
    new = table(spark, d, "final_data").select(F.col("index_symbol").alias("symbol"), F.col("file_no").cast("long").alias("_no"), F.lit("final").alias("_era")).distinct()
    x = x.filter("symbol is not null and date is not null").join(new, ["symbol", "_no"], "left")
    return x.withColumn("file", F.struct("symbol", F.coalesce("_era", F.lit("unused")).alias("era"))).drop("_no", "_era")


def prices(x: DataFrame) -> DataFrame:
    """(symbol, date, open, high, low, close, volume): rows with an open and a close above 0, high and low made of both."""
    top, low = F.greatest("open", "close") * 1.005, F.least("open", "close") * 0.995
    return x.filter("open is not null and close > 0").select("symbol", "date", "open", top.alias("high"), low.alias("low"), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def headlines(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, date, article_count, avg_sentiment, sentiment_std): all headlines with a usable date, each once a day."""
    both = table(spark, d, problems.HEADLINES[0]).unionByName(table(spark, d, problems.HEADLINES[1])).select("date", "headline", "feed").filter("headline is not null")
    x = instants.normalise_instants(both, table(spark, d, "feeds")).filter("utc_us is not null")
    x = x.select(day_of(F.col("utc_us")).alias("date"), "headline").distinct()
    return features.daily_news(x, score=extended_score("headline")).withColumn("symbol", F.lit("all"))


def assemble(x: DataFrame, news: DataFrame | None) -> DataFrame:
    """Technical, fundamental and sentiment features of each index, filled FILL rows forward, then with 0.

    Columns that hold one value only go. Without news the files' own score stands for it.
    """
    tech = features.technical(prices(x)).drop("excess_return_5d").dropna()
    fund = features.fundamentals(x)
    if news is None:
        m = features.merge(tech, fund, features.precomputed_sentiment(fund))
    else:
        m = features.merge(tech, fund, by_date=features.index_sentiment(news).drop("symbol"))  # a row a day
    numbers = [c for c in m.columns if c not in ("symbol", "date")]
    m = cut(m.withColumns({c: F.coalesce(w.fill_forward(c, FILL), F.lit(0.0)) for c in numbers}))
    constant = [r["column"] for r in cleaning.profile(m, numbers).filter("is_constant").collect()]  # one row per column
    return m.drop(*constant)


def matrix(spark: SparkSession, d: str) -> DataFrame:
    news = cut(headlines(spark, d))  # a row a day
    return assemble(cut(rows(spark, d)), news if news.limit(1).count() else None)
