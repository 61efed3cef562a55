"""Feature families over panels. Each takes and returns DataFrames; windows of a family share one shuffle and sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.lexicon import lexicon_score
from tidemark.functions.scalars import clip, dead_band, flag, interpolate
from tidemark.operators import panel

YEAR = w.ANNUAL**0.5
#: The part each macro series plays, in the order of the macro features.
ROLES = ("vix", "tnx", "irx", "dxy", "gold", "oil", "sp500", "fund1", "fund2", "fund3", "fund4", "fund5")


def _div(a, b) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def _technical_windows(bars: DataFrame, horizon: int, market: DataFrame | None) -> DataFrame:
    x = bars if market is None else panel.align(bars, market, "close", "_market")
    x = x.withColumns({"log_return_1d": w.log_return("close"), "_prev": w.lag("close"), "_delta": w.diff("close"), "bb_mid": w.roll_mean("close", 20), "_bb": w.roll_std("close", 20), "log_return_5d": F.ln(F.try_divide(w.lag("close", -horizon), F.col("close")))})
    excess = F.col("log_return_5d") if market is None else F.col("log_return_5d") - F.ln(F.try_divide(w.lag("_market", -horizon), F.col("_market")))
    x = x.withColumns({f"momentum_{k}d": w.pct_change("close", k) for k in (5, 10, 20)} | {f"volatility_{k}d": w.roll_std("log_return_1d", k) * YEAR for k in (10, 20, 30)} | {"excess_return_5d": excess})
    return x.withColumns({"_gain": clip("_delta", lo=0.0), "_loss": -clip("_delta", hi=0.0), "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev")))}).drop("_prev", "_delta", "_market")


_MEANS = [("_g", "_gain", 1 / 14, 14), ("_l", "_loss", 1 / 14, 14), ("_fast", "close", 2 / 13, 1), ("_slow", "close", 2 / 27, 1), ("_atr", "_tr", 2 / 15, 1), ("_signal", ("_fast", "_slow"), 2 / 10, 1)]


def _technical_columns(x: DataFrame) -> DataFrame:
    close, mid, up, low, macd = F.col("close"), F.col("bb_mid"), F.col("bb_mid") + 2 * F.col("_bb"), F.col("bb_mid") - 2 * F.col("_bb"), F.col("_fast") - F.col("_slow")
    x = x.withColumns({
        "rsi_14": 100 - _div(F.lit(100.0), 1 + _div(F.col("_g"), F.col("_l"))), "macd": F.try_divide(macd, close), "macd_signal": F.try_divide("_signal", close), "macd_hist": F.try_divide(macd - F.col("_signal"), close),
        "bb_upper": F.try_divide(up, close), "bb_lower": F.try_divide(low, close), "bb_width": _div(up - low, mid), "bb_pct": _div(close - low, up - low), "atr_14": _div(F.col("_atr"), close),
    })
    return x.withColumn("bb_mid", F.try_divide("bb_mid", close))


def _public(x: DataFrame) -> DataFrame:
    return x.drop(*[c for c in x.columns if c.startswith("_")])


def technical(bars: DataFrame, horizon: int = 5, market: DataFrame | None = None) -> DataFrame:
    """Returns, momentum, volatility, strength index, moving-average divergence, bands, true range, and the targets.

    Windows and the recurrences share one shuffle by symbol.
    """
    return _public(_technical_columns(w.by_symbol(_technical_windows(bars, horizon, market), _MEANS)))


#: The names of the features of each family.
TECHNICAL = ["log_return_1d", "momentum_5d", "momentum_10d", "momentum_20d", "volatility_10d", "volatility_20d", "volatility_30d", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_mid", "bb_width", "bb_pct", "atr_14"]


def macro_series(series: DataFrame) -> DataFrame:
    """(symbol, date, close and the macro windows of each series on its own calendar), for any number of symbols."""
    x = series.withColumns({"return_1d": w.log_return("close"), "change_1d": w.diff("close"), "change_5d": w.diff("close", 5), "ma_5": w.roll_mean("close", 5), "ma_10": w.roll_mean("close", 10)})
    return x.withColumns({"return_ma_5": w.roll_mean("return_1d", 5), "return_ma_10": w.roll_mean("return_1d", 10)})


MACRO_SERIES = ["close", "change_1d", "change_5d", "ma_5", "ma_10", "return_1d", "return_ma_5", "return_ma_10"]


def macro(series: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """(date, features) from (symbol, date, close), where symbol is a role.

    Windows run on each series' own calendar, all in one pass; the outer alignment is one conditional aggregation.
    The yield spread alone is taken after the alignment.
    """
    x = macro_series(series)
    want = [("vix", "close", "vix_level"), ("vix", "change_1d", "vix_change_1d"), ("vix", "change_5d", "vix_change_5d"), ("vix", "ma_5", "vix_ma_5"), ("vix", "ma_10", "vix_ma_10"), ("tnx", "close", "yield_10y"), ("irx", "close", "yield_3m")]
    want += [(r, "return_1d", f"{r}_return_1d") for r in ("dxy", "gold", "oil", "sp500")] + [("sp500", "return_ma_5", "sp500_ma_5"), ("sp500", "return_ma_10", "sp500_ma_10")]
    want += [(r, c, f"{r}_{n}") for r in roles if r.startswith("fund") for c, n in (("return_1d", "return_1d"), ("return_ma_5", "ma_5"))]
    y = x.groupBy("date").agg(*[F.max(F.when(F.col("symbol") == r, F.col(c))).alias(n) for r, c, n in want])
    y = y.withColumn("yield_spread", F.col("yield_10y") - F.col("yield_3m"))
    # one short series: a row per calendar day
    y = y.withColumn("yield_spread_change_1d", F.col("yield_spread") - F.lag("yield_spread").over(Window.partitionBy(F.lit(1)).orderBy("date")))
    return y.dropna("all", subset=[c for c in y.columns if c != "date"])


MACRO = ["vix_level", "vix_change_1d", "vix_change_5d", "vix_ma_5", "vix_ma_10", "yield_10y", "yield_3m", "yield_spread", "yield_spread_change_1d", "dxy_return_1d", "gold_return_1d", "oil_return_1d", "sp500_return_1d", "sp500_ma_5", "sp500_ma_10", *[f"fund{i}_{n}" for i in range(1, 6) for n in ("return_1d", "ma_5")]]


def sentiment(daily: DataFrame) -> DataFrame:
    """(symbol, date, sentiment features) from (symbol, date, avg_sentiment, article_count). Always the same columns."""
    x = daily.withColumnRenamed("avg_sentiment", "sentiment_score")
    x = x.withColumns({f"sentiment_ma_{k}d": w.roll_mean("sentiment_score", k, 1) for k in (3, 5, 10)} | {f"buzz_ma_{k}d": w.roll_mean("article_count", k, 1) for k in (3, 5)} | {"sentiment_std_5d": F.coalesce(w.roll_std("sentiment_score", 5, 1), F.lit(0.0))})
    return x.withColumn("sentiment_momentum", F.col("sentiment_ma_3d") - F.col("sentiment_ma_10d")).drop("article_count")


SENTIMENT = ["sentiment_score", "sentiment_ma_3d", "sentiment_ma_5d", "sentiment_ma_10d", "buzz_ma_3d", "buzz_ma_5d", "sentiment_momentum", "sentiment_std_5d"]


def no_sentiment(calendar: DataFrame) -> DataFrame:
    """The sentiment features as zeros, where there is no news."""
    return calendar.select("symbol", "date", *[F.lit(0.0).alias(c) for c in SENTIMENT])


def daily_news(items: DataFrame, text: str = "headline", score: Column | None = None, days: DataFrame | None = None) -> DataFrame:
    """(date, article_count, avg_sentiment, sentiment_std) of items with a date; days of the spine without news are 0."""
    s = lexicon_score(text) if score is None else score
    d = items.withColumn("_s", s).groupBy("date").agg(F.count("*").alias("article_count"), F.avg("_s").alias("avg_sentiment"), F.coalesce(F.stddev_samp("_s"), F.lit(0.0)).alias("sentiment_std"))
    return d if days is None else days.join(d, "date", "left").fillna(0, ["article_count", "avg_sentiment", "sentiment_std"])


def _sector_windows(bars: DataFrame, market: DataFrame, sector_close: DataFrame | None) -> DataFrame:
    # returns of the market and the sector are taken on their own calendars (one row a day), then aligned
    days = Window.partitionBy(F.lit(1)).orderBy("date")
    own = lambda m: m.withColumn("ret", F.ln(F.try_divide("close", F.lag("close").over(days))))
    x = panel.align(bars, own(market), "ret", "_mr")
    x = panel.align(x, own(sector_close), "ret", "_sr") if sector_close is not None else x.withColumn("_sr", F.col("_mr"))
    x = w.with_position(x)
    x = x.withColumns({"_r": w.log_return("close"), "_dir": F.signum(w.diff("close")), "_v20": w.roll_mean("volume", 20), "_v10": w.roll_mean("volume", 10), "_v5": w.roll_mean("volume", 5), "_slope": w.roll_slope("volume", 5)})
    x = x.withColumns({"_obv": w.cum_sum(F.col("volume") * F.col("_dir"))})
    x = x.withColumns({"_beta": w.roll_beta("_r", "_mr", 60), "_vol20": w.roll_std("_r", 20) * YEAR, "_vol60": w.roll_std("_r", 60) * YEAR} | {f"_{n}{k}": w.roll_sum(f"_{n}", k) for n in ("r", "mr", "sr") for k in (5, 20)} | {"_obv10": w.diff("_obv", 10)})
    x = x.withColumns({
        "volume_ratio_20d": F.try_divide("volume", F.nullif("_v20", F.lit(0.0))),
        "volume_trend_5d": F.when(F.col("_v5") > 0, F.try_divide("_slope", "_v5")).when(F.col("_v5").isNotNull(), 0.0), "obv_momentum_10d": _div(F.col("_obv10"), F.col("_v10")),
        "rolling_beta": clip("_beta", -3.0, 3.0), "vol_regime": flag(F.col("_vol20") > F.col("_vol60")), "vol_of_vol": w.roll_std("_vol20", 20),
    } | {f"idiosyncratic_momentum_{k}d": F.col(f"_r{k}") - F.col("_beta") * F.col(f"_mr{k}") for k in (5, 20)} | {f"sector_rel_momentum_{k}d": F.col(f"_r{k}") - F.col(f"_sr{k}") for k in (5, 20)})
    return x.drop("_mr", "_sr", "_pos", "_r", "_dir", "_v20", "_v10", "_v5", "_slope", "_obv", "_beta", "_vol60", "_obv10", *[f"_{n}{k}" for n in ("r", "mr", "sr") for k in (5, 20)])


_VOL_RANK = ("vol_percentile", "_vol20", 252, 252)


def sector(bars: DataFrame, market: DataFrame, sector_close: DataFrame | None = None) -> DataFrame:
    """Volume, market-relative, sector-relative and volatility-regime features."""
    x = _sector_windows(bars, market, sector_close).select("symbol", "date", "_vol20", *[c for c in SECTOR if c != "vol_percentile"])
    return w.by_symbol(x, ranks=[_VOL_RANK]).select("symbol", "date", *SECTOR)


def earnings(calendar: DataFrame, events: DataFrame, decay_days: int = 30, threshold: float = 0.05, publication_lag_days: int = 0) -> DataFrame:
    """Latest surprise on or before each day, until twice the decay: its size, age, linear decay and direction."""
    x = panel.last_event(calendar.select("symbol", "date"), events, ["surprise_pct"], publication_lag_days)
    age = F.datediff("date", "event.date")
    fresh = F.coalesce(age <= 2 * decay_days, F.lit(False))
    s = F.when(fresh, F.col("event.surprise_pct") / 100)
    return x.select("symbol", "date", F.coalesce(s, F.lit(0.0)).alias("earnings_surprise"), F.coalesce(F.abs(s), F.lit(0.0)).alias("earnings_surprise_abs"), F.when(fresh, age.cast("double")).alias("days_since_earnings"), F.coalesce(s * F.greatest(F.lit(0.0), 1 - age / decay_days), F.lit(0.0)).alias("earnings_drift_signal"), dead_band(s, threshold).alias("beat_miss"))


def no_earnings(calendar: DataFrame) -> DataFrame:
    z = F.lit(0.0)
    return calendar.select("symbol", "date", z.alias("earnings_surprise"), z.alias("earnings_surprise_abs"), F.lit(None).cast("double").alias("days_since_earnings"), z.alias("earnings_drift_signal"), z.alias("beat_miss"))


def _options_windows(bars: DataFrame, vix: DataFrame) -> DataFrame:
    x = panel.align(bars, vix, "close", "_vix").withColumns({"_ret": w.log_return("close"), "_x": F.col("_vix") / 100})
    x = x.withColumns({"_rv20": w.roll_std("_ret", 20) * YEAR, "_rv30": w.roll_std("_ret", 30) * YEAR, "_dx": w.pct_change("_x")})
    x = x.withColumn("_dr", w.pct_change("_rv20"))
    x = x.withColumn("_vbeta", clip(w.roll_beta("_dr", "_dx", 60), 0.5, 3.0))
    x = x.withColumn("_iv", F.coalesce(F.col("_x") * F.col("_vbeta"), "_rv20"))
    x = x.withColumns({"_iv60": w.roll_mean("_iv", 5), "_change": w.diff("_iv", 5)})
    return x.drop("_vix", "_ret", "_x", "_dx", "_dr", "_vbeta")


_IV_RANK = ("_iv_rank", "_iv", 252, 252)


def _options_columns(x: DataFrame) -> DataFrame:
    iv, iv60 = F.col("_iv"), F.col("_iv60")
    out = {"iv_30d": iv, "iv_60d": iv60, "iv_rv_spread_20": iv - F.col("_rv20"), "iv_rv_spread_30": iv - F.col("_rv30"), "iv_percentile_252": F.col("_iv_rank"), "iv_change_5d": F.col("_change"), "iv_term_structure": iv60 - iv}
    return x.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in out.items()})


def implied_volatility_proxy(bars: DataFrame, vix: DataFrame) -> DataFrame:
    """Implied volatility from the level of an index of it and the symbol's beta to it, on the price calendar."""
    x = _options_windows(bars, vix).select("symbol", "date", "_iv", "_iv60", "_rv20", "_rv30", "_change")
    return _options_columns(w.by_symbol(x, ranks=[_IV_RANK])).select("symbol", "date", *OPTIONS)


def price_families(bars: DataFrame, market: DataFrame, vix: DataFrame, horizon: int = 5) -> DataFrame:
    """technical, sector and implied_volatility_proxy of the same bars, in one shuffle and one pass instead of three and joins."""
    x = _options_windows(_sector_windows(_technical_windows(bars, horizon, market), market, None), vix)
    return _public(_options_columns(_technical_columns(w.by_symbol(x, _MEANS, [_VOL_RANK, _IV_RANK]))))


def implied_volatility(chain: DataFrame, spot: float, as_of: str, days: Sequence[int] = (30, 60)) -> DataFrame:
    """One row: implied volatility at the money, interpolated over the days to expiry of the first four expiries that
    are at least seven days out. chain(expiry, kind, strike, iv), kind 'call' or 'put'. Ties take the lower strike."""
    left = F.datediff("expiry", F.lit(as_of).cast("date"))
    c = chain.filter(F.col("iv").isNotNull()).withColumn("dte", left).filter("dte >= 7")
    first = c.select("dte").distinct().orderBy("dte").limit(4)
    money = c.join(F.broadcast(first), "dte").groupBy("dte", "kind").agg(F.min(F.struct(F.abs(F.col("strike") - spot), "strike", "iv")).alias("m")).groupBy("dte").agg(F.avg("m.iv").alias("iv"))
    p = money.agg(F.sort_array(F.collect_list(F.struct("dte", "iv"))).alias("p"))  # four rows at most

    def at(d: int) -> Column:
        lo = F.filter("p", lambda q: q["dte"] <= d)
        hi = F.filter("p", lambda q: q["dte"] >= d)
        a, b = F.try_element_at(lo, F.lit(-1)), F.try_element_at(hi, F.lit(1))
        a, b = F.coalesce(a, b), F.coalesce(b, a)
        return interpolate(F.lit(d), a["dte"], a["iv"], b["dte"], b["iv"])

    return p.select(*[at(d).alias(f"iv_{d}d") for d in days])


def fundamentals(rows: DataFrame) -> DataFrame:
    """Valuation features from (symbol, date, pe, pb, vix, sentiment_score, file): levels, changes, means, ranks, flags.

    The score is standardised per file (nulls are 0 before), clipped at three deviations and scaled to one.
    """
    per = Window.partitionBy("file")
    s = F.coalesce("sentiment_score", F.lit(0.0))
    x = rows.withColumn("_s", s).withColumn("precomputed_sentiment", clip((F.col("_s") - F.avg("_s").over(per)) / (F.stddev_samp("_s").over(per) + 1e-8), -3.0, 3.0) / 3)
    x = x.withColumnsRenamed({"pe": "pe_ratio", "pb": "pb_ratio", "vix": "india_vix"})
    x = x.withColumns({"pe_change_1d": w.diff("pe_ratio"), "pb_change_1d": w.diff("pb_ratio"), "vix_change_1d": w.diff("india_vix"), "vix_change_5d": w.diff("india_vix", 5), "vix_ma_5": w.roll_mean("india_vix", 5, 1), "vix_ma_10": w.roll_mean("india_vix", 10, 1), "pe_ma_10": w.roll_mean("pe_ratio", 10, 1), "pb_ma_10": w.roll_mean("pb_ratio", 10, 1), "pe_regime": flag(F.col("pe_ratio") > w.roll_mean("pe_ratio", 60, 20)), "vix_regime": flag(F.col("india_vix") > w.roll_mean("india_vix", 60, 20)), "vix_crisis": flag(F.col("india_vix") > 30), "market_expensive": flag(F.col("pe_ratio") > 25), "market_cheap": flag(F.col("pe_ratio") < 15)})
    x = w.by_symbol(x.select("symbol", "date", *[c for c in FUNDAMENTAL if c in x.columns]), ranks=[("vix_percentile", "india_vix", 252, 60), ("pe_percentile", "pe_ratio", 252, 60), ("pb_percentile", "pb_ratio", 252, 60)])
    x = x.withColumn("pe_vix_danger", F.col("pe_percentile") * F.col("vix_percentile"))
    return x.select("symbol", "date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FUNDAMENTAL])


FUNDAMENTAL = ["pe_ratio", "pb_ratio", "india_vix", "precomputed_sentiment", "pe_change_1d", "pb_change_1d", "vix_change_1d", "vix_change_5d", "vix_ma_5", "vix_ma_10", "pe_ma_10", "pb_ma_10", "vix_percentile", "pe_percentile", "pb_percentile", "pe_regime", "vix_regime", "pe_vix_danger", "vix_crisis", "market_expensive", "market_cheap"]


def index_sentiment(daily: DataFrame) -> DataFrame:
    """INDEX_SENTIMENT from daily news (symbol, date, article_count, avg_sentiment, sentiment_std)."""
    x = daily.withColumns({"sentiment_score": F.col("avg_sentiment"), "article_count": F.col("article_count").cast("double")})
    x = x.withColumns({f"sentiment_ma_{k}d": w.roll_mean("sentiment_score", k, 1) for k in (3, 5, 10)} | {f"buzz_ma_{k}d": w.roll_mean("article_count", k, 1) for k in (3, 5)} | {"sentiment_std_5d": F.coalesce(w.roll_std("sentiment_score", 5, 1), F.lit(0.0))})
    return x.withColumn("sentiment_momentum", F.col("sentiment_ma_3d") - F.col("sentiment_ma_10d")).select("symbol", "date", *INDEX_SENTIMENT)


def precomputed_sentiment(fundamental: DataFrame) -> DataFrame:
    """INDEX_SENTIMENT where there are no headlines: the files' own standardised score; counts are 1, the deviation 0."""
    return index_sentiment(fundamental.select("symbol", "date", F.lit(1).alias("article_count"), F.col("precomputed_sentiment").alias("avg_sentiment"), F.lit(0.0).alias("sentiment_std")))


INDEX_SENTIMENT = ["sentiment_score", "sentiment_std", "article_count", "sentiment_ma_3d", "sentiment_ma_5d", "sentiment_ma_10d", "sentiment_momentum", "buzz_ma_3d", "buzz_ma_5d", "sentiment_std_5d"]


def augment(df: DataFrame, columns: Sequence[str], target: str = "log_return_5d", lags: Sequence[int] = (1, 5), spans: Sequence[int] = (5, 10)) -> DataFrame:
    """Lags and rolling means of columns and rolling deviations of the target; incomplete rows are dropped."""
    new = {f"{c}_lag{k}": w.lag(c, k) for c in columns for k in lags} | {f"{c}_mom{k}": w.roll_mean(c, k) for c in columns for k in spans} | {f"target_vol_{k}": w.roll_std(target, k) for k in spans}
    return df.withColumns(new).dropna(subset=list(new))


def transform_target(df: DataFrame, target: str = "log_return_5d", smooth: int = 3, bins: int = 0) -> DataFrame:
    """The target smoothed by its rolling mean, its direction, and (bins > 0) its equal-frequency bin per symbol."""
    x = df.withColumn(target, w.roll_mean(target, smooth) if smooth > 1 else F.col(target)).dropna(subset=[target])
    x = x.withColumn("direction", (F.col(target) > 0).cast("int"))
    return x if not bins else x.withColumn("target_bin", w.quantile_bins(target, bins, Window.partitionBy("symbol")))


def merge(bars: DataFrame, *families: DataFrame, by_date: DataFrame | None = None, fill: Sequence[str] = (), limit: int = 5) -> DataFrame:
    """All families on the price calendar by left joins; columns in `fill` are carried forward up to `limit` rows."""
    x = reduce(lambda a, b: a.join(b, ["symbol", "date"], "left"), families, bars)
    if by_date is not None:
        x = x.join(by_date, "date", "left")
    return x.withColumns({c: w.fill_forward(c, limit) for c in fill if c in x.columns})


SECTOR = ["volume_ratio_20d", "volume_trend_5d", "obv_momentum_10d", "rolling_beta", "idiosyncratic_momentum_5d", "idiosyncratic_momentum_20d", "sector_rel_momentum_5d", "sector_rel_momentum_20d", "vol_regime", "vol_of_vol", "vol_percentile"]
EARNINGS = ["earnings_surprise", "earnings_surprise_abs", "days_since_earnings", "earnings_drift_signal", "beat_miss"]
OPTIONS = ["iv_30d", "iv_60d", "iv_rv_spread_20", "iv_rv_spread_30", "iv_percentile_252", "iv_change_5d", "iv_term_structure"]
#: Every feature column of the matrix.
ALL = [*TECHNICAL, *MACRO, *SENTIMENT, *SECTOR, *EARNINGS, *OPTIONS]
