"""Queries of the relational and analytic operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon, scalars
from tidemark.functions import windows as w
from tidemark.ml import causal, evaluate, models, sequence
from tidemark.operators import cleaning, features, panel, quality
from tidemark.plans import index, pipeline
from tidemark.runtime import cut
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REGIMES = [("bull", "2018-01-01", "2019-12-31"), ("covid_crash", "2020-01-01", "2020-06-30"), ("recovery", "2020-07-01", "2021-12-31"), ("rate_hike", "2022-01-01", "2022-12-31")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col.cast("double"), 6) + F.lit(0.0)).alias(name or c)


def out(df: DataFrame, *numbers: str, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    return df.select(*[F.date_format(k, "yyyy-MM-dd").alias(k) if k == "date" else F.col(k) for k in keys], *[r6(c) for c in numbers])


def s6(expr: str, name: str) -> str:
    return f"round(({expr})::double, 6) + 0.0 as {name}"


DAY = "strftime(date, '%Y-%m-%d') as date"
P = "partition by symbol order by date"


def win(f: str, c: str, k: int, least: int | None = None) -> str:
    o = f"over ({P} rows {k - 1} preceding)"
    n = k if least is None else least
    if f.startswith("stddev") or f.startswith("var"):
        n = max(2, n)
    return f"(case when count({c}) {o} >= {n} then {f}({c}) {o} end)"


def rank_sql(c: str, k: int, least: int | None = None) -> str:
    h = f"list({c}) over ({P} rows {k - 1} preceding)"
    n = f"len(list_filter({h}, lambda v: v is not null))"
    return f"(case when {c} is not null and {n} >= {k if least is None else least} then (len(list_filter({h}, lambda v: v < {c})) + (len(list_filter({h}, lambda v: v = {c})) + 1) / 2.0) / {n} end)"


BARS = """bars as (select symbol, date::date as date, coalesce(case when isfinite(open) then open end, close) as open,
coalesce(case when isfinite(high) then high end, greatest(coalesce(case when isfinite(open) then open end, close), close) * 1.005) as high,
coalesce(case when isfinite(low) then low end, least(coalesce(case when isfinite(open) then open end, close), close) * 0.995) as low, close,
case when isfinite(volume) and volume >= 0 then volume else 0.0 end as volume
from prices where isfinite(close) and close > 0 and date is not null qualify row_number() over (partition by symbol, date::date order by bar_id) = 1)"""
MARKET = BARS + ",\nmarket as (select date, sum(close::decimal(20,6))::double / count(*) as close from bars group by 1)"
_ROLES = ", ".join(f"'{r}'" for r in features.ROLES)
MACRO = f"""mall as (select symbol, date::date as date, close from macro where isfinite(close) and date is not null qualify row_number() over (partition by symbol, date::date order by date desc, reading_id desc) = 1),
mac as (select [{_ROLES}][n] as symbol, date, close from mall join (select symbol as s, row_number() over (order by symbol) as n from (select distinct symbol from mall)) on s = symbol where n <= {len(features.ROLES)})"""
NEWS = """news as (select symbol, date, coalesce(r.s, 0.0) as avg_sentiment, coalesce(r.a, 0) as article_count from (select symbol, date,
max(struct_pack(l := loaded_at, a := article_count, s := case when isnan(sentiment_score) then null else sentiment_score end)) as r from sentiment group by 1, 2))"""
EVENTS = """ev as (select upper(trim(symbol)) as symbol, date::date as date, arg_min(surprise_pct, report_id) as surprise_pct from earnings where surprise_pct is not null and not isnan(surprise_pct) and date is not null group by 1, 2)"""
LN = lambda a, b: f"(case when ({a}) / nullif({b}, 0) > 0 then ln(({a}) / ({b})) end)"
LAG = lambda c, k=1: f"lag({c}, {k}) over ({P})"
DIV = lambda a, b: f"(({a}) / nullif({b}, 0))"


# --- sources, projections, filters ------------------------------------------------------------------------------


@query(f"with {BARS} select symbol, {DAY}, {s6('open', 'open')}, {s6('high', 'high')}, {s6('low', 'low')}, {s6('close', 'close')}, {s6('volume', 'volume')} from bars")
def src_bars(spark, d):
    return out(panel.bars(table(spark, d, "prices")), "open", "high", "low", "close", "volume")


@query(f"with {MACRO} select symbol, {DAY}, {s6('close', 'close')} from mac")
def src_macro(spark, d):
    return out(pipeline.views(spark, d)["macro"], "close")


_SERIES = MACRO.split(",\nmac as")[0]


@query(f"with {_SERIES} select symbol, {DAY}, {s6('close', 'close')} from mall")
def src_macro_series(spark, d):
    return out(pipeline.views(spark, d)["series"], "close")


HEAD = r"""head as (select case when regexp_matches(date, '^\d{1,2}-\d{1,2}-\d{4}$') then try_strptime(date, '%d-%m-%Y') when regexp_matches(date, '^\d{1,2}-\d{1,2}-\d{2}$') then try_strptime(date, '%d-%m-%y') end::date as date, headline
from (select date, headline from financial_headlines_with_serial_no_2 union all select date, headline from financial_headlines_with_serial_no))"""


def _headlines(spark, d):
    both = table(spark, d, "financial_headlines_with_serial_no_2").unionByName(table(spark, d, "financial_headlines_with_serial_no"))
    return both.select(scalars.day_first_date("date").alias("date"), "headline")


@query(f"with {HEAD} select {DAY}, headline from (select distinct date, headline from head where date is not null)")
def src_headlines(spark, d):
    return _headlines(spark, d).filter("date is not null").dropDuplicates(["date", "headline"]).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "headline")


@query("select distinct symbol, translate(replace(symbol, '^', ''), '=-.', '___') as file from macro")
def src_filenames(spark, d):
    return table(spark, d, "macro").select("symbol").distinct().withColumn("file", scalars.safe_filename("symbol"))


@query(f"select report_id, {s6('coalesce(case when isfinite(surprise_pct) then surprise_pct end, (actual_eps - estimate_eps) / nullif(abs(estimate_eps), 0) * 100)', 'surprise_pct')} from earnings")
def src_surprise(spark, d):
    e = table(spark, d, "earnings")
    return e.select("report_id", r6(scalars.surprise(F.nanvl("actual_eps", F.lit(None)), F.nanvl("estimate_eps", F.lit(None)), "surprise_pct"), "surprise_pct"))


@query("select o_orderkey, o_totalprice, o_orderstatus as status from orders where o_totalprice > 100000 and o_orderstatus is not null")
def prj_filter(spark, d):
    o = table(spark, d, "orders")
    want = ["o_orderkey", "o_totalprice", "o_orderstatus", "not_there"]
    return o.select(*[c for c in want if c in o.columns]).filter("o_totalprice > 100000").dropna("any").withColumnRenamed("o_orderstatus", "status").drop("absent")


@query(
    f"with {BARS} select symbol, {DAY}, {s6('least(greatest(close, 50), 500)', 'clipped')}, (close > 300)::double as high_flag, case when open - close > 1 then 1.0 when open - close < -1 then -1.0 else 0.0 end as band, {s6('least(greatest(0.3 + 0.6 / (1 + exp(-2 * (close % 1 - 0.5))), 0.3), 0.9)', 'confidence')} from bars"
)
def flt_expressions(spark, d):
    b = pipeline.views(spark, d)["bars"].withColumns({"clipped": scalars.clip("close", 50.0, 500.0), "high_flag": scalars.flag(F.col("close") > 300), "band": scalars.dead_band(F.col("open") - F.col("close"), 1.0), "confidence": scalars.confidence(F.col("close") % 1)})
    return b.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("clipped"), "high_flag", "band", r6("confidence"))


@query("select bar_id, case when isfinite(close) then close end as close, case when isfinite(volume) then volume end as volume, isfinite(close) and isfinite(volume) as complete from prices where close is not null or volume is not null")
def flt_finite(spark, d):
    p = table(spark, d, "prices").filter("close is not null or volume is not null")
    c, v = scalars.finite("close"), scalars.finite("volume")
    both = F.when(F.col("close").isNotNull() & F.col("volume").isNotNull(), c.isNotNull() & v.isNotNull())
    # a null side makes the conjunction null unless the other is false
    both = F.coalesce(both, F.when((F.col("close").isNotNull() & c.isNull()) | (F.col("volume").isNotNull() & v.isNull()), F.lit(False)))
    return p.select("bar_id", c.alias("close"), v.alias("volume"), both.alias("complete"))


# --- joins ------------------------------------------------------------------------------------------------------


@query(f"with {MARKET}, {EVENTS} select b.symbol, strftime(b.date, '%Y-%m-%d') as date, {s6('m.close', 'market')}, {s6('n.surprise_pct', 'surprise_pct')} from bars b left join market m on b.date = m.date left join ev n on n.symbol = b.symbol and n.date = b.date")
def jn_left(spark, d):
    v = pipeline.views(spark, d)
    x = v["bars"].join(v["market"].withColumnRenamed("close", "market"), "date", "left").join(v["events"], ["symbol", "date"], "left")
    return out(x, "market", "surprise_pct")


@query(f"with {MACRO} select {DAY}, {', '.join(s6(f'''max(close) filter (symbol = '{r}')''', r) for r in ('vix', 'tnx', 'irx'))} from mac where symbol in ('vix', 'tnx', 'irx') group by date")
def jn_full_align(spark, d):
    m = pipeline.views(spark, d)["macro"].filter(F.col("symbol").isin("vix", "tnx", "irx"))
    return out(panel.wide(m, ["vix", "tnx", "irx"], "close"), "vix", "tnx", "irx", keys=("date",))


@query(f"with {BARS}, {EVENTS} select b.symbol, strftime(b.date, '%Y-%m-%d') as date, strftime(e.date, '%Y-%m-%d') as event_date, {s6('e.surprise_pct', 'surprise_pct')} from bars b asof left join ev e on b.symbol = e.symbol and b.date >= e.date")
def jn_asof(spark, d):
    v = pipeline.views(spark, d)
    x = panel.last_event(v["bars"], v["events"], ["surprise_pct"])
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("event.date", "yyyy-MM-dd").alias("event_date"), r6("event.surprise_pct", "surprise_pct"))


@query(f"with {BARS}, {MACRO}, v as (select date, close from mac where symbol = 'vix') select b.symbol, strftime(b.date, '%Y-%m-%d') as date, round(last_value(v.close ignore nulls) over (partition by b.symbol order by b.date rows unbounded preceding), 6) + 0.0 as vix from bars b left join v on b.date = v.date")
def jn_reindex_fill(spark, d):
    v = pipeline.views(spark, d)
    return out(panel.align(v["bars"], v["macro"].filter("symbol = 'vix'"), "close", "vix"), "vix")


_LABEL = "case " + " ".join(f"when date between date '{a}' and date '{b}' then '{n}'" for n, a, b in REGIMES[::-1]) + " else 'other' end"


@query(f"with {BARS} select symbol, {DAY}, {_LABEL} as regime from bars")
def jn_range_label(spark, d):
    return out(panel.label_ranges(pipeline.views(spark, d)["bars"], REGIMES).select("symbol", "date", "regime"), keys=("symbol", "date", "regime"))


@query(f"with {BARS}, {EVENTS} select symbol, count(*) as n from bars where symbol in (select symbol from ev) group by 1")
def jn_semi(spark, d):
    v = pipeline.views(spark, d)
    return v["bars"].join(v["events"].select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"with {BARS}, {EVENTS}, b as (select symbol, count(*) as n from bars group by 1), e as (select symbol, count(*) as k from ev group by 1) select coalesce(b.symbol, e.symbol) as symbol, coalesce(n, 0) as bars, coalesce(k, -1) as events from b full join e on b.symbol = e.symbol")
def jn_full_defaults(spark, d):
    v = pipeline.views(spark, d)
    b, e = (v[k].groupBy("symbol").agg(F.count("*").alias(k)) for k in ("bars", "events"))
    return b.join(e, "symbol", "full").fillna({"bars": 0, "events": -1})


@query(f"with {BARS}, s as (select unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day))::date as date from bars), n as (select date, count(*) as n from bars group by 1) select strftime(s.date, '%Y-%m-%d') as date, coalesce(n, 0) as n from s left join n on s.date = n.date")
def jn_spine(spark, d):
    b = pipeline.views(spark, d)["bars"]
    n = b.groupBy("date").agg(F.count("*").alias("n"))
    return panel.spine(n).join(n, "date", "left").fillna(0, ["n"]).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "n")


@query(f"with {BARS} select symbol, {DAY}, {s6('close - (select max(close) from bars)', 'below_top')} from bars")
def jn_one_row(spark, d):
    b = pipeline.views(spark, d)["bars"]
    top = b.agg(F.max("close").alias("top"))  # one row by construction
    return out(b.join(F.broadcast(top)).withColumn("below_top", F.col("close") - F.col("top")), "below_top")


# --- aggregations -----------------------------------------------------------------------------------------------

_POS, _NEG = (", ".join(f"'{x}'" for x in ws) for ws in (lexicon.POSITIVE, lexicon.NEGATIVE))


def _score_sql(text: str, p: str = _POS, n: str = _NEG) -> str:
    ws = f"list_distinct(regexp_split_to_array(lower(trim(coalesce({text}, ''))), '\\s+'))"
    a, b = f"len(list_intersect({ws}, [{p}]))", f"len(list_intersect({ws}, [{n}]))"
    return f"coalesce(({a} - {b})::double / nullif({a} + {b}, 0), 0.0)"


@query(f"with {HEAD}, x as (select date, {_score_sql('headline')} as s from head where date is not null) select {DAY}, count(*) as article_count, {s6('avg(s)', 'avg_sentiment')}, {s6('coalesce(stddev_samp(s), 0)', 'sentiment_std')} from x group by date")
def agg_daily_news(spark, d):
    x = features.daily_news(_headlines(spark, d).filter("date is not null"))
    return x.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "article_count", r6("avg_sentiment"), r6("sentiment_std"))


_P4 = ("open", "high", "close", "volume")


@query(" union all ".join(f"select '{c}' as column, count(*) as n, coalesce(sum(({c} is null)::bigint), 0)::bigint as nulls, {s6(f'avg(({c} is null)::int)', 'null_ratio')}, count(distinct {c}) <= 1 as is_constant from prices" for c in _P4))
def agg_profile(spark, d):
    return cleaning.profile(table(spark, d, "prices"), _P4).withColumn("null_ratio", r6("null_ratio"))


_RETURNS = f"{BARS}, r as (select *, {LN('close', LAG('close'))} as log_return_1d from bars)"


@query(f"with {_RETURNS} select {_LABEL} as regime, count(*) as n_rows, strftime(min(date), '%Y-%m-%d') as first_day, strftime(max(date), '%Y-%m-%d') as last_day, round(avg(log_return_1d), 4) + 0.0 as mean, round(stddev_samp(log_return_1d), 4) + 0.0 as std, round(min(log_return_1d), 4) + 0.0 as min, round(max(log_return_1d), 4) + 0.0 as max from r group by 1")
def agg_regime_stats(spark, d):
    x = pipeline.views(spark, d)["bars"].withColumn("log_return_1d", w.log_return("close"))
    s = evaluate.regime_stats(x, REGIMES)
    return s.select("regime", "n_rows", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")], *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max")])


@query("select event_type, min(value) as least, arg_min(event_id, struct_pack(v := value, e := event_id)) as at from events group by 1")
def agg_min_by(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.min(F.struct("value", "event_id")).alias("m"))
    return m.select("event_type", F.col("m.value").alias("least"), F.col("m.event_id").alias("at"))


@query("select l_returnflag, min(l_extendedprice) filter (l_linestatus = 'F') as f, min(l_extendedprice) filter (l_linestatus = 'O') as o from lineitem group by 1")
def agg_pivot_min(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.min("l_extendedprice").alias("p"))  # a row per flag, status and line
    links = [(r.l_returnflag, r.l_linestatus, r.l_linenumber, r.p, 0.0) for r in x.collect()]
    return causal.graph_matrix(x, links).withColumnsRenamed({"src": "l_returnflag", "F": "f", "O": "o"})


_LINKS = "with l as (select event_type, extract(hour from ts)::int as lag, min(value) as p, count(*)::double as v from events where event_type is not null group by 1, 2)"


@query(f"{_LINKS} select event_type as feature, min(p) < 0.1 as causal, {s6('min(p)', 'pval')}, arg_min(v, struct_pack(p := p, l := lag)) as val, arg_min(lag, struct_pack(p := p, l := lag)) as best_lag from l group by 1")
def agg_links(spark, d):
    x = table(spark, d, "events").filter("event_type is not null").groupBy("event_type", F.hour("ts").alias("lag")).agg(F.min("value").alias("p"), F.count("*").cast("double").alias("v"))
    links = [(r.event_type, "all", r.lag, r.p, r.v) for r in x.collect()]  # a row per type and hour
    return causal.links_into(x, links, "all", alpha=0.1).withColumn("pval", r6("pval"))


@query(f"with {BARS} select symbol, {DAY}, {s6('least(greatest((close - avg(close) over (partition by symbol)) / (stddev_samp(close) over (partition by symbol) + 1e-8), -3), 3) / 3', 'z')} from bars")
def agg_zscore(spark, d):
    per = Window.partitionBy("symbol")
    return out(pipeline.views(spark, d)["bars"].withColumn("z", scalars.clip((F.col("close") - F.avg("close").over(per)) / (F.stddev_samp("close").over(per) + 1e-8), -3.0, 3.0) / 3), "z")


# --- windows ----------------------------------------------------------------------------------------------------


@query(f"with {BARS} select symbol, {DAY}, {s6(LAG('close'), 'lag_1')}, {s6(f'lead(close, 5) over ({P})', 'lead_5')}, {s6('close - ' + LAG('close', 5), 'diff_5')}, {s6(DIV('close', LAG('close', 10)) + ' - 1', 'pct_10')}, row_number() over ({P}) as n from bars")
def win_shift(spark, d):
    b = pipeline.views(spark, d)["bars"].withColumns({"lag_1": w.lag("close"), "lead_5": w.lag("close", -5), "diff_5": w.diff("close", 5), "pct_10": w.pct_change("close", 10), "n": F.row_number().over(w.by())})
    return b.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("lag_1"), r6("lead_5"), r6("diff_5"), r6("pct_10"), "n")


_ROLLED = ("mean_5", "mean_open", "std_10", "std_open", "sum_20", "slope_5", "beta_60")


@query(
    f"with {MARKET}, x as (select b.*, row_number() over (partition by b.symbol order by b.date) as pos from bars b), r as (select *, close - {LAG('close')} as dc, open - {LAG('open')} as d_o from x) select symbol, {DAY}, {s6(win('avg', 'close', 5), 'mean_5')}, {s6(win('avg', 'close', 5, 1), 'mean_open')}, {s6(win('stddev_samp', 'close', 10), 'std_10')}, {s6('coalesce(' + win('stddev_samp', 'close', 5, 1) + ', 0)', 'std_open')}, {s6(win('sum', 'close', 20), 'sum_20')}, {s6(f'case when count(close) over ({P} rows 4 preceding) >= 5 then regr_slope(close, pos) over ({P} rows 4 preceding) end', 'slope_5')}, {s6(f'case when count(case when dc is not null and d_o is not null then 1 end) over ({P} rows 59 preceding) >= 60 then covar_samp(dc, d_o) over ({P} rows 59 preceding) / nullif(var_samp(d_o) over ({P} rows 59 preceding), 0) end', 'beta_60')} from r"
)
def win_rolling(spark, d):
    b = w.with_position(pipeline.views(spark, d)["bars"]).withColumns({"dc": w.diff("close"), "do": w.diff("open")})
    b = b.withColumns({"mean_5": w.roll_mean("close", 5), "mean_open": w.roll_mean("close", 5, 1), "std_10": w.roll_std("close", 10), "std_open": F.coalesce(w.roll_std("close", 5, 1), F.lit(0.0)), "sum_20": w.roll_sum("close", 20), "slope_5": w.roll_slope("close", 5), "beta_60": w.roll_beta("dc", "do", 60)})
    return out(b, *_ROLLED)


@query(f"with {BARS} select symbol, {DAY}, {s6(rank_sql('close', 252, 60), 'rank_252')}, {s6(rank_sql('close', 20), 'rank_20')} from bars")
def win_percentile_rank(spark, d):
    return out(w.by_symbol(pipeline.views(spark, d)["bars"].select("symbol", "date", "close"), ranks=[("rank_252", "close", 252, 60), ("rank_20", "close", 20, 20)]), "rank_252", "rank_20")


def ewm_sql(base: str, col: str, alpha: float, first: int, name: str, least: int = 1) -> str:
    """One CTE: the recursive mean of a column without inner gaps that begins at row `first`, as a weighted sum."""
    return f"""{name} as (select t.symbol, t.date, case when max(t.rn) - {first} + 1 >= {least} then sum(s.{col} * (case when s.rn = {first} then 1 else {alpha!r} end) * pow({1 - alpha!r}, t.rn - s.rn)) end as v
from {base} t join {base} s on s.symbol = t.symbol and s.rn <= t.rn and s.rn >= {first} where t.rn >= {first} group by 1, 2)"""


@query(f"with {BARS}, x as (select *, row_number() over ({P}) as rn from bars), {ewm_sql('x', 'close', 2 / 13, 1, 'a')}, {ewm_sql('x', 'close', 1 / 14, 1, 'b', 14)} select a.symbol, strftime(a.date, '%Y-%m-%d') as date, {s6('a.v', 'span_12')}, {s6('b.v', 'wilder_14')} from a left join b on a.symbol = b.symbol and a.date = b.date")
def win_ewm(spark, d):
    return out(w.ewm(pipeline.views(spark, d)["bars"].select("symbol", "date", "close"), [("span_12", "close", 2 / 13, 1), ("wilder_14", "close", 1 / 14, 14)]), "span_12", "wilder_14")


@query(f"with {_RETURNS}, x as (select *, {DIV('close', LAG('close'))} - 1 as ret from bars), c as (select *, case when ret is not null then sum(ret) over ({P} rows unbounded preceding) end as total, product(1 + coalesce(ret, 0)) over ({P} rows unbounded preceding) as growth from x) select symbol, {DAY}, {s6('total', 'total')}, {s6('growth', 'growth')}, {s6(f'max(growth) over ({P} rows unbounded preceding)', 'peak')} from c")
def win_cumulative(spark, d):
    b = pipeline.views(spark, d)["bars"].withColumn("ret", w.pct_change("close"))
    b = b.withColumns({"total": w.cum_sum("ret"), "growth": w.cum_growth(F.coalesce("ret", F.lit(0.0)))})
    return out(b.withColumn("peak", w.cum_max("growth")), "total", "growth", "peak")


@query(f"with {BARS}, g as (select *, date - {LAG('date')} as gap from bars) select symbol, max(gap)::bigint as max_gap, strftime(min(date) filter (gap = top), '%Y-%m-%d') as at from (select *, max(gap) over (partition by symbol) as top from g) group by 1")
def win_date_gap(spark, d):
    g = pipeline.views(spark, d)["bars"].withColumn("gap", F.datediff("date", w.lag("date")))
    m = g.groupBy("symbol").agg(F.max(F.struct("gap", (-F.unix_date("date")).alias("n"))).alias("m"))
    return m.select("symbol", F.col("m.gap").cast("long").alias("max_gap"), F.date_format(F.date_from_unix_date(-F.col("m.n")), "yyyy-MM-dd").alias("at"))


@query(f"with {BARS}, x as (select *, row_number() over (partition by symbol order by close, date) as rk, count(*) over (partition by symbol) as n from bars) select symbol, {DAY}, case when n > 1 then least(4, greatest(0, ((rk - 1) * 5 + n - 2) // (n - 1) - 1)) else 0 end::int as bin from x")
def win_quantile_bins(spark, d):
    return pipeline.views(spark, d)["bars"].select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), w.quantile_bins(F.col("close"), 5, Window.partitionBy("symbol")).alias("bin"))


_FILLED = f"{BARS}, x as (select *, case when (close * 100)::bigint % 3 = 0 then close end as c from bars)"


@query(f"with {_FILLED} select symbol, {DAY}, {s6(f'last_value(c ignore nulls) over ({P} rows between 5 preceding and current row)', 'fill_5')}, {s6(f'last_value(c ignore nulls) over ({P} rows unbounded preceding)', 'fill')}, {s6(f'first_value(c ignore nulls) over ({P} rows between current row and unbounded following)', 'back')} from x")
def win_fill(spark, d):
    b = pipeline.views(spark, d)["bars"].withColumn("c", F.when(F.round(F.col("close") * 100).cast("long") % 3 == 0, F.col("close")))
    return out(b.withColumns({"fill_5": w.fill_forward("c", 5), "fill": w.fill_forward("c"), "back": w.fill_backward("c")}), "fill_5", "fill", "back")


@query(f"with {BARS}, x as (select symbol, date, list(close) over ({P} rows between 20 preceding and 1 preceding) as h from bars) select symbol, {DAY}, {s6('h[1]::float', 'oldest')}, {s6('h[20]::float', 'newest')} from x where len(h) = 20")
def win_sequences(spark, d):
    x = w.sequences(pipeline.views(spark, d)["bars"], ["close"], 20)
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), r6(F.col("sequence")[0][0], "oldest"), r6(F.col("sequence")[19][0], "newest"))


# --- feature families -------------------------------------------------------------------------------------------

_TECH = f"""{MARKET}, x as (select *, row_number() over ({P}) as rn, {LN('close', LAG('close'))} as lr, close - {LAG('close')} as dl, {LAG('close')} as pc from bars),
y as (select *, greatest(dl, 0) as gain, greatest(-dl, 0) as loss, greatest(high - low, abs(high - pc), abs(low - pc)) as tr, {win('avg', 'close', 20)} as mid, {win('stddev_samp', 'close', 20)} as sd from x),
{ewm_sql('y', 'gain', 1 / 14, 2, 'eg', 14)}, {ewm_sql('y', 'loss', 1 / 14, 2, 'el', 14)}, {ewm_sql('y', 'close', 2 / 13, 1, 'ef')}, {ewm_sql('y', 'close', 2 / 27, 1, 'es')}, {ewm_sql('y', 'tr', 2 / 15, 1, 'ea')},
m as (select y.symbol, y.date, y.rn, ef.v - es.v as macd from y join ef on ef.symbol = y.symbol and ef.date = y.date join es on es.symbol = y.symbol and es.date = y.date), {ewm_sql('m', 'macd', 2 / 10, 1, 'sg')},
mk as (select b.symbol, b.date, last_value(j.close ignore nulls) over (partition by b.symbol order by b.date rows unbounded preceding) as mc from bars b left join market j on j.date = b.date),
mr as (select symbol, date, {LN(f'lead(mc, 5) over ({P})', 'mc')} as fwd from mk),
tech as (select y.symbol, y.date, y.close, lr as log_return_1d, {', '.join(f"{DIV('y.close', f'lag(y.close, {k}) over (partition by y.symbol order by y.date)')} - 1 as momentum_{k}d" for k in (5, 10, 20))},
{', '.join(f"(case when count(lr) over (partition by y.symbol order by y.date rows {k - 1} preceding) >= {k} then stddev_samp(lr) over (partition by y.symbol order by y.date rows {k - 1} preceding) end) * sqrt(252) as volatility_{k}d" for k in (10, 20, 30))},
100 - 100 / nullif(1 + eg.v / nullif(el.v, 0), 0) as rsi_14, m.macd / y.close as macd, sg.v / y.close as macd_signal, (m.macd - sg.v) / y.close as macd_hist,
(mid + 2 * sd) / y.close as bb_upper, (mid - 2 * sd) / y.close as bb_lower, mid / y.close as bb_mid, (mid + 2 * sd - (mid - 2 * sd)) / nullif(mid, 0) as bb_width, (y.close - (mid - 2 * sd)) / nullif(mid + 2 * sd - (mid - 2 * sd), 0) as bb_pct, ea.v / y.close as atr_14,
{LN('lead(y.close, 5) over (partition by y.symbol order by y.date)', 'y.close')} as log_return_5d, {LN('lead(y.close, 5) over (partition by y.symbol order by y.date)', 'y.close')} - mr.fwd as excess_return_5d
from y left join eg on eg.symbol = y.symbol and eg.date = y.date left join el on el.symbol = y.symbol and el.date = y.date left join m on m.symbol = y.symbol and m.date = y.date left join sg on sg.symbol = y.symbol and sg.date = y.date left join ea on ea.symbol = y.symbol and ea.date = y.date left join mr on mr.symbol = y.symbol and mr.date = y.date)"""
_TECH_COLS = [*features.TECHNICAL, "log_return_5d", "excess_return_5d"]


@query(f"with {_TECH} select symbol, {DAY}, {', '.join(s6(c, c) for c in _TECH_COLS)} from tech where {' and '.join(f'{c} is not null' for c in _TECH_COLS)}")
def feat_technical(spark, d):
    v = pipeline.views(spark, d)
    return out(features.technical(v["bars"], 5, v["market"]).dropna(subset=_TECH_COLS), *_TECH_COLS)


_FUNDS = [r for r in features.ROLES if r.startswith("fund")]
_MX = f"{MACRO}, r as (select *, {LN('close', LAG('close'))} as ret, close - {LAG('close')} as d1, close - {LAG('close', 5)} as d5, {win('avg', 'close', 5)} as m5, {win('avg', 'close', 10)} as m10 from mac), q as (select *, {win('avg', 'ret', 5)} as r5, {win('avg', 'ret', 10)} as r10 from r)"
_MPICK = [("vix", "close", "vix_level"), ("vix", "d1", "vix_change_1d"), ("vix", "d5", "vix_change_5d"), ("vix", "m5", "vix_ma_5"), ("vix", "m10", "vix_ma_10"), ("tnx", "close", "yield_10y"), ("irx", "close", "yield_3m")] + [(x, "ret", f"{x}_return_1d") for x in ("dxy", "gold", "oil", "sp500", *_FUNDS)] + [("sp500", "r5", "sp500_ma_5"), ("sp500", "r10", "sp500_ma_10")] + [(x, "r5", f"{x}_ma_5") for x in _FUNDS]


@query(
    f"with {_MX}, z as (select date, {', '.join(f'''max({c}) filter (symbol = '{r}') as {n}''' for r, c, n in _MPICK)} from q group by 1), s as (select *, yield_10y - yield_3m as yield_spread from z) select {DAY}, {', '.join(s6(n, n) for _, _, n in _MPICK)}, {s6('yield_spread', 'yield_spread')}, {s6('yield_spread - lag(yield_spread) over (order by date)', 'yield_spread_change_1d')} from s where {' or '.join(f'{n} is not null' for _, _, n in _MPICK)}"
)
def feat_macro(spark, d):
    return out(features.macro(pipeline.views(spark, d)["macro"]), *features.MACRO, keys=("date",))


# means of ten prices lie on halves of the seventh place, so they are given to eight
@query(
    f"with {_SERIES}, r as (select *, {LN('close', LAG('close'))} as return_1d from mall) select symbol, {DAY}, {s6('close', 'close')}, {s6('close - ' + LAG('close'), 'change_1d')}, {s6('close - ' + LAG('close', 5), 'change_5d')}, round({win('avg', 'close', 5)}, 8) + 0.0 as ma_5, round({win('avg', 'close', 10)}, 8) + 0.0 as ma_10, {s6('return_1d', 'return_1d')}, {s6(win('avg', 'return_1d', 5), 'return_ma_5')}, {s6(win('avg', 'return_1d', 10), 'return_ma_10')} from r"
)
def feat_macro_series(spark, d):
    x = features.macro_series(pipeline.views(spark, d)["series"])
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), *[r6(c) if not c.startswith("ma_") else (F.round(c, 8) + F.lit(0.0)).alias(c) for c in features.MACRO_SERIES])


@query(
    f"with {NEWS}, x as (select symbol, date, avg_sentiment as sentiment_score, {', '.join(win('avg', 'avg_sentiment', k, 1) + f' as sentiment_ma_{k}d' for k in (3, 5, 10))}, {', '.join(win('avg', 'article_count', k, 1) + f' as buzz_ma_{k}d' for k in (3, 5))}, coalesce({win('stddev_samp', 'avg_sentiment', 5, 1)}, 0) as sentiment_std_5d from news) select symbol, {DAY}, {', '.join(s6(c, c) for c in features.SENTIMENT if c != 'sentiment_momentum')}, {s6('sentiment_ma_3d - sentiment_ma_10d', 'sentiment_momentum')} from x"
)
def feat_sentiment(spark, d):
    return out(features.sentiment(pipeline.views(spark, d)["news"]), *features.SENTIMENT)


_SEC = f"""{MARKET}, mo as (select date, {LN('close', 'lag(close) over (order by date)')} as ret from market),
x as (select b.*, row_number() over (partition by b.symbol order by b.date) as pos, last_value(mo.ret ignore nulls) over (partition by b.symbol order by b.date rows unbounded preceding) as mr from bars b left join mo on mo.date = b.date),
y as (select *, {LN('close', LAG('close'))} as r, sign(close - {LAG('close')}) * volume as signed from x),
z as (select *, case when signed is not null then sum(signed) over ({P} rows unbounded preceding) end as obv, {win('avg', 'volume', 20)} as v20, {win('avg', 'volume', 10)} as v10, {win('avg', 'volume', 5)} as v5, case when count(volume) over ({P} rows 4 preceding) >= 5 then regr_slope(volume, pos) over ({P} rows 4 preceding) end as slope,
case when count(case when r is not null and mr is not null then 1 end) over ({P} rows 59 preceding) >= 60 and count(mr) over ({P} rows 59 preceding) >= 60 then covar_samp(r, mr) over ({P} rows 59 preceding) / nullif(var_samp(mr) over ({P} rows 59 preceding), 0) end as beta,
{', '.join(win('sum', c, k) + f' as {c}{k}' for c in ('r', 'mr') for k in (5, 20))}, {win('stddev_samp', 'r', 20)} * sqrt(252) as vol20, {win('stddev_samp', 'r', 60)} * sqrt(252) as vol60 from y)"""
_SEC_COLS = ["volume_ratio_20d", "volume_trend_5d", "obv_momentum_10d", "rolling_beta", "idiosyncratic_momentum_5d", "idiosyncratic_momentum_20d", "sector_rel_momentum_5d", "sector_rel_momentum_20d", "vol_regime", "vol_of_vol", "vol_percentile"]


@query(
    f"with {_SEC} select symbol, {DAY}, {s6(DIV('volume', 'v20'), 'volume_ratio_20d')}, {s6('case when v5 > 0 then slope / v5 when v5 is not null then 0 end', 'volume_trend_5d')}, {s6(DIV('obv - ' + LAG('obv', 10), 'v10'), 'obv_momentum_10d')}, {s6('case when beta is not null then least(greatest(beta, -3), 3) end', 'rolling_beta')}, {s6('r5 - beta * mr5', 'idiosyncratic_momentum_5d')}, {s6('r20 - beta * mr20', 'idiosyncratic_momentum_20d')}, {s6('r5 - mr5', 'sector_rel_momentum_5d')}, {s6('r20 - mr20', 'sector_rel_momentum_20d')}, coalesce(vol20 > vol60, false)::double as vol_regime, {s6(win('stddev_samp', 'vol20', 20), 'vol_of_vol')}, {s6(rank_sql('vol20', 252), 'vol_percentile')} from z"
)
def feat_sector(spark, d):
    v = pipeline.views(spark, d)
    return out(features.sector(v["bars"], v["market"]), *_SEC_COLS)


_EAR_COLS = ["earnings_surprise", "earnings_surprise_abs", "days_since_earnings", "earnings_drift_signal", "beat_miss"]


@query(
    f"with {BARS}, {EVENTS}, x as (select b.symbol, b.date, b.date - e.date as age, e.surprise_pct / 100 as s from bars b asof left join ev e on b.symbol = e.symbol and b.date >= e.date), y as (select symbol, date, case when age <= 60 then age end as age, case when age <= 60 then s end as s from x) select symbol, {DAY}, {s6('coalesce(s, 0)', 'earnings_surprise')}, {s6('coalesce(abs(s), 0)', 'earnings_surprise_abs')}, {s6('age', 'days_since_earnings')}, {s6('coalesce(s * greatest(0, 1 - age / 30.0), 0)', 'earnings_drift_signal')}, {s6('case when s > 0.05 then 1 when s < -0.05 then -1 else 0 end', 'beat_miss')} from y"
)
def feat_earnings(spark, d):
    v = pipeline.views(spark, d)
    return out(features.earnings(v["bars"], v["events"]), *_EAR_COLS)


_IV = f"""{BARS}, {MACRO}, vx as (select date, close from mac where symbol = 'vix'),
x as (select b.symbol, b.date, b.close, last_value(vx.close ignore nulls) over (partition by b.symbol order by b.date rows unbounded preceding) / 100 as x from bars b left join vx on vx.date = b.date),
y as (select *, {LN('close', LAG('close'))} as r, {DIV('x', LAG('x'))} - 1 as dx from x), z as (select *, {win('stddev_samp', 'r', 20)} * sqrt(252) as rv20, {win('stddev_samp', 'r', 30)} * sqrt(252) as rv30 from y),
u as (select *, {DIV('rv20', LAG('rv20'))} - 1 as dr from z),
t as (select *, case when count(case when dr is not null and dx is not null then 1 end) over ({P} rows 59 preceding) >= 60 and count(dx) over ({P} rows 59 preceding) >= 60 then covar_samp(dr, dx) over ({P} rows 59 preceding) / nullif(var_samp(dx) over ({P} rows 59 preceding), 0) end as beta from u),
i as (select *, coalesce(x * (case when beta is not null then least(greatest(beta, 0.5), 3) end), rv20) as iv from t), j as (select *, {win('avg', 'iv', 5)} as iv5 from i)"""
_IV_COLS = ["iv_30d", "iv_60d", "iv_rv_spread_20", "iv_rv_spread_30", "iv_percentile_252", "iv_change_5d", "iv_term_structure"]


@query(f"with {_IV} select symbol, {DAY}, {', '.join(s6(f'coalesce({e}, 0)', n) for n, e in zip(_IV_COLS, ['iv', 'iv5', 'iv - rv20', 'iv - rv30', rank_sql('iv', 252), 'iv - ' + LAG('iv', 5), 'iv5 - iv'], strict=True))} from j")
def feat_options_proxy(spark, d):
    v = pipeline.views(spark, d)
    return out(features.implied_volatility_proxy(v["bars"], v["macro"].filter("symbol = 'vix'").select("date", "close")), *_IV_COLS)


_FU = f"""{BARS}, f as (select symbol, date, 5 + close % 30 as pe, 1 + open % 5 as pb, 8 + high % 40 as vix, coalesce(low % 20 - 10, 0) as s, date < date '2021-01-01' as file from bars),
x as (select *, least(greatest((s - avg(s) over (partition by file)) / (stddev_samp(s) over (partition by file) + 1e-8), -3), 3) / 3 as precomputed_sentiment, {rank_sql('vix', 252, 60)} as vp, {rank_sql('pe', 252, 60)} as pp, {rank_sql('pb', 252, 60)} as bp from f)"""
_FU_SQL = {"pe_ratio": "pe", "pb_ratio": "pb", "india_vix": "vix", "precomputed_sentiment": "precomputed_sentiment", "pe_change_1d": "pe - " + LAG("pe"), "pb_change_1d": "pb - " + LAG("pb"), "vix_change_1d": "vix - " + LAG("vix"), "vix_change_5d": "vix - " + LAG("vix", 5), "vix_ma_5": win("avg", "vix", 5, 1), "vix_ma_10": win("avg", "vix", 10, 1), "pe_ma_10": win("avg", "pe", 10, 1), "pb_ma_10": win("avg", "pb", 10, 1), "vix_percentile": "vp", "pe_percentile": "pp", "pb_percentile": "bp", "pe_regime": f"(pe > {win('avg', 'pe', 60, 20)})::int", "vix_regime": f"(vix > {win('avg', 'vix', 60, 20)})::int", "pe_vix_danger": "pp * vp", "vix_crisis": "(vix > 30)::int", "market_expensive": "(pe > 25)::int", "market_cheap": "(pe < 15)::int"}


# the product of two ranks lies on halves of the sixth place, where engines may round either way; it is exact as it is
@query(f"with {_FU} select symbol, {DAY}, {', '.join((s6(f'coalesce({e}, 0)', n) if n != 'pe_vix_danger' else f'coalesce({e}, 0)::double as {n}') for n, e in _FU_SQL.items())} from x")
def feat_fundamentals(spark, d):
    b = pipeline.views(spark, d)["bars"]
    f = b.select("symbol", "date", (5 + F.col("close") % 30).alias("pe"), (1 + F.col("open") % 5).alias("pb"), (8 + F.col("high") % 40).alias("vix"), (F.col("low") % 20 - 10).alias("sentiment_score"), (F.col("date") < F.lit("2021-01-01").cast("date")).alias("file"))
    x = features.fundamentals(f)
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), *[r6(c) if c != "pe_vix_danger" else F.col(c) for c in features.FUNDAMENTAL])


@query()
def feat_index_fundamentals(spark, d):
    return features.fundamentals(index.rows(spark, d))


_T5 = f"{BARS}, t as (select *, {LN(f'lead(close, 5) over ({P})', 'close')} as y, {LN('close', LAG('close'))} as r from bars)"


@query(f"with {_T5}, a as (select symbol, date, {LAG('r')} as r_lag1, {LAG('r', 5)} as r_lag5, {win('avg', 'r', 5)} as r_mom5, {win('avg', 'r', 10)} as r_mom10, {win('stddev_samp', 'y', 5)} as target_vol_5, {win('stddev_samp', 'y', 10)} as target_vol_10 from t) select symbol, {DAY}, {', '.join(s6(c, c) for c in ('r_lag1', 'r_lag5', 'r_mom5', 'r_mom10', 'target_vol_5', 'target_vol_10'))} from a where r_lag1 is not null and r_lag5 is not null and r_mom5 is not null and r_mom10 is not null and target_vol_5 is not null and target_vol_10 is not null")
def feat_augment(spark, d):
    b = _targets(spark, d).withColumnsRenamed({"log_return_1d": "r"})
    return out(features.augment(b, ["r"]), "r_lag1", "r_lag5", "r_mom5", "r_mom10", "target_vol_5", "target_vol_10")


def _targets(spark, d):
    return pipeline.views(spark, d)["bars"].withColumns({"log_return_5d": F.ln(w.lag("close", -5) / F.col("close")), "log_return_1d": w.log_return("close")})


@query(f"with {_T5}, a as (select symbol, date, {win('avg', 'y', 3)} as y from t) select symbol, {DAY}, {s6('y', 'log_return_5d')}, (y > 1e-12)::int as direction from a where y is not null")
def feat_target(spark, d):
    x = features.transform_target(_targets(spark, d)).withColumn("direction", (F.col("log_return_5d") > 1e-12).cast("int"))
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("log_return_5d"), "direction")


# --- cleaning and quality ---------------------------------------------------------------------------------------


@query(f"with {_T5}, k as (select *, row_number() over (partition by symbol order by date desc) as t from t), c as (select * from k where t > 5) select 'close' as column, {s6('avg((close is null)::int)', 'null_ratio')}, false as dropped from c union all select 'y', round(avg((y is null)::int), 6) + 0.0, avg((y is null)::int) > 0.01 from c union all select 'r', round(avg((r is null)::int), 6) + 0.0, avg((r is null)::int) > 0.01 from c union all select 'one', 0.0, true from (select 1)")
def cln_training(spark, d):
    x = _targets(spark, d).withColumnsRenamed({"log_return_5d": "y", "log_return_1d": "r"}).withColumn("one", F.lit(1.0))
    _, _, report = cleaning.clean_training(x, ["close", "y", "r", "one", "close"], leakage=("nothing",))
    return report.select("column", r6("null_ratio"), "dropped")


@query(f"with {_FILLED}, g as (select symbol, median(c) as m from x group by 1), f as (select symbol, date, coalesce(last_value(c ignore nulls) over ({P} rows unbounded preceding), first_value(c ignore nulls) over ({P} rows between current row and unbounded following)) as c from x) select f.symbol, {DAY}, {s6('coalesce(c, m)', 'c')} from f join g on f.symbol = g.symbol")
def cln_conservative(spark, d):
    b = pipeline.views(spark, d)["bars"].withColumn("c", F.when(F.round(F.col("close") * 100).cast("long") % 3 == 0, F.col("close")))
    return out(cleaning.clean_conservative(b, ["c"]), "c")


@query(f"with {_RETURNS} select symbol, {DAY}, {s6('coalesce(log_return_1d, 0)', 'log_return_1d')}, 0.0 as absent from r")
def cln_live(spark, d):
    x = pipeline.views(spark, d)["bars"].withColumn("log_return_1d", w.log_return("close"))
    x = cleaning.clean_live(x, ["log_return_1d", "absent"])
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("log_return_1d"), "absent")


def _dq(name, severity, column, value, passed):
    return f"select '{name}' as check, '{severity}' as severity, '{column}' as column, round(({value})::double, 6) + 0.0 as value, coalesce(({passed}), true) as passed from x"


_DQ_PRICES = " union all ".join([_dq("null_ratio", "error", c, f"avg(({c} is null)::int)", f"avg(({c} is null)::int) <= 0.05") for c in ("open", "high", "low", "close", "volume")] + [_dq("any_null", "warning", "*", "count(*) * 0", "count(*) >= 0"), _dq("row_count", "error", "*", "count(*)", "count(*) >= 200"), _dq("date_gap", "warning", "date", "max(gap)", "max(gap) <= 10"), _dq("stale", "warning", "date", "date '2024-12-31' - max(date)", "date '2024-12-31' - max(date) <= 30")] + [_dq("non_positive", "error", c, f"count(*) filter ({c} <= 0)", f"count(*) filter ({c} <= 0) = 0") for c in ("open", "high", "low", "close")] + [_dq("large_change", "warning", "close", "count(*) filter (chg > 0.5)", "count(*) filter (chg > 0.5) = 0"), _dq("zero_volume", "warning", "volume", "count(*) filter (volume <= 0)", "count(*) filter (volume <= 0) = 0")])


@query(f"with {BARS}, x as (select *, date - {LAG('date')} as gap, abs(close / nullif({LAG('close')}, 0) - 1) as chg from bars) {_DQ_PRICES}")
def dq_prices(spark, d):
    return quality.check_prices(pipeline.views(spark, d)["bars"], as_of="2024-12-31").withColumn("value", r6("value"))


@query(f"with {NEWS}, x as (select * from news) " + " union all ".join([_dq("null_ratio", "error", c, "count(*) * 0", "count(*) >= 0") for c in ("article_count", "avg_sentiment")] + [_dq("any_null", "warning", "*", "count(*) * 0", "count(*) >= 0"), _dq("row_count", "error", "*", "count(*)", "count(*) >= 200"), _dq("out_of_bounds", "error", "avg_sentiment", "count(*) filter (not avg_sentiment between -1 and 1)", "count(*) filter (not avg_sentiment between -1 and 1) = 0")]))
def dq_sentiment(spark, d):
    return quality.check_sentiment(pipeline.views(spark, d)["news"]).withColumn("value", r6("value"))


# --- sorts, sets, pivots, text ----------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query(f"with {BARS} select symbol, {DAY}, {s6('close', 'close')} from bars qualify row_number() over (partition by symbol order by date desc) <= 3")
def top_tail(spark, d):
    x = pipeline.views(spark, d)["bars"].withColumn("t", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter("t <= 3")
    return out(x, "close")


@query("select distinct symbol from (select symbol from prices union all select symbol from sentiment) where symbol is not null")
def set_union_distinct(spark, d):
    return table(spark, d, "prices").select("symbol").unionByName(table(spark, d, "sentiment").select("symbol", "date"), allowMissingColumns=True).select("symbol").dropDuplicates().filter("symbol is not null")


@query("select symbol from (select distinct symbol from prices) where symbol in (select symbol from sentiment) and symbol in (select upper(trim(symbol)) from earnings)")
def set_intersect_flags(spark, d):
    flags = [table(spark, d, t).select(F.upper(F.trim("symbol")).alias("symbol") if t == "earnings" else F.col("symbol")).distinct().withColumn(t, F.lit(True)) for t in ("prices", "sentiment", "earnings")]
    x = flags[0].join(flags[1], "symbol", "full").join(flags[2], "symbol", "full")
    return x.filter("prices and sentiment and earnings").select("symbol")


@query(f"select serial_no, {s6(_score_sql('headline'), 'basic')}, {s6(_score_sql('headline', _POS + ', ' + ', '.join(repr(x) for x in lexicon.MORE_POSITIVE), _NEG + ', ' + ', '.join(repr(x) for x in lexicon.MORE_NEGATIVE)), 'extended')} from financial_headlines_with_serial_no")
def txt_lexicon(spark, d):
    return table(spark, d, "financial_headlines_with_serial_no").select("serial_no", r6(lexicon.lexicon_score("headline"), "basic"), r6(lexicon.extended_score("headline"), "extended"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.absent'), 'none') as absent from events")
def fn_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent"))


# --- evaluation -------------------------------------------------------------------------------------------------

_PRED = f"{BARS}, pr as (select symbol, date, {DIV('close', LAG('close', 5))} - 1 as y_pred, {LN(f'lead(close, 5) over ({P})', 'close')} as y_true from bars), p as (select *, (case when y_pred >= 0 then 1 else -1 end) * y_true as r from pr where y_pred is not null and y_true is not null)"


def _preds(spark, d):
    b = pipeline.views(spark, d)["bars"]
    return b.select("symbol", "date", w.pct_change("close", 5).alias("y_pred"), F.ln(w.lag("close", -5) / F.col("close")).alias("y_true"))


_MET = ["directional_accuracy", "rmse", "mae", "r2", "sharpe", "max_drawdown", "calmar"]


def _metrics_sql(by: str) -> str:
    e = f"over (partition by {by} order by date rows unbounded preceding)"
    return f"""q as (select *, product(1 + r) {e} as eq from p), z as (select *, (eq - max(eq) {e}) / max(eq) {e} as dd from q),
a as (select {by}, count(*) as n, avg(((y_pred >= 0) = (y_true >= 0))::int) as directional_accuracy, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) as rmse, avg(abs(y_true - y_pred)) as mae, coalesce(1 - sum((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true) * count(*), 0), 0) as r2,
coalesce(avg(r - 0.001 - 0.04 / 252) / nullif(stddev_samp(r - 0.001), 0), 0) * sqrt(252) as sharpe, min(dd) as max_drawdown, avg(r) * 252 as y from z group by 1)
select {by}, n, {', '.join(s6(c, c) for c in _MET[:-1])}, {s6('coalesce(y / nullif(abs(max_drawdown), 0), 0)', 'calmar')} from a"""


@query(f"with {_PRED}, {_metrics_sql('symbol')}")
def ev_metrics(spark, d):
    return evaluate.metrics(_preds(spark, d)).select("symbol", "n", *[r6(c) for c in _MET])


@query(f"with {_PRED} select {_LABEL} as regime, count(*) as n, {s6('avg(((y_pred >= 0) = (y_true >= 0))::int)', 'directional_accuracy')}, {s6('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 'rmse')} from p group by 1")
def ev_regimes(spark, d):
    return evaluate.regime_metrics(_preds(spark, d), REGIMES).select("regime", "n", r6("directional_accuracy"), r6("rmse"))


_WALK = evaluate.walk_forward_windows(dt.date(2018, 1, 1), dt.date(2024, 12, 31))


@query(f"with {BARS} " + " union all ".join(f"select {i} as \"window\", count(*) filter (date <= date '{e}') as train_rows, count(*) filter (date > date '{e}' and date <= date '{t}') as test_rows, count(*) filter (date <= date '{e}') >= 200 and count(*) filter (date > date '{e}' and date <= date '{t}') >= 60 as used from bars" for i, e, t in _WALK))
def ev_walk_forward(spark, d):
    return evaluate.walk_forward_sizes(pipeline.views(spark, d)["bars"], _WALK)


@query(f"with {_PRED}, g as (select round(-0.02 + 0.0005 * i, 10) as threshold from range(81) t(i)) select threshold, {s6('avg(((y_pred >= threshold) = (y_true >= 0))::int)', 'accuracy')} from p, g group by 1")
def ev_threshold_sweep(spark, d):
    return evaluate.threshold_sweep(_preds(spark, d)).select("threshold", r6("accuracy"))


@query(f"with {_PRED}, t as (select * from p qualify row_number() over (partition by symbol order by date desc) <= 252) select symbol, count(*) as n, {s6('avg(((y_pred >= 0) = (y_true >= 0))::int)', 'accuracy')}, case when avg(((y_pred >= 0) = (y_true >= 0))::int) < 0.6 then 'momentum_fallback' else 'model' end as mode from t group by 1")
def ev_monitor(spark, d):
    return evaluate.monitor(_preds(spark, d)).withColumn("accuracy", r6("accuracy"))


@query(f"with {BARS}, t as (select *, row_number() over (partition by symbol order by date desc) as k from bars where date <= date '2021-06-30') select symbol, {DAY} from t where k > 1")
def ev_pre_regime_train(spark, d):
    return out(evaluate.pre_regime_train(pipeline.views(spark, d)["bars"], "2021-06-30"))


@query()
def ev_random_baseline(spark, d):
    return evaluate.random_baseline(_preds(spark, d))


@query(f"with {_PRED}, l as (select *, {_LABEL} as regime from p) select symbol as model, {', '.join(f'''printf('%.2f', 100 * avg(((y_pred >= 0) = (y_true >= 0))::int) filter (regime = '{r}')) as {r}''' for r in ('bull', 'recovery'))} from l group by 1")
def piv_metrics(spark, d):
    x = panel.label_ranges(_preds(spark, d).dropna(), REGIMES).groupBy(F.col("symbol").alias("model"), "regime").agg(evaluate.directional_accuracy(F.col("y_pred"), F.col("y_true")).alias("directional_accuracy"))
    return evaluate.comparison(x, names=["bull", "recovery"])


# --- causal selection and models --------------------------------------------------------------------------------

_CAND = ["momentum_5d", "volatility_10d", "log_return_1d"]


def _small(spark, d):
    b = pipeline.views(spark, d)["bars"]
    x = b.withColumns({"log_return_1d": w.log_return("close"), "momentum_5d": w.pct_change("close", 5), "log_return_5d": F.ln(w.lag("close", -5) / F.col("close"))})
    return x.withColumn("volatility_10d", w.roll_std("log_return_1d", 10)).dropna(subset=[*_CAND, "log_return_5d"])


def _full(spark, d):
    """The matrix with every feature; missing features are 0, as in the cleaned matrix, but no column goes."""
    return cut(pipeline.matrix(spark, d).select("symbol", "date", "log_return_5d", *features.ALL).fillna(0.0, features.ALL))


@query()
def cau_granger(spark, d):
    return causal.granger(_full(spark, d), features.ALL, "log_return_5d")


@query()
def cau_pcmci(spark, d):
    x = _full(spark, d)
    return causal.links_into(x, causal.pcmci(x, [*features.ALL, "log_return_5d"], targets=["log_return_5d"]), "log_return_5d")


@query()
def cau_select(spark, d):
    x = _full(spark, d)
    return causal.select_features(causal.granger(x, features.ALL, "log_return_5d"), causal.pcmci_by_symbol(x, [*features.ALL, "log_return_5d"], "log_return_5d"), "union")


@query(f"with {_T5}, c as (select symbol, date, row_number() over ({P}) - 1 as i, count(*) over (partition by symbol) as n from t where y is not null) select symbol, {DAY}, case when i < floor(n * 0.7::double) then 'train' when i < floor(n * 0.85::double) then 'validation' else 'test' end as part from c")
def ml_split(spark, d):
    return out(models.chronological_split(_targets(spark, d), ["log_return_5d"], 0.7, 0.15).select("symbol", "date", "part"), keys=("symbol", "date", "part"))


@query(f"with {BARS} select 'close' as feature, {s6('avg(close)', 'center')}, {s6('stddev_pop(close)', 'scale')} from bars union all select 'open', round(avg(open), 6) + 0.0, round(stddev_pop(open), 6) + 0.0 from bars")
def ml_scaler(spark, d):
    return models.fit_scaler(pipeline.views(spark, d)["bars"], ["close", "open"]).select("feature", r6("center"), r6("scale"))


@query()
def ml_ar(spark, d):
    return models.ar_forecasts(_small(spark, d), "log_return_5d")


@query(f"with {_PRED}, s as (select avg(y_pred) as m, stddev_pop(y_pred) as d, avg(y_true) as y, covar_pop(y_pred, y_true) as c, count(*) as n from p) select {s6('c / d * n / (n + 1) / d', 'weight')}, {s6('y - m * (c / d * n / (n + 1) / d)', 'intercept')} from s")
def ml_ridge(spark, d):
    weights, intercept = models.fit_ridge(_preds(spark, d), ["y_pred"], "y_true")
    return spark.createDataFrame([(weights["y_pred"], intercept)], "weight double, intercept double").select(r6("weight"), r6("intercept"))


@query(f"with {_RETURNS}, v as (select *, {win('stddev_samp', 'log_return_1d', 10)} * sqrt(252) as vol, {DIV('close', LAG('close', 5))} - 1 as p from r), t as (select symbol, date, close, p, coalesce(case when vol > 0 then vol / sqrt(252) end, 0.02) * sqrt(5) as b from v where p is not null) select symbol, {DAY}, {s6('close * exp(p)', 'predicted_price')}, {s6('close * exp(p - 1.645 * b)', 'lower_band')}, {s6('close * exp(p + 1.645 * b)', 'upper_band')}, case when p >= 0 then 'UP' else 'DOWN' end as direction from t")
def ml_prediction_record(spark, d):
    b = pipeline.views(spark, d)["bars"].withColumns({"_r": w.log_return("close"), "predicted_return": w.pct_change("close", 5)})
    b = b.withColumn("volatility_10d", w.roll_std("_r", 10) * 252**0.5).withColumns({c: F.lit(None).cast("double") for c in ("volatility_20d", "volatility_30d")}).filter("predicted_return is not null")
    x = models.prediction_record(b, ["predicted_return", "volatility_10d"])
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("predicted_price"), r6("lower_band"), r6("upper_band"), "direction")


@query(f"with {_MX}, z as (select date, max(close) filter (symbol = 'vix') as vix_level, max(d1) filter (symbol = 'vix') as vc, max(close) filter (symbol = 'tnx') - max(close) filter (symbol = 'irx') as ys, max(ret) filter (symbol = 'sp500') as sp from q group by 1) select {DAY}, case when coalesce(vix_level, 20) > 30 and coalesce(vc, 0) > 2 then 'crisis' when coalesce(ys, 1) < -0.1 then 'rate_hike' when coalesce(vix_level, 20) < 20 and coalesce(sp, 0) > 0 then 'bull' else 'neutral' end as regime from z where date in (select date from q where symbol in ('vix', 'tnx', 'irx', 'dxy', 'gold', 'oil', 'sp500') or symbol like 'fund%')")
def ml_detect_regime(spark, d):
    m = features.macro(pipeline.views(spark, d)["macro"]).withColumn("vol_regime", F.lit(None).cast("double"))
    known = pipeline.views(spark, d)["macro"].select("date").distinct()
    x = known.join(m, "date", "left")
    return x.select(F.date_format("date", "yyyy-MM-dd").alias("date"), models.detect_regime().alias("regime"))


@query()
def ml_lstm(spark, d):
    x = models.chronological_split(_full(spark, d), ["log_return_5d"])
    scaler = models.fit_scaler(x.filter("part = 'train'"), features.ALL)
    q = cut(w.sequences(models.apply_scaler(x, scaler), features.ALL, 20))
    m = sequence.fit_sequences(q.filter("part != 'test'").withColumn("v", F.col("part") == "validation"), len(features.ALL), "log_return_5d", "v")
    return sequence.score(q, m)


@query()
def ml_drivers(spark, d):
    x = _full(spark, d)
    return models.Ensemble(features.ALL, "log_return_5d").fit(x).drivers(x)


@query()
def ml_ensemble(spark, d):
    x = _full(spark, d)
    return models.Ensemble(features.ALL, "log_return_5d").fit(x).predict(x)


# the families' SQL joined as the matrix joins them, with the configured series in the parts
_PART = f"mac as (select case symbol {' '.join(f"""when '{v}' then '{k}'""" for k, v in pipeline.ROLE_SYMBOLS.items())} end as symbol, date, close from mall where symbol in ({', '.join(repr(v) for v in pipeline.ROLE_SYMBOLS.values())}))"
_PARTS = {n: f"({SQL[n].replace(MACRO, _SERIES + ',' + chr(10) + _PART)})" for n in ("feat_technical", "feat_sector", "feat_earnings", "feat_options_proxy", "feat_sentiment", "feat_macro")}
_OUT = ["log_return_5d", "excess_return_5d", *features.ALL]
# half of a level with four decimals lies on halves of the seventh place, so the options' columns are given to eight
_PARTS["feat_options_proxy"] = _PARTS["feat_options_proxy"].replace("::double, 6)", "::double, 8)")


@query(
    f"with x as (select t.*, {', '.join(f's.{c}' for c in features.SECTOR)}, {', '.join(f'e.{c}' for c in features.EARNINGS)}, {', '.join(f'o.{c}' for c in features.OPTIONS)}, {', '.join(f'n.{c}' for c in features.SENTIMENT)}, {', '.join(f'm.{c}' for c in features.MACRO)} from {_PARTS['feat_technical']} t left join {_PARTS['feat_sector']} s on s.symbol = t.symbol and s.date = t.date left join {_PARTS['feat_earnings']} e on e.symbol = t.symbol and e.date = t.date left join {_PARTS['feat_options_proxy']} o on o.symbol = t.symbol and o.date = t.date left join {_PARTS['feat_sentiment']} n on n.symbol = t.symbol and n.date = t.date left join {_PARTS['feat_macro']} m on m.date = t.date) select symbol, date, {', '.join(f'last_value({c} ignore nulls) over ({P} rows 5 preceding) as {c}' if c in (*features.MACRO, *features.SENTIMENT) else c for c in _OUT)} from x"
)
def pipe_matrix(spark, d):
    x = pipeline.matrix(spark, d)
    return x.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), *[(F.round(c, 8) + F.lit(0.0)).alias(c) if c in features.OPTIONS else r6(c) for c in _OUT])


@query()
def pipe_index_matrix(spark, d):
    return index.matrix(spark, d)
