"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import epoch_us
from tidemark.operators import instants, regular_grid, rolling_state, schema_drift, spikes
from tidemark.runtime import cut
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _spikes(spark: SparkSession, d: str) -> DataFrame:
    prices, macro = table(spark, d, "prices"), table(spark, d, "macro")
    obs = spikes.readings(prices, "prices", "bar_id", {"close": "level", "volume": "volume"}).unionByName(spikes.readings(macro, "macro", "reading_id", {"close": "level"}))
    return spikes.flag_readings(obs, 2 * prices.count() + macro.count())  # counts come from the footers


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _spikes(spark, d).select("table_name", "row_id", "field_name")


@query
def p1_states(spark: SparkSession, d: str) -> DataFrame:
    return _spikes(spark, d)


HEADLINES = ("financial_headlines_with_serial_no_2", "financial_headlines_with_serial_no")


@query
def p5_instants(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, HEADLINES[0]).unionByName(table(spark, d, HEADLINES[1]))
    return instants.normalise_instants(both.select("serial_no", "date", "feed"), table(spark, d, "feeds")).select("serial_no", "date", "feed", "utc_us")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_instants(spark, d).filter("utc_us is not null").select("serial_no", "utc_us")


def _state(spark: SparkSession, d: str) -> DataFrame:
    return rolling_state.rolling_state(table(spark, d, "sentiment"), keep=("sentiment_ma_5d", "buzz_ma_3d"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = _state(spark, d)
    off = lambda stored, true: F.abs(F.col(stored) - F.col(true)) > 0.001
    age = F.col("n") - F.col("lo") + 1
    cases = F.array_compact(
        F.array(
            F.when(F.col("has_row") & (F.col("buzz_ma_3d").isNull() | off("buzz_ma_3d", "mean_articles_3")), F.lit("buzz_ma_3d")),
            F.when(F.col("has_row") & (off("sentiment_ma_5d", "mean_score_5") | (F.col("sentiment_ma_5d").isNull() != F.col("mean_score_5").isNull())), F.lit("sentiment_ma_5d")),
            F.when((age >= 7) & (F.col("articles_7") == 0), F.lit("quiet_7d")),
            F.when((age >= 30) & (F.col("articles_30") >= 20) & (F.col("articles_7") * 2 > F.col("articles_30")), F.lit("surge_7d")),
        )
    )
    return x.select(F.col("entity").alias("symbol"), F.date_format("on_day", "yyyy-MM-dd").alias("on_day"), F.explode(cases).alias("metric"))


@query
def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    x = _state(spark, d)
    r = [f"mean_score_{k}" for k in rolling_state.WINDOWS]
    return x.select(F.col("entity").alias("symbol"), F.date_format("on_day", "yyyy-MM-dd").alias("on_day"), *[f"articles_{k}" for k in rolling_state.WINDOWS], *r)


def _files(spark: SparkSession, d: str):
    lines = table(spark, d, "unused_data").unionByName(table(spark, d, "final_data"))
    heads = cut(schema_drift.schemas(lines))  # a row a file
    return heads, cut(schema_drift.cells(lines, heads))  # a row a file and day, used twice


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(*_files(spark, d)).select("index_symbol", "file_no", "field_name", "drift")


@query
def p4_table(spark: SparkSession, d: str) -> DataFrame:
    heads, c = _files(spark, d)
    return schema_drift.one_table(c, cut(schema_drift.changes(heads, c)))


@query
def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """p4_table with a row per field."""
    x = p4_table(spark, d).select("index_symbol", "on_day", "file_no", F.explode("fields").alias("field_name", "u"))
    return x.select("index_symbol", "on_day", "file_no", "field_name", "u.*")


def _grids(spark: SparkSession, d: str) -> DataFrame:
    macro, sent = table(spark, d, "macro"), table(spark, d, "sentiment")
    m = regular_grid.fill_grid(regular_grid.last_of_day(macro, "symbol", epoch_us(macro, "date"), "close", "reading_id"), "source", "on_day", "value", weekdays_only=True)
    out = m.select(F.lit("macro.close").alias("field_name"), "*")
    v = rolling_state.versions(sent, "symbol", "date", ["article_count", "sentiment_score"], "loaded_at").withColumn("day", F.date_from_unix_date("n"))
    for f in ("sentiment_score", "article_count"):
        g = regular_grid.fill_grid(v.withColumn("value", F.col(f"last.{f}").cast("double")), "entity", "day", "value")
        out = out.unionByName(g.select(F.lit(f"sentiment.{f}").alias("field_name"), "*"))
    return out.select("field_name", F.col("source").alias("symbol"), F.date_format("on_day", "yyyy-MM-dd").alias("on_day"), "value", "missing", F.date_format("filled_from", "yyyy-MM-dd").alias("filled_from"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).filter("missing").select("field_name", "symbol", "on_day")


@query
def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d)


_HELD = """held as (select symbol, date, max(struct_pack(l := loaded_at, a := article_count, s := case when isnan(sentiment_score) then null else sentiment_score end, m := sentiment_ma_5d, b := buzz_ma_3d)) as r
from sentiment where date is not null group by 1, 2),
span as (select symbol, min(date) as lo, max(date) as hi from held group by 1)"""
_ROLL = f"""with {_HELD},
spine as (select symbol, lo, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as date from span),
x as (select s.symbol, s.lo, s.date, h.symbol is not null as has_row, coalesce(h.r.a, 0) as a, h.r.s as s, h.r.m as m, h.r.b as b
from spine s left join held h on s.symbol = h.symbol and s.date = h.date),
roll as (select *, {", ".join(f"sum(a) over w{k} as articles_{k}, sum(s::decimal(20,8)) over w{k}::double / nullif(count(s) over w{k}, 0) as mean_score_{k}" for k in (3, 5, 7, 30))} from x
window {", ".join(f"w{k} as (partition by symbol order by date rows {k - 1} preceding)" for k in (3, 5, 7, 30))})"""
SQL["p2_rolling"] = _ROLL + f" select symbol, strftime(date, '%Y-%m-%d') as on_day, {', '.join(f'articles_{k}::bigint as articles_{k}, mean_score_{k}' for k in (3, 5, 7, 30))} from roll"
SQL["p2_found"] = _ROLL + """ select symbol, strftime(date, '%Y-%m-%d') as on_day, metric from (
select symbol, date, 'buzz_ma_3d' as metric from roll where has_row and (b is null or abs(b - articles_3 / 3.0) > 0.001)
union all select symbol, date, 'sentiment_ma_5d' from roll where has_row and (abs(m - mean_score_5) > 0.001 or (m is null) <> (mean_score_5 is null))
union all select symbol, date, 'quiet_7d' from roll where date >= lo + 6 and articles_7 = 0
union all select symbol, date, 'surge_7d' from roll where date >= lo + 29 and articles_30 >= 20 and articles_7 * 2 > articles_30)"""
_SENT = "with " + _HELD
SQL["p6_found"] = _SENT + """,
m as (select symbol, date::date as date from macro where close is not null and not isnan(close) group by 1, 2),
md as (select symbol, unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day))::date as date from m group by 1),
sd as (select symbol, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as date from span)
select 'macro.close' as field_name, symbol, strftime(date, '%Y-%m-%d') as on_day from md where isodow(date) < 6 and not exists (select 1 from m where m.symbol = md.symbol and m.date = md.date)
union all select 'sentiment.sentiment_score', symbol, strftime(date, '%Y-%m-%d') from sd where not exists (select 1 from held h where h.symbol = sd.symbol and h.date = sd.date and h.r.s is not null)
union all select 'sentiment.article_count', symbol, strftime(date, '%Y-%m-%d') from sd where not exists (select 1 from held h where h.symbol = sd.symbol and h.date = sd.date and h.r.a is not null)"""

_FILLED = "select '{0}' as field_name, symbol, strftime(date, '%Y-%m-%d') as on_day, last_value(v ignore nulls) over (partition by symbol order by date)::double as value, v is null as missing, strftime(last_value(case when v is not null then date end ignore nulls) over (partition by symbol order by date), '%Y-%m-%d') as filled_from from {1}"
SQL["p6_grid"] = f"""{_SENT},
m as (select symbol, date::date as date, arg_max(close, struct_pack(t := date, r := reading_id)) as v from macro where close is not null and not isnan(close) group by 1, 2),
md as (select symbol, unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day))::date as date from m group by 1),
sd as (select symbol, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as date from span),
gm as ({_FILLED.format("macro.close", "(select md.symbol, md.date, v from md left join m on m.symbol = md.symbol and m.date = md.date)")})
select * from gm where isodow(on_day::date) < 6
union all {_FILLED.format("sentiment.sentiment_score", "(select sd.symbol, sd.date, h.r.s as v from sd left join held h on h.symbol = sd.symbol and h.date = sd.date)")}
union all {_FILLED.format("sentiment.article_count", "(select sd.symbol, sd.date, h.r.a as v from sd left join held h on h.symbol = sd.symbol and h.date = sd.date)")}"""

SQL["p1_found"] = """with r as (select 'prices' as table_name, bar_id as row_id, 'close' as field_name, symbol, date, close as v from prices where close is not null and not isnan(close) and date is not null
union all select 'prices', bar_id, 'volume', symbol, date, volume from prices where volume is not null and not isnan(volume) and date is not null
union all select 'macro', reading_id, 'close', symbol, date, close from macro where close is not null and not isnan(close) and date is not null),
p as (select table_name, field_name, symbol, date, arg_min(v, row_id) as v from r group by all),
q as (select *, isinf(v) or (case when field_name = 'volume' then v < 0 or (v = 0 and avg((v = 0)::int) over s <= 0.1) else v <= 0 and avg((v <= 0)::int) over s <= 0.1 end) as bad,
lag(v) over (s order by date) is not distinct from v as again from p window s as (partition by table_name, field_name, symbol)),
g as (select *, sum((not again)::int) over (partition by table_name, field_name, symbol order by date rows unbounded preceding) as run from q),
c as (select *, count(*) over (partition by table_name, field_name, symbol, run) >= 6 and again and not (field_name = 'volume' and v = 0) as stuck from g),
u as (select *, case when field_name <> 'volume' then v when v > 0 then ln(v) end as y from q where not bad and not (field_name = 'volume' and v <= 0)),
w as (select *, abs(y - lag(y) over o) as step, list(y) over (o rows between 5 preceding and 1 preceding) as b, list(y) over (o rows between 1 following and 5 following) as a from u window o as (partition by table_name, field_name, symbol order by date)),
m as (select table_name, field_name, symbol, median(step) as unit from w group by all),
f as (select table_name, field_name, symbol, date from c where bad or stuck
union select w.table_name, w.field_name, w.symbol, date from w join m on w.table_name = m.table_name and w.field_name = m.field_name and w.symbol is not distinct from m.symbol where least(abs(y - list_aggregate(b, 'median')), abs(y - list_aggregate(a, 'median'))) > 12 * unit and len(b) > 0 and len(a) > 0)
select r.table_name, r.row_id, r.field_name from r join f on r.table_name = f.table_name and r.field_name = f.field_name and r.symbol is not distinct from f.symbol and r.date = f.date"""
_MONTHS = str(list(instants.MONTHS))
SQL["p5_found"] = r"""with h as (select serial_no, regexp_replace(regexp_replace(date, '^\s+|\s+$', '', 'g'), '(\.\d{6})\d+', '\1') as t, lower(trim(feed)) as feed from (select serial_no, date, feed from financial_headlines_with_serial_no_2 union all select serial_no, date, feed from financial_headlines_with_serial_no)),
z as (select serial_no, t, tz_name, day_order, nullif(regexp_extract(t, '[0-9] ?([A-Z]{2,5}|Z)$', 1), '') as za, nullif(regexp_extract(t, ':\d\d(?::\d\d(?:\.\d+)?)? ?([+-]\d\d:?\d\d)$', 1), '') as off from h left join (select lower(trim(feed)) as f, tz_name, day_order from feeds) on feed = f),
b as (select *, case when za is not null and za not in ('AM', 'PM') then upper(za) end as zone, case when za is not null and za not in ('AM', 'PM') then regexp_replace(t, ' ?[A-Z]+$', '') when off is not null then regexp_replace(t, ' ?[+-]\d\d:?\d\d$', '') else t end as s from z),
d as (select *, regexp_extract(s, '^(\d{4})[-/](\d\d)[-/](\d\d)(?:[T ]|$)', ['y', 'm', 'd']) as q1, regexp_extract(s, '^(\d{4})(\d\d)(\d\d)(?:[T ]|$)', ['y', 'm', 'd']) as q2, regexp_extract(s, '^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d\d)(?: |$)', ['a', 'b', 'y']) as q3,
regexp_extract(s, '^(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})(?: |$)', ['d', 'm', 'y']) as q4, regexp_extract(s, '^([A-Z][a-z]+) (\d{1,2}), (\d{4})(?: |$)', ['m', 'd', 'y']) as q5, regexp_extract(s, '[T ](\d{1,2}):(\d\d)(?::(\d\d)(?:\.(\d+))?)? ?([aApP]?)[mM]?$', ['h', 'mi', 's', 'f', 'ap']) as t1, regexp_extract(s, '^\d{8}[T ](\d\d)(\d\d)(\d\d)?$', ['h', 'mi', 's']) as t2 from b),
c as (select *, case when q1.y <> '' then [q1.y, q1.m, q1.d] when q2.y <> '' then [q2.y, q2.m, q2.d] when q3.y <> '' and day_order is not null then [case when length(q3.y) = 2 then '20' else '' end || q3.y, case when day_order = 'dmy' then q3.b else q3.a end, case when day_order = 'dmy' then q3.a else q3.b end]
when q4.y <> '' then [q4.y, list_position(@, lower(q4.m))::varchar, q4.d] when q5.y <> '' then [q5.y, list_position(@, lower(q5.m[1:3]))::varchar, q5.d] end as ymd from d),
l as (select *, try_cast(ymd[1] || '-' || lpad(ymd[2], 2, '0') || '-' || lpad(ymd[3], 2, '0') || ' ' || case when t1.h <> '' then lpad(case when t1.ap = '' then t1.h else (try_cast(t1.h as int) % 12 + case when lower(t1.ap) = 'p' then 12 else 0 end)::varchar end, 2, '0') || ':' || t1.mi || ':' || case when t1.s = '' then '00' else t1.s end || case when t1.f = '' then '' else '.' || t1.f end
when t2.h <> '' then t2.h || ':' || t2.mi || ':' || case when t2.s = '' then '00' else t2.s end else '00:00:00' end as timestamp) as local from c),
i as (select *, case when zone in ('UTC', 'GMT', 'Z') then 'UTC' else tz_name end as tz from l),
k as (select *, case when local is not null and tz is not null then timezone(tz, local) end as u from i),
e as (select *, case when timezone(tz, u - interval 1 hour) = local then u - interval 1 hour else u end as u0 from k)
select serial_no, case when off is not null then epoch_us(local) - (case when off[1] = '-' then -1 else 1 end) * (try_cast(off[2:3] as bigint) * 60 + try_cast(right(off, 2) as bigint)) * 60000000 when local is not null then epoch_us(u0) else try_cast(t as bigint) * (case length(t) when 10 then 1000000 when 13 then 1000 else 1 end) end::bigint as utc_us
from e where case when off is not null then local is not null when local is not null then timezone(tz, u0) = local else regexp_matches(t, '^\d+$') and length(t) in (10, 13, 16) end""".replace("@", _MONTHS)
SQL["p5_instants"] = f"select a.serial_no, a.date, a.feed, f.utc_us from (select serial_no, date, feed from {HEADLINES[0]} union all select serial_no, date, feed from {HEADLINES[1]}) a left join ({SQL['p5_found']}) f on a.serial_no = f.serial_no"


def _split_sql(x: str, d: str) -> str:
    cases = (("','", ",", ","), ("';'", ";", ";"), ("'|'", "|", "[|]"), ("chr(9)", "\\t", "\\t"))
    return "case " + " ".join(f"when {d} = {lit} then regexp_extract_all({x} || {lit}, '(\"[^\"]*\"|[^{c}]*){e}', 1)" for lit, c, e in cases) + " end"


def _count_sql(d: str) -> str:
    return f"length(bare) - length(replace(bare, {d}, ''))"


SQL["p4_found"] = f"""with lines as (select index_symbol as i, file_no::bigint as f, line_no as n, raw_line as l from (select * from unused_data union all select * from final_data) where raw_line is not null and file_no is not null and trim(raw_line, E' \\t') <> '' and not starts_with(ltrim(raw_line, E' \\t'), '#')),
h0 as (select i, f, arg_min(l, n) as hl, min(n) as hn, regexp_replace(arg_min(l, n), '"[^"]*"', '', 'g') as bare from lines group by 1, 2),
h1 as (select *, [{_count_sql("','")}, {_count_sql("';'")}, {_count_sql("'|'")}, {_count_sql("chr(9)")}] as cs from h0),
h2 as (select *, [',', ';', '|', chr(9)][list_position(cs, list_max(cs))] as d from h1),
h as (select i, f, hl, hn, d, list_transform({_split_sql('hl', 'd')}, lambda v: lower(trim(trim(trim(replace(v, chr(65279), '')), '"')))) as names from h2),
r as (select h.i, h.f, n, names, list_transform({_split_sql('l', 'd')}, lambda v: trim(trim(trim(v), '"'))) as v from lines join h on lines.i is not distinct from h.i and lines.f = h.f where n > hn and l <> hl),
c0 as (select i, f, n, v[list_position(names, 'date')] as day, names[k] as name, v[k] as val from r, unnest(range(1, len(names) + 1)) t(k)),
c1 as (select i, f, day, name, case when val not in ('', 'NA', 'null', '-') then val end as val from c0 where name not in ('date', '') and day <> '' qualify row_number() over (partition by i, f, day, name order by n) = 1),
c2 as (select *, regexp_extract(regexp_replace(regexp_replace(lower(val), '^[(+-]|^rs ', '', 'g'), '[),%x]', '', 'g'), '^([0-9]*\\.?[0-9]*)(?:e\\+?([0-9]+))?(m?)$', ['d', 'e', 'm']) as p from c1),
c as (select *, case when p.d <> '' then (case when val[1] in ('(', '-') then -1 else 1 end) * try_cast(p.d as double) * s end as amt, case when s = 1 then 0 else 0.5001 * s * pow(10, -length(regexp_extract(p.d, '\\.([0-9]*)$', 1))) end as slack
from (select *, case when p.e <> '' then pow(10, try_cast(p.e as int)) when p.m <> '' then 1e6 else 1 end as s from c2)),
k as (select i, f, name, case when bool_or(not regexp_matches(val, '^-?[0-9]+[.]?[0-9]*$')) then 'text' when bool_or(not regexp_matches(val, '^-?[0-9]+$')) then 'decimal' when count(val) > 0 then 'integer' end as kind from c group by 1, 2, 3),
nm as (select h.i, h.f, name, kind from (select i, f, unnest(list_distinct(names)) as name from h) h left join k using (i, f, name) where name not in ('date', '')),
file as (select distinct i, f from h), had as (select a.i, a.f from file a join file b on a.i = b.i and a.f = b.f + 1),
fresh as (select nm.* from nm join had using (i, f) where not exists (select 1 from nm o where o.i = nm.i and o.f = nm.f - 1 and o.name = nm.name)),
gone as (select nm.i, nm.f + 1 as f, nm.name, nm.kind from nm where exists (select 1 from had where had.i = nm.i and had.f = nm.f + 1) and not exists (select 1 from nm o where o.i = nm.i and o.f = nm.f + 1 and o.name = nm.name)),
pair as (select a.i, a.f, a.name, b.name as old, count(a.val) as days from c a join fresh on fresh.i = a.i and fresh.f = a.f and fresh.name = a.name join c b on b.i = a.i and b.f = a.f - 1 and b.day = a.day join gone on gone.i = b.i and gone.f = a.f and gone.name = b.name
group by 1, 2, 3, 4 having bool_and(case when a.val is null or b.val is null then a.val is null and b.val is null when a.amt is null or b.amt is null then a.val = b.val else abs(a.amt - b.amt) <= a.slack + b.slack + 1e-9 * abs(a.amt) end) and count(a.val) > 0),
ren as (select * from pair qualify row_number() over (partition by i, f, name order by days desc, old) = 1 and row_number() over (partition by i, f, old order by days desc, name) = 1)
select i as index_symbol, f as file_no, name as field_name, 'renamed' as drift from ren
union all select i, f, name, 'added' from fresh where not exists (select 1 from ren where ren.i = fresh.i and ren.f = fresh.f and ren.name = fresh.name)
union all select i, f, name, 'removed' from gone where not exists (select 1 from ren where ren.i = gone.i and ren.f = gone.f and ren.old = gone.name)
union all select a.i, a.f, a.name, 'retyped' from nm a left join ren on ren.i = a.i and ren.f = a.f and ren.name = a.name join nm b on b.i = a.i and b.f = a.f - 1 and b.name = coalesce(ren.old, a.name) where a.kind <> b.kind"""
# the same tables as for the changes, then the names that renames link, and of each day and field the latest value
SQL["p4_cells"] = (
    SQL["p4_found"].split("\nselect i as index_symbol")[0].replace("with lines", "with recursive lines", 1)
    + """,
e as (select old as a, name as b from ren union select name, old from ren),
reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
canon as (select a as name, min(b) as canonical from reach group by 1),
cc as (select i, f, day, c.name, val, amt, coalesce(canonical, c.name) as field, max(f) over (partition by i, day) as last_file from c left join canon on canon.name = c.name),
clash as (select distinct i, day, field from (select i, f, day, field from cc group by all having count(*) > 1)),
x as (select cc.*, case when exists (select 1 from clash k where k.i is not distinct from cc.i and k.day = cc.day and k.field = cc.field) then name else field end as field_name from cc),
m as (select i, day, last_file, field_name, max(struct_pack(has := val is not null, f := f, name := name, val := val, amt := amt)) as r from x group by all)
select i as index_symbol, day as on_day, last_file as file_no, field_name, r.f as from_file, r.name as written_as, case when regexp_matches(r.val, '^-?[0-9]+$') then try_cast(r.val as bigint) end as as_integer,
case when regexp_matches(r.val, '^-?[0-9]+[.]?[0-9]*$') and not regexp_matches(r.val, '^-?[0-9]+$') then try_cast(r.val as double) end as as_decimal, case when not regexp_matches(r.val, '^-?[0-9]+[.]?[0-9]*$') then r.val end as as_text, r.amt as amount from m"""
)
