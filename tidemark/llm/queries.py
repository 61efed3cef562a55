"""Queries of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import leakage, nearest, packing, splitting
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOLERANCE_US = 36 * 3_600_000_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "prices").filter("close is not null and not isnan(close)")
    return nearest.nearest(table(spark, d, "earnings"), bars, TOLERANCE_US, "report_id", "bar_id", "symbol", "symbol", "date", "date")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("report_id", "bar_id")


@query
def p3_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


@query
def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents")).filter("piece_no = 0").select("doc_id")


@query
def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"))


_NEAREST = """with b as (select upper(trim(symbol)) as s, date as t, min(bar_id) as bar_id from prices where close is not null and not isnan(close) group by 1, 2),
x as (select report_id, bar_id, epoch_us(t) - epoch_us(e.date) as gap_us, row_number() over (partition by report_id order by abs(epoch_us(t) - epoch_us(e.date)), t) as r
from earnings e join b on upper(trim(e.symbol)) = b.s and b.t between e.date - interval 36 hour and e.date + interval 36 hour)"""
SQL["p3_found"] = _NEAREST + " select report_id, bar_id from x where r = 1"
SQL["p3_gaps"] = _NEAREST + " select report_id, bar_id, gap_us from x where r = 1"
SQL["p8_found"] = r"""with x as (select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from eval_items),
n as (select kind, id, regexp_extract_all(lower(regexp_replace(replace(replace(replace(replace(regexp_replace(text, '<[^<>\n]*>|\[[^\[\]\n]*\]', ' ', 'g'), '&nbsp;', ' '), '&#39;', ''''), '&#101;', 'e'), '&amp;', '&'), '[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]', '', 'g')), '[\p{L}\p{N}]+') as w from x where text is not null),
g as (select distinct kind, id, array_to_string(w[k:k + 11], ' ') as run from n, unnest(range(1, len(w) - 10)) t(k) where len(w) >= 12)
select distinct d.id as doc_id, i.id as item_id from g d join g i on d.run = i.run where d.kind = 0 and i.kind = 1"""
