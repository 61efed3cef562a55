"""Every query with SQL gives the same rows as DuckDB; the others give rows and a stable schema."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
CORE = [n for n in QUERIES if n not in (entry.llm.QUERIES if entry.llm else {})]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_same_as_sql(spark, name):
    assert compare(spark, DIR, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, DIR)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["symbol", "date"]


def test_plans_push_columns_and_filters_to_the_scan(spark):
    plan = QUERIES["p6_found"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "sentiment_ma_5d" not in plan  # never read
    plan = QUERIES["prj_filter"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_custkey" not in plan


def test_a_family_of_windows_shares_one_shuffle(spark):
    from tidemark.functions import windows as w
    from tidemark.operators import panel
    from tidemark.sources.tables import table

    b = panel.bars(table(spark, DIR, "prices")).withColumn("r", w.log_return("close"))
    b = b.withColumn("v", w.roll_std("r", 20)).withColumn("vv", w.roll_std("v", 20))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Window [") + plan.count("Window(") >= 3


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found", "p6_found", "src_bars", "jn_asof"])
def test_the_session_zone_does_not_matter(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert compare(spark, DIR, QUERIES[name], SQL[name]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
