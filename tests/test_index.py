import datetime as dt

import pytest

from tidemark.operators import features
from tidemark.plans import index

DIR = "/root/testdata/sf0.001"


def test_fundamentals_are_what_the_files_hold(spark):
    """Each level is an amount that some line of the index writes for the day."""
    got = features.fundamentals(index.rows(spark, DIR)).collect()
    lines = spark.read.parquet(f"{DIR}/unused_data.parquet").unionByName(spark.read.parquet(f"{DIR}/final_data.parquet")).collect()
    text = {}
    for r in lines:
        if r.raw_line:
            text.setdefault((r.index_symbol, r.raw_line[:10]), []).append(r.raw_line.replace('"', ""))
    seen = 0
    for r in got:
        day = (r.symbol, r.date.isoformat())
        assert day in text
        for v in (r.pe_ratio, r.pb_ratio, r.india_vix):
            if v:
                seen += any(f"{v:.2f}" in line for line in text[day])
    assert seen > 100 and len({(r.symbol, r.date) for r in got}) == len(got)


@pytest.mark.parametrize("with_news", [True, False])
def test_matrix(spark, with_news):
    days = [dt.date(2019, 1, 1) + dt.timedelta(i) for i in range(60)]
    rows = [("I", t, 100.0 + i % 7, 101.0 + i % 5, None, None if 40 <= i < 50 else 20.0 + i % 3, 3.0, 15.0 + i % 4, float(i % 6), "f") for i, t in enumerate(days)]
    x = spark.createDataFrame(rows, "symbol string, date date, open double, close double, volume double, pe double, pb double, vix double, sentiment_score double, file string")
    news = spark.createDataFrame([("all", days[i], 2, 0.1 * (i % 3), 0.0) for i in range(36)], "symbol string, date date, article_count long, avg_sentiment double, sentiment_std double") if with_news else None
    m = index.assemble(x, news)
    got = {r.date: r for r in m.collect()}
    assert not {"pb_ratio", "volume", "vix_crisis"} & set(m.columns) and {"pe_ratio", "india_vix", "sentiment_score", "rsi_14"} <= set(m.columns)  # constant ones go
    if with_news:  # carried five rows, then 0
        assert got[days[40]].sentiment_score == got[days[35]].sentiment_score != 0 and got[days[41]].sentiment_score == 0
    else:
        assert all(r.sentiment_score == r.precomputed_sentiment for r in got.values()) and "article_count" not in m.columns
    assert all(v is not None for r in got.values() for v in r)
