import datetime as dt

from tests.compare import compare
from tidemark.plans import pipeline, reference


def test_every_symbol_stays(spark):
    d = "/root/testdata/sf0.1"  # more symbols than parts
    for name in ("src_macro_series", "feat_macro_series"):
        assert compare(spark, d, reference.QUERIES[name], reference.SQL[name]) is None
    s = pipeline.views(spark, d)["series"]
    assert s.select("symbol").distinct().count() == spark.read.parquet(f"{d}/macro.parquet").filter("close is not null and not isnan(close) and date is not null").select("symbol").distinct().count() > 12


def test_a_new_symbol_moves_no_part(spark):
    roles = {"vix": "M", "tnx": "N"}
    rows = [("M", dt.date(2024, 1, 1), 20.0), ("N", dt.date(2024, 1, 1), 4.0)]
    frame = lambda r: spark.createDataFrame(r, "symbol string, date date, close double")
    before = {tuple(r) for r in pipeline.with_roles(frame(rows), roles).collect()}
    after = {tuple(r) for r in pipeline.with_roles(frame([("A", dt.date(2024, 1, 1), 1.0), *rows]), roles).collect()}
    assert before == after == {("vix", dt.date(2024, 1, 1), 20.0), ("tnx", dt.date(2024, 1, 1), 4.0)}


def test_the_matrix_takes_its_parts_from_the_configuration(spark):
    d = "/root/testdata/sf0.001"
    want = {r.date: r.close for r in pipeline.views(spark, d)["series"].filter("symbol = '^SOBA0'").collect()}
    got = pipeline.matrix(spark, d, pipeline.Config(roles={"vix": "^SOBA0"})).filter("vix_level is not null").select("date", "vix_level").collect()
    assert any(want.get(r.date) == r.vix_level for r in got) and {r.vix_level for r in got} <= set(want.values())
