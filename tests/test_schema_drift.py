import datetime as dt

import pytest

from tidemark.operators import schema_drift as sd

SCHEMA = "index_symbol string, file_no int, file_name string, received_at timestamp, line_no int, raw_line string, name string, value string, pieces int"


def frame(spark, files):
    rows = [(s, n, "f", dt.datetime(2024, 1, 1), i, line, "clash", "x", 3) for (s, n), lines in files.items() for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, SCHEMA)


FILES = {
    ("A", 1): ["# note", "", None, "﻿Date; Open ;\"Volume\"", "2024-01-01;1.5;1,500,000", "2024-01-02;2.5;1,600,000", "2024-01-02;2.5;1,600,000", "2024-01-03;NA;1,700,000"],
    ("A", 2): ["date,Traded,open,extra", "2024-01-02,1.60M,2.5,7", "2024-01-03,1.70E+06,null,8", "2024-01-04,1.80M", "2024-01-05,1,2,3,4,5"],
    ("A", 3): ["Date|Traded|Open|Other", "2024-01-04|1800000|2|x", "# inside", "2024-01-06|(5)|\"3\"|y"],
    ("B", 1): ["Date\tP", "2024-01-01\t1", "Date\tP"],
    ("B", 3): ["Date\tQ", "2024-01-01\t1"],
    ("C", 1): ["# nothing else"],
    (None, 1): ["Date,P", "2024-01-01,5"],
    (None, 2): ["Date,P", "2024-01-01,5.0"],
}
WANT = {("A", 2, "traded", "renamed"), ("A", 2, "extra", "added"), ("A", 3, "extra", "removed"), ("A", 3, "other", "added"), ("A", 3, "open", "retyped"), (None, 2, "p", "retyped")}


@pytest.mark.parametrize("piece", [2, 20_000])
def test_changes(spark, piece, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", piece)
    lines = frame(spark, FILES)
    h = sd.schemas(lines)
    found = sd.changes(h, sd.cells(lines, h))
    got = {(r.index_symbol, r.file_no, r.field_name, r.drift) for r in found.collect()}
    assert got == WANT  # volume and traded are both text: no change of kind


def test_one_table(spark):
    lines = frame(spark, FILES)
    h = sd.schemas(lines)
    c = sd.cells(lines, h)
    rows = {(r.index_symbol, r.on_day): r for r in sd.one_table(c, sd.changes(h, c)).collect()}
    assert len(rows) == len({("A", f"2024-01-0{i}") for i in range(1, 7)}) + 2
    f = rows["A", "2024-01-02"]
    assert f.file_no == 2 and f.fields["traded"].amount == 1_600_000 and f.fields["traded"].as_text == "1.60M" and f.fields["open"].as_decimal == 2.5
    assert rows["A", "2024-01-01"].fields["traded"].written_as == "volume" and rows["A", "2024-01-06"].fields["traded"].amount == -5


AMOUNTS = {"12": 12, "-3.50": -3.5, "+6.45": 6.45, "(1.96)": -1.96, "1,234,567.00": 1234567, "Rs 12809.03": 12809.03, "15.52%": 15.52, "24.32x": 24.32, "1.4595E+07": 14595000, "12.38M": 12380000, "abc": None, "": None, None: None, "1.2.3": None}


def test_amounts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in AMOUNTS], "v string").select("v", sd.amount_of(F.col("v")).alias("a"))
    assert {r.v: None if r.a is None else round(r.a.amount, 6) for r in df.collect()} == AMOUNTS


def test_empty(spark):
    lines = spark.createDataFrame([], SCHEMA)
    h = sd.schemas(lines)
    c = sd.cells(lines, h)
    found = sd.changes(h, c)
    assert found.count() == 0 and sd.one_table(c, found).count() == 0
