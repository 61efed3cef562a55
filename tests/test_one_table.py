from tests.test_schema_drift import frame
from tidemark.operators import schema_drift as sd


def table(spark, files):
    lines = frame(spark, files)
    h = sd.schemas(lines)
    c = sd.cells(lines, h)
    return {(r.index_symbol, r.on_day): r for r in sd.one_table(c, sd.changes(h, c)).collect()}


def test_a_newer_file_loses_no_cell(spark):
    t = table(spark, {
        ("A", 1): ["Date,Open,Volume,P/E", "2024-01-01,1,10,5", "2024-01-02,2,20,6", "2024-01-03,3,NA,7"],
        ("A", 2): ["Date,Open,P/E", "2024-01-02,2.5,NA", "2024-01-03,3,8", "2024-01-04,4,9"],  # without Volume
    })
    r = t["A", "2024-01-02"]
    assert r.file_no == 2 and r.fields["open"].as_decimal == 2.5 and r.fields["open"].from_file == 2
    assert r.fields["volume"].as_integer == 20 and r.fields["volume"].from_file == 1 and r.fields["p/e"].amount == 6
    assert t["A", "2024-01-03"].fields["p/e"].amount == 8 and t["A", "2024-01-03"].fields["volume"].amount is None
    assert "volume" not in t["A", "2024-01-04"].fields and len(t) == 4


def test_renamed_back_and_both_at_once(spark):
    days = ["2024-01-01,1,10", "2024-01-02,2,20"]
    t = table(spark, {
        ("A", 1): ["Date,Open,Volume", *days], ("A", 2): ["Date,Open,Traded", *days],
        ("A", 3): ["Date,Open,Traded,Volume", "2024-01-02,2,20,7", "2024-01-03,3,30,8"],
    })
    assert t["A", "2024-01-01"].fields["traded"].amount == 10 and "volume" not in t["A", "2024-01-01"].fields
    f = t["A", "2024-01-03"].fields
    assert f["traded"].amount == 30 and f["volume"].amount == 8  # two fields of one file stay two


def test_a_rename_in_one_index_and_both_names_in_another(spark):
    days = ["2024-01-01,10", "2024-01-02,20"]
    t = table(spark, {
        ("A", 1): ["Date,Vol", *days], ("A", 2): ["Date,Volume", *days],
        ("B", 1): ["Date,Vol,Volume", "2024-01-01,1,2"], ("B", 2): ["Date,Vol", "2024-01-01,1"],
    })
    assert {n: u.amount for n, u in t["B", "2024-01-01"].fields.items()} == {"vol": 1, "volume": 2}
    assert {n: u.amount for n, u in t["A", "2024-01-02"].fields.items()} == {"vol": 20}


def test_quotes(spark):
    t = table(spark, {("A", 1): ['Date,"a,b",c', '2024-01-01,"1,5","say ""x"""', '2024-01-02,"open,7', "2024-01-03,,", "2024-01-04," + "x" * 100_000 + ',"' + "y," * 50_000 + '"']})
    f = {d: {n: u.as_text for n, u in r.fields.items()} for (_, d), r in t.items()}
    assert f["2024-01-01"] == {"a,b": "1,5", "c": 'say "x"'} and f["2024-01-02"] == {"a,b": '"open', "c": None} and f["2024-01-03"] == {"a,b": None, "c": None}
    assert len(f["2024-01-04"]["a,b"]) == len(f["2024-01-04"]["c"]) == 100_000
