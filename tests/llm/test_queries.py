import os

import pytest

from tests.compare import compare
from tidemark.llm import queries as q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.mark.parametrize("name", list(q.SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, DIR, q.QUERIES[name], q.SQL[name]) is None


def test_whole_tables_are_used(spark, enc):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    big = {r.doc_id for r in docs if len(enc.encode_ordinary(r.text or "")) > 1024}
    assert {r.doc_id for r in q.QUERIES["p9_found"](spark, DIR).collect()} == big == {r.doc_id for r in q.QUERIES["p9_pieces"](spark, DIR).collect()}
    assert {r.doc_id for r in q.QUERIES["p7_pack"](spark, DIR).collect()} == {r.doc_id for r in docs}
    assert set(q.QUERIES["p8_found"](spark, DIR).columns) == {"doc_id", "item_id"}
