import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks


@pytest.mark.parametrize("rows_per_block", [7, 50, 10_000])
def test_ranks_and_medians_of_a_hot_key(spark, rows_per_block):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.6 else f"k{r.randrange(9)}", float(r.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {x.k: x.median for x in blocks.exact_medians(df, "k", "v", 400, rows_per_block).collect()}
    want = {}
    for k, v in data:
        want.setdefault(k, []).append(v)
    for k, v in want.items():
        v.sort()
        assert got[k] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    b = blocks.ordered_blocks(df.withColumn("id", F.monotonically_increasing_id()), ["k", "v", "id"], 400, rows_per_block)
    ranks = blocks.rank_in_group(b, "k", "k string, v double, id long").collect()
    for k, v in want.items():
        mine = sorted((x["rank"], x.v, x.total) for x in ranks if x.k == k)
        assert [m[0] for m in mine] == list(range(len(v))) and [m[1] for m in mine] == v and {m[2] for m in mine} == {len(v)}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert blocks.exact_medians(df, "k", "v", 0).count() == 0
