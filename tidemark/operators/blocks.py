"""Ordered blocks: long sequences cut into sorted runs of bounded size, whatever the skew of their keys.

A frame is range-partitioned by (key, order), so that each partition is one contiguous run of about
rows_per_block rows; a key that holds a third of all rows simply spans many blocks. Work on a sequence then takes
two passes. The first emits a summary of constant size for each block. The summaries (their number is that of the
blocks) are combined by a prefix scan, which gives each block what it must know of the others. The second pass
treats all blocks independently. No key is ever gathered in one task.

What a block must know of the others reaches it by a broadcast join on its number, at its first row: a table of the
number of blocks, once an executor, and each task gets its own entry only. There are at most MAX_BLOCKS blocks; beyond
MAX_BLOCKS * ROWS_PER_BLOCK rows the blocks grow.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

ROWS_PER_BLOCK, MAX_BLOCKS = 100_000, 100_000


def ordered_blocks(df: DataFrame, by: list[str], rows: int, rows_per_block: int = ROWS_PER_BLOCK, least: int = 1) -> DataFrame:
    """df sorted by `by` over contiguous partitions, with the partition's number as `block`, in the checkpoint folder.

    rows is an upper bound of df's rows (cheap to take from Parquet footers); ties of `by` may lie in any order, so
    it should end in a unique column. An empty frame gives no block.
    """
    n = min(MAX_BLOCKS, max(least, math.ceil(rows / rows_per_block)))
    x = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return cut(x.withColumn("block", F.spark_partition_id()).withColumn("opens", F.monotonically_increasing_id() % 2**33 == 0))


def map_blocks(df: DataFrame, fn: Callable, schema: str, carry: dict[int, object] | None = None) -> DataFrame:
    """fn over each whole block (one partition, bounded by rows_per_block); with carry, fn(block, carry of the block)."""
    if carry is not None:
        c = df.sparkSession.createDataFrame([(b, pickle.dumps(v)) for b, v in carry.items()], "_b int, _carry binary")
        df = df.join(F.broadcast(c), (F.col("block") == F.col("_b")) & F.col("opens"), "left").drop("_b")

    def go(batches):
        frames = [b for b in batches if len(b)]
        if frames:
            pdf = pd.concat(frames, ignore_index=True)
            if carry_given:
                own = pdf.pop("_carry").dropna()
                out = fn(pdf, pickle.loads(bytes(own.iloc[0])) if len(own) else None)
            else:
                out = fn(pdf)
            if out is not None and len(out):
                yield out

    carry_given = carry is not None
    return df.mapInPandas(go, schema)


def summaries(df: DataFrame, fn: Callable, carry: dict[int, object] | None = None) -> list[tuple[int, object]]:
    """(block, fn(block)) in order of the blocks. fn must return something of constant size."""

    def one(pdf: pd.DataFrame, *own) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "summary": [pickle.dumps(fn(pdf, *own))]})

    got = map_blocks(df, one, "block int, summary binary", carry).collect()  # one row a block
    return [(r.block, pickle.loads(bytes(r.summary))) for r in sorted(got, key=lambda r: r.block)]


def group_counts(blocks: DataFrame, key: str) -> dict[int, dict]:
    """For each block, of its first and last key: the rows in blocks before, and in all blocks.

    Only a block's edge keys can reach beyond it, so two counts a block are enough.
    """

    def edges(pdf: pd.DataFrame):
        first, last = pdf[key].iloc[0], pdf[key].iloc[-1]
        return {k: int((pdf[key] == k).sum()) for k in {first, last}}

    got = summaries(blocks, edges)
    total: dict = {}
    before: dict[int, dict] = {}
    for b, own in got:
        before[b] = {k: total.get(k, 0) for k in own}
        for k, n in own.items():
            total[k] = total.get(k, 0) + n
    return {b: {k: (before[b][k], total[k]) for k in own} for b, own in got}


def rank_in_group(blocks: DataFrame, key: str, schema: str) -> DataFrame:
    """Adds `rank` (from 0) and `total` of each row within its key, without a window over the key."""
    counts = group_counts(blocks, key)

    def ranked(pdf: pd.DataFrame, edge: dict) -> pd.DataFrame:
        g = pdf.groupby(key, sort=False)[key]
        own = g.transform("size")
        return pdf.drop(columns="opens").assign(
            rank=g.cumcount() + pdf[key].map({k: v[0] for k, v in edge.items()}).fillna(0).astype("int64"),
            total=pdf[key].map({k: v[1] for k, v in edge.items()}).fillna(own).astype("int64"),
        )

    return map_blocks(blocks, ranked, f"{schema}, block int, rank long, total long", counts)


def exact_medians(df: DataFrame, key: str, value: str, rows: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(key, median) of non-null values, exact also where one key holds most rows: values of no more than one block are
    aggregated, more are ranked over blocks."""
    x = cut(df.select(F.col(key).alias("key"), F.col(value).alias("value")))
    if x.count() <= rows_per_block:
        return x.groupBy(F.col("key").alias(key)).agg(F.median("value").alias("median"))
    b = ordered_blocks(x, ["key", "value"], rows, rows_per_block)
    r = rank_in_group(b, "key", "key string, value double")
    mid = r.filter((F.col("rank") == F.floor((F.col("total") - 1) / 2)) | (F.col("rank") == F.floor(F.col("total") / 2)))
    return mid.groupBy(F.col("key").alias(key)).agg(F.avg("value").alias("median"))
