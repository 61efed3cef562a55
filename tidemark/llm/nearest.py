"""Pairing rows with the nearest row in time of the same entity, within a tolerance.

Time is cut into buckets as wide as the tolerance; a row's partner can only lie in its own or an adjacent bucket. Of
an adjacent bucket only the last (or first) candidate can be nearest, so buckets are reduced to these two before the
join and no bucket is paired with another. In the own bucket all candidates count, if they are few; buckets with
more than DIRECT candidates are cut into FAN finer ones, again reduced to their ends, and so on down to buckets of
one microsecond. So the joined rows stay in proportion to the rows however hot a bucket is.

Defined cases: entities are equal without regard to case and outer blanks; a null entity or time has no partner.
Of equally near candidates the earlier wins, of those at the same time the smallest id. Repeated rows each get their
partner. Other columns are ignored, so clashing names do no harm. Empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import epoch_us
from tidemark.runtime import cut

DIRECT, FAN = 64, 256


def entity_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _ends(cand: DataFrame, *by: str) -> DataFrame:
    at = F.struct("t", "cid")
    return cand.groupBy(*by).agg(F.min(at).alias("first"), F.max(F.struct("t", (-F.col("cid")).alias("m"))).alias("l"), F.count("*").alias("n")).withColumn("last", F.struct(F.col("l.t").alias("t"), (-F.col("l.m")).alias("cid"))).drop("l")


def nearest(left: DataFrame, right: DataFrame, tolerance_us: int, left_id: str, right_id: str, left_entity: str, right_entity: str, left_at: str, right_at: str) -> DataFrame:
    """(left_id, right_id, gap_us): the nearest right row of each left row within the tolerance; gap < 0: it is earlier."""
    q = left.select(F.col(left_id).alias("rid"), entity_key(F.col(left_entity)).alias("key"), epoch_us(left, left_at).alias("rt")).filter("key is not null and rt is not null")
    c = right.select(F.col(right_id).alias("cid"), entity_key(F.col(right_entity)).alias("key"), epoch_us(right, right_at).alias("t")).filter("key is not null and t is not null and cid is not null")
    c = c.groupBy("key", "t").agg(F.min("cid").alias("cid"))  # of one instant only the smallest id can win
    bucket = lambda x, w: F.floor(F.col(x) / F.lit(w)).cast("long")
    width = tolerance_us
    q, c = q.withColumn("b", bucket("rt", width)), c.withColumn("b", bucket("t", width))
    ends = cut(_ends(c, "key", "b"))
    around = q.select("rid", "rt", "key", F.explode(F.array(F.struct((F.col("b") - 1).alias("b"), F.lit(-1).alias("side")), F.struct((F.col("b") + 1).alias("b"), F.lit(1).alias("side")))).alias("x")).select("rid", "rt", "key", "x.b", "x.side")
    found = around.join(ends, ["key", "b"]).select("rid", "rt", F.when(F.col("side") < 0, F.col("last")).otherwise(F.col("first")).alias("c"))
    n = ends.select("key", "b", "n")
    while True:
        # own bucket: few candidates are compared directly
        few = c.join(n.filter(F.col("n") <= DIRECT).select("key", "b"), ["key", "b"], "left_semi") if width == tolerance_us else c.filter(F.col("n") <= DIRECT)
        found = found.unionByName(q.join(few.select("key", "b", F.struct("t", "cid").alias("c")), ["key", "b"]).select("rid", "rt", "c"))
        hot = n.filter(F.col("n") > DIRECT).select("key", "b")
        if width == 1 or not hot.limit(1).count():
            break
        # hot buckets: finer ones inside, at most FAN of each, know the nearest candidates before and after them
        fine = max(1, -(-width // FAN))
        q = q.join(hot, ["key", "b"], "left_semi").withColumn("f", bucket("rt", fine))
        c = c.drop("n").join(hot, ["key", "b"], "left_semi").withColumn("f", bucket("t", fine))
        e = _ends(c, "key", "b", "f")
        own = q.select("key", "b", "f").distinct().join(e, ["key", "b", "f"], "full")
        w = Window.partitionBy("key", "b").orderBy("f")
        near = cut(own.select("key", "b", "f", "n", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after")))
        pairs = q.join(near, ["key", "b", "f"]).select("rid", "rt", F.explode(F.array_compact(F.array("before", "after"))).alias("c"))
        found = found.unionByName(pairs)
        width = fine
        n = near.filter("n is not null").select("key", F.col("f").alias("b"), "n")
        q = q.drop("b").withColumnRenamed("f", "b")
        c = c.drop("b").withColumnRenamed("f", "b").join(n, ["key", "b"])
        n = cut(n)
    gap = F.col("c.t") - F.col("rt")
    best = found.filter(F.abs(gap) <= tolerance_us).groupBy("rid").agg(F.min(F.struct(F.abs(gap).alias("d"), F.col("c.t").alias("t"), F.col("c.cid").alias("cid"), gap.alias("gap"))).alias("m"))
    return best.select(F.col("rid").alias(left_id), F.col("m.cid").alias(right_id), F.col("m.gap").alias("gap_us"))
