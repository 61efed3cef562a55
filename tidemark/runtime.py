"""Session helpers: where checkpoints go and how small a table must be before it is broadcast."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast. Both the rows and Spark's own byte limit are checked.
BROADCAST_ROWS = 20_000


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.session.timeZone", "UTC")
    for k, v in ({"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in a single-machine session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-ckpt-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the table is counted to be small; beyond that Spark's shuffle joins stay."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context: their Python needn't find it on its own path."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    sc.addPyFile(archive)  # the driver serves it; executors keep their own copies
    sc._tidemark_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run with the package at hand on every executor."""

    @functools.wraps(query)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        ship_package(spark)
        return query(spark, directory)

    return run
