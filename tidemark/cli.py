"""python -m tidemark.cli TABLES OUT [--train] [--live DATE]: tables to a feature matrix, and an ensemble on it."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.ml.models import Ensemble
from tidemark.operators import cleaning, features
from tidemark.plans.pipeline import Config, matrix
from tidemark.runtime import ensure_checkpoint_dir, ship_package
from tidemark.sources.files import live, write_matrix

USED = features.ALL


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("tables")
    p.add_argument("out")
    p.add_argument("--train", action="store_true")
    p.add_argument("--live", metavar="DATE")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    cfg = Config()
    m = matrix(spark, a.tables, cfg, live=bool(a.live))
    if a.live:
        write_matrix(cleaning.clean_live(live(m, a.live), USED), f"{a.out}/live")
        return
    m, kept, report = cleaning.clean_training(m, USED, cfg.leakage, cfg.extra_tail_rows, cfg.max_null)
    write_matrix(cleaning.require_rows(m, cfg.least_rows), f"{a.out}/matrix")
    report.write.mode("overwrite").json(f"{a.out}/dropped_columns")
    if a.train:
        e = Ensemble(kept, cfg.target).fit(spark.read.parquet(f"{a.out}/matrix").withColumn("symbol", F.col("symbol").cast("string")))
        e.save(f"{a.out}/model")


if __name__ == "__main__":
    main()
