"""What Python workers need."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, REPO) if p)
    if REPO not in sys.path:
        sys.path.insert(0, REPO)


def spread(rows: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """rows dealt over many tasks, at least so many, by keys: where much work is done on each, the splits of a scan, which go by bytes, are too few."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, least)
    return rows.repartition(n, *keys)
