"""What the jobs share: configuration, logging and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
log = logging.getLogger("jobs")


def load(spark: SparkSession, path: str, known: dict) -> dict:
    """A configuration file, JSON, from wherever Spark reads; what it leaves out is as in ``known``, and names that aren't there are refused."""
    given = json.loads(spark.read.text(path, wholetext=True).first().value)
    if odd := sorted(set(given) - set(known)):
        raise ValueError(f"{path}: unknown settings {odd}; there are {sorted(known)}")
    return known | given


def written(df: DataFrame, path: str, *by: str, mode: str = "overwrite", dynamic: bool = False) -> None:
    """Writes df as Parquet, a folder for each value of the columns ``by``; dynamic: only folders that df has rows for are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*by).parquet(path)


def main(doc: str, paths: dict[str, str], config: str, work: Callable[[SparkSession, argparse.Namespace], None]) -> None:
    """Parses the command line, makes a session, does the work and stops the session."""
    parser = argparse.ArgumentParser(description=doc)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", default=f"file://{HERE}/{config}", help="JSON settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, args)
    finally:
        spark.stop()
