"""Intermediate tables in the folder that all executors share.

A written table cuts the plan that led to it, so that what follows is planned quickly, and outlives the executors that made it.  Tables
stay while results may still be read from them: until ``drop_tables`` or, at the latest, the driver's end.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder; in local mode, else one of this machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        where = "file://" + tempfile.mkdtemp(prefix="nichefold-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of these bytes, wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables() -> None:
    """Removes all tables written so far; results that read them must have been used."""
    while _written:
        remove(*_written.pop())


@atexit.register
def _sweep() -> None:
    try:
        drop_tables()
    except Exception:  # the JVM may have gone first
        return
