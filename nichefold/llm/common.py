"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.functions.workers import ship
from nichefold.sources.stage import scratch
from nichefold.sources.stage import stage as materialise

__all__ = ["SPACE_CLASS", "free_name", "free_names", "give_back", "let", "materialise", "scratch", "ship", "table"]
#: White space of the corpus contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def give_back() -> None:
    """Returns memory that Arrow holds for later batches, so that idle workers stay small."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], stems: list[str]) -> list[str]:
    """A name for each stem that isn't taken, nor given to another: the stem, or the stem and a number."""
    used = {c.lower() for c in taken}
    out = []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in used:
            k += 1
            name = f"{stem}_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df hasn't, whatever columns the caller brings."""
    return free_names(df.columns, [stem])[0]
