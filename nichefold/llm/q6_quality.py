"""op6: a quality score for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm.common import table
from nichefold.llm.quality_model import bucket, score_documents

NAME = "op6_quality_classifier"
CUT = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket(F.col("id"), 5) != 0)
    held_out = F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
