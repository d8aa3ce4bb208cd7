"""op1: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm.common import table
from nichefold.llm.mixing import Mix, one_source, weighted_targets

NAME = "op1_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = Mix(docs, one_source(), "doc_id", "text", weighted_targets)
    # The sizes are written already, so the texts aren't read again.
    sized = mix.sizes.select(F.col("id").alias("doc_id"), F.get("m", F.lit(0)).alias("source"), "size", F.lit("").alias("text"))
    targets = spark.createDataFrame([(s, mix.source_size[s], float(mix.quotas[s])) for s in mix.source_size], "source string, source_size long, target double")
    rows = mix.copies(sized, "copies", F.col("size"))
    # A row for each source of the catalogue, held on the driver already.
    out = rows.join(F.broadcast(targets.withColumnRenamed("source", "s_")), F.col("source").eqNullSafe(F.col("s_")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", F.col("copies").cast("int").alias("copies"))
