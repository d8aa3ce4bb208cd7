"""op7: the language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm.common import table
from nichefold.llm.language import identify, learn
from nichefold.llm.quality_model import bucket

NAME = "op7_language"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = learn(docs, ~held_out)
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
