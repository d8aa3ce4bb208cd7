"""The corpus pipeline: rules, line dedup, near dedup, mixing and tokenising, in that order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs.  All but the last return the columns of ``documents``.  n_chars follows the text where a stage changes it.

Defined cases, of every stage: null text counts as empty, and the rules reject it, as they do texts of fewer than ten words; texts of any length are read
whole; a null id ranks after all others; rows that share an id are judged each by its own text, count as one document when lines are compared, and near dedup
keeps one row of those whose texts are alike; ties of a draw fall together; an empty table gives an empty table; columns beyond those of ``documents`` pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm.bpe import as_array, encode_column
from nichefold.llm.common import materialise
from nichefold.llm.line_dedup import dedup_lines
from nichefold.llm.minhash import keep_one
from nichefold.llm.mixing import mix_documents
from nichefold.llm.q2_bpe import vocabulary
from nichefold.llm.quality_rules import quality_filter

#: BPE ids aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted mix takes, a row for each copy."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, their number and hash, of every document."""

    def make(tok, text):
        ids = tok.encode(text)
        return as_array(ids), len(ids) // 4, hashlib.sha256(ids).hexdigest()

    return encode_column(docs, vocabulary(), "text", ["doc_id", "source"], make, "ids array<int>, n_tokens long, ids_sha256 string")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows from all documents; every stage between is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
