"""op11: all documents packed into sequences of at most 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nichefold.llm.common import table
from nichefold.llm.packing import pack

NAME = "op11_packing"
#: The ranks of byte_bpe_50k.json, its one special token, and the id that ends a document.
RANKS, SPECIAL, END = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}, 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, SPECIAL, END)
