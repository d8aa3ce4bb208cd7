"""op2: BPE encoding and decoding of all documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from nichefold.llm.bpe import Tokenizer, encode_column
from nichefold.llm.common import table

NAME = "op2_bpe"
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def digests(tok: Tokenizer, text: str | None) -> tuple[int, str, str]:
    ids = tok.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tok.decode(ids).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), vocabulary(), "text", ["doc_id"], digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
