"""op4: every text stored as samples of an ISO media file, read back and described."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm import media
from nichefold.llm.common import table

NAME = "op4_media"


def row(text: bytes | None) -> dict:
    raw = text or b""
    stored = media.write_track(media.pad(raw))
    info, back = media.probe(stored), media.read_track(stored)
    return {
        "n_bytes": len(raw),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-64:]),
        "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": media.feature(info),
        "n_keyframes": info["n_keyframes"],
    }


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_keyframes long"
    return media.map_rows(docs, ["doc_id"], F.col("text").cast("binary"), row, schema)
