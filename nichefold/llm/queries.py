"""The op* queries of the training-data operators and the SQL that DuckDB checks them with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q9_rules", "q5_lines", "q2_bpe", "q1_mixing", "q10_warc", "q4_media", "q8_html", "q6_quality", "q7_language", "q3_minhash", "q11_packing", "q12_codes")


def _modules():
    return [importlib.import_module(f"nichefold.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if getattr(m, "SQL", None)}
