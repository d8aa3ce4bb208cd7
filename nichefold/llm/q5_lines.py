"""op5: line dedup over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm import line_dedup as L
from nichefold.llm.common import ship, table

NAME = "op5_line_dedup"


def _digest(batches):
    import hashlib

    import pyarrow as pa

    for b in batches:
        rows = [L.kept_text(x.as_py(), m.as_py()) for x, m in zip(b.column(1), b.column(2), strict=True)]
        yield pa.record_batch(
            [b.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows])],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = L.with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"), "bitmap")
    return rows.select("doc_id", F.col("text").cast("binary"), "bitmap").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT r, doc_id, p, ls[p] AS line,
         translate(regexp_replace(regexp_replace(ls[p], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, ls, unnest(generate_series(1, len(ls))) AS p FROM d)
), firsts AS (
  SELECT k, min(doc_id) AS f FROM lines WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)
), marked AS (SELECT l.*, f.f IS NOT NULL AND l.doc_id > f.f AS gone FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
