"""op12: all usable embeddings as codes of four parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm.common import materialise, table
from nichefold.llm.vector_codes import compress

NAME = "op12_vector_codes"
PARTS, ENTRIES, ROUNDS = 4, 256, 4


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"], parts=PARTS, entries=ENTRIES, rounds=ROUNDS)
    sums = materialise(coded.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error")), "label-errors")  # small or not, Spark knows its size
    digits = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("label_")))
    return rows.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    sql = r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT i, part, len(q) // 4 AS w, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS v FROM kept, range(4) t(part)
), c0 AS MATERIALIZED (SELECT part, i AS e, v AS c FROM p WHERE i < 256)"""
    for r in range(ROUNDS + 1):
        sql += f""", a{r} AS MATERIALIZED (
  SELECT i, part, any_value(v) AS v, arg_min(e, key) AS e, min(key)::BIGINT // 256 AS d FROM (
    SELECT i, p.part, v, e, (list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c)) * 256 + e AS key FROM p JOIN c{r} USING (part)
  ) GROUP BY i, part
)"""
        if r < ROUNDS:
            sql += f""", c{r + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT part, e, list(floor(s / n) ORDER BY k) AS c FROM (
      SELECT part, e, k, sum(v[k]) AS s, count(*) AS n FROM (SELECT part, e, v, unnest(range(1, len(v) + 1)) AS k FROM a{r}) GROUP BY ALL
    ) GROUP BY part, e
  ) n USING (part, e)
)"""
    return sql + f""", f AS (
  SELECT i, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY i
), h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN f USING (i), h
"""


SQL = _sql()
