"""op3: classes of near duplicates over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.llm.common import table
from nichefold.llm.minhash import near_classes

NAME = "op3_minhash_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("is_kept", F.col("doc_id") == F.col("class_id"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), n AS (SELECT text, any_value(w) AS w, min(doc_id) AS id, count(*) AS c, row_number() OVER (ORDER BY text) AS k FROM d WHERE len(w) > 0 GROUP BY text),
sh AS (
  SELECT DISTINCT k, g FROM (SELECT k, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) ELSE [w] END) AS g FROM n)
), sizes AS (SELECT k, count(*) AS s FROM sh GROUP BY k),
pairs AS (SELECT a.k AS ka, b.k AS kb, count(*) AS both_ FROM sh a JOIN sh b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
links AS (SELECT ka, kb FROM pairs JOIN sizes x ON x.k = ka JOIN sizes y ON y.k = kb WHERE both_ >= 0.8 * (x.s + y.s - both_) - 1e-9),
edges AS (SELECT ka AS a, kb AS b FROM links UNION ALL SELECT kb, ka FROM links),
reach(k, root) AS (SELECT k, k FROM n UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.k),
labels AS (SELECT k, min(root) AS label FROM reach GROUP BY k),
classes AS (SELECT label, min(id) AS class_id, sum(c)::BIGINT AS class_size FROM n JOIN labels USING (k) GROUP BY label)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_size, 1)::BIGINT AS class_size, d.doc_id = coalesce(class_id, d.doc_id) AS is_kept
FROM d LEFT JOIN n ON n.text = d.text LEFT JOIN labels l ON l.k = n.k LEFT JOIN classes x ON x.label = l.label
"""
