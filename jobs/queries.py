"""The jobs as registered queries: each runs twice into one new folder and gives what lies there then; and the SQL of that."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cell_atlas, passage_search
from nichefold.config import LINEAGES, NICHES
from nichefold.functions.exprs import half_up
from nichefold.plans.fixtures import SETTINGS
from nichefold.plans.oracles import CTE, h, r6, with_
from nichefold.sources.stage import shared_folder


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[half_up(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def job1_passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed as they come, benchmark passages ranked over them; the second run finds nothing new."""
    at = f"{shared_folder(spark)}/passage-search-{uuid.uuid4().hex}"
    for _ in range(2):
        passage_search.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{at}/out", f"{at}/checkpoint")
    return _six(passage_search.result(spark, f"{at}/out"))


def job2_cell_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells, labelled; the second run replaces the first."""
    out = f"{shared_folder(spark)}/cell-atlas-{uuid.uuid4().hex}"
    for _ in range(2):
        cell_atlas.run(spark, sf_dir, out)
    return _six(cell_atlas.result(spark, out))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_passage_search, job2_cell_atlas)}


_P = passage_search.DEFAULTS
_BUCKET = "(CAST(list_sum(list_transform(range(1, length(w) + 1), lambda i: unicode(substr(w, i, 1)) * ((i - 1) * 37 + 11))) AS BIGINT) % 256)"
_SEARCH = f"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
words AS (SELECT kind, id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{passage_search.SPACE}'), lambda w: w <> '')) AS w FROM texts),
bags AS (SELECT kind, id, {_BUCKET} AS b, sum(n)::BIGINT AS n FROM (SELECT kind, id, w, count(*) AS n FROM words GROUP BY ALL) GROUP BY ALL),
sizes AS (SELECT kind, id, sum(n)::BIGINT AS n_words FROM bags GROUP BY ALL),
raw AS (SELECT kind, id, d, sum(n * (({h(f"b * {_P['dim']} + d")})::DOUBLE / 1073741823.5 - 1.0)) AS v FROM bags, range({_P['dim']}) AS r(d) GROUP BY ALL),
vec AS (SELECT kind, id, d, (v / greatest(sqrt(sum(v * v) OVER (PARTITION BY kind, id)), 1e-8))::FLOAT::DOUBLE AS u FROM raw),
index AS (SELECT id AS doc_id, lang, source, n_words, {r6('c')} AS "check" FROM sizes JOIN (SELECT kind, id, sum(u * (d + 1)) AS c FROM vec GROUP BY ALL) USING (kind, id) JOIN documents ON doc_id = id WHERE kind = 'd' AND n_words >= {_P['min_words']}),
scores AS (SELECT q.id AS query_id, i.id AS doc_id, {r6('sum(q.u * i.u) / sqrt(sum(q.u * q.u)) / sqrt(sum(i.u * i.u))')} AS score FROM vec q JOIN vec i ON i.d = q.d AND q.kind = 'q' AND i.kind = 'd' GROUP BY ALL),
ranking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rnk FROM scores JOIN index USING (doc_id) QUALIFY rnk <= {_P['top']})
SELECT i.*, query_id, score, rnk FROM index i LEFT JOIN ranking r USING (doc_id)
"""

_A = cell_atlas.DEFAULTS
_enough = f"(SELECT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING sum(l_quantity) >= {_A['min_counts']})"
_ATLAS = with_(
    f"SELECT '{_A['sample']}' AS sample, c.cell_id, {r6('x')} AS x, {r6('y')} AS y, {r6('total')} AS transcript_counts, t.cell_type, {r6('cell_type_score')} AS cell_type_score, {r6('cell_type_margin')} AS cell_type_margin, "
    f"{r6('proliferation_score')} AS proliferation_score, is_proliferating, {', '.join(f'niche_{n}' for n in NICHES)}, niche_label, pool_idx, ({h('c.cell_id')}, c.cell_id) AS order_, "
    "(SELECT count(*) FROM customer) AS n_cells_raw, (SELECT count(*) FROM cells) AS n_cells_qc, (SELECT median(total) FROM totals) AS median_transcripts, "
    + ", ".join(f"(SELECT count(*) FROM types WHERE cell_type = '{t}') AS \"n_{t}\"" for t in LINEAGES)
    + " FROM cells c JOIN totals USING (cell_id) JOIN types t USING (cell_id) JOIN state USING (cell_id) JOIN niches USING (cell_id) LEFT JOIN pool p ON p.cell_id = c.cell_id",
    ("cells", f"SELECT * FROM ({CTE['cells']}) WHERE cell_id IN {_enough}"),
    ("counts", f"SELECT * FROM ({CTE['counts']}) WHERE cell_id IN {_enough}"),
)
_ATLAS = f"""SELECT * EXCLUDE order_, CASE WHEN pool_idx IS NOT NULL THEN ((row_number() OVER (PARTITION BY pool_idx IS NULL ORDER BY order_) - 1) % {_A['folds']})::INT END AS fold FROM ({_ATLAS})"""


def oracle_sql() -> dict[str, str]:
    if (_A["k"], _A["pool_size"], _A["seed"]) != (SETTINGS.k, SETTINGS.pool_size, SETTINGS.seed):
        raise ValueError("the atlas' SQL is that of the library's default settings")
    return {"job1_passage_search": _SEARCH, "job2_cell_atlas": _ATLAS}
