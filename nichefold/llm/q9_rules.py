"""op9: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nichefold.llm import quality_rules as Q
from nichefold.llm.common import table

NAME = "op9_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_table(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_K = len(Q.RULES)
_ODDS = " + ".join(f"CASE WHEN v[{j}] > 0 THEN ln(good[{j}] / (1 - bad[{j}])) WHEN v[{j}] < 0 THEN ln((1 - good[{j}]) / bad[{j}]) ELSE 0 END" for j in range(1, _K + 1))


def _accuracies(part: str, right: int, bounds: tuple[float, float], start: float) -> str:
    one = "coalesce(greatest({1}, least({2}, sum({0} * (v[{j}] = {3})::INT) / nullif(sum({0} * abs(v[{j}])), 0))), {4})"
    return ", ".join(one.format(part, *bounds, right, start, j=j) for j in range(1, _K + 1))


_GOOD, _BAD = _accuracies("g", 1, Q.GOOD, Q.GOOD_START), _accuracies("b", -1, Q.BAD, Q.BAD_START)
SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), keyed AS (SELECT row_number() OVER () AS r, * FROM words),
grams AS (
  SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM keyed WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, generate_series(0, 4) AS s(k) GROUP BY r
), stats AS (
  SELECT k.r, doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars0,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x)))::BIGINT AS n_capitals,
         len(list_filter(w, lambda x: length(x) BETWEEN 2 AND 3))::BIGINT AS n_short,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims, len(list_distinct(w))::BIGINT AS n_distinct
  FROM keyed k LEFT JOIN covered c ON k.r = c.r
), full_stats AS (SELECT *, coalesce(word_chars0, 0) AS word_chars FROM stats),
voted AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, [
    CASE WHEN 20 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END,
    CASE WHEN 100 * n_repeat_words > 15 * n_words THEN -1 WHEN 100 * n_repeat_words <= 2 * n_words THEN 1 ELSE 0 END,
    CASE WHEN 2 * n_dup_lines > n_lines THEN -1 WHEN n_dup_lines = 0 AND n_lines >= 2 THEN 1 ELSE 0 END,
    CASE WHEN 2 * n_capitals > n_words THEN -1 WHEN 10 * n_capitals <= n_words THEN 1 ELSE 0 END,
    CASE WHEN n_words >= 20 AND 10 * n_short < n_words THEN -1 WHEN 5 * n_short >= n_words THEN 1 ELSE 0 END,
    CASE WHEN 4 * n_exclaims > n_words THEN -1 WHEN 50 * n_exclaims <= n_words THEN 1 ELSE 0 END,
    CASE WHEN n_words >= 30 AND n_distinct * n_distinct < 4 * n_words THEN -1 WHEN n_words >= 30 AND n_distinct * n_distinct >= 25 * n_words THEN 1 ELSE 0 END,
    CASE WHEN word_chars > 12 * n_words OR word_chars < 2 * n_words THEN -1 WHEN word_chars BETWEEN 3 * n_words AND 9 * n_words THEN 1 ELSE 0 END
  ] AS v FROM full_stats
), patterns AS (SELECT v, count(*)::DOUBLE AS c FROM voted GROUP BY v),
em(it, p, good, bad) AS (
  SELECT 0, {Q.PRIOR}::DOUBLE, list_resize(CAST([] AS DOUBLE[]), {_K}, {Q.GOOD_START}::DOUBLE), list_resize(CAST([] AS DOUBLE[]), {_K}, {Q.BAD_START}::DOUBLE)
  UNION ALL
  SELECT it + 1, greatest({Q.SHARE[0]}, least({Q.SHARE[1]}, sum(g) / sum(g + b))), [{_GOOD}], [{_BAD}]
  FROM (SELECT it, v, c * q AS g, c * (1 - q) AS b FROM (SELECT it, v, c, 1 / (1 + exp(-(ln(p / (1 - p)) + {_ODDS}))) AS q FROM em, patterns WHERE it < {Q.ROUNDS})) GROUP BY it
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-(ln(p / (1 - p)) + {_ODDS}))) >= {Q.KEEP_AT} AS kept
FROM voted, (SELECT p, good, bad FROM em WHERE it = {Q.ROUNDS}) m
"""
