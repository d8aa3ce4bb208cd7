"""Information-retrieval metrics of rankings: one window pass and one aggregation give them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichefold.config import IMAGE_VARIANTS, REPORTED
from nichefold.functions.exprs import as_score, half_even, or_zero


def ranked(scores: DataFrame, relevance: DataFrame, by: list[str], pieces: int = 1) -> DataFrame:
    """Rows with rk (rank by score, ties by item, NaN last), rel as 0 or 1, and hits (relevant ones so far).

    A ranking over a candidate pool fits one task.  Over far more items, ask for pieces: each ranking is cut at approximate quantiles of its
    scores, the pieces are ranked side by side, and the counts of the pieces before (a row a piece) are added; the result is the same.
    """
    rows = scores.withColumn("score", as_score(F.col("score"))).join(relevance, ["query_id", "item_id"]).withColumn("rel", F.col("rel").cast("int"))
    order = [F.desc_nulls_last("score"), F.col("item_id")]
    if pieces <= 1:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.select(*by, "item_id", "rel", F.row_number().over(w).alias("rk"), F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    cuts = rows.groupBy(*by).agg(F.percentile_approx("score", [i / pieces for i in range(1, pieces)]).alias("cuts"))
    above = F.when(F.col("score").isNull(), F.lit(pieces)).otherwise(F.size(F.filter("cuts", lambda c: c > F.col("score"))))
    rows = rows.join(F.broadcast(cuts), by).withColumn("piece", above).drop("cuts")
    sizes = rows.groupBy(*by, "piece").agg(F.count("*").alias("n_"), F.sum("rel").alias("r_"))
    run = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select(*by, "piece", (F.sum("n_").over(run) - F.col("n_")).alias("n0"), (F.sum("r_").over(run) - F.col("r_")).alias("r0"))
    w = Window.partitionBy(*by, "piece").orderBy(*order)
    out = rows.join(F.broadcast(before), [*by, "piece"])
    return out.select(*by, "item_id", "rel", (F.col("n0") + F.row_number().over(w)).alias("rk"), (F.col("r0") + F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("hits"))


def pieces_for(items: int) -> int:
    """Pieces that rankings of so many items are cut into: a task ranks a million at a time."""
    return max(1, items // 1_000_000)


def evaluate(scores: DataFrame, relevance: DataFrame, ks: list[int] | tuple[int, ...], ndcg_k: int = 10, by: list[str] | None = None, pieces: int = 1) -> DataFrame:
    """One row a ranking with hit@k, P@k, R@k, enrich@k, mAP, MRR, nDCG@k, n_relevant and base_rate.

    P@k divides by k even if fewer items exist; all is 0 where nothing is relevant.
    """
    by = by or ["query_id"]
    rows = ranked(scores, relevance, by, pieces)
    rel, rk = F.col("rel"), F.col("rk")
    within = lambda k: F.sum(F.when(rk <= k, rel).otherwise(0))
    gain = lambda on: F.sum(F.when(on, 1 / F.log2(rk.cast("double") + 1)).otherwise(0.0))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("rel").alias("tot"),
        F.sum(F.when(rel == 1, F.col("hits") / rk).otherwise(0.0)).alias("ap"),
        F.min(F.when(rel == 1, rk)).alias("first"),
        gain((rel == 1) & (rk <= ndcg_k)).alias("dcg"),
        *[within(k).alias(f"h{k}") for k in ks],
    )
    ideal: Column = F.lit(0.0)
    for i in range(1, ndcg_k + 1):
        ideal = ideal + F.when(F.least("tot", "n") >= i, 1 / F.log2(F.lit(float(i + 1)))).otherwise(0.0)
    tot, n = F.col("tot"), F.col("n")
    base = tot / n
    out = [F.when(F.col(f"h{k}") > 0, 1.0).otherwise(0.0).alias(f"hit@{k}") for k in ks]
    out += [(F.col(f"h{k}") / F.lit(float(k))).alias(f"P@{k}") for k in ks]
    out += [or_zero(F.try_divide(F.col(f"h{k}").cast("double"), tot)).alias(f"R@{k}") for k in ks]
    out += [or_zero(F.try_divide(F.col(f"h{k}") / F.lit(float(k)), base)).alias(f"enrich@{k}") for k in ks]
    out += [
        or_zero(F.try_divide(F.col("ap"), tot)).alias("mAP"),
        or_zero(1 / F.col("first")).alias("MRR"),
        or_zero(F.try_divide(F.col("dcg"), ideal)).alias(f"nDCG@{ndcg_k}"),
        tot.cast("long").alias("n_relevant"),
        base.alias("base_rate"),
    ]
    return sums.select(*by, *out)


def metric_columns(per_query: DataFrame) -> list[str]:
    """The columns that hold metrics, by their prefix."""
    return [c for c in per_query.columns if c.startswith(("hit@", "P@", "R@", "enrich@", "nDCG@")) or c in ("mAP", "MRR")]


def macro(per_query: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """Means over queries; queries without a relevant item count."""
    columns = columns or [c for c in REPORTED if c in per_query.columns]
    return per_query.groupBy(*by).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in columns])


def rounded(table: DataFrame, digits: int = 4) -> DataFrame:
    return table.select(*[half_even(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in table.dtypes])


def main_table(per_query: DataFrame) -> DataFrame:
    """A row a method, best mean average precision first, ties by name."""
    return rounded(macro(per_query, ["baseline"])).orderBy(F.desc("mAP"), "baseline")


def grouped_tables(per_query: DataFrame) -> DataFrame:
    """Means by method, by method and split, and by method and task, in one pass; columns not grouped by are null."""
    columns = [c for c in REPORTED if c in per_query.columns]
    b, s, t = (F.col(c) for c in ("baseline", "split", "task_type"))
    return per_query.groupingSets([[b], [b, s], [b, t]], b, s, t).agg(*[F.avg(f"`{c}`").alias(c) for c in columns])


def ablation(per_query: DataFrame) -> DataFrame:
    """Means of the methods that use images."""
    return rounded(macro(per_query.filter(F.col("baseline").isin(IMAGE_VARIANTS)), ["baseline"]))


def by_scheme_and_task(per_query: DataFrame, tasks: list[str]) -> DataFrame:
    """Mean enrich@10 overall and by task of each scheme; a task without queries has 0."""
    cols = [F.coalesce(F.avg(F.when(F.col("task_type") == t, F.col("`enrich@10`"))), F.lit(0.0)).alias(t) for t in tasks]
    return per_query.groupBy("scheme").agg(F.avg("`enrich@10`").alias("overall"), *cols)


def r_squared(pairs: DataFrame, truth: str, guess: str, by: str) -> DataFrame:
    """One row r2: 1 - SSE / SST over all rows, SST about each group's mean."""
    means = pairs.groupBy(by).agg(F.avg(truth).alias("m_"))
    rows = pairs.join(F.broadcast(means), by)
    return rows.agg((1 - F.sum((F.col(truth) - F.col(guess)) ** 2) / F.sum((F.col(truth) - F.col("m_")) ** 2)).alias("r2"))
