"""Bootstrap intervals, paired tests and the significance table over per-query metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichefold.config import METHODS, REFERENCE_METHOD
from nichefold.functions.exprs import stable_hash


def _positions(values: DataFrame, query_col: str = "query_id") -> DataFrame:
    return values.withColumn("i", (F.dense_rank().over(Window.orderBy(query_col)) - 1).cast("int"))


def resampled_means(values: DataFrame, by: list[str], rounds: int, seed: int = 0) -> DataFrame:
    """(by, b, m): means of resamples of the queries, the same resamples for every group.

    values: query_id, value and by.  Queries are few (a benchmark's set), rounds may be many and are spread.
    """
    spark = values.sparkSession
    rows = _positions(values)
    n = rows.agg((F.max("i") + 1).alias("n"))
    draws = spark.range(rounds).crossJoin(F.broadcast(n)).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("p"), "n")
    draws = draws.select("b", (stable_hash(F.col("b") * F.col("n") + F.col("p"), seed) % F.col("n")).cast("int").alias("i"))
    return draws.join(F.broadcast(rows), "i").groupBy(*by, "b").agg((F.sum("value") / F.count("*")).alias("m"))


def bootstrap_ci(values: DataFrame, by: list[str], rounds: int = 5000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, mean, lo, hi): the mean over queries and the percentile interval of resampled means."""
    means = values.groupBy(*by).agg(F.avg("value").alias("mean"))
    q = resampled_means(values, by, rounds, seed).groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    return means.join(q, by)


def paired_bootstrap(values: DataFrame, method_col: str, reference: str, by: list[str] | None = None, rounds: int = 5000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, method, diff, lo, hi, p_value) of the reference minus each other method, on shared resamples."""
    by = by or []
    ref = values.filter(F.col(method_col) == reference).select(*by, "query_id", F.col("value").alias("ref"))
    diffs = values.filter(F.col(method_col) != reference).join(ref, [*by, "query_id"]).select(*by, method_col, "query_id", (F.col("ref") - F.col("value")).alias("value"))
    keys = [*by, method_col]
    boot = resampled_means(diffs, keys, rounds, seed).groupBy(*keys).agg(
        F.percentile("m", F.lit(alpha / 2)).alias("lo"),
        F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p_value"),
    )
    return diffs.groupBy(*keys).agg(F.avg("value").alias("diff")).join(boot, keys)


def stars(p: Column) -> Column:
    return F.when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 5e-2, "*").otherwise("ns")


def aligned(per_query: DataFrame, method_col: str, metric: str) -> DataFrame:
    """(method, query_id, value) for every method by every query; NaN where a method lacks a query, which makes its mean NaN."""
    methods, ids = per_query.select(method_col).distinct(), per_query.select("query_id").distinct()
    grid = methods.crossJoin(F.broadcast(ids))
    return grid.join(per_query.select(method_col, "query_id", F.col(f"`{metric}`").alias("value")), [method_col, "query_id"], "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def significance_table(per_query: DataFrame, metrics: list[str], rounds: int = 5000, reference: str = REFERENCE_METHOD, top: str = "oracle") -> DataFrame:
    """A row a known method in display order: 'mean [lo,hi]' per metric, and stars against the reference, none for it and the ceiling."""
    spark = per_query.sparkSession
    order = spark.createDataFrame([(m, i, label) for i, (m, label) in enumerate(METHODS.items())], "baseline string, ord int, method string")
    out = per_query.select("baseline").distinct().join(F.broadcast(order), "baseline")
    has_ref = not per_query.filter(F.col("baseline") == reference).isEmpty()
    for m in metrics:
        v = aligned(per_query, "baseline", m)
        ci = bootstrap_ci(v, ["baseline"], rounds).select("baseline", F.format_string("%.3f [%.2f,%.2f]", "mean", "lo", "hi").alias(m))
        out = out.join(ci, "baseline")
        if has_ref:
            p = paired_bootstrap(v, "baseline", reference, rounds=rounds).filter(F.col("baseline") != top)
            out = out.join(p.select("baseline", stars(F.col("p_value")).alias(f"{m}_sig")), "baseline", "left")
    return out.orderBy("ord")


def latex_table(table: DataFrame, metrics: list[str], rounds: int, reference_label: str) -> str:
    """The significance table as LaTeX; its rows are few."""

    def cell(r, m):
        s = r.asDict().get(f"{m}_sig")
        return r[m] + (rf"\textsuperscript{{{s}}}" if s and s != "ns" else "")

    body = [f"{rf'\textbf{{{r.method}}}' if r.method == reference_label else r.method} & " + " & ".join(cell(r, m) for m in metrics) + r" \\" for r in table.collect()]
    head = [r"\begin{table}[t]", r"\centering", rf"\caption{{Bootstrap means with 95\% intervals over queries, {rounds} rounds.}}", rf"\begin{{tabular}}{{l{'c' * len(metrics)}}}", r"\toprule", "Method & " + " & ".join(metrics) + r" \\", r"\midrule"]
    return "\n".join([*head, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
