"""What is relevant to a query, and scores that come from the transcripts themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.config import NICHES
from nichefold.functions.exprs import stable_hash

FIELDS = ("cell_type", "gene", "cell_state", "niche")
FLOOR = 1e-9


def check_queries(queries: DataFrame) -> None:
    """Refuses fields, states and niches that have no resolver."""
    bad = queries.filter(~F.col("target_field").isin(*FIELDS) | ((F.col("target_field") == "cell_state") & (F.col("target_label") != "proliferating")) | ((F.col("target_field") == "niche") & ~F.col("target_label").isin(*NICHES)))
    rows = bad.limit(3).collect()
    if rows:
        raise ValueError(f"no way to resolve {rows}")


def _pick(name: Column, options: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda acc, kv: F.when(name == kv[0], kv[1]).otherwise(acc), options.items(), otherwise)


def gene_cuts(pool: DataFrame, lognorm: DataFrame, genes: DataFrame, quantile: float = 0.90) -> DataFrame:
    """(gene, cut): the quantile of a gene over the whole pool, absent cells as zeros, and at least FLOOR.

    The dense column is never built: with n cells, z of them zeros, the quantile is read off the ordered non-zeros.
    """
    n = pool.agg(F.count("*").alias("n"))
    mine = lognorm.join(pool.select("cell_id"), "cell_id", "left_semi").join(F.broadcast(genes.select("gene").distinct()), "gene")
    vals = mine.groupBy("gene").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    rows = genes.select("gene").distinct().join(vals, "gene", "left").crossJoin(F.broadcast(n)).withColumn("vs", F.coalesce("vs", F.array().cast("array<double>")))
    at = F.lit(quantile) * (F.col("n") - 1)
    zeros = F.col("n") - F.size("vs")
    value = lambda i: F.when(i < zeros, F.lit(0.0)).otherwise(F.get("vs", (i - zeros).cast("int")))
    lo = F.floor(at)
    low, high = value(lo), value(F.least(lo + 1, F.col("n") - 1))
    return rows.select("gene", F.greatest(low + (high - low) * (at - lo), F.lit(FLOOR)).alias("cut"))


def relevance(queries: DataFrame, pool: DataFrame, lognorm: DataFrame, panel: DataFrame, quantile: float = 0.90) -> DataFrame:
    """(query_id, item_id, rel) of every query by every cell of the pool.

    pool: cell_id, pool_idx, cell_type, is_proliferating and niche_<name> booleans.  queries: query_id, target_field, target_label, and gene, the panel's
    name of a gene query's target.  A gene that the panel lacks has no relevant cell.  The pool is bounded; the queries are broadcast.
    """
    genes = queries.filter("target_field = 'gene'").select("gene").distinct().join(panel.select("gene").distinct(), "gene")
    cuts = gene_cuts(pool, lognorm, genes, quantile)
    express = lognorm.join(F.broadcast(cuts), "gene").filter(F.col("v") >= F.col("cut")).select("cell_id", "gene", F.lit(True).alias("high"))
    grid = pool.crossJoin(F.broadcast(queries.select("query_id", "target_field", "target_label", "gene")))
    grid = grid.join(express, ["cell_id", "gene"], "left")
    niche = _pick(F.col("target_label"), {n: F.col(f"niche_{n}") for n in NICHES}, F.lit(False))
    rel = _pick(
        F.col("target_field"),
        {"cell_type": F.col("cell_type") == F.col("target_label"), "cell_state": F.col("is_proliferating"), "niche": niche, "gene": F.coalesce("high", F.lit(False))},
        F.lit(False),
    )
    return grid.select("query_id", F.col("pool_idx").alias("item_id"), rel.alias("rel"))


def niche_score(name: Column) -> Column:
    """How much a neighbourhood is of a niche, from its composition."""
    f = lambda t: F.col(f"frac_{t}")
    return _pick(
        name,
        {
            "bcell_rich": f("B_cell"),
            "tcell_rich": f("T_cell"),
            "myeloid_rich": f("Myeloid"),
            "vascular": f("Endothelial"),
            "immune_rich": f("T_cell") + f("B_cell") + f("Myeloid"),
            "tumor_immune_interface": f("Epithelial") * (f("T_cell") + f("Myeloid")),
        },
        F.lit(0.0),
    )


def transcript_scores(queries: DataFrame, pool: DataFrame, expression: DataFrame, lineages: list[str]) -> DataFrame:
    """(query_id, item_id, score): type queries by their lineage's score, state by proliferation, gene by expression (0 where absent), niche by composition.

    pool: cell_id, pool_idx, score_<lineage>, proliferation_score, frac_<lineage>.  expression: cell_id, gene, v.
    """
    grid = pool.crossJoin(F.broadcast(queries.select("query_id", "target_field", "target_label", "gene"))).join(expression, ["cell_id", "gene"], "left")
    kind = _pick(F.col("target_label"), {t: F.col(f"score_{t}") for t in lineages}, F.lit(0.0))
    score = _pick(F.col("target_field"), {"cell_type": kind, "cell_state": F.col("proliferation_score"), "gene": F.coalesce("v", F.lit(0.0)), "niche": niche_score(F.col("target_label"))}, F.lit(0.0))
    return grid.select("query_id", F.col("pool_idx").alias("item_id"), score.alias("score"))


def random_scores(queries: DataFrame, pool: DataFrame, seed: int = 0) -> DataFrame:
    """Uniform scores by hashing query number and cell; only their order matters."""
    n = F.substring("query_id", 2, 9).cast("long")
    return pool.crossJoin(F.broadcast(queries.select("query_id"))).select("query_id", F.col("pool_idx").alias("item_id"), (stable_hash(F.col("pool_idx") * 64 + n, seed) / F.lit(2147483647.0)).alias("score"))
