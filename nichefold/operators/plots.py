"""What a client needs to draw: points in drawing order, ranked patches on a grid.  Drawing itself is left to clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichefold.config import LINEAGES, UNKNOWN
from nichefold.functions.exprs import as_score

# Colours of cell types.
TYPE_COLORS = {
    "B_cell": "#1f77b4", "T_cell": "#d62728", "Myeloid": "#ff7f0e", "Endothelial": "#2ca02c", "Fibroblast": "#9467bd", "Epithelial": "#8c564b", "Mast": "#e377c2", "unknown": "#cccccc",
}


def celltype_map(cells: DataFrame) -> DataFrame:
    """(cell_id, x, y, layer, color, label): cells in layers by type, unknown ones last; labels tell how many there are.  Types that aren't known aren't drawn."""
    spark = cells.sparkSession
    kinds = spark.createDataFrame([(t, i, TYPE_COLORS[t]) for i, t in enumerate([*LINEAGES, UNKNOWN])], "cell_type string, layer int, color string")
    label = F.concat("cell_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    named = cells.groupBy("cell_type").agg(F.count("*").alias("n")).join(F.broadcast(kinds), "cell_type").select("cell_type", "layer", "color", label.alias("label"))
    return cells.join(F.broadcast(named), "cell_type").select("cell_id", "x", "y", "layer", "color", "label")


def query_heatmap(points: DataFrame, scores: DataFrame, rel: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, x, y, score, rel, is_top, z): the points of each query, drawn by rising z so that high scores lie on top; the k best are marked."""
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("s_"), "item_id")
    rows = scores.join(rel, ["query_id", "item_id"]).withColumn("s_", as_score(F.col("score")))
    rows = rows.withColumn("r_", F.row_number().over(best)).withColumn("n_", F.count("*").over(Window.partitionBy("query_id")))
    return rows.join(points, "item_id").select("query_id", "item_id", "x", "y", "score", "rel", (F.col("r_") <= k).alias("is_top"), (F.col("n_") - F.col("r_")).alias("z"))


def retrieval_examples(scores: DataFrame, rel: DataFrame, k: int, columns: int = 8) -> DataFrame:
    """(query_id, item_id, grid_row, grid_col, title, color): where each of a query's k best patches goes on a grid, green if relevant, else red."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("s_"), "item_id")
    rows = scores.withColumn("s_", as_score(F.col("score"))).withColumn("r_", F.row_number().over(w) - 1).filter(F.col("r_") < k)
    title = F.format_string("#%d %.3f", F.col("r_") + 1, "score")
    return rows.join(rel, ["query_id", "item_id"]).select(
        "query_id", "item_id", F.floor(F.col("r_") / columns).cast("int").alias("grid_row"), (F.col("r_") % columns).cast("int").alias("grid_col"), title.alias("title"), F.when(F.col("rel"), "green").otherwise("red").alias("color")
    )


def niche_map(cells: DataFrame, niche: str) -> DataFrame:
    """(cell_id, x, y, layer, color): cells outside the niche below, those in it above."""
    inside = F.coalesce(F.col(f"niche_{niche}"), F.lit(False))
    return cells.select("cell_id", "x", "y", inside.cast("int").alias("layer"), F.when(inside, "#d62728").otherwise("#e8e8e8").alias("color"))
