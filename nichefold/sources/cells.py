"""Scans and sinks of cell tables, expression matrices, polygons, queries, scores and reports."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.config import MARKER_SETS, QUERY_SET

CELLS = "cell_id string, x_centroid double, y_centroid double, transcript_counts double, cell_area double"
BOUNDARIES = "cell_id string, vertex_x double, vertex_y double"
QUERIES = "query_id string, query_text string, target_field string, target_label string, task_type string, level string, split string"


def read_cells(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Cells from CSV, gzipped or not; ids are strings.  extra: more columns, as DDL, by name."""
    return spark.read.schema(CELLS + (f", {extra}" if extra else "")).option("header", True).option("enforceSchema", False).csv(path)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Polygon vertices, a row each."""
    return spark.read.schema(BOUNDARIES).option("header", True).csv(path)


def csc_to_counts(matrix: DataFrame, features: DataFrame, expression_only: bool = True) -> DataFrame:
    """(cell_id, gene, cnt) of a compressed cells x genes matrix kept as a row a cell.

    matrix: cell_id, indices array<int>, data array<double>.  features: idx int, name string, feature_type string; only
    'Gene Expression' is kept if asked.  Cells are exploded where they lie; only the feature catalogue is joined.
    """
    keep = features.filter(F.col("feature_type") == "Gene Expression") if expression_only else features
    rows = matrix.select("cell_id", F.explode(F.arrays_zip("indices", "data")).alias("z")).select("cell_id", F.col("z.indices").alias("idx"), F.col("z.data").cast("double").alias("cnt"))
    return rows.join(keep.select("idx", F.col("name").alias("gene")), "idx").filter("cnt <> 0").select("cell_id", "gene", "cnt")


def columns_to_cells(data: DataFrame) -> DataFrame:
    """Index pointers of a compressed matrix turned into a row a cell.

    data: cell_id, start long, end long, with the matrix's data and indices arrays as indices, data slices of one stored block.
    """
    part = lambda c: F.slice(c, F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return data.select("cell_id", part("indices").alias("indices"), part("data").alias("data"))


def pixel_size(xml: Column, default: float = 0.363788) -> Column:
    """PhysicalSizeX of OME metadata, or the default where it is missing or no number."""
    return F.coalesce(F.regexp_extract(xml, 'PhysicalSizeX="([^"]+)"', 1).try_cast("double"), F.lit(default))


def pyramid_level(levels: Column, level: int | Column = 0) -> Column:
    """The asked level of an image pyramid (array of structs), clamped to the last."""
    return F.element_at(levels, F.least((F.lit(level) if isinstance(level, int) else level) + 1, F.size(levels)))


def read_affine(spark: SparkSession, path: str) -> list[list[float]]:
    """A 3 x 3 matrix from CSV, wherever Spark can read it."""
    return [[float(x) for x in r.value.split(",")] for r in spark.read.text(path).collect() if r.value.strip()]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, length, content); decoding is the caller's, tile by tile."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def query_set(spark: SparkSession) -> DataFrame:
    """The benchmark's queries with ids and levels."""
    rows = [(f"q{i:03d}", text, f, label, task, "neighborhood" if task == "niche" else "cell", split) for i, (text, f, label, task, split) in enumerate(QUERY_SET)]
    return spark.createDataFrame(rows, QUERIES)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).option("header", True).csv(path)


def marker_table(spark: SparkSession, sets: dict[str, Iterable] | None = None, gene_type: str = "string") -> DataFrame:
    """(lineage_ord, lineage, ord, gene) of marker sets."""
    sets = MARKER_SETS if sets is None else sets
    return spark.createDataFrame([(i, t, j, g) for i, (t, gs) in enumerate(sets.items()) for j, g in enumerate(gs)], f"lineage_ord int, lineage string, ord int, gene {gene_type}")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores of all methods, a folder each."""
    scores.write.mode("overwrite").partitionBy("baseline").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """All methods' scores that lie there, older ones included."""
    return spark.read.parquet(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").partitionBy("encoder", "scale").parquet(path)


def read_embeddings(spark: SparkSession, path: str, encoder: str, scale: str) -> DataFrame:
    """Vectors of one encoder and scale; no rows where there are none.  The partition filter prunes the scan."""
    return spark.read.parquet(path).filter((F.col("encoder") == encoder) & (F.col("scale") == scale))


def write_report(table: DataFrame, path: str, digits: int | None = 4) -> None:
    """A small table as CSV with a header, doubles rounded half to even."""
    from nichefold.functions.exprs import half_even

    out = table.select(*[half_even(F.col(f"`{c}`"), digits).alias(c) if t == "double" and digits is not None else F.col(f"`{c}`") for c, t in table.dtypes])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_processed(cells: DataFrame, lognorm: DataFrame, genes: DataFrame, folder: str) -> None:
    """Labelled cells, their log-normalised non-zeros and the gene panel."""
    cells.write.mode("overwrite").parquet(f"{folder}/cells.parquet")
    lognorm.write.mode("overwrite").parquet(f"{folder}/expression.parquet")
    genes.coalesce(1).write.mode("overwrite").json(f"{folder}/genes.json")


def load_processed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/cells.parquet"), spark.read.parquet(f"{folder}/expression.parquet"), spark.read.json(f"{folder}/genes.json")


def fetch(url: str, target: str, least: int = 1024) -> bool:
    """Downloads a file unless it is there already; writes beside it first, so a broken download leaves nothing.  True if fetched."""
    if os.path.exists(target) and os.path.getsize(target) > least:
        return False
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    part = f"{target}.part"
    urllib.request.urlretrieve(url, part)  # noqa: S310
    os.replace(part, target)
    return True
