"""The driver's tables as the benchmark's frames: customers are cells, brands are genes, quantities are counts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.config import LINEAGES, Settings
from nichefold.operators import expression as E
from nichefold.operators import sampling, spatial
from nichefold.sources.cells import marker_table, query_set
from nichefold.sources.stage import stage

SETTINGS = Settings()
#: Three genes a lineage, then four of proliferation.
MARKERS = {t: [3 * i + 1, 3 * i + 2, 3 * i + 3] for i, t in enumerate(LINEAGES)}
STATE_GENES = [22, 23, 24, 25]
#: Panel genes that stand for those of gene queries; EPCAM has none, so its query has no relevant cell.
ALIASES = {"CD79A": 1, "CD3D": 4, "CD68": 7, "MKI67": 22}
DIM = 64
#: Size of the drawn pool in the query that draws one; other queries use the configured size.
SMALL_POOL = 600


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("cell_id"), F.col("c_acctbal").alias("x"), (((key * 7919) % 10007) / 10.0).alias("y"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, d, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("gene"))
    rows = lines.join(part, lines.l_partkey == part.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.groupBy(F.col("o_custkey").alias("cell_id"), "gene").agg(F.sum("l_quantity").alias("cnt"))


def markers(spark: SparkSession) -> DataFrame:
    return marker_table(spark, MARKERS, "int")


def state_genes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g,) for g in STATE_GENES], "gene int")


def queries(spark: SparkSession) -> DataFrame:
    alias = spark.createDataFrame(list(ALIASES.items()), "target_label string, gene int")
    return query_set(spark).join(F.broadcast(alias), "target_label", "left")


class Labelled:
    """Cells with types, state, composition and niches, and what they are made of.

    Three things read the labels (pool, relevance and transcript scores), so they are written.
    """

    def __init__(self, spark: SparkSession, d: str, settings: Settings = SETTINGS):
        self.spark, self.settings = spark, settings
        self.cells = cells(spark, d)
        self.counts = stage(counts(spark, d), "counts")  # totals and values both read it
        self.lognorm = stage(E.normalise(self.counts, settings.target_sum), "lognorm")
        self.n = self.cells.agg(F.count("*").alias("n"))
        self.stats = stage(E.gene_stats(self.lognorm, self.n), "gene-stats")
        self.scores = E.marker_scores(self.cells, self.lognorm, self.stats, markers(spark))
        self.types = E.assign_types(self.scores, settings.type_threshold, settings.type_margin)

    @cached_property
    def state(self) -> DataFrame:
        return E.proliferation(self.cells, self.lognorm, self.stats, state_genes(self.spark), self.settings.proliferation_quantile)

    def edges(self) -> DataFrame:
        if self.settings.use == "radius" and self.settings.radius is not None:
            return spatial.radius_edges(self.cells, self.settings.radius)
        return spatial.knn_edges(self.cells, self.settings.k)

    def composition(self, types: DataFrame) -> DataFrame:
        if self.settings.use == "radius" and self.settings.radius is not None:
            return spatial.radius_composition(self.cells, self.settings.radius, types)
        return spatial.knn_composition(self.cells, self.settings.k, types)

    def all(self) -> DataFrame:
        scores = stage(self.scores, "marker-scores")  # types and wide scores both read it
        types = stage(E.assign_types(scores, self.settings.type_threshold, self.settings.type_margin), "types")
        comp = self.composition(types)
        niches = spatial.niche_labels(comp, self.settings.niche)
        wide = E.wide_scores(scores, LINEAGES)
        return stage(self.cells.join(types, "cell_id").join(self.state, "cell_id").join(wide, "cell_id").join(niches, "cell_id"), "labelled")

    def typed(self, cells: DataFrame) -> DataFrame:
        """Some of the cells with their types: no neighbour, niche or state is worked out."""
        points = stage(cells, "points")
        scores = E.marker_scores(points, self.lognorm.join(points.select("cell_id"), "cell_id", "left_semi"), self.stats, markers(self.spark))
        return stage(points.join(E.assign_types(scores, self.settings.type_threshold, self.settings.type_margin), "cell_id"), "typed")

    def pool(self, labelled: DataFrame) -> DataFrame:
        s = self.settings
        return stage(sampling.build_pool(labelled, s.pool_size, "cell_type" if s.stratify else None, s.seed), "pool")


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
