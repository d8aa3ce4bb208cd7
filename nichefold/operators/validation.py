"""How well labels agree with clusters of expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichefold.functions.workers import ship
from nichefold.operators.communities import fuzzy_union, leiden, memberships, whole_weights
from nichefold.operators.expression import agreement, majority
from nichefold.operators.heads import add_up, pairs_of
from nichefold.operators.neighbours import feature_knn
from nichefold.sources.stage import stage


def components(z: DataFrame, genes: list, k: int) -> DataFrame:
    """(cell_id, features): the k first principal components of dense rows (cell_id, gene, z)."""
    return wide_components(z.groupBy("cell_id").pivot("gene", genes).agg(F.first("z")), genes, k)


def wide_components(wide: DataFrame, genes: list, k: int) -> DataFrame:
    """(cell_id, features): the k first principal components of rows with a column a gene."""
    from pyspark.ml.feature import PCA, VectorAssembler

    rows = VectorAssembler(inputCols=[str(g) for g in genes], outputCol="all").transform(wide).select("cell_id", "all")
    return PCA(k=k, inputCol="all", outputCol="features").fit(rows).transform(rows).select("cell_id", "features")


def sparse_components(cells: DataFrame, lognorm: DataFrame, stats: DataFrame, k: int = 30, most: float = 10.0) -> tuple[DataFrame, np.ndarray]:
    """(cell_id, features) of all cells, the k first principal components of their z-scores cut off above at ``most``, and the components' variances.

    From non-zeros alone: a zero's z-score is the same for all cells of a gene, so what a cell differs by lies in its non-zeros, and centring takes their mean from it.
    Products of genes are summed where the rows lie and then band by band; the driver holds genes x genes numbers, whatever the cells.  Of a component's loadings
    the largest is positive.  Fewer genes than k give as many components.
    """
    spark = cells.sparkSession
    ship(spark)
    genes = [r.gene for r in stats.select("gene").orderBy("gene").collect()]  # the panel
    width = len(genes)
    place = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], f"gene {dict(stats.dtypes)['gene']}, at int")
    known = F.broadcast(stats.join(place, "gene"))
    rest = F.col("mu") / F.col("sd")
    rows = lognorm.join(known, "gene").select("cell_id", "at", (F.least((F.col("v") - F.col("mu")) / F.col("sd"), F.lit(most)) + rest).alias("s"))
    lists = stage(rows.groupBy("cell_id").agg(F.collect_list("at").alias("at"), F.collect_list("s").alias("s")), "sparse-rows")  # as many as a panel has
    high = max(1, 64_000 // max(1, width))

    def dense(b, i: int) -> np.ndarray:
        """A batch's rows, a few thousand at a time."""
        x = np.zeros((b.num_rows, width))
        n = b.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x[np.repeat(np.arange(b.num_rows), n), b.column(i).flatten().to_numpy(zero_copy_only=False)] = b.column(i + 1).flatten().to_numpy(zero_copy_only=False)
        return x

    def products(batches):
        import pyarrow as pa

        total = np.zeros((width + 1, width))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = dense(b.slice(at, 4096), 0)
                total[:-1] += x.T @ x
                total[-1] += x.sum(axis=0)
        for at in range(0, width + 1, high):
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([at // high], pa.int32()), pa.array([total[at : at + high].tobytes()])], names=["of", "band", "sums"])

    kind = "of int, band int, sums binary"
    bands = pairs_of(add_up(lists.select("at", "s").mapInArrow(products, kind), ["of", "band"], kind))
    total = np.frombuffer(b"".join(s for _, s in bands), dtype=np.float64).reshape(width + 1, width) if bands else np.zeros((width + 1, width))
    n = max(1, cells.count())
    mean = total[-1] / n
    values, vectors = np.linalg.eigh(total[:-1] / n - np.outer(mean, mean)) if width else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if width else vectors
    shared = spark.sparkContext.broadcast((mean @ vectors, vectors))
    every = cells.select("cell_id").join(lists, "cell_id", "left")

    def project(batches):
        import pyarrow as pa

        away, w = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                out = dense(part, 1) @ w - away
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * w.shape[1]), pa.array(out.ravel()))
                yield pa.record_batch([part.column(0), flat], names=["cell_id", "features"])

    return every.mapInArrow(project, f"cell_id {dict(cells.dtypes)['cell_id']}, features array<double>"), np.maximum(values, 0)


def graph_clusters(points: DataFrame, neighbours: int = 15, resolution: float = 0.5) -> DataFrame:
    """(cell_id, cluster): communities of the fuzzy graph of nearest neighbours of (cell_id, features); ``neighbours`` counts a cell itself.  Cell ids are whole numbers."""
    near = stage(feature_knn(points, neighbours - 1, "cell_id", "features"), "near")
    graph = stage(whole_weights(fuzzy_union(memberships(near, neighbours))), "graph")
    return leiden(graph, resolution).select(F.col("node").alias("cell_id"), F.col("community").alias("cluster"))


def clusters(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cell_id, cluster) by k-means on features."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed).fit(points).transform(points).select("cell_id", F.col("prediction").alias("cluster"))


def cluster_agreement(types: DataFrame, found: DataFrame) -> DataFrame:
    """(cell_type, cluster_type, n, share): each cell's type against the commonest type of its cluster."""
    rows = types.select("cell_id", "cell_type").join(found, "cell_id")
    named = majority(rows, "cluster", "cell_type").select("cluster", F.col("cell_type").alias("cluster_type"))
    return agreement(rows.join(named, "cluster"), "cell_type", "cluster_type")


def purity(table: DataFrame) -> DataFrame:
    """One row: the share of cells whose type is their cluster's."""
    return table.agg((F.sum(F.when(F.col("cell_type") == F.col("cluster_type"), F.col("n")).otherwise(0)) / F.sum("n")).alias("purity"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nmi, the mutual information of two labellings over the mean of their entropies; 1 where both have but one label."""
    both = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over a table of labels by labels
    share = both.select("n", F.sum("n").over(whole).alias("t"), F.sum("n").over(Window.partitionBy(a)).alias("na"), F.sum("n").over(Window.partitionBy(b)).alias("nb"))
    p = F.col("n") / F.col("t")
    mi = F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    entropy = lambda c: -F.sum(p * F.log(F.col(c) / F.col("t")))
    return share.agg(mi.alias("mi"), ((entropy("na") + entropy("nb")) / 2).alias("h")).select(F.when(F.col("h") > 0, F.col("mi") / F.col("h")).otherwise(1.0).alias("nmi"))


def scaled(z: DataFrame, most: float = 10.0) -> DataFrame:
    """z cut off above, as before components are taken."""
    return z.withColumn("z", F.least("z", F.lit(most)))
