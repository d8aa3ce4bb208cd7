"""Labels the cells of a sample and writes them, by sample and cell type, with the sample's statistics.

    python -m jobs.cell_atlas --tables IN --out OUT [--config FILE]

Reads cells and their counts, keeps cells with enough counts, normalises, types cells by marker genes, tells proliferating ones, labels niches by the types of the nearest
neighbours, draws the candidate pool, stratified by type, and deals it to folds.  Output: cells/sample=S/cell_type=T and stats/sample=S.  A sample that is run again is
replaced, whatever types it had; other samples that lie there stay.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import load, log, main, written
from nichefold.config import LINEAGES, NICHES, Settings
from nichefold.operators import expression as E
from nichefold.operators import sampling, spatial
from nichefold.plans import fixtures as X
from nichefold.sources.stage import stage

DEFAULTS = {"dataset": "atlas", "sample": "all", "min_counts": 10, "k": 15, "pool_size": 20_000, "folds": 5, "seed": 0}
SETTINGS = Settings()


def labelled(raw: DataFrame, all_counts: DataFrame, config: dict) -> DataFrame:
    """Cells that pass, with their counts' total, type, state and niche."""
    spark = raw.sparkSession
    totals = E.library_totals(all_counts).withColumnRenamed("total", "transcript_counts")
    cells = stage(E.qc_filter(raw.join(totals, "cell_id"), config["min_counts"]), "cells")
    counts = stage(E.align(cells, all_counts, strict=False), "counts")
    lognorm = stage(E.normalise(counts, SETTINGS.target_sum), "lognorm")
    stats = stage(E.gene_stats(lognorm, cells.agg(F.count("*").alias("n"))), "gene-stats")
    types = stage(E.assign_types(E.marker_scores(cells, lognorm, stats, X.markers(spark)), SETTINGS.type_threshold, SETTINGS.type_margin), "types")
    state = E.proliferation(cells, lognorm, stats, X.state_genes(spark), SETTINGS.proliferation_quantile)
    near = spatial.knn_composition(cells, config["k"], types)
    niches = spatial.niche_labels(near, SETTINGS.niche).select("cell_id", *[f"niche_{n}" for n in NICHES], "niche_label")
    return stage(cells.join(types, "cell_id").join(state, "cell_id").join(niches, "cell_id"), "labelled")


def pooled(cells: DataFrame, config: dict) -> DataFrame:
    """(cell_id, pool_idx, fold) of the candidate pool."""
    pool = stage(sampling.build_pool(cells.select("cell_id", "cell_type"), config["pool_size"], "cell_type", config["seed"]), "pool")
    return pool.select("cell_id", "pool_idx").join(sampling.kfold(pool, "cell_id", config["folds"], config["seed"]), "cell_id")


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> None:
    config = DEFAULTS | (config or {})
    raw, counts = X.cells(spark, tables), stage(X.counts(spark, tables), "all-counts")
    log.info("read %d cells and %d counts of %s", raw.count(), counts.count(), tables)
    cells = labelled(raw, counts, config)
    rows = cells.join(pooled(cells, config), "cell_id", "left")
    where = f"{out}/cells/sample={config['sample']}"
    written(rows, where, "cell_type")
    log.info("wrote %d cells to %s", spark.read.parquet(where).count(), where)
    stats = E.dataset_stats(cells, raw, counts, config["dataset"], config["sample"])
    written(stats.coalesce(1), f"{out}/stats/sample={config['sample']}")
    log.info("wrote statistics to %s/stats/sample=%s", out, config["sample"])


def result(spark: SparkSession, out: str) -> DataFrame:
    """The output read back: cells of all samples, with how many cells their sample had before and after quality control and its median count."""
    types = {"n_cells_raw": "long", "n_cells_qc": "long", "median_transcripts": "double", **{f"n_{t}": "long" for t in LINEAGES}}
    stats = spark.read.parquet(f"{out}/stats").groupBy("sample").pivot("stat", list(types)).agg(F.first("value"))
    return spark.read.parquet(f"{out}/cells").join(F.broadcast(stats.select("sample", *[F.col(c).cast(t).alias(c) for c, t in types.items()])), "sample")


if __name__ == "__main__":
    main(
        sys.modules[__name__].__doc__,
        {"tables": "folder of customer, orders, lineitem and part as Parquet", "out": "folder of the output"},
        "cell_atlas.json",
        lambda spark, a: run(spark, a.tables, a.out, load(spark, a.config, DEFAULTS)),
    )
