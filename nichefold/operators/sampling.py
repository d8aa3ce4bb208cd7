"""Candidate pools, folds and bootstrap indices by integer hashing, so every engine draws the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichefold.functions.exprs import id_number, stable_hash
from nichefold.sources.stage import stage


def build_pool(cells: DataFrame, size: int, stratify_by: str | None = "cell_type", seed: int = 0) -> DataFrame:
    """cells of the pool with pool_idx, numbered by id from 0.

    All cells if there are no more than size.  Else a uniform draw, or of each stratum its share of size, rounded half to
    even and at least one, so the total may differ from size.
    """
    if cells.count() <= size:
        return _numbered(cells)
    draw = stable_hash(id_number(cells, "cell_id"), seed)
    if stratify_by is None:
        # The pool is a bounded sample, so one global top-k keeps it small.
        picked = cells.withColumn("h_", draw).orderBy("h_", "cell_id").limit(size).drop("h_")
    else:
        sizes = cells.groupBy(stratify_by).agg(F.count("*").alias("len"))
        n = sizes.agg(F.sum("len").alias("n"))
        want = F.least(F.col("len"), F.greatest(F.lit(1).cast("long"), F.rint(F.lit(float(size)) * F.col("len") / F.col("n")).cast("long")))
        quota = sizes.crossJoin(n).select(F.col(stratify_by).alias("s_"), want.alias("quota"), "len")
        # Hashes are about uniform: a margin above each stratum's quota is ranked, and where it came out short, the whole stratum.
        share = F.least(F.lit(1.0), (F.col("quota") + 8 * F.sqrt("quota") + 16) / F.col("len"))
        known = stage(quota.select("*", F.floor(share * 2147483647.0).cast("long").alias("upto")), "quotas")
        rows = cells.withColumn("h_", draw)
        same = F.col(stratify_by).eqNullSafe(F.col("s_"))
        met = rows.join(F.broadcast(known), same).groupBy("s_").agg(F.count_if(F.col("h_") <= F.col("upto")).alias("has_"))
        short = known.join(met.withColumnRenamed("s_", "t_"), F.col("s_").eqNullSafe(F.col("t_"))).select("s_", "quota", F.when(F.col("has_") < F.col("quota"), F.lit(2147483647)).otherwise(F.col("upto")).alias("upto"))
        near = rows.join(F.broadcast(short), same).filter(F.col("h_") <= F.col("upto"))
        w = Window.partitionBy(stratify_by).orderBy("h_", "cell_id")
        picked = near.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= F.col("quota")).select(*cells.columns)
    return _numbered(picked)


def _numbered(pool: DataFrame) -> DataFrame:
    """pool with pool_idx; a pool is bounded by its configured size, so one task ranks it."""
    return pool.withColumn("pool_idx", (F.row_number().over(Window.orderBy("cell_id")) - 1).cast("long"))


def shuffled_order(items: DataFrame, id_col: str, seed: int = 0, to: str = "place") -> DataFrame:
    """items with their place, from 0, in the order of a hash of the id.

    Hashes are uniform, so their leading bits cut the order into 1,024 even pieces, which are ranked side by side; the counts of the pieces before, a table
    of at most as many rows, do the rest.
    """
    rows = items.withColumn("h_", stable_hash(id_number(items, id_col), seed)).withColumn("b_", F.shiftright("h_", 21))
    sizes = rows.groupBy("b_").agg(F.count("*").alias("n_"))
    before = sizes.select("b_", (F.sum("n_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).alias("before_"))
    w = Window.partitionBy("b_").orderBy("h_", id_col)
    return rows.join(F.broadcast(before), "b_").withColumn(to, (F.col("before_") + F.row_number().over(w) - 1).cast("long")).drop("h_", "b_", "before_")


def kfold(items: DataFrame, id_col: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(id, fold): shuffled folds whose sizes differ by at most one."""
    return shuffled_order(items.select(id_col), id_col, seed, "place_").select(id_col, (F.col("place_") % folds).cast("int").alias("fold"))


def tile_folds(tiles: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """tiles with a random fold a tile."""
    return tiles.withColumn("fold", (stable_hash(F.col("tile"), seed) % folds).cast("int"))


def uniform_subset(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return rows.withColumn("h_", stable_hash(id_number(rows, id_col), seed)).orderBy("h_", id_col).limit(n).drop("h_")


def bootstrap_indices(spark: SparkSession, rounds: int, n: int, seed: int = 0) -> DataFrame:
    """(b, i): n positions drawn with replacement from 0 to n-1 in each round."""
    cells = spark.range(rounds * n).select(F.floor(F.col("id") / n).cast("int").alias("b"), F.col("id"))
    return cells.select("b", (stable_hash(F.col("id"), seed) % n).cast("int").alias("i"))
