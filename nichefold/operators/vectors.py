"""Embedding vectors: normalising, cosine ranking, feature blocks and their variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nichefold.config import variant_specs
from nichefold.functions.arrays import matrix
from nichefold.functions.exprs import EPS, l2_normalise
from nichefold.functions.workers import ship
from nichefold.sources.stage import stage

#: Query vectors that a worker may hold, in numbers.
MAX_QUERY_NUMBERS = 50_000_000


def with_unit(vectors: DataFrame, vec_col: str = "embedding", to: str = "unit") -> DataFrame:
    return vectors.withColumn(to, l2_normalise(F.col(vec_col)))


def mean_vectors(rows: DataFrame, by: str, vec_col: str, to: str, combine: bool = True) -> DataFrame:
    """(by, to array<double>): the mean vector of each group, in Arrow batches; vectors of uneven width within a group are an error.

    combine: sums are made where the rows lie before they are dealt by group, which pays where groups are large.  Other columns of rows
    only settle the order of summation.
    """
    ship(rows.sparkSession)
    id_type = dict(rows.dtypes)[by]
    order = [c for c in rows.columns if c not in (by, vec_col)]
    kind = f"`{by}` {id_type}, s array<double>, n long"

    def sums(batches, last: bool):
        """Sums and counts of runs of equal keys; the last step divides."""
        import pyarrow as pa

        def emit(keys, total, n):
            made = total / n[:, None] if last else total
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            return pa.record_batch([keys, flat] + ([] if last else [pa.array(n, pa.int64())]), names=[by, to] if last else [by, "s", "n"])

        held = None  # key, sum and count of the run that isn't over
        for b in batches:
            if not b.num_rows:
                continue
            keys, x = b.column(0), matrix(b.column(1))
            n = b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else np.ones(b.num_rows, dtype=np.int64)
            k = keys.to_numpy(zero_copy_only=False)
            start = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
            total, n = np.add.reduceat(x, start, axis=0), np.add.reduceat(n, start)
            keys = keys.take(pa.array(start))
            if held is not None:
                if held[0][0] == keys[0]:
                    if held[1].shape[1] != x.shape[1]:
                        raise ValueError("vectors of different widths")
                    total[0] += held[1][0]
                    n[0] += held[2][0]
                else:
                    yield emit(*held)
            if len(n) > 1:
                yield emit(keys[:-1], total[:-1], n[:-1])
            held = keys[-1:], total[-1:], n[-1:]
        if held is not None:
            yield emit(*held)

    parts = rows.select(by, vec_col, *order)
    if combine:
        parts = parts.sortWithinPartitions(by, *order).select(by, vec_col).mapInArrow(lambda x: sums(x, False), kind)
        return parts.repartition(by).sortWithinPartitions(by).mapInArrow(lambda x: sums(x, True), f"`{by}` {id_type}, `{to}` array<double>")
    return parts.repartition(by).sortWithinPartitions(by, *order).select(by, vec_col).mapInArrow(lambda x: sums(x, True), f"`{by}` {id_type}, `{to}` array<double>")


def group_centroids(vectors: DataFrame, by: str, vec_col: str = "unit") -> DataFrame:
    """(by, qvec): unit-length means."""
    return mean_vectors(vectors.select(by, vec_col), by, vec_col, "mean").select(by, l2_normalise(F.col("mean")).alias("qvec"))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), EPS)


def _held_queries(queries: DataFrame, id_col: str, vec_col: str) -> tuple[list, np.ndarray] | None:
    """Query ids and unit vectors on the driver; None beyond MAX_QUERY_NUMBERS."""
    n, d = queries.agg(F.count("*"), F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()
    if n * max(1, d) > MAX_QUERY_NUMBERS:
        return None
    rows = queries.select(id_col, vec_col).orderBy(id_col).collect()
    return [r[0] for r in rows], _unit_rows(np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), d))


def _scored(names, q: np.ndarray, ids, x: np.ndarray, best: int | None, digits: int | None = None):
    """A batch of (query_id, item_id, score): all pairs, or each query's best and what ties with the last of them."""
    import pyarrow as pa

    s = q @ _unit_rows(x).T
    if digits is not None:
        s = np.floor(s * 10.0**digits + 0.5) / 10.0**digits
    n = len(x)
    if best is None or n <= best:
        at, cols = np.repeat(np.arange(len(s)), n), np.tile(np.arange(n), len(s))
    else:
        # Ties at the border are kept, the final ranking settles them.
        border = np.partition(s, n - best, axis=1)[:, n - best]
        rows = [np.flatnonzero(s[i] >= border[i]) for i in range(len(s))]
        at, cols = np.repeat(np.arange(len(s)), [len(r) for r in rows]), np.concatenate(rows)
    return pa.record_batch([names.take(pa.array(at)), ids.take(pa.array(cols)), pa.array(s[at, cols])], names=["query_id", "item_id", "score"])


def _score_batches(items: DataFrame, queries: DataFrame, q_id: str, q_vec: str, i_id: str, i_vec: str, best: int | None, digits: int | None = None) -> DataFrame:
    ship(items.sparkSession)
    kinds = dict(queries.dtypes)[q_id], dict(items.dtypes)[i_id]
    kind = f"query_id {kinds[0]}, item_id {kinds[1]}, score double"
    held = _held_queries(queries, q_id, q_vec)
    if held is None:
        return _score_blocks(items, queries, q_id, q_vec, i_id, i_vec, best, kind, digits=digits)
    shared = items.sparkSession.sparkContext.broadcast(held)
    q_type = to_arrow_type(queries.schema[q_id].dataType)

    def run(batches):
        import pyarrow as pa

        ids, q = shared.value
        names = pa.array(ids, q_type)
        for b in batches:
            if b.num_rows and ids:
                yield _scored(names, q, b.column(0), matrix(b.column(1)), best, digits)

    return items.select(i_id, i_vec).mapInArrow(run, kind)


def _score_blocks(items: DataFrame, queries: DataFrame, q_id: str, q_vec: str, i_id: str, i_vec: str, best: int | None, kind: str, numbers: int | None = None, digits: int | None = None) -> DataFrame:
    """Scores of more queries than a worker holds: queries in blocks, which meet the items in blocks; each block pair is one sorted run of rows."""
    d = items.agg(F.max(F.size(i_vec))).first()[0] or 1
    numbers = numbers or MAX_QUERY_NUMBERS // 8
    blocks = lambda df: max(1, -(-df.count() * d // numbers))
    nq, ni = blocks(queries), blocks(items)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda df, c: F.lit(None).cast(dict(df.dtypes)[c])
    left = queries.select(place(q_id, nq).alias("i"), each(ni).alias("j"), F.lit(0).alias("side"), F.col(q_id).alias("q"), none(items, i_id).alias("item"), F.col(q_vec).cast("array<double>").alias("v"))
    right = items.select(each(nq).alias("i"), place(i_id, ni).alias("j"), F.lit(1).alias("side"), none(queries, q_id).alias("q"), F.col(i_id).alias("item"), F.col(i_vec).cast("array<double>").alias("v"))
    rows = left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j", "side")

    def run(batches):
        import pyarrow as pa

        now, names, q = None, [], []
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            for part in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1):
                if not len(part):
                    continue
                at, cut = tuple(key[part[0], :2]), b.slice(part[0], len(part))
                if at != now:
                    now, names, q = at, [], []
                if key[part[0], 2] == 0:
                    names.append(cut.column(3))
                    q.append(_unit_rows(matrix(cut.column(5))))
                elif q:
                    yield _scored(pa.concat_arrays(names), np.concatenate(q), cut.column(4), matrix(cut.column(5)), best, digits)

    return rows.mapInArrow(run, kind)


def cosine_scores(items: DataFrame, queries: DataFrame, q_id: str = "query_id", q_vec: str = "qvec", i_id: str = "item_id", i_vec: str = "embedding") -> DataFrame:
    """(query_id, item_id, score) of every query by every item; a zero vector scores 0.

    The queries, few by nature, are broadcast behind a check of their size, and items are scored in Arrow batches where they lie; more queries
    meet the items in blocks.
    """
    return _score_batches(items, queries, q_id, q_vec, i_id, i_vec, None)


def cosine_top(items: DataFrame, queries: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "qvec", i_id: str = "item_id", i_vec: str = "embedding", digits: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rnk): the k best items of each query, ties by item.  Batches leave only their own best to rank.

    digits: scores count on so many decimals, halves up, so that what differs by rounding alone is a tie.
    """
    near = _score_batches(items, queries, q_id, q_vec, i_id, i_vec, k, digits)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return near.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def prompt_ensemble(texts: DataFrame, templates: list[str], encode) -> DataFrame:
    """(query_id, qvec): the unit mean of a text's unit vectors under all templates.

    texts: query_id, query_text.  encode(df with column text) adds column vec.
    """
    rows = texts.select("query_id", F.explode(F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("query_text")) for t in templates])).alias("text"))
    unit = encode(rows).select("query_id", l2_normalise(F.col("vec")).alias("unit"))
    return group_centroids(unit, "query_id")


def standardised(rows: DataFrame, vec_col: str = "x", sample: bool = False, eps: float = 0.0) -> DataFrame:
    """rows with each number of the vector less its mean over its deviation, over all rows.

    sample: of the sample, else of the population; eps is added to it; a number that doesn't vary is divided by 1 where nothing is added.
    """
    spread = F.stddev_samp("col") if sample else F.stddev_pop("col")
    by_place = rows.select(F.posexplode(vec_col)).groupBy("pos").agg(F.avg("col").alias("m"), (F.coalesce(spread, F.lit(0.0)) + eps).alias("d"))
    # One row of as many numbers as a vector has.
    one = by_place.agg(F.sort_array(F.collect_list(F.struct("pos", "m", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d")))).alias("s"))
    one = stage(one.select(F.col("s.m").alias("mean_"), F.col("s.d").alias("dev_")), "scale")
    scaled = F.zip_with(F.zip_with(vec_col, "mean_", lambda a, b: a - b), "dev_", lambda a, b: a / b)
    return rows.crossJoin(F.broadcast(one)).withColumn(vec_col, scaled).drop("mean_", "dev_")


def assemble(blocks: DataFrame, names: list[str]) -> DataFrame:
    """(cell_id, feature): named blocks one after another, those that are missing left out.  blocks: cell_id, block, vec."""
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = blocks.filter(F.col("block").isin(names)).groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct(order[F.col("block")].alias("o"), "vec"))).alias("b"))
    return rows.select("cell_id", F.flatten(F.transform("b", lambda x: x["vec"])).alias("feature"))


def spec_table(spark, specs: dict[str, list[str]] | None = None) -> DataFrame:
    specs = variant_specs() if specs is None else specs
    return spark.createDataFrame([(s, i, b) for s, bs in specs.items() for i, b in enumerate(bs)], "spec string, ord int, block string")


def available_variants(specs: DataFrame, have: DataFrame) -> DataFrame:
    """(spec, n_blocks): variants all of whose blocks exist.  have: block."""
    rows = specs.join(have.select("block").distinct().withColumn("there", F.lit(1)), "block", "left")
    return rows.groupBy("spec").agg(F.count("*").alias("n_blocks"), F.count("there").alias("found")).filter("n_blocks = found").drop("found")


def choose_variant(variants: DataFrame, wanted: list[str]) -> str | None:
    """The first of the wanted variants that is available."""
    have = {r.spec for r in variants.filter(F.col("spec").isin(wanted)).collect()}
    return next((w for w in wanted if w in have), None)


def load_blocks(embeddings: DataFrame, edges: DataFrame, encoders: list[str], scales: list[str]) -> DataFrame:
    """(cell_id, block, vec): unit blocks of each encoder and scale there is, and the neighbour average of medium ones.

    embeddings: cell_id, encoder, scale, embedding, of a width of its own for each encoder.  Averages are of raw vectors and are normalised after.
    """
    from nichefold.operators.spatial import neighbour_average

    there = {r.encoder for r in embeddings.filter(F.col("scale") == "medium").select("encoder").distinct().collect()}  # a row an encoder
    rows = embeddings.filter(F.col("encoder").isin(encoders) & F.col("scale").isin(scales))
    plain = rows.select("cell_id", F.concat_ws("_", "encoder", "scale").alias("block"), l2_normalise(F.col("embedding")).alias("vec"))
    out = plain
    for e in (e for e in encoders if e in there):
        medium = embeddings.filter((F.col("encoder") == e) & (F.col("scale") == "medium"))
        avg = neighbour_average(medium, edges)
        out = out.unionByName(avg.select("cell_id", F.lit(f"{e}_medium_nbravg").alias("block"), l2_normalise(F.col("embedding")).alias("vec")))
    return out
