"""Named queries over the driver tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.config import LINEAGES, NICHES, PROMPTS, load_settings, results_dir
from nichefold.functions.exprs import half_up, stable_hash, stable_unit
from nichefold.functions.workers import ship, spread
from nichefold.operators import communities, encoders, expression, heads, imaging, metrics, neighbours, plots, relevance, sampling, spatial, stats, validation, vectors
from nichefold.plans import baselines, oracles
from nichefold.plans import fixtures as X
from nichefold.sources import cells as sources
from nichefold.sources import hdf5, tiff
from nichefold.sources.stage import put_file, scratch, stage
from nichefold.streaming.events import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def six(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles on so many decimals."""
    return df.select(*[half_up(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _typed(s: SparkSession, d: str) -> X.Labelled:
    return X.Labelled(s, d)


def _unpivot(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("d", "v")).select(key, (F.col("d") + 1).cast("long").alias("d"), "v")


def _times(vec, k: float):
    return F.transform(vec, lambda x: x * k)


# ---- expression ----


@query
def cell_qc_filter(s, d):
    totals = expression.library_totals(X.counts(s, d)).withColumnRenamed("total", "transcript_counts")
    cells = X.cells(s, d).join(totals, "cell_id").select("cell_id", "transcript_counts", F.abs("x").alias("cell_area"))
    return expression.qc_filter(cells, 1000, 100)


@query
def align_left_anti(s, d):
    return expression.unmatched_cells(X.cells(s, d), X.counts(s, d).filter("gene <= 3")).select("cell_id")


def _half_panel(s, d):
    rows = X.table(s, d, "part").filter("p_size < 40").select(F.substring("p_brand", 7, 9).cast("int").alias("gene"))
    return rows.filter("gene % 2 = 1")


@query
def panel_intersection(s, d):
    return expression.panel_markers(X.markers(s), _half_panel(s, d)).select("lineage", "gene")


@query
def panel_dropped(s, d):
    return expression.dropped_markers(X.markers(s), _half_panel(s, d)).select("lineage", "gene")


@query
def library_totals(s, d):
    return expression.library_totals(X.counts(s, d))


@query
def lognorm_expression(s, d):
    return six(expression.normalise(X.counts(s, d)))


@query
def gene_stats(s, d):
    return six(_typed(s, d).stats)


@query
def zscore_dense(s, d):
    t = _typed(s, d)
    return six(expression.zscores(t.cells, t.lognorm, t.stats))


@query
def marker_scores(s, d):
    return six(_typed(s, d).scores.select("cell_id", "lineage", "score"))


@query
def wide_scores(s, d):
    return six(expression.wide_scores(_typed(s, d).scores, LINEAGES))


@query
def cell_types(s, d):
    return six(_typed(s, d).types)


@query
def cell_type_counts(s, d):
    return expression.type_counts(_typed(s, d).types)


@query
def proliferation_flag(s, d):
    return six(_typed(s, d).state)


@query
def dataset_stats(s, d):
    t = _typed(s, d)
    totals = expression.library_totals(t.counts).withColumnRenamed("total", "transcript_counts")
    cells = t.all().join(totals, "cell_id")
    kept = stage(expression.qc_filter(cells, t.settings.min_counts, t.settings.min_area), "qc")
    return expression.dataset_stats(kept, t.cells, t.counts, t.settings.dataset, t.settings.sample)


# ---- space ----


@query
def knn_edges(s, d):
    return six(spatial.knn_edges(X.cells(s, d), X.SETTINGS.k))


@query
def knn_composition(s, d):
    t = _typed(s, d)
    return six(t.composition(t.types))


@query
def niche_labels(s, d):
    t = _typed(s, d)
    comp = t.composition(t.types)
    return spatial.niche_labels(comp, t.settings.niche).select("cell_id", *[f"niche_{n}" for n in NICHES], "niche_label")


@query
def radius_edges(s, d):
    return six(spatial.radius_edges(X.cells(s, d), X.SETTINGS.radius))


@query
def radius_composition(s, d):
    t = _typed(s, d)
    return six(spatial.radius_composition(t.cells, t.settings.radius, t.types))


@query
def neighbor_average(s, d):
    points = X.cells(s, d)
    edges = spatial.knn_edges(points, X.SETTINGS.k).filter("rnk <= 5")
    vecs = X.table(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), "embedding").join(points.select("cell_id"), "cell_id", "left_semi")
    return six(_unpivot(spatial.neighbour_average(vecs, edges), "cell_id", "embedding"))


@query
def grid_folds(s, d):
    return sampling.tile_folds(spatial.grid_tiles(X.cells(s, d), 500.0)).select("cell_id", "tile", "fold")


@query
def fold_sizes(s, d):
    return sampling.kfold(X.cells(s, d), "cell_id").groupBy("fold").agg(F.count("*").alias("n"))


@query
def buffer_exclusion(s, d):
    points = X.cells(s, d)
    return spatial.outside_buffer(points, sampling.kfold(points, "cell_id"), 0, 20.0).select("cell_id")


@query
def scale_pixels(s, d):
    return six(spatial.to_pixels(X.cells(s, d), 0.363788))


@query
def affine_pixels(s, d):
    path = _lines(s, "affine", [",".join(map(repr, r)) for r in oracles.AFFINE])
    return six(spatial.to_pixels_affine(X.cells(s, d), sources.read_affine(s, path)))


@query
def kmeans_regions(s, d):
    return spatial.kmeans_regions(X.cells(s, d), 5, 0)


# ---- sampling ----


@query
def stratified_pool(s, d):
    t = _typed(s, d)
    return sampling.build_pool(t.types, X.SMALL_POOL).select("cell_id", "cell_type", "pool_idx")


@query
def kfold_assign(s, d):
    return sampling.kfold(X.item_vectors(s, d), "item_id")


@query
def uniform_subset(s, d):
    return sampling.uniform_subset(X.cells(s, d), "cell_id", 50, 3).select("cell_id")


# ---- vectors ----


def _label_queries(s, d) -> tuple[DataFrame, DataFrame]:
    items = vectors.with_unit(X.item_vectors(s, d))
    return items, vectors.group_centroids(items, "label").withColumnRenamed("label", "query_id")


@query
def l2_normalize(s, d):
    return six(_unpivot(vectors.with_unit(X.item_vectors(s, d)), "item_id", "unit"))


@query
def cosine_scores(s, d):
    items, queries = _label_queries(s, d)
    return six(vectors.cosine_scores(items, queries))


@query
def cosine_topk(s, d):
    items, queries = _label_queries(s, d)
    return six(vectors.cosine_top(items, queries, 15))


@query
def feature_knn(s, d):
    """The nearest other vectors of each."""
    return six(neighbours.feature_knn(X.item_vectors(s, d), X.SETTINGS.k))


def _weights(s, d) -> DataFrame:
    near = stage(neighbours.feature_knn(X.item_vectors(s, d), X.SETTINGS.k - 1), "near")
    return communities.fuzzy_union(communities.memberships(near, X.SETTINGS.k))


@query
def neighbour_weights(s, d):
    """The fuzzy graph of nearest vectors: how much each pair belongs together."""
    return six(_weights(s, d))


@query
def graph_modularity(s, d):
    """How well labels cut the fuzzy graph of nearest vectors."""
    labels = X.item_vectors(s, d).select(F.col("item_id").alias("node"), F.col("label").alias("community"))
    return six(communities.modularity(stage(_weights(s, d), "weights"), labels, 0.5))


@query
def feature_communities(s, d):
    """Communities of the fuzzy graph of nearest vectors."""
    return communities.leiden(communities.whole_weights(_weights(s, d)), 1.0)


@query
def hash_text_features(s, d):
    rows = X.queries(s).select("query_id", F.explode(encoders.text_buckets(F.col("query_text"))).alias("bucket"))
    return rows.groupBy("query_id", "bucket").agg(F.count("*").alias("n"))


def _prompt_vectors(s) -> DataFrame:
    texts = X.queries(s).select("query_id", "query_text")
    return vectors.prompt_ensemble(texts, PROMPTS, lambda df: encoders.hash_text(df, oracles.TEXT_DIM))


@query
def prompt_ensemble(s, d):
    return six(_unpivot(_prompt_vectors(s), "query_id", "qvec").withColumn("d", F.col("d") - 1))


@query
def feature_variants(s, d):
    return vectors.available_variants(vectors.spec_table(s), s.createDataFrame([(b,) for b in oracles.HAVE], "block string"))


@query
def assemble_blocks(s, d):
    base = X.item_vectors(s, d).select(F.col("item_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    blocks = reduce(DataFrame.unionByName, [base.select("cell_id", F.lit(n).alias("block"), _times("v", k).alias("vec")) for k, n in ((3, "plip_medium"), (1, "biomedclip_medium"), (2, "biomedclip_neighborhood"))])
    out = vectors.assemble(blocks, ["biomedclip_medium", "biomedclip_neighborhood", "missing", "plip_medium"])
    at = lambda i: F.get("feature", F.lit(i))
    return six(out.select(F.col("cell_id").alias("item_id"), F.size("feature").alias("n"), at(0).alias("first"), at(64).alias("second"), at(191).alias("last")))


# ---- queries, relevance, scores ----


@query
def query_set(s, d):
    return sources.query_set(s)


@query
def query_set_counts(s, d):
    return sources.query_set(s).groupBy("task_type", "split").agg(F.count("*").alias("n"))


class _Bench:
    """The labelled cells, the pool, the queries and what is relevant to them."""

    def __init__(self, s, d):
        self.t = X.Labelled(s, d)
        self.labelled = self.t.all()
        self.pool = self.t.pool(self.labelled)
        self.queries = stage(X.queries(s), "queries")
        relevance.check_queries(self.queries)
        self.rel = relevance.relevance(self.queries, self.pool, self.t.lognorm, self.t.stats, self.t.settings.gene_quantile)

    def oracle(self):
        return relevance.transcript_scores(self.queries, self.pool, self.t.lognorm, LINEAGES)

    def random(self):
        return relevance.random_scores(self.queries, self.pool, self.t.settings.seed)

    def scores(self):
        return six(self.oracle().withColumn("baseline", F.lit("oracle"))).unionByName(six(self.random().withColumn("baseline", F.lit("random"))))

    def per_query(self):
        rows = metrics.evaluate(self.scores(), self.rel, self.t.settings.ks, self.t.settings.ndcg_k, ["baseline", "query_id"], metrics.pieces_for(self.pool.count()))
        return six(rows)

    def described(self):
        return self.per_query().join(F.broadcast(self.queries.select("query_id", "task_type", "split")), "query_id")


@query
def relevance_rows(s, d):
    return _Bench(s, d).rel


_queries["relevance"] = _queries.pop("relevance_rows")


@query
def oracle_scores(s, d):
    return six(_Bench(s, d).oracle())


@query
def random_scores(s, d):
    return six(_Bench(s, d).random())


# ---- metrics ----


def _vector_scores(s, d) -> tuple[DataFrame, DataFrame]:
    items, queries = _label_queries(s, d)
    cos = stage(six(vectors.cosine_scores(items, queries)), "cosines")
    noise = cos.select("query_id", "item_id", (stable_hash(F.col("item_id") * 64 + F.col("query_id")) / F.lit(2147483647.0)).alias("score"))
    scores = cos.withColumn("baseline", F.lit("biomedclip")).unionByName(six(noise).withColumn("baseline", F.lit("random")))
    rel = cos.select("query_id", "item_id").join(F.broadcast(items.select("item_id", "label")), "item_id").select("query_id", "item_id", (F.col("query_id") == F.col("label")).alias("rel"))
    return scores, rel


def _vector_metrics(s, d) -> DataFrame:
    scores, rel = _vector_scores(s, d)
    return six(metrics.evaluate(scores, rel, X.SETTINGS.ks, 10, ["baseline", "query_id"]))


@query
def rank_metrics(s, d):
    return _vector_metrics(s, d)


@query
def metrics_per_query(s, d):
    return _Bench(s, d).per_query()


@query
def metrics_main(s, d):
    return metrics.main_table(_Bench(s, d).described())


@query
def metrics_by_split(s, d):
    return six(metrics.macro(_Bench(s, d).described(), ["baseline", "split"]))


@query
def metrics_by_task(s, d):
    return six(metrics.macro(_Bench(s, d).described(), ["baseline", "task_type"]))


@query
def metrics_grouping_sets(s, d):
    return six(metrics.grouped_tables(_Bench(s, d).described()))


@query
def metrics_ablation(s, d):
    return metrics.ablation(_vector_metrics(s, d))


@query
def majority_vote(s, d):
    rows = _typed(s, d).types.withColumn("cluster", F.col("cell_id") % 12)
    return expression.majority(rows, "cluster", "cell_type")


@query
def agreement_matrix(s, d):
    t = _typed(s, d)
    types = t.types
    types = stage(types, "types")
    niches = spatial.niche_labels(t.composition(types), t.settings.niche)
    return six(expression.agreement(types.join(niches, "cell_id"), "cell_type", "niche_label"))


@query
def expression_r2(s, d):
    rows = expression.normalise(X.counts(s, d)).withColumn("guess", 0.5 * F.col("v") + 0.1)
    return six(metrics.r_squared(rows, "v", "guess", "gene"))


# ---- statistics ----


def _ap(s, d) -> DataFrame:
    return stage(_vector_metrics(s, d).select("baseline", "query_id", F.col("mAP").alias("value")), "precision")


@query
def bootstrap_ci(s, d):
    return six(stats.bootstrap_ci(_ap(s, d), ["baseline"], oracles.BOOT), 11)


@query
def paired_bootstrap(s, d):
    out = stats.paired_bootstrap(_ap(s, d), "baseline", "biomedclip", rounds=oracles.BOOT)
    return six(out.withColumn("sig", stats.stars(F.col("p_value"))), 11)


@query
def significance_table(s, d):
    """Three methods: vectors as the reference method, noise, and a ceiling a little above the first."""
    per = stage(_vector_metrics(s, d), "metrics")
    top = per.filter("baseline = 'biomedclip'")
    columns = ["mAP", "nDCG@10", "enrich@10"]
    ceiling = top.select(F.lit("oracle").alias("baseline"), "query_id", *[(F.col(f"`{c}`") + 0.125).alias(c) for c in columns])
    named = per.select(F.when(F.col("baseline") == "biomedclip", "cellseek").otherwise(F.col("baseline")).alias("baseline"), "query_id", *[F.col(f"`{c}`") for c in columns])
    return stats.significance_table(stage(named.unionByName(ceiling), "methods"), columns, oracles.BOOT).drop("baseline", "ord")


@query
def latex_lines(s, d):
    """The significance table as the lines of a LaTeX table."""
    text = stats.latex_table(significance_table(s, d), ["mAP", "enrich@10"], oracles.BOOT, "Fused features (ours)")
    return s.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, tex string")


# ---- heads ----


@query
def ridge_oof_2d(s, d):
    items = X.item_vectors(s, d)
    rows = items.join(sampling.kfold(items, "item_id"), "item_id")
    xy = rows.select("item_id", "fold", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("x"), F.array((F.col("label") == 3).cast("double")).alias("y"))
    return six(heads.ridge_oof(xy, 1).select("item_id", "score"))


#: Names of the ten labels as queries.
TEN = [str(i) for i in range(10)]


def _labelled_vectors(s, d) -> DataFrame:
    items = X.item_vectors(s, d)
    rows = items.join(sampling.kfold(items, "item_id"), "item_id")
    return rows.select("item_id", "label", "fold", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.array(*[(F.col("label") == i).cast("double") for i in range(10)]).alias("y"))


@query
def ridge_oof(s, d):
    return six(heads.ridge_oof(_labelled_vectors(s, d), 10))


@query
def logistic_oof(s, d):
    return six(heads.head_oof(_labelled_vectors(s, d), TEN))


@query
def mlp_oof(s, d):
    return six(heads.head_oof(_labelled_vectors(s, d), TEN, "mlp"))


@query
def openvocab_oof(s, d):
    rng = np.random.default_rng(0)
    words = {str(i): v / np.linalg.norm(v) for i, v in enumerate(rng.standard_normal((8, 32)))}  # labels 8 and 9 are unknown
    rows = _labelled_vectors(s, d).withColumn("kind", F.col("label").cast("string"))
    return six(heads.openvocab_oof(rows, words, list(words), np.stack(list(words.values()))))


@query
def transfer_scores(s, d):
    rows = _labelled_vectors(s, d)
    return six(heads.transfer(rows.filter("item_id % 2 = 0"), rows.filter("item_id % 2 = 1"), TEN))


def _plane(s, d) -> DataFrame:
    """Vectors' first two numbers, ten times as large, and whether a label is low or even."""
    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double") * 10)
    y = F.array((F.col("label") < 3).cast("double"), (F.col("label") % 2 == 0).cast("double"))
    return X.item_vectors(s, d).select("item_id", x.alias("x"), y.alias("y"))


@query
def logistic_oof_2d(s, d):
    rows = _plane(s, d)
    return six(heads.head_oof(rows.join(sampling.kfold(rows, "item_id"), "item_id"), ["low", "even"]))


@query
def transfer_2d(s, d):
    rows = _plane(s, d)
    return six(heads.transfer(rows.filter("item_id % 2 = 0"), rows.filter("item_id % 2 = 1"), ["low", "even"]))


@query
def mlp_oof_2d(s, d):
    """Three hidden units, no dropout, and so few steps that engines' last digits don't drift apart; mlp_oof takes all."""
    rows = _plane(s, d)
    return six(heads.head_oof(rows.join(sampling.kfold(rows, "item_id"), "item_id"), ["low", "even"], "mlp", hidden=3, epochs=oracles.STEPS, dropout=0.0))


@query
def mlp_dropout_2d(s, d):
    """The same with dropout, whose draws any engine repeats."""
    rows = _plane(s, d)
    return six(heads.head_oof(rows.join(sampling.kfold(rows, "item_id"), "item_id"), ["low", "even"], "mlp", hidden=3, epochs=oracles.STEPS))


@query
def openvocab_oof_2d(s, d):
    """So few steps that engines' last digits don't drift apart; openvocab_oof takes all."""
    rows = _plane(s, d).drop("y").join(X.item_vectors(s, d).select("item_id", F.col("label").cast("string").alias("kind")), "item_id")
    words = {str(i): v for i, v in enumerate(oracles.WORDS)}  # labels 8 and 9 are unknown
    return six(heads.openvocab_oof(rows.join(sampling.kfold(rows, "item_id"), "item_id"), words, list(words), oracles.WORDS, epochs=oracles.STEPS))


def _schemes(s, d) -> dict[str, tuple[DataFrame, float | None]]:
    """Folds and buffers of the spatial schemes that need no clustering, over cells that have vectors."""
    points = X.cells(s, d).join(X.item_vectors(s, d).select(F.col("item_id").alias("cell_id")), "cell_id", "left_semi")
    tiles = lambda w: sampling.tile_folds(spatial.grid_tiles(points, w)).select("cell_id", "fold")
    return {
        "random": (sampling.kfold(points, "cell_id"), None),
        "grid500": (tiles(500.0), None),
        "grid500_buffer": (tiles(500.0), 150.0),
        "grid1000_buffer": (tiles(1000.0), 150.0),
    }


def _by_scheme(s, d, base: DataFrame, names: list[str], schemes: dict) -> DataFrame:
    """(scheme, query_id, item_id, score) of the logistic head; rows within a scheme's buffer of a fold aren't learned from for it."""
    points, out = X.cells(s, d), []
    for name, (folds, buffer) in schemes.items():
        folds = stage(folds, "folds")
        rows = base.join(folds.withColumnRenamed("cell_id", "item_id"), "item_id")
        if buffer is not None:
            rows = rows.join(spatial.buffered_folds(points, folds, buffer).withColumnRenamed("cell_id", "item_id"), "item_id", "left")
            rows = rows.withColumn("skip", F.coalesce("skip", F.array().cast("array<int>")))
        out.append(heads.head_oof(stage(rows, "scheme"), names).withColumn("scheme", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


@query
def scheme_scores_2d(s, d):
    """Held-out scores by fold scheme, with and without buffers."""
    return six(_by_scheme(s, d, _plane(s, d), ["low", "even"], _schemes(s, d)))


@query
def scheme_report_2d(s, d):
    """Mean enrichment by fold scheme, overall and by kind of query."""
    base = _plane(s, d)
    scores = six(_by_scheme(s, d, base, ["low", "even"], _schemes(s, d)))
    names = F.array(F.lit("low"), F.lit("even"))
    rel = base.select("item_id", F.posexplode("y").alias("q", "v")).select(F.get(names, F.col("q")).alias("query_id"), "item_id", (F.col("v") > 0).alias("rel"))
    per = six(metrics.evaluate(scores, rel, X.SETTINGS.ks, X.SETTINGS.ndcg_k, ["scheme", "query_id"]))
    task = F.when(F.col("query_id") == "low", "cell_type").otherwise("niche")
    return six(metrics.by_scheme_and_task(per.withColumn("task_type", task), ["cell_type", "niche", "gene_marker", "cell_state"]))


def _inputs(s, d) -> baselines.Inputs:
    """The fixture's pool for all baselines: cells that have vectors, drawn by type, with labels once they are read; encoders are the vectors themselves, reversed, negated and squared."""
    t = _typed(s, d)
    queries = stage(X.queries(s), "queries")
    relevance.check_queries(queries)
    vec = X.table(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    cells = t.typed(t.cells.join(vec.select("cell_id"), "cell_id", "left_semi"))
    pool = stage(sampling.build_pool(cells, X.SETTINGS.pool_size), "vector-pool")
    labels = lambda p: p.select("cell_id", "pool_idx").join(t.all(), "cell_id")
    kinds = {("biomedclip", "medium"): F.col("v"), ("biomedclip", "neighborhood"): F.reverse("v"), ("plip", "medium"): F.transform("v", lambda x: -x), ("plip", "neighborhood"): F.transform("v", lambda x: x * x)}
    emb = reduce(DataFrame.unionByName, [vec.select("cell_id", F.lit(e).alias("encoder"), F.lit(k).alias("scale"), c.alias("embedding")) for (e, k), c in kinds.items()])
    text = {"biomedclip": lambda df: encoders.hash_text(df, X.DIM), "plip": lambda df: encoders.hash_text(df, X.DIM, seed=1)}
    return baselines.Inputs(pool, queries, t.lognorm, t.stats, X.markers(s), X.state_genes(s), X.SETTINGS, emb, text, PROMPTS, labels=labels)


@query
def predicted_expression(s, d):
    return six(baselines.predicted_expression(_inputs(s, d)))


@query
def zero_shot_scores(s, d):
    """The six baselines that need no learning from images, by the dispatcher."""
    names = ["biomedclip", "biomedclip_nbhd", "plip", "neighborhood", "biomedclip_prompt", "plip_prompt"]
    return six(baselines.run(_inputs(s, d), names)[0])


@query
def mixed_blocks(s, d):
    """Unit blocks and neighbour averages of encoders of different widths, one after another."""
    points = X.cells(s, d).join(X.item_vectors(s, d).select(F.col("item_id").alias("cell_id")), "cell_id", "left_semi")
    base = X.item_vectors(s, d).select(F.col("item_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).join(points.select("cell_id"), "cell_id", "left_semi")
    wide = F.concat("v", F.transform("v", lambda x: x * x))
    kinds = {("plip", "medium"): F.slice("v", 1, 3), ("uni2", "medium"): wide, ("plip", "neighborhood"): F.slice("v", 4, 3)}
    emb = reduce(DataFrame.unionByName, [base.select("cell_id", F.lit(e).alias("encoder"), F.lit(k).alias("scale"), c.alias("embedding")) for (e, k), c in kinds.items()])
    blocks = vectors.load_blocks(emb, spatial.knn_edges(points, 3), ["plip", "uni2", "conch"], ["medium", "neighborhood"])
    out = vectors.assemble(stage(blocks, "blocks"), ["plip_medium", "plip_neighborhood", "plip_medium_nbravg", "uni2_medium", "uni2_medium_nbravg"])
    return six(_unpivot(out, "cell_id", "feature"))


@query
def baseline_scores(s, d):
    """All thirteen baselines over one pool."""
    return six(baselines.run(_inputs(s, d))[0])


@query
def baseline_metrics(s, d):
    """The benchmark's main table: all baselines, best first."""
    i = _inputs(s, d)
    scores = stage(baselines.run(i)[0], "scores")
    return metrics.main_table(metrics.evaluate(scores, i.relevance(), X.SETTINGS.ks, X.SETTINGS.ndcg_k, ["baseline", "query_id"]))


@query
def label_validation(s, d):
    t = _typed(s, d)
    genes = [r.gene for r in t.stats.select("gene").orderBy("gene").collect()]
    z = stage(expression.wide_zscores(t.cells, t.lognorm, t.stats, genes, 10.0), "zscores")  # read by the components and by projecting on them
    points = stage(validation.wide_components(z, genes, 10), "components")  # read in each of the rounds
    found = validation.clusters(points, 8)
    return six(validation.cluster_agreement(t.types, found))


@query
def component_spectrum(s, d):
    """What the cells' components hold of the variance of their z-scores, all of it, and how it is spread: the sum of the variances' squares."""
    t = _typed(s, d)
    points, _ = validation.sparse_components(t.cells, t.lognorm, t.stats, 30)
    per = points.select(F.posexplode("features").alias("c", "v")).groupBy("c").agg(F.var_pop("v").alias("var"))
    return six(per.agg(F.count("*").alias("n_components"), F.sum("var").alias("total"), F.sum(F.col("var") * F.col("var")).alias("squared")))


@query
def label_purity(s, d):
    """How well types agree with given clusters: purity and normalised mutual information."""
    types = stage(_typed(s, d).types, "types")
    found = types.select("cell_id", (F.floor(F.col("cell_type_score") * 4) + F.col("cell_id") % 2).alias("cluster"))
    table = validation.cluster_agreement(types, found)
    return six(validation.purity(table).crossJoin(validation.mutual_information(types.join(found, "cell_id"), "cell_type", "cluster")))


@query
def spatial_cv_report(s, d):
    """Mean enrichment of the logistic head by fold scheme: random, regions, tiles, and tiles with a buffer."""
    base = _labelled_vectors(s, d).drop("fold", "label")
    points = X.cells(s, d).join(base.select(F.col("item_id").alias("cell_id")), "cell_id", "left_semi")
    schemes = _schemes(s, d) | {"kmeans": (spatial.kmeans_regions(points, 5, 0), None)}
    scores = _by_scheme(s, d, base, TEN, schemes)
    rel = base.select("item_id", F.posexplode("y").alias("q", "v")).select(F.col("q").cast("string").alias("query_id"), "item_id", (F.col("v") > 0).alias("rel"))
    per = metrics.evaluate(scores, rel, X.SETTINGS.ks, 10, ["scheme", "query_id"])
    task = F.when(F.col("query_id").cast("int") % 2 == 0, "cell_type").otherwise("niche")
    return six(metrics.by_scheme_and_task(per.withColumn("task_type", task), ["cell_type", "niche", "gene_marker", "cell_state"]))


# ---- sources ----


@query
def csc_counts(s, d):
    """The count matrix packed a row a cell and scanned back, gene features only."""
    packed = X.counts(s, d).groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene", "cnt"))).alias("z"))
    matrix = packed.select("cell_id", F.transform("z", lambda x: x["gene"]).alias("indices"), F.transform("z", lambda x: x["cnt"]).alias("data"))
    features = s.createDataFrame([(g, f"brand{g}", "Gene Expression" if g <= 22 else "Control") for g in range(1, 26)], "idx int, name string, feature_type string")
    return sources.csc_to_counts(matrix, features)


@query
def hdf5_counts(s, d):
    """The count matrix as HDF5 files by columns, some thousand cells each, in chunks, and scanned back, gene features only."""
    rows = X.counts(s, d).filter("cell_id % 3 = 0").select(F.concat(F.lit("cell"), "cell_id").alias("cell_id"), "gene", "cnt")
    names = [(g, f"brand{g}", "Gene Expression" if g <= 22 else "Control") for g in range(26)]
    files = stage(hdf5.pack(rows, names, X.cells(s, d).filter("cell_id % 3 = 0").count()), "matrix")
    return sources.csc_to_counts(*hdf5.matrices(files.select("content")))


@query
def pixel_size(s, d):
    number = (F.col("event_id") % 7) / 8.0 + 0.125
    xml = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('<Pixels PhysicalSizeX="'), number.cast("string"), F.lit('" />'))).when(F.col("event_id") % 3 == 1, F.lit("<Pixels />"))
    return X.table(s, d, "events").select("event_id", sources.pixel_size(xml).alias("um"))


@query
def event_windows(s, d):
    return windowed_counts(X.table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


def _lines(s, name: str, lines: list[str]) -> str:
    """A small text file in the shared folder."""
    path = scratch(s, name)
    s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def _cells_csv(s, d) -> DataFrame:
    """The cells written as compressed CSV and scanned back; their ids are strings then."""
    path = scratch(s, "cells-csv")
    cells = X.cells(s, d).select("cell_id", F.col("x").alias("x_centroid"), F.col("y").alias("y_centroid"), F.lit(7.0).alias("transcript_counts"), F.abs("x").alias("cell_area"), F.lit("a,b").alias("region"))
    cells.write.option("header", True).option("compression", "gzip").csv(path)
    return sources.read_cells(s, path, "region string")


@query
def cells_csv(s, d):
    return six(_cells_csv(s, d))


@query
def string_id_folds(s, d):
    """Folds and neighbours of cells whose ids are strings, as scanned."""
    cells = _cells_csv(s, d).select("cell_id", F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y"))
    nearest = spatial.knn_edges(cells, 2).filter("rnk = 1").select("cell_id", "nbr_id")
    return sampling.kfold(cells, "cell_id").join(nearest, "cell_id")


@query
def string_id_pool(s, d):
    """A drawn pool of cells whose ids are strings."""
    cells = _cells_csv(s, d).withColumn("cell_type", F.when(F.col("x_centroid") > 5000, "far").otherwise("near"))
    return sampling.build_pool(cells, 300).select("cell_id", "cell_type", "pool_idx")


@query
def boundaries_csv(s, d):
    """Polygons written as CSV and scanned back: vertices and extent of each."""
    path = scratch(s, "boundaries")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(0, 0), (4, 0), (0, 2)])]))
    rows = X.cells(s, d).withColumn("c", corner).select("cell_id", (F.col("x") + F.col("c.a")).alias("vertex_x"), (F.col("y") + F.col("c.b")).alias("vertex_y"))
    rows.write.option("header", True).csv(path)
    back = sources.read_boundaries(s, path)
    return six(back.groupBy("cell_id").agg(F.count("*").alias("n"), F.min("vertex_x").alias("x0"), F.max("vertex_y").alias("y1")))


@query
def queries_csv(s, d):
    path = scratch(s, "queries-csv")
    sources.write_report(sources.query_set(s), path)
    return sources.read_queries(s, path)


@query
def processed_tables(s, d):
    """Cells, expression and genes written and loaded: how many rows each has, and what they add up to."""
    path = scratch(s, "processed")
    counts = X.counts(s, d)
    sources.save_processed(X.cells(s, d), counts.withColumnRenamed("cnt", "v"), counts.select("gene").distinct(), path)
    cells, expr, genes = sources.load_processed(s, path)
    part = lambda df, name, c: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(c).cast("double").alias("total"))
    return six(part(cells, "cells", "y").unionByName(part(expr, "expression", "v")).unionByName(part(genes, "genes", "gene")))


@query
def stored_scores(s, d):
    """Scores written a folder a method and read back, all methods that lie there."""
    path = scratch(s, "scores")
    sources.write_scores(_vector_scores(s, d)[0], path)
    return sources.read_scores(s, path).select("baseline", "query_id", "item_id", "score")


@query
def stored_embeddings(s, d):
    """One encoder's vectors at one scale, out of four written."""
    path = scratch(s, "embeddings")
    base = X.item_vectors(s, d).select(F.col("item_id").alias("cell_id"), "embedding")
    every = [base.select("cell_id", F.lit(e).alias("encoder"), F.lit(k).alias("scale"), _times(F.transform("embedding", lambda x: x.cast("double")), float(m)).alias("embedding")) for m, (e, k) in enumerate([("plip", "medium"), ("plip", "neighborhood"), ("uni2", "medium"), ("uni2", "small")], 1)]
    sources.write_embeddings(reduce(DataFrame.unionByName, every), path)
    one = sources.read_embeddings(s, path, "uni2", "medium")
    none = sources.read_embeddings(s, path, "conch", "medium")
    return six(_unpivot(one.unionByName(none), "cell_id", "embedding"))


@query
def rounded_report(s, d):
    """A report written with four decimals, halves to even, and read back."""
    path = scratch(s, "report")
    rows = X.table(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 % 100003) / 32768.0).alias("value"))
    sources.write_report(rows, path)
    return s.read.schema("o_orderkey long, value double").option("header", True).csv(path)


@query
def pyramid_levels(s, d):
    """The asked level of each image, clamped to the last there is."""
    level = lambda i: F.struct((F.lit(4096) / 2**i).cast("int").alias("h"), (F.lit(8192) / 2**i).cast("int").alias("w"))
    images = X.table(s, d, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("asked"), F.slice(F.array(*[level(i) for i in range(5)]), 1, (F.col("event_id") % 5 + 1).cast("int")).alias("levels"))
    return images.select("event_id", sources.pyramid_level(F.col("levels"), F.col("asked")).alias("l")).select("event_id", "l.h", "l.w")


@query
def chosen_variant(s, d):
    have = s.createDataFrame([(b,) for b in oracles.HAVE], "block string")
    found = vectors.available_variants(vectors.spec_table(s), have)
    wanted = [["cellseek_all", "cellseek_full"], ["cellseek_all4", "cellseek_full"], ["conch_full"]]
    return s.createDataFrame([(i, vectors.choose_variant(found, w)) for i, w in enumerate(wanted)], "i int, spec string")


@query
def settings_table(s, d):
    """A configuration file's settings, defaults where it says nothing."""
    text = "dataset: {name: tissue, sample: s1, results_dir: out}\nseed: 3\npreprocess: {min_transcript_counts: 12}\nneighborhood: {k: 7, use: radius, niche_thresholds: {vascular: 0.2}}\ncandidate_pool: {size: 9, stratify: false}\nretrieval: {topk: [1, 2]}\n"
    path = _lines(s, "settings", text.rstrip().split("\n"))
    got = load_settings(text="\n".join(r.value for r in s.read.text(path).collect()))
    rows = [(f, str(getattr(got, f))) for f in ("dataset", "sample", "seed", "min_counts", "k", "use", "radius", "pool_size", "stratify", "ks", "ndcg_k", "type_margin")]
    rows += [("vascular", str(got.niche["vascular"])), ("bcell_rich", str(got.niche["bcell_rich"])), ("tables", results_dir(got, "tables").rsplit("/", 2)[-2] + "/tables")]
    return s.createDataFrame(rows, "field string, value string")


@query
def fetched_file(s, d):
    """A file fetched once, and left alone the second time."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as at:  # the driver's own; nothing else reads it
        (Path(at) / "there").write_bytes(b"x" * 5000)
        took = [sources.fetch((Path(at) / "there").as_uri(), f"{at}/new/copy") for _ in range(2)]
        return s.createDataFrame([(i, t, (Path(at) / "new/copy").stat().st_size, (Path(at) / "new/copy.part").exists()) for i, t in enumerate(took)], "i int, fetched boolean, size long, part_left boolean")


@query
def encoder_registry(s, d):
    """What each name stands for: the encoder, whether it reads text, whether its vectors are of unit length."""
    rows = []
    for name in sorted(encoders.REGISTRY):
        e = encoders.get_encoder(name.upper())
        rows.append((name, getattr(e, "name", "hash"), getattr(e, "has_text", True), e.normalised))
    return s.createDataFrame(rows, "name string, encoder string, has_text boolean, unit boolean")


# ---- images ----


def _patches(s, d, side: int = 8) -> DataFrame:
    """Patches of deterministic bytes."""
    n = side * side * 3
    byte = lambda i: (stable_unit(F.col("cell_id") * 3 + i % 7, 5) * (40 + (i * 29) % 200)).cast("int")
    hexes = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.lpad(F.hex(byte(i)), 2, "0"))
    return spread(X.cells(s, d), "cell_id").select("cell_id", F.lit(side).alias("h"), F.lit(side).alias("w"), F.unhex(F.array_join(hexes, "")).alias("px"))


def _sums(patches: DataFrame) -> DataFrame:
    """(cell_id, h, w, total, weighted): sums of a patch's bytes, plain and by place."""
    ship(patches.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            total, weighted = [], []
            for v in b.column(3):  # one patch at a time is held as numbers
                p = np.frombuffer(v.as_buffer(), np.uint8).astype(np.int64)
                total.append(int(p.sum()))
                weighted.append(int((p * (np.arange(len(p)) % 97)).sum()))
            yield pa.record_batch([*b.columns[:3], pa.array(total, pa.int64()), pa.array(weighted, pa.int64())], names=["cell_id", "h", "w", "total", "weighted"])

    return patches.select("cell_id", "h", "w", "px").mapInArrow(run, f"cell_id {dict(patches.dtypes)['cell_id']}, h int, w int, total long, weighted long")


@query
def patch_embeddings(s, d):
    return encoders.encode_patches(_patches(s, d), "hash", "medium", dim=32)


@query
def patch_statistics(s, d):
    """The statistics that the hash encoder projects, by place."""
    vec = encoders.encode_patches(_patches(s, d), "hash", "medium", numbers="double", dim=encoders.SIDES, plain=True)
    return six(_unpivot(vec.withColumn("embedding", F.slice("embedding", 1, encoders.STATS)), "cell_id", "embedding"), 3)


@query
def stain_density(s, d):
    rows = X.table(s, d, "orders").select(((F.col("o_orderkey") * 31) % 256).alias("a"), ((F.col("o_orderkey") * 17) % 256).alias("b"))
    r, g = imaging.density(F.col("a")), imaging.density(F.col("b"))
    return six(rows.agg(F.avg(r).alias("r"), F.avg(g).alias("g"), F.covar_samp(r, g).alias("rg")))


@query
def stain_normalised(s, d):
    patches = _patches(s, d)
    source = imaging.stain_profile(imaging.pixel_rows(patches.filter("cell_id % 2 = 0")))
    target = imaging.stain_profile(imaging.pixel_rows(patches.filter("cell_id % 2 = 1")))
    return imaging.normalise_stain(patches, source, target).select("cell_id", F.md5("px").alias("digest"))


@query
def stain_profile(s, d):
    """The stain vectors of all patches and their strongest concentrations."""
    he, top = imaging.stain_profile(imaging.pixel_rows(_patches(s, d)))
    return six(s.createDataFrame([(i, *map(float, he[:, i]), float(top[i])) for i in range(2)], "stain int, r double, g double, b double, top double"))


@query
def stain_applied(s, d):
    """Patches turned from one given profile to another."""
    return _sums(imaging.normalise_stain(_patches(s, d), oracles.STAIN_SOURCE, oracles.STAIN_TARGET)).select("cell_id", "total", "weighted")


@query
def pixel_sample(s, d):
    """Sums over the pixels of a uniform sample of patches."""
    rows = imaging.pixel_rows(_patches(s, d), 40, 5)
    return rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])


def _tiles(s) -> DataFrame:
    tiles = s.range(16).select((F.col("id") % 4).cast("int").alias("tx"), F.floor(F.col("id") / 4).cast("int").alias("ty"))
    hexes = F.transform(F.sequence(F.lit(0), F.lit(64 * 64 * 3 - 1)), lambda i: F.lpad(F.hex((i + F.col("tx") * 7 + F.col("ty") * 13) % 251), 2, "0"))
    return tiles.select("tx", "ty", F.lit(64).alias("h"), F.lit(64).alias("w"), F.unhex(F.array_join(hexes, "")).alias("px"))


def _centres(s, d) -> DataFrame:
    return X.cells(s, d).select("cell_id", ((F.col("cell_id") * 37) % 260).cast("double").alias("px"), ((F.col("cell_id") * 53) % 260).cast("double").alias("py"))


@query
def patch_crops(s, d):
    return _sums(imaging.extract_patches(_tiles(s), _centres(s, d), 64, 32))


@query
def resized_crops(s, d):
    return _sums(imaging.extract_patches(_tiles(s), _centres(s, d), 64, 32, 16))


# ---- slides ----


def _slides(s) -> str:
    """Two small pyramids: one compressed with differences, one as it is with 64-bit offsets, and a file that is none."""
    folder = scratch(s, "slides")
    for name, (h, w), options in (("a.tif", (96, 80), {"predictor": 2}), ("b.tif", (70, 64), {"compression": 1, "big": True})):
        y, x, c = np.ogrid[:h, :w, :3]
        images = [((y * 3 + x * 5 + c * 7) % 251).astype(np.uint8), ((y * 7 + x * 11 + c) % 251)[: h // 2, : w // 2].astype(np.uint8)]
        xml = '<OME><Pixels PhysicalSizeX="0.25" /></OME>' if name == "a.tif" else ""
        put_file(s, f"{folder}/{name}", tiff.write_tiff(images, 32, xml, **options))
    put_file(s, f"{folder}/c.tif", b"no image at all, but long enough")
    return folder


def _file(path: str = "path"):
    return F.substring_index(path, "/", -1).alias("file")


@query
def tiff_levels(s, d):
    return tiff.read_levels(s, _slides(s)).select(_file(), "level", "h", "w", "um", (F.col("status") == "ok").alias("ok"))


@query
def tiff_tiles(s, d):
    """The tiles of a pyramid's smaller level, asked for beyond the last there is."""
    tiles = tiff.read_tiles(s, _slides(s), 5).withColumn("file", _file())
    return _sums(tiles.withColumn("cell_id", F.format_string("%s %d %d %d", "file", "level", "ty", "tx"))).withColumnRenamed("cell_id", "tile")


# ---- plots ----


@query
def celltype_map(s, d):
    t = _typed(s, d)
    return six(plots.celltype_map(t.cells.join(t.types, "cell_id")))


@query
def niche_map(s, d):
    t = _typed(s, d)
    niches = spatial.niche_labels(t.composition(t.types), t.settings.niche)
    return six(plots.niche_map(t.cells.join(niches, "cell_id"), "tcell_rich"))


def _ranked_vectors(s, d) -> tuple[DataFrame, DataFrame]:
    scores, rel = _vector_scores(s, d)
    return scores.filter("baseline = 'biomedclip'").drop("baseline"), rel


@query
def query_heatmap(s, d):
    scores, rel = _ranked_vectors(s, d)
    return six(plots.query_heatmap(X.cells(s, d).withColumnRenamed("cell_id", "item_id"), scores, rel, 20))


@query
def retrieval_examples(s, d):
    return plots.retrieval_examples(*_ranked_vectors(s, d), 16)


@query
def feature_scaling(s, d):
    """Vectors standardised by the population's deviation, and by the sample's with a little added."""
    rows = X.item_vectors(s, d).select("item_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    kinds = {"population": vectors.standardised(rows), "sample": vectors.standardised(rows, sample=True, eps=1e-6)}
    return six(reduce(DataFrame.unionByName, [_unpivot(df, "item_id", "x").withColumn("kind", F.lit(k)) for k, df in kinds.items()]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 34 queries ranked over the pool by transcripts and at random, with every metric."""
    return _Bench(spark, sf_dir).described()


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in _queries}
