"""All ways to score queries, by name, over one candidate pool."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichefold.config import ENCODERS, LINEAGES, SCALES, Settings
from nichefold.operators import expression, heads, relevance, sampling, spatial, vectors
from nichefold.sources.stage import stage

#: A text encoder: rows with a column text gain a column vec.
TextEncoder = Callable[[DataFrame], DataFrame]


class Missing(LookupError):
    """A baseline lacks an input."""


@dataclass
class Inputs:
    """What baselines are made from; embeddings and text encoders may lack some.

    pool: cell_id, pool_idx, x, y, cell_type.  labels: makes of the pool one with scores, composition, state and niches, once a baseline reads them; without it the pool has
    them.  queries: query_id, query_text, target_field, target_label, gene.  embeddings: cell_id, encoder, scale, embedding, each encoder of its own width.  lognorm and stats: expression and genes.
    """

    pool: DataFrame
    queries: DataFrame
    lognorm: DataFrame
    stats: DataFrame
    markers: DataFrame
    state_genes: DataFrame
    settings: Settings
    embeddings: DataFrame | None = None
    text: dict[str, TextEncoder] = field(default_factory=dict)
    prompts: list[str] = field(default_factory=lambda: ["{}"])
    epochs: int = 400
    labels: Callable[[DataFrame], DataFrame] | None = None
    _kept: dict = field(default_factory=dict)

    def keep(self, key: str, make: Callable):
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    # ---- parts that several baselines share ----

    def labelled_pool(self) -> DataFrame:
        return self.pool if self.labels is None else self.keep("labels", lambda: stage(self.labels(self.pool), "labelled-pool"))

    def items(self, encoder: str, scale: str) -> DataFrame:
        if self.embeddings is None:
            raise Missing("no embeddings")
        rows = self.embeddings.filter((F.col("encoder") == encoder) & (F.col("scale") == scale))
        rows = rows.join(self.pool.select("cell_id", F.col("pool_idx").alias("item_id")), "cell_id").select("cell_id", "item_id", "embedding")
        if rows.isEmpty():
            raise Missing(f"no {encoder} embeddings at scale {scale}")
        return rows

    def text_vectors(self, encoder: str) -> DataFrame:
        if encoder not in self.text:
            raise Missing(f"no text encoder {encoder}")
        return self.keep(f"text {encoder}", lambda: stage(self.text[encoder](self.queries.select("query_id", F.col("query_text").alias("text"))).select("query_id", F.col("vec").alias("qvec")), "text"))

    def prompt_vectors(self, encoder: str) -> DataFrame:
        if encoder not in self.text:
            raise Missing(f"no text encoder {encoder}")
        return self.keep(f"prompt {encoder}", lambda: stage(vectors.prompt_ensemble(self.queries.select("query_id", "query_text"), self.prompts, self.text[encoder]), "prompts"))

    def edges(self) -> DataFrame:
        """Neighbours within the pool, always by rank."""
        return self.keep("edges", lambda: stage(spatial.knn_edges(self.pool.select("cell_id", "x", "y"), self.settings.k), "pool-edges"))

    def relevance(self) -> DataFrame:
        return self.keep("rel", lambda: stage(relevance.relevance(self.queries, self.labelled_pool(), self.lognorm, self.stats, self.settings.gene_quantile), "relevance"))

    def query_ids(self) -> list[str]:
        return self.keep("ids", lambda: [r.query_id for r in self.queries.select("query_id").orderBy("query_id").collect()])

    def labelled(self, features: DataFrame) -> DataFrame:
        """item_id, fold, x, y of the pool: features (item_id, x) with relevance in order of query and shuffled folds."""
        y = self.relevance().groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("query_id", F.col("rel").cast("double").alias("r")))).alias("q"))
        rows = features.join(y, "item_id").join(sampling.kfold(features, "item_id", seed=self.settings.seed), "item_id")
        return rows.select("item_id", "fold", "x", F.transform("q", lambda v: v["r"]).alias("y"))

    def fused(self) -> DataFrame:
        """(item_id, x): the richest set of blocks that is complete."""

        def make():
            if self.embeddings is None:
                raise Missing("no embeddings")
            mine = self.embeddings.join(self.pool.select("cell_id"), "cell_id", "left_semi")
            blocks = stage(vectors.load_blocks(mine, self.edges(), ENCODERS, SCALES), "blocks")
            variants = vectors.available_variants(vectors.spec_table(blocks.sparkSession), blocks)
            name = vectors.choose_variant(variants, ["cellseek_all", "cellseek_full"])
            if name is None:
                raise Missing("no complete set of feature blocks")
            from nichefold.config import variant_specs

            joined = vectors.assemble(blocks, variant_specs()[name]).join(self.pool.select("cell_id", F.col("pool_idx").alias("item_id")), "cell_id")
            return stage(joined.select("item_id", F.col("feature").alias("x")), "fused")

        return self.keep("fused", make)

    def fused_pool(self) -> DataFrame:
        return self.keep("fused pool", lambda: stage(self.labelled(self.fused()), "fused-pool"))


def _named(scores: DataFrame, ids: list[str]) -> DataFrame:
    names = F.array(*[F.lit(i) for i in ids])
    return scores.select(F.get(names, F.col("target")).alias("query_id"), "item_id", "score")


def zero_shot(i: Inputs, encoder: str, scale: str = "medium", prompts: bool = False) -> DataFrame:
    q = i.prompt_vectors(encoder) if prompts else i.text_vectors(encoder)
    return vectors.cosine_scores(i.items(encoder, scale), q)


def neighbourhood(i: Inputs, encoder: str = "biomedclip") -> DataFrame:
    """Cosine with the mean of a cell's and its neighbours' raw vectors."""
    items = i.items(encoder, "medium")
    mean = spatial.neighbour_average(items.select("cell_id", "embedding"), i.edges())
    return vectors.cosine_scores(mean.join(items.select("cell_id", "item_id"), "cell_id"), i.text_vectors(encoder))


def linear_probe(i: Inputs, encoder: str = "biomedclip") -> DataFrame:
    """Ridge on raw vectors with an intercept; queries without positives score 0."""
    feats = i.items(encoder, "medium").select("item_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return _named(heads.ridge_oof(i.labelled(feats), len(i.query_ids())), i.query_ids())


def fused_head(i: Inputs, head: str) -> DataFrame:
    options = {} if head == "logistic" else {"epochs": i.epochs}
    return heads.head_oof(i.fused_pool(), i.query_ids(), head, seed=i.settings.seed, **options)


def open_vocabulary(i: Inputs, encoder: str = "biomedclip") -> DataFrame:
    """Fused features mapped onto the text vectors of type names; cells of unknown type aren't learned from."""
    spark = i.pool.sparkSession
    q = {r.query_id: r.qvec for r in i.text_vectors(encoder).collect()}
    names = spark.createDataFrame([(t, t.replace("_", " ") + "s") for t in LINEAGES], "lineage string, text string")
    words = {r.lineage: np.array(r.vec) / max(np.linalg.norm(r.vec), 1e-8) for r in i.text[encoder](names).collect()}
    rows = i.fused_pool().join(i.pool.select(F.col("pool_idx").alias("item_id"), F.col("cell_type").alias("kind")), "item_id")
    ids = i.query_ids()
    return heads.openvocab_oof(rows, words, ids, np.array([q[k] for k in ids]), seed=i.settings.seed, epochs=i.epochs)


def predicted_expression(i: Inputs) -> DataFrame:
    """Expression regressed out of fold on fused features, then typed, placed and ranked like measured expression."""
    spark, s = i.pool.sparkSession, i.settings
    points = i.pool.select("cell_id", "pool_idx", "x", "y")
    mine = stage(i.lognorm.join(points.select("cell_id"), "cell_id", "left_semi"), "pool-lognorm")  # read for means, deviations and values
    stats = stage(expression.gene_stats(mine, points.agg(F.count("*").alias("n"))), "pool-stats")
    genes = [r.gene for r in stats.select("gene").orderBy("gene").collect()]
    z = expression.zscores(points, mine, stats).groupBy("cell_id").pivot("gene", genes).agg(F.first("z"))
    feats = i.fused()
    rows = vectors.standardised(feats).join(sampling.kfold(feats, "item_id", seed=s.seed), "item_id")
    rows = rows.join(z.join(points.select("cell_id", F.col("pool_idx").alias("item_id")), "cell_id"), "item_id")
    rows = rows.select("item_id", "fold", "x", F.array(*[F.col(str(g)) for g in genes]).alias("y"))
    guess = heads.ridge_oof(rows, len(genes), intercept=False, skip_empty=False)
    named = guess.join(points.select("cell_id", F.col("pool_idx").alias("item_id")), "item_id").select("cell_id", F.get(F.array(*[F.lit(g) for g in genes]), F.col("target")).alias("gene"), F.col("score").alias("v"))
    named = stage(named, "predicted")
    unit = stats.select("gene", F.lit(0.0).alias("mu"), F.lit(1.0).alias("sd"))  # predictions are z-scores already
    scores = expression.marker_scores(points, named, unit, i.markers)
    types = stage(expression.assign_types(scores, s.type_threshold, s.type_margin), "predicted-types")
    comp = spatial.composition(points, i.edges(), types)
    state = expression.proliferation(points, named, unit, i.state_genes, s.proliferation_quantile)
    pool = points.join(expression.wide_scores(scores, LINEAGES), "cell_id").join(comp, "cell_id").join(state, "cell_id")
    return relevance.transcript_scores(i.queries, pool, named, LINEAGES)


BASELINES: dict[str, Callable[[Inputs], DataFrame]] = {
    "random": lambda i: relevance.random_scores(i.queries, i.pool, i.settings.seed),
    "oracle": lambda i: relevance.transcript_scores(i.queries, i.labelled_pool(), i.lognorm, LINEAGES),
    "biomedclip": lambda i: zero_shot(i, "biomedclip"),
    "biomedclip_nbhd": lambda i: zero_shot(i, "biomedclip", "neighborhood"),
    "plip": lambda i: zero_shot(i, "plip"),
    "neighborhood": neighbourhood,
    "biomedclip_prompt": lambda i: zero_shot(i, "biomedclip", prompts=True),
    "plip_prompt": lambda i: zero_shot(i, "plip", prompts=True),
    "linear_probe": linear_probe,
    "cellseek": lambda i: fused_head(i, "logistic"),
    "cellseek_mlp": lambda i: fused_head(i, "mlp"),
    "openvocab": open_vocabulary,
    "predexpr": predicted_expression,
}


def run(inputs: Inputs, names: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(baseline, query_id, item_id, score) of the named baselines, and why others were left out."""
    done, skipped = [], {}
    for n in BASELINES if names is None else names:
        if n not in BASELINES:
            skipped[n] = "unknown baseline"
            continue
        try:
            scores = BASELINES[n](inputs)
        except Missing as e:
            skipped[n] = str(e)
            continue
        done.append(scores.select(F.lit(n).alias("baseline"), "query_id", F.col("item_id").cast("long").alias("item_id"), F.col("score").cast("double").alias("score")))
    if not done:
        raise ValueError(f"no baseline could run: {skipped}")
    return reduce(DataFrame.unionByName, done), skipped
