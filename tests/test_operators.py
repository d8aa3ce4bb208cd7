"""Operators on hand-made tables, against numbers worked out by hand or in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichefold import config
from nichefold.functions.exprs import half_even, stable_hash
from nichefold.operators import encoders, expression, heads, imaging, metrics, relevance, sampling, spatial, stats, vectors
from nichefold.functions.quantiles import exact_quantiles
from nichefold.sources import cells as sources


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


# ---- metrics ----


def ranking(spark, scores, rel, q="q0"):
    s = spark.createDataFrame([(q, i, float(v)) for i, v in enumerate(scores)], "query_id string, item_id long, score double")
    r = spark.createDataFrame([(q, i, bool(v)) for i, v in enumerate(rel)], "query_id string, item_id long, rel boolean")
    return s, r


def test_metrics_golden(spark):
    m = metrics.evaluate(*ranking(spark, [9, 8, 7, 6, 5, 4], [1, 0, 1, 0, 0, 1]), ks=[5], ndcg_k=5).first()
    assert m["mAP"] == pytest.approx(0.7222222222)
    assert m["MRR"] == 1
    assert m["P@5"] == pytest.approx(0.4)
    assert m["R@5"] == pytest.approx(0.6666666667)
    assert m["enrich@5"] == pytest.approx(0.8)
    assert m["nDCG@5"] == pytest.approx(0.7039180890)


def test_metrics_nothing_relevant_is_zero_and_stays(spark):
    s, r = ranking(spark, [3, 2, 1], [0, 0, 0])
    m = metrics.evaluate(s, r, ks=[1, 2]).first()
    assert {m[c] for c in m.asDict() if c != "query_id"} == {0}
    per = metrics.evaluate(s, r, ks=[1]).withColumn("baseline", F.lit("x"))
    assert metrics.macro(per, ["baseline"], ["mAP"]).first()["mAP"] == 0


def test_precision_divides_by_k(spark):
    m = metrics.evaluate(*ranking(spark, [2, 1], [1, 1]), ks=[5]).first()
    assert m["P@5"] == pytest.approx(0.4)
    assert m["R@5"] == 1


def test_ties_by_item_and_nan_last(spark):
    s, r = ranking(spark, [1.0, float("nan"), 1.0], [0, 1, 1])
    got = [(x.item_id, x.rk) for x in metrics.ranked(s, r, ["query_id"]).orderBy("rk").collect()]
    assert got == [(0, 1), (2, 2), (1, 3)]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.random(200), 2), rng.random(200) < 0.1
    order = np.argsort(-s, kind="stable")
    rel = y[order].astype(float)
    cum = np.cumsum(rel)
    ap = (rel * cum / np.arange(1, 201)).sum() / rel.sum()
    disc = 1 / np.log2(np.arange(2, 12))
    ndcg = (rel[:10] * disc).sum() / disc[: int(min(10, rel.sum()))].sum()
    m = metrics.evaluate(*ranking(spark, s.tolist(), y.tolist()), ks=[10]).first()
    assert m["mAP"] == pytest.approx(ap)
    assert m["nDCG@10"] == pytest.approx(ndcg)
    assert m["MRR"] == pytest.approx(1 / (np.flatnonzero(rel)[0] + 1))


def test_rankings_in_pieces_are_the_same(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.random(500), 2)
    v[::50] = np.nan
    s, r = ranking(spark, v.tolist(), (rng.random(500) < 0.2).tolist())
    assert rows(metrics.ranked(s, r, ["query_id"], 8), "rk") == rows(metrics.ranked(s, r, ["query_id"]), "rk")


def test_half_even_matches_numpy(spark):
    v = [0.00005, 0.00015, 0.00025, 1.23455, -0.00005, 0.12345]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(half_even(F.col("v"))).collect()]
    assert got == np.round(v, 4).tolist()


# ---- expression ----

COUNTS = [(0, 1, 2.0), (0, 3, 2.0), (2, 1, 1.0), (2, 2, 3.0), (2, 3, 4.0)]


def expr(spark):
    counts = spark.createDataFrame(COUNTS, "cell_id long, gene int, cnt double")
    cells = spark.range(3).withColumnRenamed("id", "cell_id")
    return cells, counts, expression.normalise(counts)


def test_normalise_and_zscore(spark):
    cells, _, ln = expr(spark)
    got = {(r.cell_id, r.gene): r.v for r in ln.collect()}
    assert got[0, 1] == pytest.approx(1.386294, abs=1e-6)
    assert got[2, 2] == pytest.approx(1.178655, abs=1e-6)
    st = expression.gene_stats(ln, cells.agg(F.count("*").alias("n")))
    z = {(r.cell_id, r.gene): r.z for r in expression.zscores(cells, ln, st).collect()}
    assert z[0, 1] == pytest.approx(1.295404, abs=1e-6)
    assert z[1, 3] == pytest.approx(-1.414214, abs=1e-6)
    markers = spark.createDataFrame([(0, "A", 1), (0, "A", 3), (1, "B", 99)], "lineage_ord int, lineage string, gene int")
    sc = {(r.cell_id, r.lineage): r.score for r in expression.marker_scores(cells, ln, st, markers).collect()}
    assert sc[1, "A"] == pytest.approx((z[1, 1] + z[1, 3]) / 2)
    assert sc[0, "B"] == 0  # no marker on the panel


def test_constant_gene_has_z_zero(spark):
    cells = spark.range(2).withColumnRenamed("id", "cell_id")
    ln = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0)], "cell_id long, gene int, v double")
    st = expression.gene_stats(ln, cells.agg(F.count("*").alias("n")))
    assert [r.z for r in expression.zscores(cells, ln, st).collect()] == [0, 0]


@pytest.mark.parametrize(("top", "second", "label"), [(0.50, 0.41, "unknown"), (-0.01, -0.5, "unknown"), (0.5, 0.375, "A"), (0.0, -1.0, "unknown")])
def test_typing(spark, top, second, label):
    s = spark.createDataFrame([(1, 0, "A", top), (1, 1, "B", second), (1, 2, "C", -9.0)], "cell_id long, lineage_ord int, lineage string, score double")
    r = expression.assign_types(s).first()
    assert (r.cell_type, r.cell_type_score) == (label, top)
    assert r.cell_type_margin == pytest.approx(top - second)


def test_no_state_marker_flags_all(spark):
    cells, _, ln = expr(spark)
    st = expression.gene_stats(ln, cells.agg(F.count("*").alias("n")))
    out = expression.proliferation(cells, ln, st, spark.createDataFrame([(77,)], "gene int"))
    assert [r.is_proliferating for r in out.collect()] == [True] * 3


def test_qc_area_zero_means_no_filter_and_align_is_strict(spark):
    cells = spark.createDataFrame([(0, 10.0, None), (1, 9.0, 5.0), (2, 99.0, 1.0)], "cell_id long, transcript_counts double, cell_area double")
    assert [r.cell_id for r in expression.qc_filter(cells, 10, 0.0).orderBy("cell_id").collect()] == [0, 2]
    assert [r.cell_id for r in expression.qc_filter(cells, 10, 1.0).collect()] == [2]
    _, counts, _ = expr(spark)
    with pytest.raises(Exception, match="no matrix row"):
        expression.align(cells, counts).collect()
    assert expression.align(cells, counts, strict=False).count() == 5


@pytest.mark.parametrize("few", [1, 5, 100_000])
def test_exact_quantiles(spark, few):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0, 1, 200), np.full(60, 0.25), rng.exponential(1e6, 40), [-np.inf, 1e300]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    finite = df.filter("v > double('-infinity') AND v < 1e200")
    qs = [0.0, 0.01, 0.5, 0.9, 0.975, 1.0]
    w = v[np.isfinite(v) & (v < 1e200)]
    assert exact_quantiles(finite, "v", qs, few) == pytest.approx(np.quantile(w, qs).tolist())
    assert exact_quantiles(df.limit(0), "v", [0.5], few) == [None]
    assert exact_quantiles(spark.createDataFrame([(3.0,)] * 9, "v double"), "v", [0.5, 1.0], few) == [3.0, 3.0]


# ---- space ----


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double")


@pytest.mark.parametrize("n", [1, 2, 10, 300])
def test_knn_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    xy = np.vstack([rng.normal(0, 1, (n - n // 10, 2)), rng.normal(500, 0.01, (n // 10, 2))])
    k = 15
    got = {}
    for r in spatial.knn_edges(points(spark, xy), k).collect():
        got.setdefault(r.cell_id, []).append((r.rnk, r.nbr_id))
    for i in range(n):
        d2 = ((xy - xy[i]) ** 2).sum(1)
        want = [j for j in sorted(range(n), key=lambda j: (d2[j], j)) if j != i][:k]
        assert [j for _, j in sorted(got.get(i, []))] == want


def test_knn_of_equal_points(spark):
    got = rows(spatial.knn_edges(points(spark, [(1, 1)] * 5), 2), "cell_id", "rnk")
    assert [r[1] for r in got] == [1, 2, 0, 2, 0, 1, 0, 1, 0, 1]


def test_far_clusters_make_no_hot_square(spark, monkeypatch):
    """Two dense clusters far apart, an outlier, and many points at one place: few pairs a point, the neighbours as by brute force."""
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.normal(0, 5, (1500, 2)), rng.normal(1e6, 5, (1500, 2)), [[5e5, 3.0]], np.full((1000, 2), 7.0)])
    pairs = []
    real = spatial._pairs
    monkeypatch.setattr(spatial, "_pairs", lambda *x: pairs.append(real(*x).count()) or real(*x))
    got = {}
    for r in spatial.knn_edges(points(spark, xy), 4).collect():
        got.setdefault(r.cell_id, []).append((r.rnk, r.nbr_id))
    assert sum(pairs) < 300 * len(xy)  # in squares by mean density, 1,500 a point and more
    for i in range(0, len(xy), 50):
        d2 = ((xy - xy[i]) ** 2).sum(1)
        want = [j for j in sorted(range(len(xy)), key=lambda j: (d2[j], j)) if j != i][:4]
        assert [j for _, j in sorted(got[i])] == want


def test_radius_is_inclusive_and_empty_is_zero(spark):
    p = points(spark, [(0, 0), (3, 4), (100, 100)])
    e = spatial.radius_edges(p, 5.0)
    assert rows(e.select("cell_id", "nbr_id")) == [(0, 1), (1, 0)]
    types = spark.createDataFrame([(0, "T_cell"), (1, "unknown"), (2, "T_cell")], "cell_id long, cell_type string")
    c = {r.cell_id: r for r in spatial.composition(p, e, types).collect()}
    assert c[1].frac_T_cell == 1
    assert c[0].frac_T_cell == 0  # an unknown neighbour counts below the line
    assert sum(c[2][f"frac_{t}"] for t in config.LINEAGES) == 0


def test_crowded_squares_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(11)
    p = points(spark, np.vstack([rng.normal(0, 1, (120, 2)), rng.random((40, 2)) * 60]))
    plain = rows(spatial.radius_edges(p, 2.5))
    monkeypatch.setattr(spatial, "SPAN", 7)
    monkeypatch.setattr(spatial, "SLOTS", 3)
    assert rows(spatial.radius_edges(p, 2.5)) == plain


def test_nearest_neighbours_shuffle_no_pairs(spark):
    """Ranks and counts are worked out where pairs are found, also of many points at one place and of rows that share an id; composition is as by the edges."""
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.random((200, 2)) * 30, np.full((50, 2), 7.0), [(500, 500)]])
    p = points(spark, xy)
    plans, kept = [], []

    def store(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        kept.append(df.localCheckpoint())
        return kept[-1]

    edges = spatial.knn_edges(p, 4, store)
    ranked = next(t for t in plans if "SortMergeJoin [gx" in t)
    assert "Exchange" not in ranked[: ranked.index("SortMergeJoin [gx")]
    types = p.select("cell_id", F.when(F.col("cell_id") % 3 == 0, "T_cell").when(F.col("cell_id") % 3 == 1, "unknown").otherwise("B_cell").alias("cell_type")).filter("cell_id % 7 <> 0")
    assert rows(spatial.knn_composition(p, 4, types)) == rows(spatial.composition(p, edges, types))
    twice = p.union(p.select("cell_id", F.col("x") + 0.5, F.col("y") + 0.25).filter("cell_id < 3"))
    got = rows(spatial.knn_edges(twice, 4).filter("cell_id < 3"), "cell_id", "rnk")
    assert [tuple(r)[-1] for r in got] == [1, 2, 3, 4] * 3


def test_composition_within_a_radius_shuffles_no_pairs(spark):
    """As by the edges, with unknown and untyped neighbours and points without any; what is shuffled after the pairs is counts."""
    rng = np.random.default_rng(4)
    p = points(spark, np.vstack([rng.random((300, 2)) * 30, [(500, 500)]]))
    types = p.select("cell_id", F.when(F.col("cell_id") % 3 == 0, "T_cell").when(F.col("cell_id") % 3 == 1, "unknown").otherwise("B_cell").alias("cell_type")).filter("cell_id % 7 <> 0")
    got = spatial.radius_composition(p, 6.0, types)
    assert rows(got) == rows(spatial.composition(p, spatial.radius_edges(p, 6.0), types))
    text = got._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("SortMergeJoin [gx")]
    assert "partial_count" in above
    assert "nbr_id" not in above.split("partial_count")[0]


def test_niche_precedence(spark):
    n = {"Epithelial": 4, "T_cell": 3, "Endothelial": 2, "Fibroblast": 1}
    comp = spark.createDataFrame([(0, *(n.get(t, 0) / 15 for t in config.LINEAGES))], "cell_id long, " + ", ".join(f"frac_{t} double" for t in config.LINEAGES))
    r = spatial.niche_labels(comp, config.Settings().niche).first()
    assert r.niche_tumor_immune_interface
    assert r.niche_vascular
    assert r.niche_tcell_rich
    assert r.niche_label == "tumor_immune_interface"


def test_neighbour_average_includes_self(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 2.0])], "cell_id long, embedding array<double>")
    e = spark.createDataFrame([(0, 1)], "cell_id long, nbr_id long")
    assert rows(spatial.neighbour_average(v, e), "cell_id") == [(0, [2.0, 1.0]), (1, [3.0, 2.0])]


def test_affine_inverse(spark):
    m = [[2.0, 0.0, 5.0], [0.0, 4.0, -1.0], [0.0, 0.0, 1.0]]
    p = points(spark, [(1, 2)])
    a = spatial.to_pixels_affine(p, m).first()
    back = spatial.to_pixels_affine(points(spark, [(a.px, a.py)]), m, invert=True).first()
    assert (back.px, back.py) == pytest.approx((1, 2))


def test_buffer_and_tiles(spark):
    p = points(spark, [(0, 0), (10, 0), (200, 0), (700, 600)])
    folds = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "cell_id long, fold int")
    assert [r.cell_id for r in spatial.outside_buffer(p, folds, 0, 10.0).orderBy("cell_id").collect()] == [2, 3]
    assert [r.tile for r in spatial.grid_tiles(p, 500.0).orderBy("cell_id").collect()] == [0, 0, 0, 3]


# ---- sampling ----


def test_pool_quota(spark):
    cells = spark.range(100).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 97, "a").when(F.col("id") < 99, "b").otherwise("c").alias("cell_type"))
    pool = sampling.build_pool(cells, 25)
    n = {r.cell_type: r["count"] for r in pool.groupBy("cell_type").count().collect()}
    assert n == {"a": 24, "b": 1, "c": 1}  # 24.25, 0.5 to even but at least 1, 0.25 but at least 1
    assert [r.pool_idx for r in pool.orderBy("cell_id").collect()] == list(range(26))
    assert sampling.build_pool(cells, 100).count() == 100
    assert sampling.build_pool(cells, 7, None).count() == 7


def test_pool_meets_quotas_whatever_the_hashes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "stable_hash", lambda x, seed=0: F.lit(2147483000) + x % 7)  # all late
    cells = spark.range(5000).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("cell_type"))
    n = {r.cell_type: r["count"] for r in sampling.build_pool(cells, 100).groupBy("cell_type").count().collect()}
    assert n == {"a": 80, "b": 20}


def test_string_ids_from_scan_to_metrics(spark, tmp_path):
    rng = np.random.default_rng(3)
    lines = [f"cell-{i:03d},{rng.random() * 40:.3f},{rng.random() * 40:.3f},50,9" for i in range(60)]
    (tmp_path / "cells.csv").write_text("cell_id,x_centroid,y_centroid,transcript_counts,cell_area\n" + "\n".join(lines) + "\n")
    cells = expression.qc_filter(sources.read_cells(spark, str(tmp_path / "cells.csv")), 10, 1.0).select("cell_id", F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y"))
    counts = cells.select("cell_id", F.explode(F.array(F.lit("CD3D"), F.lit("MS4A1"), F.lit("LYZ"))).alias("gene")).withColumn("cnt", (F.pmod(F.xxhash64("cell_id", "gene"), F.lit(9)) + 1).cast("double"))
    ln = expression.normalise(counts)
    st = expression.gene_stats(ln, cells.agg(F.count("*").alias("n")))
    scores = expression.marker_scores(cells, ln, st, sources.marker_table(spark))
    types = expression.assign_types(scores, 0.0, 0.0)
    edges = spatial.knn_edges(cells, 5)
    assert dict(edges.dtypes)["nbr_id"] == "string"
    niches = spatial.niche_labels(spatial.composition(cells, edges, types), config.Settings().niche)
    state = expression.proliferation(cells, ln, st, spark.createDataFrame([("MKI67",)], "gene string"))
    pool = sampling.build_pool(cells.join(types, "cell_id").join(niches, "cell_id").join(state, "cell_id").join(expression.wide_scores(scores, config.LINEAGES), "cell_id"), 40)
    assert 38 <= pool.count() <= 43
    folds = sampling.kfold(pool, "cell_id")
    assert max(r["count"] for r in folds.groupBy("fold").count().collect()) <= 9
    assert spatial.outside_buffer(cells, folds, 0, 2.0).count() < 40
    queries = sources.query_set(spark).withColumn("gene", F.when(F.col("target_field") == "gene", F.col("target_label")))
    rel = relevance.relevance(queries, pool, ln, st)
    per = metrics.evaluate(relevance.transcript_scores(queries, pool, ln, config.LINEAGES), rel, (1, 5), 10)
    assert per.count() == 34
    vecs = cells.select("cell_id", F.array(F.col("x"), F.col("y")).alias("embedding"))
    assert spatial.neighbour_average(vecs, edges).count() == 60
    x = pool.select(F.col("cell_id").alias("item_id"), F.array("score_T_cell", "score_B_cell").alias("x"), F.array((F.col("cell_type") == "T_cell").cast("double")).alias("y"))
    out = heads.head_oof(x.join(folds.withColumnRenamed("cell_id", "item_id"), "item_id"), ["t"])
    assert dict(out.dtypes)["item_id"] == "string"
    assert out.count() == pool.count()


def test_folds_are_balanced_and_stable(spark):
    items = spark.range(103).withColumnRenamed("id", "item_id")
    a, b = sampling.kfold(items, "item_id"), sampling.kfold(items.repartition(7), "item_id")
    assert sorted(r["count"] for r in a.groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]
    assert rows(a) == rows(b)


def test_bootstrap_indices(spark):
    ix = sampling.bootstrap_indices(spark, 50, 34)
    assert ix.count() == 1700
    assert ix.agg(F.min("i"), F.max("i")).first()[:] == (0, 33)


def test_stable_hash_in_python(spark):
    def h(x, seed):
        n = x + 1 + seed * 1000003
        a = n * 48271 % 2147483647
        return (a * a % 2147483647 + n) * 69621 % 2147483647

    got = [r[0] for r in spark.range(50).select(stable_hash(F.col("id"), 3)).collect()]
    assert got == [h(x, 3) for x in range(50)]


# ---- vectors ----


def test_cosine_zero_vector_and_batches(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8))
    x[7] = 0
    q = rng.standard_normal((3, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, qvec array<double>")
    want = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)).T
    got = {(r.query_id, r.item_id): r.score for r in vectors.cosine_scores(items, queries).collect()}
    assert got["q1", 7] == 0
    assert all(got[f"q{i}", j] == pytest.approx(want[i, j]) for i in range(3) for j in range(500))
    top = vectors.cosine_top(items, queries, 15)
    for i in range(3):
        assert [r.item_id for r in top.filter(f"query_id = 'q{i}'").orderBy("rnk").collect()] == sorted(range(500), key=lambda j: (-want[i, j], j))[:15]
    assert vectors.cosine_top(items.limit(4), queries, 15).count() == 12


def test_variants_and_blocks(spark):
    have = spark.createDataFrame([(b,) for b in config.variant_specs()["cellseek_full"]], "block string")
    names = {r.spec for r in vectors.available_variants(vectors.spec_table(spark), have).collect()}
    assert names == {"bmc_medium", "bmc_multiscale", "bmc_full", "plip_full", "both_no_context", "cellseek_full"}
    assert vectors.choose_variant(vectors.available_variants(vectors.spec_table(spark), have), ["cellseek_all", "cellseek_full"]) == "cellseek_full"
    emb = spark.createDataFrame([(0, "plip", "medium", [3.0, 4.0]), (1, "plip", "medium", [0.0, 0.0])], "cell_id long, encoder string, scale string, embedding array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "cell_id long, nbr_id long")
    b = {(r.cell_id, r.block): r.vec for r in vectors.load_blocks(emb, edges, ["plip", "uni2"], ["medium"]).collect()}
    assert b[0, "plip_medium"] == pytest.approx([0.6, 0.8])
    assert b[1, "plip_medium"] == [0, 0]
    assert b[1, "plip_medium_nbravg"] == pytest.approx([0.6, 0.8])


def test_more_queries_than_a_worker_holds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((90, 4)))], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(rng.standard_normal((40, 4)))], "query_id string, qvec array<double>")
    whole, best = rows(vectors.cosine_scores(items, queries)), rows(vectors.cosine_top(items, queries, 6))
    monkeypatch.setattr(vectors, "MAX_QUERY_NUMBERS", 100)
    again = rows(vectors.cosine_scores(items, queries))
    assert [r[:2] for r in again] == [r[:2] for r in whole]
    assert [r[2] for r in again] == pytest.approx([r[2] for r in whole])
    assert [(r[0], r[1], r[3]) for r in rows(vectors.cosine_top(items, queries, 6))] == [(r[0], r[1], r[3]) for r in best]


def test_centroids(spark):
    rng = np.random.default_rng(9)
    x, g = rng.standard_normal((300, 5)), rng.integers(0, 4, 300)
    df = spark.createDataFrame([(f"g{k}", v.tolist()) for k, v in zip(g, x, strict=True)], "k string, unit array<double>").repartition(6)
    got = {r.k: r.qvec for r in vectors.group_centroids(df, "k").collect()}
    for k in range(4):
        m = x[g == k].mean(axis=0)
        assert got[f"g{k}"] == pytest.approx((m / np.linalg.norm(m)).tolist())


# ---- relevance ----


def test_gene_cut_floor_and_quantile(spark):
    pool = spark.range(100).withColumnRenamed("id", "cell_id")
    ln = spark.createDataFrame([(i, 1, float(i)) for i in range(1, 6)] + [(i, 2, float(i + 1)) for i in range(100)], "cell_id long, gene int, v double")
    cuts = {r.gene: r.cut for r in relevance.gene_cuts(pool, ln, spark.createDataFrame([(1,), (2,), (3,)], "gene int")).collect()}
    assert cuts[1] == 1e-9
    assert cuts[2] == pytest.approx(np.quantile(np.arange(1, 101), 0.9))
    assert cuts[3] == 1e-9


def test_unknown_field_is_refused(spark):
    q = spark.createDataFrame([("q0", "colour", "red")], "query_id string, target_field string, target_label string")
    with pytest.raises(ValueError, match="resolve"):
        relevance.check_queries(q)


def test_query_set(spark):
    q = sources.query_set(spark)
    assert q.count() == 34
    assert q.filter("level = 'neighborhood'").count() == 10
    assert [r.query_id for r in q.orderBy("query_id").collect()][-1] == "q033"


# ---- statistics ----


def test_stars(spark):
    p = spark.createDataFrame([(0.0009,), (0.001,), (0.01,), (0.05,)], "p double")
    assert [r[0] for r in p.select(stats.stars(F.col("p"))).collect()] == ["***", "**", "*", "ns"]


def test_bootstrap_and_nan(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(m, f"q{i:02d}", float(x)) for m in ("a", "b") for i, x in enumerate(rng.random(34) + (m == "a"))], "baseline string, query_id string, value double")
    ci = {r.baseline: r for r in stats.bootstrap_ci(v, ["baseline"], 500).collect()}
    assert ci["a"].lo < ci["a"].mean < ci["a"].hi
    p = stats.paired_bootstrap(v, "baseline", "a", rounds=500).first()
    assert p["diff"] > 0
    assert p.p_value == 0
    part = v.filter("baseline = 'a' OR query_id <> 'q00'").withColumnRenamed("value", "m")
    means = {r.baseline: r.mean for r in stats.bootstrap_ci(stats.aligned(part, "baseline", "m"), ["baseline"], 50).collect()}
    assert math.isnan(means["b"])


def test_significance_and_latex(spark):
    per = spark.createDataFrame([(m, f"q{i}", s + i / 100) for m, s in (("cellseek", 0.8), ("random", 0.1), ("oracle", 0.9), ("other", 0.5)) for i in range(9)], "baseline string, query_id string, mAP double")
    t = stats.significance_table(per, ["mAP"], 200)
    got = {r.baseline: r.asDict() for r in t.collect()}
    assert list(got) == ["random", "cellseek", "oracle"]
    assert got["random"]["mAP_sig"] == "***"
    assert got["oracle"]["mAP_sig"] is None
    assert r"\textsuperscript{***}" in stats.latex_table(t, ["mAP"], 200, config.METHODS["cellseek"])


# ---- heads ----


def pool_rows(spark, n=120, d=5, q=3, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((n, d)), (rng.random((n, q)) < 0.3).astype(float)
    y[:, 0] = x[:, 0] > 0.5
    fold = np.arange(n) % 4
    df = spark.createDataFrame([(i, int(fold[i]), x[i].tolist(), y[i].tolist()) for i in range(n)], "item_id long, fold int, x array<double>, y array<double>")
    return df, x, y, fold


@pytest.mark.parametrize("intercept", [True, False])
def test_ridge_against_closed_form(spark, intercept):
    df, x, y, fold = pool_rows(spark)
    got = {(r.item_id, r.target): r.score for r in heads.ridge_oof(df, 3, intercept=intercept).collect()}
    for f in range(4):
        tr, te = fold != f, np.flatnonzero(fold == f)
        mx, my = (x[tr].mean(0), y[tr].mean(0)) if intercept else (0, 0)
        w = np.linalg.solve((x[tr] - mx).T @ (x[tr] - mx) + np.eye(5), (x[tr] - mx).T @ (y[tr] - my))
        want = (x[te] - mx) @ w + my
        assert all(got[i, t] == pytest.approx(want[k, t]) for k, i in enumerate(te) for t in range(3))


def gradient(x, y, theta, decay=1e-3):
    """Of the weighted, regularised loss of one query among several, by the definition."""
    z = np.hstack([x, np.ones((len(x), 1))])
    beta = theta.reshape(z.shape[1], y.shape[1])
    w = np.where(y > 0, heads.pos_weight(len(y), y.sum(axis=0)), 1) / y.size
    return z.T @ (w * (1 / (1 + np.exp(-z @ beta)) - y)) + 2 * decay * beta


def test_logistic_is_at_its_minimum(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((80, 4)), (rng.random((80, 3)) < 0.2).astype(float)
    assert np.abs(gradient(x, y, heads.fit(heads.Logistic(4, 3), x, y))).max() < 1e-14
    monkeypatch.setattr(heads, "NARROW", 0)
    assert np.abs(gradient(x, y, heads.fit(heads.Logistic(4, 3), x, y))).max() < 1e-7


@pytest.mark.parametrize("model", [heads.Logistic(3, 2), heads.Mlp(3, 2, hidden=4), heads.OpenVocab(3, 2, vectors=np.eye(2))])
def test_gradients_by_differences(model):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((20, 3)), (rng.random((20, 2)) < 0.4).astype(float)
    if isinstance(model, heads.OpenVocab):
        y = y + 0.1
    size = {heads.Logistic: 8, heads.Mlp: 3 * 4 + 4 + 4 * 2 + 2, heads.OpenVocab: 8}[type(model)]
    theta = rng.standard_normal(size)
    pw = heads.pos_weight(20, y.sum(axis=0))

    class Still:
        """Keeps every unit, so that the loss is smooth."""

        @staticmethod
        def random(shape):
            return np.ones(shape)

    def loss(t):
        if isinstance(model, heads.Logistic):
            return model.sums(t, x, y, 20, pw, Still)[0]
        if isinstance(model, heads.Mlp):
            w1, b1, w2, b2 = model.parts(t)
            m = np.maximum(x @ w1 + b1, 0) / 0.9 @ w2 + b2
            return float((np.logaddexp(0, m) * (1 - y + pw * y) - pw * y * m).sum() / y.size)
        w = t.reshape(4, 2)
        p = x @ w[:-1] + w[-1]
        return float(-((p / np.linalg.norm(p, axis=1, keepdims=True)) * y).sum() / 20)

    grad = model.sums(theta, x, y, 20, pw, Still)[1]
    for i in range(size):
        e = np.zeros(size)
        e[i] = 1e-6
        assert grad[i] == pytest.approx((loss(theta + e) - loss(theta - e)) / 2e-6, abs=1e-6)


def test_pos_weight_is_clamped():
    assert heads.pos_weight(3, np.array([3.0, 0.0])).tolist() == [1.0, 1000.0]


@pytest.mark.parametrize("head", ["logistic", "mlp"])
def test_heads_rank_what_they_learn(spark, head):
    df, x, y, _ = pool_rows(spark)
    out = heads.head_oof(df, ["a", "b", "c"], head, **({"epochs": 80, "hidden": 16} if head == "mlp" else {}))
    assert out.count() == 360
    s = np.array([r.score for r in out.filter("query_id = 'a'").orderBy("item_id").collect()])
    assert s[y[:, 0] > 0].mean() > s[y[:, 0] == 0].mean() + 1


def test_logistic_out_of_fold_by_hand(spark):
    """Standardised by training rows, learned without held-out and skipped rows."""
    df, x, y, fold = pool_rows(spark)
    skip = F.when(F.col("item_id") < 10, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    got = {(r.query_id, r.item_id): r.score for r in heads.head_oof(df.withColumn("skip", skip), ["a", "b", "c"]).collect()}
    for f in range(4):
        use = (fold != f) & ~((np.arange(120) < 10) & (f in (1, 2)))
        t = x[use].copy()
        mu, sd = heads.standardise(t)
        beta = heads.fit(heads.Logistic(5, 3), t, y[use]).reshape(6, 3)
        assert np.abs(gradient(t, y[use], beta)).max() < 1e-13
        want = (x - mu) / sd @ beta[:-1] + beta[-1]
        assert all(got[q, i] == pytest.approx(want[i, j]) for i in np.flatnonzero(fold == f) for j, q in enumerate("abc"))


@pytest.mark.parametrize("head", ["logistic", "mlp", "openvocab"])
def test_gradients_summed_over_the_cluster(spark, monkeypatch, head):
    """More rows than a worker holds: the same minimum, and heads that learn."""
    df, x, y, _ = pool_rows(spark, n=80, d=3)
    options = {"logistic": {"rounds": 60}, "mlp": {"epochs": 25, "hidden": 8}, "openvocab": {"epochs": 25, "vectors": np.eye(3)}}[head]
    here = {(r.query_id, r.item_id): r.score for r in heads.head_oof(df, ["a", "b", "c"], head, **options).collect()}
    monkeypatch.setattr(heads, "WORKER_NUMBERS", 10)
    there = {(r.query_id, r.item_id): r.score for r in heads.head_oof(df.repartition(3), ["a", "b", "c"], head, **options).collect()}
    assert here.keys() == there.keys()
    if head == "mlp":  # other units are dropped
        s = np.array([there["a", i] for i in range(80)])
        assert s[y[:, 0] > 0].mean() > s[y[:, 0] == 0].mean() + 0.3
    else:
        assert all(there[k] == pytest.approx(v, abs=1e-4) for k, v in here.items())


def test_transfer_and_openvocab(spark):
    df, x, y, _ = pool_rows(spark)
    out = heads.transfer(df, df.filter("item_id < 7"), ["a", "b", "c"])
    assert out.count() == 21
    words = {"t": np.array([1.0, 0.0]), "u": np.array([0.0, 1.0])}
    kinds = ["t" if v > 0 else "u" if v > -1 else "unknown" for v in x[:, 0]]
    rows_ = df.join(spark.createDataFrame(list(enumerate(kinds)), "item_id long, kind string"), "item_id")
    s = heads.openvocab_oof(rows_, words, ["t", "u"], np.eye(2), epochs=60)
    t = np.array([r.score for r in s.filter("query_id = 't'").orderBy("item_id").collect()])
    assert t[x[:, 0] > 0.5].mean() > t[x[:, 0] < -0.5].mean()


@pytest.mark.parametrize("dim", [3072, 7680])
def test_heads_at_full_width(spark, dim):
    """Six blocks of 512 numbers, and those with three of 1,536: few rows, so that the dual form tells the same."""
    rng = np.random.default_rng(dim)
    n, q = 30, 2
    x, y, fold = rng.standard_normal((n, dim)), (rng.random((n, q)) < 0.4).astype(float), np.arange(n) % 2
    df = spark.createDataFrame([(i, int(fold[i]), x[i].tolist(), y[i].tolist()) for i in range(n)], "item_id long, fold int, x array<double>, y array<double>")
    if dim < 5000:
        got = {(r.item_id, r.target): r.score for r in heads.ridge_oof(df, q, intercept=False, skip_empty=False).collect()}
        for f in range(2):
            tr, te = fold != f, np.flatnonzero(fold == f)
            want = x[te] @ x[tr].T @ np.linalg.solve(x[tr] @ x[tr].T + np.eye(tr.sum()), y[tr])
            assert all(got[i, t] == pytest.approx(want[k, t], abs=1e-8) for k, i in enumerate(te) for t in range(q))
    out = heads.head_oof(df, ["a", "b"], rounds=20)
    assert out.count() == n * q
    assert out.filter("isnan(score)").count() == 0


def test_ridge_dealt_by_fold(spark, monkeypatch):
    """The way of wide features, on narrow ones."""
    df, x, y, fold = pool_rows(spark)
    plain = {(r.item_id, r.target): r.score for r in heads.ridge_oof(df, 3).collect()}
    monkeypatch.setattr(heads, "GRAM_NUMBERS", 1)
    monkeypatch.setattr(heads, "BAND_NUMBERS", 20)
    assert {(r.item_id, r.target): pytest.approx(r.score) for r in heads.ridge_oof(df, 3).collect()} == plain


def test_uneven_features_are_refused(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], [1.0]), (1, 1, [1.0], [0.0])], "item_id long, fold int, x array<double>, y array<double>")
    with pytest.raises(Exception, match="widths"):
        heads.ridge_oof(df, 1).collect()
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0])], "cell_id long, embedding array<double>")
    with pytest.raises(Exception, match="widths"):
        spatial.neighbour_average(v, spark.createDataFrame([(0, 1)], "cell_id long, nbr_id long")).collect()


# ---- encoders, images, sources ----


def test_encoders():
    a, b = encoders.get_encoder("hash", dim=16), encoders.get_encoder("fallback", dim=16)
    p = np.arange(8 * 8 * 3, dtype=np.uint8).reshape(1, 8, 8, 3)
    assert np.array_equal(a.encode_image(p), b.encode_image(p))
    with pytest.raises(ValueError, match="unknown encoder"):
        encoders.get_encoder("nope")
    with pytest.raises(NotImplementedError):
        encoders.get_encoder("uni").encode_text(["x"])
    with pytest.raises(RuntimeError):
        encoders.get_encoder("biomedclip").encode_text(["x"])
    flat = encoders.patch_stats(np.full((4, 4, 3), 9, np.uint8))
    assert flat[:3].tolist() == [9, 9, 9]
    assert flat[3:6].tolist() == [0, 0, 0]
    assert len(flat) == 48


def test_pretrained_by_factory(spark):
    class Tinted:
        """A model that a factory makes: mean colours, and lengths of texts."""

        def encode_image(self, patches):
            return patches.reshape(len(patches), -1, 3).mean(axis=1)

        def encode_text(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    patches = spark.createDataFrame([("c1", 1, 2, bytearray([10, 0, 0, 20, 0, 0])), ("c2", 1, 2, bytearray([0, 3, 4, 0, 3, 4]))], "cell_id string, h int, w int, px binary")
    got = {r.cell_id: r.embedding for r in encoders.encode_patches(patches, "plip", "medium", factory=Tinted).collect()}
    assert got["c1"] == pytest.approx([1, 0, 0])  # of unit length
    assert got["c2"] == pytest.approx([0, 0.6, 0.8])
    raw = {r.cell_id: r.embedding for r in encoders.encode_patches(patches, "uni2", "medium", factory=Tinted, batch_size=1).collect()}
    assert raw["c1"] == pytest.approx([15, 0, 0])
    fine = encoders.encode_patches(patches, "hash", "medium", numbers="double", dim=encoders.SIDES, plain=True)
    assert dict(fine.dtypes)["embedding"] == "array<double>"
    with pytest.raises(ValueError, match="float or double"):
        encoders.encode_patches(patches, "hash", "medium", numbers="half")
    text = encoders.encode_texts(spark.createDataFrame([("abc",)], "text string"), "biomedclip", factory=Tinted).first()
    assert text.vec == pytest.approx((np.array([3, 1]) / 10**0.5).tolist())
    assert encoders.get_encoder("uni", factory="numpy:zeros").factory == "numpy:zeros"


def test_stain_profile_by_numpy(spark):
    rng = np.random.default_rng(4)
    px = rng.integers(0, 256, (600, 3))
    df = spark.createDataFrame([tuple(map(int, p)) for p in px], "r int, g int, b int")
    he, top = imaging.stain_profile(df)
    od = -np.log((px + 1.0) / 256)
    od = od[(od >= 0.15).all(axis=1)]
    v = np.linalg.eigh(np.cov(od.T))[1][:, [2, 1]]
    v = v * np.where(v[0] < 0, -1, 1)
    angle = np.arctan2(od @ v[:, 1], od @ v[:, 0])
    want = np.stack([v @ [np.cos(t), np.sin(t)] for t in np.percentile(angle, [1, 99])], axis=1)
    want = want / np.linalg.norm(want, axis=0)
    want = want if want[0, 0] >= want[0, 1] else want[:, ::-1]
    assert he == pytest.approx(want, abs=1e-6)
    assert top == pytest.approx(np.percentile(np.linalg.lstsq(want, od.T, rcond=None)[0], 99, axis=1), rel=1e-5)


def test_many_windows_of_one_tile(spark, monkeypatch):
    monkeypatch.setattr(imaging, "TOGETHER", 3)
    img = np.random.default_rng(1).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    tiles = spark.createDataFrame([(x, y, 8, 8, bytearray(img[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].tobytes())) for x in range(2) for y in range(2)], "tx int, ty int, h int, w int, px binary")
    at = [(f"c{i:02d}", float(i % 17), float(i * 5 % 19)) for i in range(60)] + [("far", 900.0, 900.0)]
    padded = np.zeros((1000, 1000, 3), np.uint8)
    padded[10:26, 10:26] = img
    for r in imaging.extract_patches(tiles, spark.createDataFrame(at, "cell_id string, px double, py double"), 8, 6).collect():
        x, y = next((int(a), int(b)) for c, a, b in at if c == r.cell_id)
        assert np.array_equal(np.frombuffer(r.px, np.uint8).reshape(6, 6, 3), padded[y + 7 : y + 13, x + 7 : x + 13] if r.cell_id != "far" else np.zeros((6, 6, 3)))


def test_crops_pad_with_zero(spark):
    img = np.arange(16 * 16 * 3, dtype=np.uint32).reshape(16, 16, 3).astype(np.uint8)
    tiles = spark.createDataFrame([(x, y, 8, 8, bytearray(img[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].tobytes())) for x in range(2) for y in range(2)], "tx int, ty int, h int, w int, px binary")
    centres = spark.createDataFrame([(0, 8.0, 8.0), (1, 0.5, 1.5)], "cell_id long, px double, py double")
    got = {r.cell_id: np.frombuffer(r.px, np.uint8).reshape(r.h, r.w, 3) for r in imaging.extract_patches(tiles, centres, 8, 6).collect()}
    assert np.array_equal(got[0], img[5:11, 5:11])
    assert np.array_equal(got[1][1:, 3:], img[:5, :3])  # halves round to even: centre (0, 2)
    assert got[1][0].sum() == 0


def test_stain_profile_is_undone_by_itself(spark):
    rng = np.random.default_rng(0)
    he = np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]])
    od = (he @ rng.uniform(0.2, 1.2, (2, 900))).T
    px = np.clip(256 * np.exp(-od) - 1, 0, 255).astype(np.uint8).reshape(1, 30, 30, 3)
    patches = spark.createDataFrame([(0, 30, 30, bytearray(px.tobytes()))], "cell_id long, h int, w int, px binary")
    profile = imaging.stain_profile(imaging.pixel_rows(patches))
    assert profile[0].shape == (3, 2)
    same = np.frombuffer(imaging.normalise_stain(patches, profile, profile).first().px, np.uint8).astype(int)
    assert np.abs(same - px.ravel().astype(int)).mean() < 4


def test_sources(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("cell_id,x_centroid,y_centroid,transcript_counts,cell_area\n1,2.5,3,10,7\n")
    assert sources.read_cells(spark, str(tmp_path / "cells.csv")).first()[:3] == ("1", 2.5, 3.0)
    (tmp_path / "affine.csv").write_text("1,0,2\n0,1,3\n0,0,1\n")
    assert sources.read_affine(spark, str(tmp_path / "affine.csv"))[1] == [0, 1, 3]
    xml = spark.createDataFrame([('a PhysicalSizeX="0.5" b',), ('PhysicalSizeX="x"',), (None,)], "x string")
    assert [r[0] for r in xml.select(sources.pixel_size(F.col("x"))).collect()] == [0.5, 0.363788, 0.363788]
    scores = spark.createDataFrame([("a", "q", 1, 0.5), ("b", "q", 1, 0.7)], "baseline string, query_id string, item_id long, score double")
    sources.write_scores(scores, str(tmp_path / "scores"))
    assert {r.baseline for r in sources.read_scores(spark, str(tmp_path / "scores")).collect()} == {"a", "b"}
    emb = spark.createDataFrame([(1, "plip", "medium", [1.0])], "cell_id long, encoder string, scale string, embedding array<double>")
    sources.write_embeddings(emb, str(tmp_path / "emb"))
    assert sources.read_embeddings(spark, str(tmp_path / "emb"), "plip", "medium").count() == 1
    assert sources.read_embeddings(spark, str(tmp_path / "emb"), "uni2", "medium").count() == 0
    cut = spark.createDataFrame([("c", 1, 3, [7, 8, 9, 10], [1.0, 2.0, 3.0, 4.0])], "cell_id string, start long, end long, indices array<int>, data array<double>")
    assert sources.columns_to_cells(cut).first()[:] == ("c", [8, 9], [2.0, 3.0])
    levels = spark.sql("select array(named_struct('w', 8), named_struct('w', 4)) as l")
    assert levels.select(sources.pyramid_level(F.col("l"), 5)["w"]).first()[0] == 4
    sources.write_report(scores, str(tmp_path / "report"))
    (tmp_path / "there").write_bytes(b"x" * 2000)
    assert not sources.fetch("http://nowhere.invalid/", str(tmp_path / "there"))


def test_settings():
    s = config.load_settings(text="seed: 3\nneighborhood:\n  k: 7\n  niche_thresholds: {vascular: 0.2, tumor_immune_interface_epi: 0.4}\ncandidate_pool: {size: 9, stratify: false}\nretrieval: {topk: [1, 2]}\n")
    assert (s.seed, s.k, s.pool_size, s.stratify, s.ks) == (3, 7, 9, False, (1, 2))
    assert (s.niche["vascular"], s.niche["interface_epi"], s.niche["bcell_rich"]) == (0.2, 0.4, 0.15)


def test_stream_counts(spark, tmp_path, small):
    from nichefold.streaming.events import windowed_counts

    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{small}/events.parquet*")
    q = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == 1000


def test_hash_encoder_encodes_texts_as_sql_functions_do(spark):
    texts = ["B cells", "", "  tumor\timmune\n boundary ", "x" * 5000 + " y", "grüße aus köln", "cells B", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for seed in (0, 3):
        want = {r.i: r.vec for r in encoders.hash_text(df.filter("text IS NOT NULL"), 16, seed=seed).collect()}
        got = {r.i: r.vec for r in encoders.encode_texts(df, "hash", dim=16, seed=seed, keep_text=False).collect()}
        assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
        assert got[6] == [0.0] * 16
        assert got[0] == got[5]
    assert encoders.encode_texts(df, "hash", dim=4).columns == ["i", "text", "vec"]


@pytest.mark.parametrize("head", ["logistic", "mlp", "openvocab"])
def test_heads_give_one_result_whatever_the_size(spark, monkeypatch, head):
    """In a task a fold and over the cluster, in one partition, five or nine, with bands of a few parameters: the same scores, dropout included."""
    df, _, _, _ = pool_rows(spark, n=90, d=3)
    options = {"logistic": {}, "mlp": {"epochs": 60, "hidden": 8}, "openvocab": {"epochs": 60, "vectors": np.eye(3)}}[head]
    scores = lambda rows: {(r.query_id, r.item_id): r.score for r in heads.head_oof(rows, ["a", "b", "c"], head, **options).collect()}
    here = scores(df)
    again = scores(df.repartition(5))
    monkeypatch.setattr(heads, "WORKER_NUMBERS", 10)
    monkeypatch.setattr(heads, "BAND_NUMBERS", 7)
    if head == "logistic":
        options["rounds"] = 60
    there, spread = scores(df.repartition(1)), scores(df.repartition(9))
    assert here.keys() == again.keys() == there.keys() == spread.keys()
    for k, v in here.items():
        assert again[k] == pytest.approx(v, abs=1e-12)
        assert there[k] == pytest.approx(v, abs=1e-9)
        assert spread[k] == pytest.approx(v, abs=1e-9)


def test_draws_depend_on_item_step_and_unit(spark):
    ids = list(range(7)) + [10**9, 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "item_id long")
    keys = np.array([r[0] for r in df.select(stable_hash(F.col("item_id"), 3)).collect()])
    for step in (0, 5):
        got = heads.Draws(keys, step).random((9, 4))
        row = df.select(stable_hash(stable_hash(F.col("item_id"), 3) + (step + 1) * 1000000007).alias("r"))
        want = [[r[f"u{u}"] for u in range(4)] for r in row.select(*[((stable_hash(F.col("r") + u * 1000000007) + 0.5) / 2147483647.0).alias(f"u{u}") for u in range(4)]).collect()]
        assert np.array_equal(got, np.array(want))
        assert np.array_equal(got[3:5], heads.Draws(keys[3:5], step).random((2, 4)))
    big = heads.Draws(np.arange(400) * 7919 % 2147483647, 1).random((400, 256))
    assert 0.08 < (big < 0.1).mean() < 0.12
    assert abs(np.corrcoef(big[:, 0], big[:, 1])[0, 1]) < 0.2


def test_few_points_meet_a_cluster_in_pieces(spark, monkeypatch):
    """Scattered points about a dense cluster: each task of a wide square reads a piece of the cluster, and neighbours are as by brute force."""
    monkeypatch.setattr(spatial, "SPAN", 25)
    rng = np.random.default_rng(12)
    xy = np.vstack([rng.normal(0, 1, (600, 2)), rng.uniform(-400, 400, (12, 2))])
    p = points(spark, xy)
    few, dense = p.filter("cell_id >= 600").limit(2), p.filter("cell_id < 600")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        near = spatial._pairs(few, dense, 5000.0, True, True)
        per = [r["count"] for r in near.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(per) == 2 * 600
    assert max(per) < 2 * 25 * 8
    got = {}
    for r in spatial.knn_edges(p, 3).collect():
        got.setdefault(r.cell_id, []).append((r.rnk, r.nbr_id))
    for i in range(len(xy)):
        d2 = ((xy - xy[i]) ** 2).sum(1)
        assert [j for _, j in sorted(got[i])] == [j for j in sorted(range(len(xy)), key=lambda j: (d2[j], j)) if j != i][:3]


def test_draws_without_divisions_are_the_same():
    keys = np.concatenate([heads.stable_hashes(np.arange(700, dtype=np.int64), 3), [0, 1, 2147483645, 2147483646]])
    for step in range(20):
        d = heads.Draws(keys, step)
        for rate in (0.0, 0.1, 0.5, 1.0):
            assert np.array_equal(d.kept((len(keys), 64), rate), d.random((len(keys), 64)) >= rate)


@pytest.mark.parametrize("head", ["logistic", "mlp"])
def test_a_task_works_on_some_rows_at_a_time(head, monkeypatch):
    """What a step works out for each row is never there for all rows, and fits agree."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 5))
    y = (x[:, :2] + rng.standard_normal((500, 2)) > 0).astype(float)
    options = {"epochs": 20, "hidden": 8} if head == "mlp" else {}
    whole = heads.fit(heads.HEADS[head](5, 2, **options), x, y)
    monkeypatch.setattr(heads, "TOGETHER", 64)
    model, most = heads.HEADS[head](5, 2, **options), []
    sums = model.sums
    model.sums = lambda theta, x, *rest: (most.append(len(x)), sums(theta, x, *rest))[1]
    assert np.allclose(heads.fit(model, x, y), whole, rtol=1e-9, atol=1e-9)
    assert max(most) == 64


def test_cells_by_lineages_and_by_genes_are_not_shuffled(spark):
    import re

    from nichefold.operators import expression

    cells = spark.createDataFrame([(i,) for i in range(5)], "cell_id long")
    values = [(0, 1, 2.0), (0, 2, 1.0), (1, 2, 3.0), (2, 4, 4.0), (3, 1, 90.0)]
    lognorm = spark.createDataFrame(values, "cell_id long, gene int, v double")
    stats = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.5, 1.0), (4, 0.0, 1.0)], "gene int, mu double, sd double")
    markers = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (1, "b", 4), (1, "b", 9), (2, "c", 9)], "lineage_ord int, lineage string, gene int")
    scores = expression.marker_scores(cells, lognorm, stats, markers)
    wide = expression.wide_zscores(cells, lognorm, stats, [1, 2, 4], 10.0)
    for df in (scores, wide):
        assert not re.search(r"hashpartitioning\(cell_id#\d+L?, (lineage|gene)", df._jdf.queryExecution().executedPlan().toString())
    dense = {(i, g): (dict(((c, x), v) for c, x, v in values).get((i, g), 0.0) - mu) / sd for i in range(5) for g, mu, sd in ((1, 1.0, 2.0), (2, 0.5, 1.0), (4, 0.0, 1.0))}
    got = {(r.cell_id, r.lineage): r.score for r in scores.collect()}
    assert got == pytest.approx({(i, n): z for i in range(5) for n, z in (("a", (dense[i, 1] + dense[i, 2]) / 2), ("b", dense[i, 4]), ("c", 0.0))})
    assert {(r.cell_id, g): r[str(g)] for r in wide.collect() for g in (1, 2, 4)} == pytest.approx({k: min(v, 10.0) for k, v in dense.items()})


def test_long_steps_are_shared_and_short_ones_are_not(spark, monkeypatch):
    """A head of many operations trains on more tasks than folds, whose rows fit a worker each; scores are as by a task a fold, with a fold that has no rows to learn from as well."""
    df, _, _, _ = pool_rows(spark, n=90, d=3)
    rows_ = df.withColumn("fold", F.col("fold") % 3).withColumn("skip", F.when(F.col("item_id") % 2 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    options, seen = {"epochs": 6, "hidden": 8}, []
    scores = lambda d: {(r.query_id, r.item_id): r.score for r in heads.head_oof(d, ["a", "b", "c"], "mlp", **options).collect()}
    fit_on_cluster = heads._fit_on_cluster
    monkeypatch.setattr(heads, "_fit_on_cluster", lambda *args: (seen.append(args[-1]), fit_on_cluster(*args))[1])
    nothing = rows_.withColumn("skip", F.array(F.lit(1)))
    here, bare = scores(rows_), scores(nothing)
    assert seen == []
    monkeypatch.setattr(heads, "WORKER_WORK", 6.0 * 30 * 8 * (3 + 3) * 6)
    scores(rows_.limit(20))
    scores(rows_)  # too few rows for another task
    assert seen == []
    monkeypatch.setattr(heads, "TASK_ROWS", 20)
    monkeypatch.setattr(heads, "BLOCK_NUMBERS", 21)
    assert scores(rows_) == pytest.approx(here, abs=1e-9)
    assert scores(nothing) == pytest.approx(bare, abs=1e-9)
    assert seen == [4, 4]


def test_a_row_is_drawn_once_for_all_folds():
    keys = heads.stable_hashes(np.arange(50, dtype=np.int64), 3)
    draws, use = heads.Draws(keys, 7), np.arange(50) % 3 > 0
    some = draws.of(use).kept((use.sum(), 300), 0.2)
    assert np.array_equal(some, heads.Draws(keys[use], 7).random((use.sum(), 300)) >= 0.2)
    assert draws.kept((50, 300), 0.2) is draws.kept((50, 300), 0.2)
