"""What SQL can't say of the baselines, against numpy."""

from __future__ import annotations

import dataclasses
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichefold.config import LINEAGES
from nichefold.functions.exprs import l2_normalise
from nichefold.operators import relevance, spatial, validation
from nichefold.plans import baselines, catalog
from nichefold.plans import fixtures as X
from nichefold.sources.stage import drop_tables, shared_folder


@pytest.fixture(scope="module")
def inputs(spark, small):
    i = catalog._inputs(spark, small)
    yield dataclasses.replace(i, epochs=15, _kept={})
    drop_tables()


def wide(df, key, names, value):
    rows = df.groupBy(key).pivot(names[0], names[1]).agg(F.first(value)).orderBy(key).collect()
    return np.array([[0.0 if v is None else v for v in r[1:]] for r in rows])


def fused_arrays(i):
    rows = i.fused_pool().orderBy("item_id").collect()
    return np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])


def scores_of(df, ids):
    return wide(df, "item_id", ("query_id", ids), "score")


def test_blocks_are_concatenated(inputs):
    x, y, fold = fused_arrays(inputs)
    assert x.shape == (inputs.pool.count(), 6 * X.DIM)
    assert np.linalg.norm(x, axis=1) == pytest.approx(6**0.5)
    assert y.shape[1] == 34


def test_linear_probe(inputs):
    """Ridge with an intercept on raw vectors; queries without positives score 0."""
    ids = inputs.query_ids()
    _, y, fold = fused_arrays(inputs)
    x = np.array([r.embedding for r in inputs.items("biomedclip", "medium").orderBy("item_id").collect()])
    want = np.zeros(y.shape)
    for f in range(5):
        tr, te = fold != f, fold == f
        mx, my = x[tr].mean(0), y[tr].mean(0)
        w = np.linalg.solve((x[tr] - mx).T @ (x[tr] - mx) + np.eye(x.shape[1]), (x[tr] - mx).T @ (y[tr] - my))
        want[te] = ((x[te] - mx) @ w + my) * (y[tr].sum(0) > 0)
    assert scores_of(baselines.linear_probe(inputs), ids) == pytest.approx(want, abs=1e-8)


def test_fused_logistic_is_at_its_minimum(inputs):
    ids = inputs.query_ids()
    x, y, fold = fused_arrays(inputs)
    got = scores_of(baselines.fused_head(inputs, "logistic"), ids)
    for f in (0, 3):
        tr, te = fold != f, fold == f
        mu, sd = x[tr].mean(0), x[tr].std(0, ddof=1) + 1e-6
        z = np.hstack([(x - mu) / sd, np.ones((len(x), 1))])
        pos = y[tr].sum(0)
        w = np.where(y[tr] > 0, np.clip((tr.sum() - pos) / (pos + 1e-6), 1, 1000), 1) / y[tr].size
        beta = np.zeros((z.shape[1], y.shape[1]))
        for j in range(y.shape[1]):
            for _ in range(40):
                p = 1 / (1 + np.exp(-z[tr] @ beta[:, j]))
                step = np.linalg.solve((z[tr] * (w[:, j] * p * (1 - p))[:, None]).T @ z[tr] + 2e-3 * np.eye(z.shape[1]), z[tr].T @ (w[:, j] * (p - y[tr][:, j])) + 2e-3 * beta[:, j])
                beta[:, j] -= step
                if np.abs(step).max() < 1e-12:
                    break
        assert got[te] == pytest.approx(z[te] @ beta, abs=2e-3)


def test_predicted_expression(inputs):
    """Ridge without intercept on features scaled over the pool, then scores, types, neighbourhoods and ranking from what it predicts."""
    ids, s = inputs.query_ids(), inputs.settings
    x, _, fold = fused_arrays(inputs)
    sd = x.std(0)
    x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    genes = [r.gene for r in inputs.stats.select("gene").orderBy("gene").collect()]
    cells = inputs.pool.select("cell_id", "pool_idx", "x", "y").orderBy("pool_idx").collect()
    expr = {(r.cell_id, r.gene): r.v for r in inputs.lognorm.collect()}
    v = np.array([[expr.get((c.cell_id, g), 0.0) for g in genes] for c in cells])
    dev = v.std(0)
    z = (v - v.mean(0)) / np.where(dev > 0, dev, 1)
    guess = np.zeros_like(z)
    for f in range(5):
        tr = fold != f
        guess[~tr] = x[~tr] @ np.linalg.solve(x[tr].T @ x[tr] + np.eye(x.shape[1]), x[tr].T @ z[tr])
    at = {g: k for k, g in enumerate(genes)}
    score = np.stack([guess[:, [at[g] for g in X.MARKERS[t]]].mean(1) for t in LINEAGES], axis=1)
    order = np.sort(score, axis=1)
    kinds = [LINEAGES[k] if a > s.type_threshold and a - b >= s.type_margin else "unknown" for k, a, b in zip(score.argmax(1), order[:, -1], order[:, -2], strict=True)]
    xy = np.array([[c.x, c.y] for c in cells])
    frac = {t: np.zeros(len(cells)) for t in LINEAGES}
    for i in range(len(cells)):
        d2 = ((xy - xy[i]) ** 2).sum(1)
        near = [j for j in sorted(range(len(cells)), key=lambda j: (d2[j], j)) if j != i][: s.k]
        for t in LINEAGES:
            frac[t][i] = np.mean([kinds[j] == t for j in near])
    niche = {
        "bcell_rich": frac["B_cell"], "tcell_rich": frac["T_cell"], "myeloid_rich": frac["Myeloid"], "vascular": frac["Endothelial"],
        "immune_rich": frac["T_cell"] + frac["B_cell"] + frac["Myeloid"], "tumor_immune_interface": frac["Epithelial"] * (frac["T_cell"] + frac["Myeloid"]),
    }
    want = np.zeros((len(cells), len(ids)))
    for j, q in enumerate(inputs.queries.orderBy("query_id").collect()):
        if q.target_field == "cell_type":
            want[:, j] = score[:, LINEAGES.index(q.target_label)]
        elif q.target_field == "cell_state":
            want[:, j] = guess[:, [at[g] for g in X.STATE_GENES]].mean(1)
        elif q.target_field == "gene":
            want[:, j] = guess[:, at[q.gene]] if q.gene in at else 0
        else:
            want[:, j] = niche[q.target_label]
    assert scores_of(baselines.predicted_expression(inputs), ids) == pytest.approx(want, abs=1e-6)


def test_predicted_expression_labels_no_cell_beyond_the_pool(spark, small, inputs, monkeypatch):
    """Neighbours are sought of the pool's cells only, and no labels are made; the pool and the scores are those of a pool with labels."""
    sought, nearest = [], spatial._nearest
    monkeypatch.setattr(spatial, "_nearest", lambda points, *a, **k: sought.append(points.count()) or nearest(points, *a, **k))
    monkeypatch.setattr(X, "SETTINGS", dataclasses.replace(X.SETTINGS, pool_size=40))
    i = catalog._inputs(spark, small)
    n = i.pool.count()
    assert n < inputs.pool.count()
    scores = baselines.predicted_expression(i)
    assert scores.count() == 34 * n
    assert sought and max(sought) <= n
    whole = i.labelled_pool()
    assert max(sought) > n
    assert sorted(i.pool.select("cell_id", "pool_idx", "x", "y", "cell_type").collect()) == sorted(whole.select("cell_id", "pool_idx", "x", "y", "cell_type").collect())
    again = dataclasses.replace(i, pool=whole, labels=None, _kept={})
    assert sorted(baselines.predicted_expression(again).collect()) == sorted(scores.collect())


def test_a_length_is_worked_out_once_a_vector(spark):
    """Work that grows with the square of a vector's width takes most of a minute here."""
    v = [float(k % 7 - 3) for k in range(20_000)]
    began = time.monotonic()
    rows = spark.createDataFrame([(0, v), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "i int, v array<double>").select("i", l2_normalise(F.col("v")).alias("u")).orderBy("i").collect()
    assert time.monotonic() - began < 15
    assert rows[0].u == pytest.approx((np.array(v) / np.linalg.norm(v)).tolist(), abs=1e-12)
    assert [r.u for r in rows[1:]] == [[0.0, 0.0], [0.6, 0.8], None]


def test_dispatcher(inputs, spark):
    out, skipped = baselines.run(inputs, ["random", "nonsense", "plip", "openvocab", "cellseek_mlp"])
    assert skipped == {"nonsense": "unknown baseline"}
    assert out.groupBy("baseline").count().count() == 4
    assert out.filter("isnan(score)").count() == 0
    bare = dataclasses.replace(inputs, embeddings=None, text={}, _kept={})
    out, skipped = baselines.run(bare)
    assert {r.baseline for r in out.select("baseline").distinct().collect()} == {"random", "oracle"}
    assert set(skipped) == set(baselines.BASELINES) - {"random", "oracle"}
    assert "no embeddings" in skipped["cellseek"]
    one = dataclasses.replace(inputs, embeddings=inputs.embeddings.filter("encoder = 'plip'"), _kept={})
    assert set(baselines.run(one, ["plip", "biomedclip", "cellseek"])[1]) == {"biomedclip", "cellseek"}
    with pytest.raises(ValueError, match="no baseline"):
        baselines.run(bare, ["plip"])


def test_all_baselines_rank(spark, small, inputs):
    from nichefold.operators import metrics

    scores, skipped = baselines.run(inputs)
    assert not skipped
    per = metrics.evaluate(scores, inputs.relevance(), (1, 5, 10), 10, ["baseline", "query_id"])
    table = {r.baseline: r.mAP for r in metrics.main_table(per.withColumn("split", F.lit("x"))).collect()}
    assert len(table) == 13
    assert table["oracle"] == max(table.values())


def test_regions(spark, small):
    points = X.cells(spark, small)
    rows = spatial.kmeans_regions(points, 3, 0, starts=4).join(points, "cell_id").collect()
    assert len(rows) == points.count()
    xy, fold = np.array([[r.x, r.y] for r in rows]), np.array([r.fold for r in rows])
    centres = np.stack([xy[fold == f].mean(0) for f in range(3)])
    far = ((xy[:, None] - centres) ** 2).sum(2)
    assert (far.argmin(1) == fold).mean() > 0.97


def test_clusters_that_agree_with_types(spark):
    rng = np.random.default_rng(0)
    kinds = np.arange(90) % 3
    z = spark.createDataFrame([(i, g, float(5.0 * (g == k) + rng.normal() / 4 + (100 if i == 0 and g == 0 else 0))) for i, k in enumerate(kinds.tolist()) for g in range(6)], "cell_id int, gene int, z double")
    found = validation.clusters(validation.components(validation.scaled(z), list(range(6)), 3), 3)
    types = spark.createDataFrame([(i, f"t{k}") for i, k in enumerate(kinds.tolist())], "cell_id int, cell_type string")
    assert validation.purity(validation.cluster_agreement(types, found)).first()[0] == 1
    assert validation.mutual_information(types.join(found, "cell_id"), "cell_type", "cluster").first()[0] == pytest.approx(1)
    split = types.withColumn("cluster", F.col("cell_id") % 2)
    assert validation.mutual_information(split, "cell_type", "cluster").first()[0] == pytest.approx(0, abs=1e-9)
    assert validation.mutual_information(split.withColumn("one", F.lit(1)), "one", "one").first()[0] == 1


def test_relevance_fields_are_known(inputs):
    relevance.check_queries(inputs.queries)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Nowhere:
        master = "spark://x"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Nowhere()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session())


def test_regions_of_few_places(spark):
    two = spark.createDataFrame([(i, float(i % 2), 5.0) for i in range(9)], "cell_id long, x double, y double")
    assert {(r.cell_id, r.fold) for r in spatial.kmeans_regions(two, 4, starts=3).collect()} == {(i, i % 2) for i in range(9)}
    assert spatial.kmeans_regions(two.limit(0), 4).collect() == []
    named = two.select(F.concat(F.lit("c"), "cell_id").alias("cell_id"), "x", "y")
    assert {(r.cell_id, r.fold) for r in spatial.kmeans_regions(named, 2).collect()} == {(f"c{i}", i % 2) for i in range(9)}


def test_regions_are_the_best_start_and_settled(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(c, 1.0, (60, 2)) for c in ((0, 0), (20, 0), (0, 20), (20, 20), (40, 10))]).round(3)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell_id long, x double, y double")
    fold = np.array([r.fold for r in spatial.kmeans_regions(points, 5).orderBy("cell_id").collect()])
    assert all(len(set(fold[60 * c : 60 * c + 60])) == 1 for c in range(5))
    centres = [xy[fold == f].mean(0)[0] for f in range(5)]
    assert centres == sorted(centres)


def test_components_from_non_zeros(spark, small):
    """Against numpy's decomposition of the dense matrix, zeros and cells without counts included."""
    cells, counts = X.cells(spark, small), X.counts(spark, small)
    from nichefold.operators import expression

    cells = cells.unionByName(cells.limit(2).selectExpr("cell_id + 100000 AS cell_id", "x", "y"))
    lognorm = expression.normalise(counts)
    stats = expression.gene_stats(lognorm, cells.agg(F.count("*").alias("n")))
    wide = expression.zscores(cells, lognorm, stats).groupBy("cell_id").pivot("gene").agg(F.first("z")).orderBy("cell_id").collect()
    for most in (10.0, 1.5):
        z = np.minimum(np.array([r[1:] for r in wide]), most)
        z = z - z.mean(axis=0)
        u, sv, vt = np.linalg.svd(z, full_matrices=False)
        points, values = validation.sparse_components(cells, lognorm, stats, 30, most)
        assert np.allclose(np.sqrt(values * len(z)), sv, rtol=1e-6, atol=1e-6)
        got = np.array([r.features for r in points.orderBy("cell_id").collect()])
        assert got.shape == (152, 25)
        assert np.allclose(np.abs(got), np.abs(u * sv), atol=1e-6)
    few, values = validation.sparse_components(cells, lognorm, stats, 3)
    assert len(few.first().features) == len(values) == 3
    none, values = validation.sparse_components(cells, lognorm.limit(0), stats.limit(0), 3)
    assert none.count() == 152 and len(values) == 0


def test_graph_clusters_agree_with_types(spark):
    rng = np.random.default_rng(1)
    kinds = np.arange(60) % 3
    points = spark.createDataFrame([(i, (8.0 * np.eye(3)[k] + rng.normal(size=3) / 4).tolist()) for i, k in enumerate(kinds.tolist())], "cell_id long, features array<double>")
    found = validation.graph_clusters(points, 8)
    types = spark.createDataFrame([(i, f"t{k}") for i, k in enumerate(kinds.tolist())], "cell_id long, cell_type string")
    assert validation.purity(validation.cluster_agreement(types, found)).first()[0] == 1
    assert found.select("cluster").distinct().count() == 3
