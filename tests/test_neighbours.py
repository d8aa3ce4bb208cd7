"""The neighbour join in many dimensions against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from nichefold.operators import neighbours


def brute(rows, k):
    """{id: [(d2, id), ...]} by all pairs; rows: (id, vector)."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        d = ((x - v) ** 2).sum(axis=1)
        out[i] = sorted((float(a), b) for a, b in zip(d, ids, strict=True) if b != i)[:k]
    return out


def found(spark, rows, k, kind="long", parts=3, **options):
    df = spark.createDataFrame(rows, f"item_id {kind}, embedding array<double>").repartition(parts)
    join = neighbours.Join(df.selectExpr("item_id AS id", "embedding AS vec"), k, **options)
    got: dict = {}
    for r in join.result().orderBy("id", "rnk").collect():
        got.setdefault(r.id, []).append((r.d2, r.nbr))
        assert r.rnk == len(got[r.id])
    return got, join


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert [n for _, n in got[i]] == [n for _, n in want[i]]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], rtol=1e-12, atol=1e-12)


def clusters(n, dim, groups, spread, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + spread * rnd.normal(size=dim)).tolist()) for i in range(n)]


def test_clusters_meet_few(spark):
    rows = clusters(2000, 30, 40, 0.05)
    got, join = found(spark, rows, 15)
    same(got, brute(rows, 15))
    assert join.pairs < 0.2 * len(rows) ** 2


def test_without_structure_it_is_still_exact(spark):
    rows = clusters(300, 16, 1, 1.0)
    got, _ = found(spark, rows, 5)
    same(got, brute(rows, 5))


def test_blocks_pieces_and_repeated_answers(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "RINGS", 8)
    monkeypatch.setattr(neighbours, "ASK", 9)
    monkeypatch.setattr(neighbours, "AT_ONCE", 7)
    rows = clusters(260, 5, 3, 0.2, seed=4)
    got, join = found(spark, rows, 6, pivots=4)
    same(got, brute(rows, 6))
    assert join.pairs > 0


def test_copies_and_ties(spark):
    rows = [(i, [0.5, 0.5, 0.0]) for i in range(400)] + [(1000 + i, [float(i % 4), float(i // 4 % 4), 1.0]) for i in range(40)] + [(2000, [1e6, 1e6, 1e6])]
    got, join = found(spark, rows, 4)
    same(got, brute(rows, 4))
    assert join.pairs < 3000  # of 441 ** 2: copies neither ask nor answer more than once or k + 1 times


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_rows(spark, n):
    rows = [(i, [float(i), 0.0]) for i in range(n)]
    got, _ = found(spark, rows, 8)
    same(got, {i: v for i, v in brute(rows, 8).items() if v})


def test_odd_rows(spark):
    rows = [("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("c", None), ("d", [0.0, None]), ("e", [float("nan"), 1.0]), ("f", [0.0, 1.5])]
    got, _ = found(spark, rows, 2, kind="string")
    same(got, brute([r for r in rows if r[0] in "abf"], 2))
    empty = neighbours.feature_knn(spark.createDataFrame([], "item_id string, embedding array<double>"), 3)
    assert empty.dtypes == [("item_id", "string"), ("nbr_id", "string"), ("d2", "double"), ("rnk", "int")]
    assert empty.collect() == []
    with pytest.raises(Exception, match="different widths"):
        found(spark, [(1, [0.0]), (2, [0.0, 1.0])], 1)


def test_rows_go_once_to_a_task(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(3000, 24))
    rows = list(enumerate((x / np.linalg.norm(x, axis=1)[:, None]).tolist()))
    got, join = found(spark, rows, 7, parts=2)
    same(got, brute(rows, 7))
    assert 0 < join.sent <= 2 * 4 * len(rows)  # two tasks a core, though rows without structure ask nearly all 55 cells


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 0.0), (1.0, 1e6), (1e-25, 0.0), (1e22, 0.0), (1.0, 1e30)])
def test_single_precision_rules_nothing_near_out(scale, offset):
    rnd = np.random.default_rng(3)
    x = scale * rnd.normal(size=(500, 6)) + offset
    x[::5] = x[0]
    near = neighbours.Nearest(x, 9, np.full(len(x), np.inf))
    ids = np.arange(len(x))
    for at in range(0, len(x), 90):
        near.meet(ids, ids[at : at + 90], x[at : at + 90], x[at])
    near.rank()
    for i, v in enumerate(x):
        d = ((x - v) ** 2).sum(axis=1)
        assert near.ids[i].tolist() == np.lexsort((ids, d))[:9].tolist()
