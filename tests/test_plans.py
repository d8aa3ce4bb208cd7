"""Plans: what is read, and how it is joined."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from nichefold.operators import spatial, vectors
from nichefold.plans import catalog
from nichefold.plans import fixtures as X


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, small):
    p = plan(catalog.queries()["library_totals"](spark, small))
    assert "l_discount" not in p
    assert "c_name" not in p
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>", p)


def test_filters_reach_the_scan(spark, small):
    p = plan(X.table(spark, small, "part").filter("p_size < 40").select("p_brand"))
    assert "PushedFilters: [IsNotNull(p_size), LessThan(p_size,40)]" in p


def test_neighbours_are_found_by_equi_joins(spark, small):
    p = plan(spatial.radius_edges(X.cells(spark, small), 50.0))
    assert "Cartesian" not in p
    assert "NestedLoop" not in p


def test_pairs_are_dealt_by_squares_however_few_bytes(spark, small):
    """A scan of few bytes is one task, and work is in the pairs: neither side may be broadcast to it."""
    e = spatial.radius_edges(X.cells(spark, small), 50.0)
    assert "SortMergeJoin" in plan(e)
    before = X.cells(spark, small).rdd.getNumPartitions()
    assert before == 1
    assert e.rdd.getNumPartitions() >= 8


def test_patches_are_made_over_many_tasks(spark, small):
    assert X.cells(spark, small).rdd.getNumPartitions() == 1
    assert catalog._patches(spark, small).rdd.getNumPartitions() >= 8


def test_a_sample_of_pixels_is_drawn_by_ids_alone(spark, small):
    from nichefold.operators import imaging

    p = plan(imaging.pixel_rows(catalog._patches(spark, small), 40, 5))
    assert re.search(r"TakeOrderedAndProject\(limit=40.*output=\[cell_id#\d+L\]\)", p)


def test_regions_are_staged_over_many_tasks(spark, small, monkeypatch):
    parts = []
    stage = spatial.stage
    monkeypatch.setattr(spatial, "stage", lambda df, name="stage": (parts.append(df.rdd.getNumPartitions()), stage(df, name))[1])
    spatial.kmeans_regions(X.cells(spark, small), 2, 0, starts=2, rounds=2).collect()
    assert parts[0] >= 8


def test_counts_are_combined_before_the_shuffle(spark, small):
    p = plan(X.counts(spark, small))
    assert "partial_sum" in p


def test_top_k_ranks_only_what_batches_leave(spark, small):
    items = X.item_vectors(spark, small)
    q = items.limit(3).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("qvec"))
    p = plan(vectors.cosine_top(items, q, 5))
    assert "WindowGroupLimit" in p
    assert "Cartesian" not in p
