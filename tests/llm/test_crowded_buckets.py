"""op3: crowded buckets over several tasks, and what the filters before the exact check lose."""

from __future__ import annotations

import math
import random

import pytest

from nichefold.llm import minhash
from tests.llm.test_llm_ops import near_rows, near_truth


def chance_below(n: int, p: float, most: int) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most))


def test_losses_are_as_written():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS == pytest.approx(3e-6, rel=0.2)
    assert chance_below(minhash.COORDS, 0.8, math.ceil(minhash.LIKELY * minhash.COORDS)) == pytest.approx(1.1e-8, rel=0.1)


@pytest.mark.parametrize(("span", "block"), [(3, 7), (10_000, 500)])
def test_dealt_buckets_are_exact(spark, monkeypatch, span, block):
    monkeypatch.setattr(minhash, "SPAN", span)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows(7)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_truth(rows)


def test_only_crowded_buckets_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SPAN", 10)
    rows = spark.createDataFrame([(k, 100 * k + i) for k in range(200) for i in range(95 if k == 7 else 3)], "key long, node long")
    buckets = rows.groupBy("key").count().withColumnRenamed("count", "n")
    dealt = minhash.NearDuplicates.dealt(rows, buckets)
    assert dealt.count() == rows.count()
    assert {(r.key, r.node) for r in dealt.collect()} == {tuple(r) for r in rows.collect()}
    from pyspark.sql import functions as F

    seen = []
    real = F.explode
    monkeypatch.setattr(F, "explode", lambda c: seen.append(c) or real(c))
    minhash.NearDuplicates.dealt(rows, buckets)
    repeated = buckets.select("key", real(seen[0]).alias("part")).groupBy("key").count().filter("count > 1").collect()
    assert [tuple(r) for r in repeated] == [(7, 10)]


def test_templated_texts(spark):
    """Many texts that share buckets but aren't similar enough, and a chain of those that are."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    form = rng.choices(words, k=120)
    rows = [(i, " ".join(form[:60] + rng.choices(words, k=45) + form[60:])) for i in range(150)]
    chain = rng.choices(words, k=100)
    for i in range(25):
        rows.append((500 + i, " ".join(chain)))
        chain = list(chain)
        chain[rng.randrange(100)] = f"new{i}"
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_truth(rows)


def test_string_ids_and_clashing_columns(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    df = spark.createDataFrame([("b", text, 1, 2), ("a", text, 3, 4), ("c", "other words than those", 5, 6)], "doc_id string, text string, node int, label int")
    assert sorted(r.doc_id for r in minhash.keep_one(df).collect()) == ["a", "c"]
    assert minhash.keep_one(df).columns == df.columns
    assert {(r.doc_id, r.class_id) for r in minhash.near_classes(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
