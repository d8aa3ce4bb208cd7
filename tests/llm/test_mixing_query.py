"""op1's query against sums and targets worked out anew."""

from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction

import pytest

from nichefold.llm import mixing
from nichefold.llm import queries as llm_queries


def expected(rows):
    """Sizes, sizes of sources and targets, in exact numbers."""
    size = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    total = defaultdict(int)
    for _, s, n in size:
        total[s] += n
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest, open_, target = Fraction(sum(total.values())), set(names), {}
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(3 * total[s])
            rest -= target[s]
        open_ -= over
    return size, dict(total), {s: float(t) for s, t in target.items()}


def check(spark, folder, rows):
    query = llm_queries.queries()["op1_mixing"]
    got = query(spark, folder).collect()
    size, total, target = expected(rows)
    key = lambda d, n, s: (repr(d), n, repr(s))
    assert sorted(key(r.doc_id, r.size, r.source) for r in got) == sorted(key(d, n, s) for d, s, n in size)
    took, big = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        took[r.source] += r.taken
        big[r.source] = max(big[r.source], r.size)
    for s, t in target.items():
        assert abs(took[s] - t) <= max(0.05 * t, big[s] / 2 + 1)
    again = {(r.doc_id, r.source, r.size): r.taken for r in query(spark, folder).collect()}
    assert again == {(r.doc_id, r.source, r.size): r.taken for r in got}


def test_query_on_all_documents(spark, small):
    check(spark, small, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, None, "b"), (2, "", None), (3, "one two\x0bthree\u00a0four", "b"), (3, "again three", "b"), (None, "no id here", None), (5, "x " * 50, "ä"), (6, "y " * 200_000, "hot")]
    rows += [(100 + i, "w " * (i % 40), "hot") for i in range(400)] + [(1000 + i, "w " * 5, f"s{i % 7}") for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), rows)


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert llm_queries.queries()["op1_mixing"](spark, str(tmp_path)).count() == 0


def test_more_patterns_than_a_catalogue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    df = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(3)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="catalogue"):
        mixing.mix_documents(df)
