"""op12 against loops over vectors, parts and entries."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from nichefold.llm import q12_codes
from nichefold.llm import vector_codes as V

NAN, INF = float("nan"), float("inf")


def slow(rows, parts, entries, rounds, scale=1024, width=None):
    """(code, error) by place of the row, and the codebooks' digest; every round sums all parts anew."""
    kept = {}
    for i, (key, v) in enumerate(rows):
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = [max(-V.LIMIT, min(V.LIMIT, math.floor(x * scale))) for x in v]
    order = sorted(kept, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, len(kept[i]), kept[i]))
    if not order:
        return {}, hashlib.sha256(b"").hexdigest()
    width = len(kept[order[0]]) // parts
    order = [i for i in order if len(kept[i]) == width * parts]
    cut = lambda i, p: kept[i][p * width : (p + 1) * width]
    books = [[cut(i, p) for i in order[:entries]] for p in range(parts)]

    def code(i, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(i, p), e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for i in order:
                mine[code(i, p)[0]].append(cut(i, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(mine, books[p], strict=True)]
    found = {i: [code(i, p) for p in range(parts)] for i in order}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ([c for c, _ in f], sum(d for _, d in f)) for i, f in found.items()}, digest


def both(spark, rows, parts=2, entries=4, rounds=3, kind="float", **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place long, vec_id long, embedding array<{kind}>").repartition(3)
    got, books = V.compress(df, keep=["place", "vec_id"], parts=parts, entries=entries, rounds=rounds, **options)
    want, digest = slow(rows, parts, entries, rounds, **options)
    assert {r.place: (r.code, r.error) for r in got.collect()} == want
    assert books.sha256() == digest
    return got


def test_random_vectors(spark):
    rnd = random.Random(1)
    rows = [(i * 7 % 101, [float(np.float32(rnd.gauss(0, 1))) for _ in range(8)]) for i in range(90)]
    both(spark, rows)
    both(spark, rows, parts=4, entries=256)
    both(spark, rows, parts=8, entries=1, rounds=1)
    both(spark, rows, rounds=0)


def test_ties_repeats_and_clusters(spark):
    grid = [(i, [float(i % 3), float(i % 2), float(i % 3), 0.0]) for i in range(30)]
    both(spark, grid)
    both(spark, [(5, [1.0, 1.0])] * 20 + [(5, [2.0, 1.0])] * 3, entries=3)
    both(spark, [(i, [0.25, -0.25]) for i in range(40)], entries=8)


def test_odd_rows(spark):
    good = [(9, [0.1, 0.2, 0.3, 0.4]), (2, [-0.1, 0.0, 0.5, 0.5]), (None, [0.9, 0.9, 0.9, 0.9]), (4, [0.0, 0.0, 0.0, -0.0001])]
    odd = [(1, None), (0, []), (3, [0.1, None, 0.2, 0.3]), (5, [0.1, NAN, 0.2, 0.3]), (6, [INF, 0.0, 0.0, 0.0]), (7, [-INF, 0.0, 0.0, 0.0]), (8, [0.1, 0.2, 0.3]), (10, [0.1] * 8)]
    both(spark, good + odd)
    both(spark, [(1, [1e30, -1e30, 3e8, 1.0]), (2, [0.0, 1.0, 2.0, 3.0]), (3, [16000.0, -16000.0, 1.0, 1.0])], kind="double")
    both(spark, odd[:-2])
    both(spark, [])


def test_kept_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 7, "a", "b", "c", "d")], "id long, v array<double>, code int, error string, q string, was string, `a.b` string")
    out, _ = V.compress(df, "id", "v", keep=df.columns, parts=2)
    assert out.columns == [*df.columns, "code_1", "error_1"]
    row = out.first()
    assert (row["code"], row["error"], row["q"], row["a.b"], row["code_1"], row["error_1"]) == (7, "a", "b", "d", [0, 0], 0)


def test_only_what_changed_is_summed(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 1], [0, 1]), ([5, 6, 7, 8], [1, 1], [0, 1]), ([9, 9, 9, 9], [2, 0], None)], "q array<int>, code array<int>, was array<int>")
    got = {tuple(r) for r in V.changes(df, "q", "code", "was", 2, 2).collect()}
    assert got == {(0, 1, 1, 5, 6), (0, 0, -1, -5, -6), (0, 2, 1, 9, 9), (1, 0, 1, 9, 9)}


def test_running_sums_equal_sums_anew(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    out, books = V.compress(df, rounds=3)
    assert books.counts.sum() == 4 * out.count()
    q = df.select(V.whole_numbers(F.col("embedding"), 1024).alias("q"))
    assert books.sums.sum() == q.select(F.explode("q")).agg(F.sum("col")).first()[0]


def test_query_columns(spark, small):
    rows = q12_codes.query(spark, small)
    assert dict(rows.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    first = rows.first()
    assert len(first.code) == 8 and len(first.codebooks_sha256) == 64
