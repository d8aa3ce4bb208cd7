"""The pipeline on tables with more columns than documents has, with names that its stages use themselves."""

from __future__ import annotations

import corpus_pipeline as cp

EXTRA = ("votes", "model", "bitmap", "d_", "t_", "node_", "keep_", "copies", "m_", "n_", "cut_", "size")


def test_clashing_columns_pass_through(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in EXTRA])
    plain = docs
    for _, f in cp.STAGES[:-1]:
        wide, plain = f(spark, wide, small), f(spark, plain, small)
        wide, plain = spark.createDataFrame(wide.collect(), wide.schema), spark.createDataFrame(plain.collect(), plain.schema)
        assert wide.columns == [*docs.columns, *EXTRA]
        assert sorted(map(tuple, wide.select(*docs.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert all(r[c] == f"{c}{r.doc_id}" for r in wide.collect() for c in EXTRA)
    tokens = cp.STAGES[-1][1](spark, wide, small)
    assert tokens.columns == ["doc_id", "source", "ids", "n_tokens", "ids_sha256"]
    assert tokens.count() == wide.count()
