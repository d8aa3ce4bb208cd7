"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from nichefold.plans import catalog
from nichefold.sources.stage import drop_tables

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: tests/test_baselines.py and tests/test_communities.py hold these against numpy and slow versions.
COVERED = {"feature_communities", "baseline_scores", "baseline_metrics", "label_validation"}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - COVERED))
def test_query(spark, duck, small, tmp_path, name):
    out = str(tmp_path / "out")
    QUERIES[name](spark, small).write.parquet(out)
    drop_tables()
    got = duck.sql(f"SELECT * FROM '{out}/*.parquet'")
    if name not in SQL:
        assert got.limit(1).fetchall()
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    duck.sql(f"CREATE OR REPLACE TABLE w AS SELECT {columns} FROM ({SQL[name]})")
    duck.sql(f"CREATE OR REPLACE TABLE g AS SELECT {columns} FROM '{out}/*.parquet'")
    assert [r[1] for r in duck.sql("DESCRIBE w").fetchall()] == [r[1] for r in duck.sql("DESCRIBE g").fetchall()]
    assert duck.sql("SELECT count(*) FROM w").fetchall() == duck.sql("SELECT count(*) FROM g").fetchall()
    assert duck.sql("SELECT * FROM w EXCEPT ALL SELECT * FROM g LIMIT 3").fetchall() == []
