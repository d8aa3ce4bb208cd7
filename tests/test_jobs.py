"""The jobs: over growing input, run again, replayed, from the command line, and against their SQL."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import cell_atlas, passage_search
from jobs import queries as jobs
from jobs.common import HERE, load
from nichefold.sources.stage import drop_tables

ROOT = Path(HERE).parent


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_job_against_sql(spark, duck, small, tmp_path, name):
    jobs.queries()[name](spark, small).write.parquet(str(tmp_path / "out"))
    drop_tables()
    sql = jobs.oracle_sql()[name]
    columns = ", ".join(f'"{c}"' for c in sorted(duck.sql(sql).columns))
    duck.sql(f"CREATE OR REPLACE TABLE w AS SELECT {columns} FROM ({sql})")
    duck.sql(f"CREATE OR REPLACE TABLE g AS SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    assert [r[:2] for r in duck.sql("DESCRIBE w").fetchall()] == [r[:2] for r in duck.sql("DESCRIBE g").fetchall()]
    assert duck.sql("SELECT count(*) FROM w").fetchall() == duck.sql("SELECT count(*) FROM g").fetchall()
    assert duck.sql("SELECT * FROM w EXCEPT ALL SELECT * FROM g").fetchall() == []


def rows(df) -> list:
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def files(folder) -> dict[str, float]:
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def put(df, folder, name) -> None:
    """One Parquet file of df in the folder, as a copy that lands there whole."""
    part = f"{folder}-{name}"
    df.coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    next(Path(part).glob("*.parquet")).rename(f"{folder}/{name}.parquet")


@pytest.fixture
def search(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.limit(1).select(F.lit(900).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    nameless = docs.limit(1).select(F.lit(901).cast("long").alias("doc_id"), F.repeat(F.lit("a long word and "), 40).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    parts = [docs.filter("doc_id < 80"), docs.filter("doc_id BETWEEN 80 AND 150"), docs.filter("doc_id > 150").unionByName(odd).unionByName(nameless)]
    queries = f"{small}/benchmark.parquet"
    return parts, queries, str(tmp_path)


def test_search_takes_only_what_is_new(spark, search):
    parts, queries, at = search
    for i, part in enumerate(parts):
        put(part, f"{at}/in", f"part{i}")
        before = files(f"{at}/out/index")
        passage_search.run(spark, f"{at}/in", queries, f"{at}/out", f"{at}/mark", {"top": 7})
        after = files(f"{at}/out/index")
        assert before.items() <= after.items()  # what was there wasn't written again
        new = spark.read.parquet(f"{at}/out/index").filter(F.col("batch") == i)
        assert {r.doc_id for r in new.collect()} <= {r.doc_id for r in part.collect()}
    again = files(f"{at}/out/index")
    best = files(f"{at}/out/best")
    result = rows(passage_search.result(spark, f"{at}/out"))
    passage_search.run(spark, f"{at}/in", queries, f"{at}/out", f"{at}/mark", {"top": 7})
    assert files(f"{at}/out/index") == again
    assert files(f"{at}/out/best") == best
    assert rows(passage_search.result(spark, f"{at}/out")) == result
    passage_search.run(spark, f"{at}/in", queries, f"{at}/whole", f"{at}/whole-mark", {"top": 7})
    assert rows(passage_search.result(spark, f"{at}/whole")) == result
    ids = [r[1] for r in {(r[1], r[1]) for r in result}]
    assert 900 not in ids
    assert 901 in ids


def test_search_replays_a_batch_that_was_not_committed(spark, search):
    parts, queries, at = search
    put(parts[0], f"{at}/in", "a")
    passage_search.run(spark, f"{at}/in", queries, f"{at}/out", f"{at}/mark")
    put(parts[1], f"{at}/in", "b")
    passage_search.take_new(spark, f"{at}/in", f"{at}/out", f"{at}/mark", passage_search.DEFAULTS)
    os.remove(f"{at}/mark/commits/1")  # as if the driver had ended between writing and committing
    for crc in Path(f"{at}/mark/commits").glob(".1.*"):
        crc.unlink()
    passage_search.run(spark, f"{at}/in", queries, f"{at}/out", f"{at}/mark")
    passage_search.run(spark, f"{at}/in", queries, f"{at}/whole", f"{at}/whole-mark")
    assert rows(passage_search.result(spark, f"{at}/out")) == rows(passage_search.result(spark, f"{at}/whole"))


def test_search_scores_changed_passages_against_all_batches(spark, search):
    parts, queries, at = search
    for i in range(2):
        put(parts[i], f"{at}/in", f"part{i}")
        passage_search.run(spark, f"{at}/in", queries, f"{at}/out", f"{at}/mark")
    fewer = spark.read.parquet(queries).filter("item_id < 3").unionByName(spark.createDataFrame([(77, None)], "item_id long, text string"))
    fewer.write.parquet(f"{at}/queries")
    index = files(f"{at}/out/index")
    passage_search.run(spark, f"{at}/in", f"{at}/queries", f"{at}/out", f"{at}/mark")
    assert files(f"{at}/out/index") == index
    got = spark.read.parquet(f"{at}/out/ranking")
    assert {r.query_id for r in got.collect()} == {0, 1, 2, 77}
    passage_search.run(spark, f"{at}/in", f"{at}/queries", f"{at}/whole", f"{at}/whole-mark")
    assert rows(got) == rows(spark.read.parquet(f"{at}/whole/ranking"))


def test_search_of_an_empty_table(spark, search):
    parts, queries, at = search
    put(parts[0].limit(0), f"{at}/in", "none")
    passage_search.run(spark, f"{at}/in", queries, f"{at}/out", f"{at}/mark")
    assert passage_search.result(spark, f"{at}/out").count() == 0


def test_atlas_replaces_its_sample_and_leaves_others(spark, small, tmp_path):
    out = str(tmp_path / "atlas")
    config = {"sample": "one", "pool_size": 60}
    cell_atlas.run(spark, small, out, config)
    first = rows(cell_atlas.result(spark, out))
    cell_atlas.run(spark, small, out, config)
    assert rows(cell_atlas.result(spark, out)) == first
    pool = spark.read.parquet(f"{out}/cells").filter("pool_idx IS NOT NULL")
    assert 50 <= pool.count() <= 70
    assert sorted(r["count"] for r in pool.groupBy("fold").count().collect())[0] >= pool.count() // 5
    cell_atlas.run(spark, small, out, {"sample": "two", "min_counts": 600})
    assert rows(cell_atlas.result(spark, out).filter("sample = 'one'")) == first
    n = cell_atlas.result(spark, out).filter("sample = 'two'")
    assert 0 < n.count() == n.first().n_cells_qc < 150
    os.makedirs(f"{out}/cells/sample=two/cell_type=Ghost")
    pool.limit(1).drop("sample", "cell_type").write.mode("overwrite").parquet(f"{out}/cells/sample=two/cell_type=Ghost")
    cell_atlas.run(spark, small, out, {"sample": "two", "min_counts": 600})
    assert cell_atlas.result(spark, out).filter("cell_type = 'Ghost'").count() == 0
    drop_tables()


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"top": 3}))
    assert load(spark, f"file://{path}", passage_search.DEFAULTS) == passage_search.DEFAULTS | {"top": 3}
    path.write_text(json.dumps({"tap": 3}))
    with pytest.raises(ValueError, match="tap"):
        load(spark, f"file://{path}", passage_search.DEFAULTS)
    for job in (passage_search, cell_atlas):
        assert load(spark, f"file://{HERE}/{job.__name__.split('.')[-1]}.json", job.DEFAULTS) == job.DEFAULTS


def test_command_line(spark, search):
    parts, queries, at = search
    put(parts[0], f"{at}/in", "a")
    call = [sys.executable, "-m", "jobs.passage_search", "--documents", f"{at}/in", "--queries", queries, "--out", f"{at}/out", "--checkpoint", f"{at}/mark"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run(call, cwd=ROOT, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.search(r"batch 0: read 80 rows", done.stderr)
    assert re.search(r"wrote \d+ rows to .*/ranking", done.stderr)
    assert passage_search.result(spark, f"{at}/out").select("doc_id").distinct().count() > 70


def test_jobs_stand_alone():
    for p in [*Path(HERE).glob("*.py"), Path(__file__)]:
        imported = re.findall(r"^\s*(?:from|import) +(\S+)", p.read_text(), re.M)
        assert not [m for m in imported if m.startswith(("nichefold.llm", "corpus_pipeline"))]
