"""The driver's contract."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 68
    assert {"baseline", "query_id", "mAP", "nDCG@10", "task_type", "split"} <= set(df.columns)


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 60


def test_parts_that_are_absent_are_left_out(monkeypatch):
    real = importlib.import_module

    def absent(name, *a):
        if name.startswith(("nichefold.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", absent)
    assert not [q for q in entry.queries() if q[:2] == "op" and q[2].isdigit() or q == "pipeline"]


def test_other_import_errors_pass_through(monkeypatch):
    def broken(name, *a):
        raise ModuleNotFoundError(name="somelibrary")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_nothing_else_needs_the_optional_part():
    assert not [m for m in sys.modules if m.startswith("nichefold.") and not m.startswith("nichefold.llm") and any(getattr(v, "__name__", "").startswith("nichefold.llm") for v in vars(sys.modules[m]).values() if hasattr(v, "__spec__"))]
