"""Every core query runs at the smallest scale and equals its SQL in DuckDB."""

from __future__ import annotations

import importlib

import pytest

from tests.oracle_check import compare, connect

MODULES = ("quality_queries", "analysis_queries", "feature_queries", "learning_queries")
ALL = [(m, q) for m in MODULES for q in importlib.import_module(f"grainmill.plans.{m}").QUERIES]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize(("module", "name"), ALL, ids=[q for _, q in ALL])
def test_query(spark, sf, con, module, name):
    m = importlib.import_module(f"grainmill.plans.{module}")
    assert not compare(spark, con, name, m.QUERIES[name], m.SQL.get(name), sf).startswith("FAIL")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
