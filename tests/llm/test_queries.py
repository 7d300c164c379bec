"""Every query of the subpackage runs at the smallest scale and equals its SQL where it has one."""

from __future__ import annotations

import pytest

from grainmill.llm import queries, tokens
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, con, name):
    assert not compare(spark, con, name, queries.QUERIES[name], queries.SQL.get(name), sf).startswith("FAIL")


def test_token_limits_against_counting_everything(spark, sf, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    n = dict(zip([r[0] for r in rows], tokens.count_tokens([r[1] for r in rows]), strict=True))
    for name, limit in (("p6_found", 4096), ("p8_found", 1024)):
        assert {r[0] for r in queries.QUERIES[name](spark, sf).collect()} == {d for d, k in n.items() if k > limit}
