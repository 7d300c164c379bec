"""The bad-row operator against hand-made lines and against its own strict parser."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.operators import badrows as b

CASES = [
    ("csv", "u1,1,23,5.5,Orva,\"a,b\",note", None),
    ("csv", "  u1 , 1 , \\N ,, Orva ,\"a\"\"b\" , \"\"  ", None),
    ("csv", "u1,,23,5.5,Orva,a,n", None),
    ("csv", "u1,1,23,5.5,Orva,\"a,b", "quotes"),
    ("csv", "u1,1,23,5.5,Orva,\"a\"x,n", "quotes"),
    ("csv", "u1,1,23,5.5,Or\"va,a,n", "quotes"),
    ("csv", "u1\"", "quotes"),
    ("csv", "u1,1,23,5.5,Orva,a", "columns"),
    ("csv", "u1,1,23,5.5,Orva,a,b,c", "columns"),
    ("csv", "", "columns"),
    ("csv", None, "columns"),
    ("csv", "u1,2,23,5.5,Orva,a,n", "label"),
    ("csv", "u1,nan,x,5.5,Orva,a,n", "label"),
    ("csv", "u1,1,nan,5.5,Orva,a,n", "features"),
    ("csv", "u1,1,1e999,5.5,Orva,a,n", "features"),
    ("csv", "u1,1,٤٥,5.5,Orva,a,n", "features"),
    ("csv", "u1,1,0x1F,5.5,Orva,a,n", "features"),
    ("csv", "u1,1,1_000,5.5,Orva,a,n", "features"),
    ("csv", "u1,+1.0e0,.5,5.,Orva,a,n", None),
    ("sparse", "label:1,city:Orva,age:23", None),
    ("sparse", "label:1", None),
    ("sparse", "label:1,city", "columns"),
    ("sparse", "label:1,a:b:c", "columns"),
    ("sparse", "label:1,,age:2", "columns"),
    ("sparse", " ", "columns"),
    ("sparse", "city:Orva,age:2", "label"),
    ("sparse", "label:,age:2", "label"),
    ("sparse", "label:-1,age:", "features"),
    ("sparse", "label:0,bid:12%", "features"),
    ("sparse", "label:0,city:", None),
    ("libsvm", "1 3:2.0 1:1.5", None),
    ("libsvm", "  -1\t3:2.0   1:1e3 ", None),
    ("libsvm", "1", "columns"),
    ("libsvm", "1 3:2:1", "columns"),
    ("libsvm", "1 3:", "features"),
    ("libsvm", "1 :3", "features"),
    ("libsvm", "1 9223372036854775807:1", None),
    ("libsvm", "1 9223372036854775808:1", "features"),
    ("libsvm", "1 -3:1", "features"),
    ("libsvm", "1 +3:1", "features"),
    ("libsvm", "yes 3:1", "label"),
    ("libsvm", "１ 3:1", "label"),
    ("libsvm", "1 3:-Infinity", "features"),
    ("libffm", "0 1:2:3 4:5:-6.5", None),
    ("libffm", "0 1:2", "columns"),
    ("libffm", "0.5 1:2:3", "label"),
    ("libffm", "1 1:x7:3", "features"),
    ("other", "1 1:2", "columns"),
    (None, "1 1:2", "columns"),
]


@pytest.mark.parametrize(("feed", "line", "reason"), CASES)
def test_strict(feed, line, reason):
    assert b.parse_strict(feed, line)["reason"] == reason


@pytest.mark.parametrize("feed", list(b.FAST))
def test_block_equals_strict(feed):
    lines = [x for f, x, _ in CASES if f == feed] * 3
    strict: list[int] = []
    got = b.parse_block(feed, pa.array(lines, pa.string()), strict=strict).to_pylist()
    assert got == [b.parse_strict(feed, x) for x in lines]
    assert {i for i, x in enumerate(lines) if got[i]["reason"]} <= set(strict)


def test_a_block_whose_kernel_raises_is_bisected_to_single_lines(monkeypatch):
    whole = b.FAST["libsvm"]

    def raising(lines):
        if any(x.startswith("!") for x in lines.to_pylist()):
            raise pa.ArrowInvalid("of the whole block")
        return whole(lines)

    monkeypatch.setitem(b.FAST, "libsvm", raising)
    lines = [f"1 {i}:2" for i in range(200)]
    lines[57] = lines[140] = "! 1:2"
    calls: list[int] = []
    strict: list[int] = []
    got = b.parse_block("libsvm", pa.array(lines), calls, strict).to_pylist()
    assert got == [b.parse_strict("libsvm", x) for x in lines]
    assert strict == [57, 140] and len(calls) < 40


def test_few_lines_reach_the_strict_parser(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/raw_samples.parquet").to_pandas()
    strict: list[int] = []
    for feed, own in t.groupby("feed"):
        b.parse_block(feed, pa.array(own["line"], pa.string()), strict=strict)
    assert len(strict) < 0.1 * len(t)


@pytest.mark.parametrize("feed", list(b.FAST))
def test_clean_block_takes_one_call(feed):
    lines = [x for f, x, r in CASES if f == feed and r is None and "  " not in x and "\t" not in x] * 40
    calls: list[int] = []
    b.parse_block(feed, pa.array(lines, pa.string()), calls)
    assert calls == [len(lines)]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(list(b.FAST)), st.lists(st.text(alphabet='ab"1,:. \t\\N-e+5\n\r', max_size=14), min_size=1, max_size=6))
def test_fast_never_disagrees(feed, tails):
    start = {"csv": "u,1,2,3,c,", "sparse": "label:1,", "libsvm": "1 2:3", "libffm": "1 1:2:3"}[feed]
    lines = [start + t for t in tails] + tails
    assert b.parse_block(feed, pa.array(lines)).to_pylist() == [b.parse_strict(feed, x) for x in lines]


def test_frame_with_clashing_columns_and_nulls(spark):
    rows = [(i, f, x, "clash", 1.0) for i, (f, x, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "line_no bigint, feed string, line string, reason string, label double")
    got = {r["line_no"]: r["reason"] for r in b.parse_lines(df).collect()}
    assert got == {i: c[2] for i, c in enumerate(CASES)}
    assert {r["line_no"] for r in b.failed_lines(df).collect()} | {r["line_no"] for r in b.loaded_lines(df).collect()} == set(got)
    assert b.parse_lines(df.limit(0)).count() == 0


def test_very_long_line_and_repeats(spark):
    long = "1 " + " ".join(f"{i}:1" for i in range(50_000))
    df = spark.createDataFrame([(1, "libsvm", long), (1, "libsvm", long), (2, "csv", "x" * 1_000_000)], "line_no bigint, feed string, line string")
    got = b.parse_lines(df).selectExpr("line_no", "reason", "size(ids) n").collect()
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] == 1) == [(1, None, 50_000)] * 2
    assert [r[1] for r in got if r[0] == 2] == ["columns"]
