"""python tests/oracle_check.py [--sf DIR] [NAME...]: each query against its SQL in DuckDB, as sorted rows with column names."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str):  # noqa: ANN201
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def _norm(x: object) -> object:
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_norm, x))
    return x


def mixes_nan_and_null(columns: list[str], rows: list) -> list[str]:
    """Columns with both NaN and NULL. A comparison through data frames can't tell the two apart, so a query must give only one of them."""
    nan = {c for r in rows for c, x in zip(columns, r, strict=True) if isinstance(x, float) and math.isnan(x)}
    return sorted(nan & {c for r in rows for c, x in zip(columns, r, strict=True) if x is None})


def rows_of(columns: list[str], rows: list) -> list:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str:  # noqa: ANN001
    df = query(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return f"rows only ({len(got)})"
    cur = con.execute(sql)
    want_cols, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"FAIL columns {sorted(df.columns)} {sorted(want_cols)}"
    if mixed := mixes_nan_and_null(df.columns, got) + mixes_nan_and_null(want_cols, want):
        return f"FAIL NaN and NULL in {mixed}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        return f"FAIL {len(a)} rows against {len(b)}; only here {[x for x in a if x not in b][:3]}; only SQL {[x for x in b if x not in a][:3]}"
    return f"ok ({len(a)} rows)"


if __name__ == "__main__":
    import __spark_entry__ as e

    from grainmill.session import build_session

    args = sys.argv[1:]
    sf = args.pop(1) if args[:1] == ["--sf"] else "/root/testdata/sf0.01"
    args = [a for a in args if a != "--sf"]
    spark = build_session(master=f"local[{os.cpu_count()}]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(sf), e.queries(), e.oracle_sql()
    bad = 0
    for n in args or qs:
        for name in [q for q in qs if q == n or (n.endswith("*") and q.startswith(n[:-1]))]:
            t = time.time()
            try:
                said = compare(spark, con, name, qs[name], sqls.get(name), sf)
            except Exception as x:  # noqa: BLE001
                said = f"FAIL {type(x).__name__}: {str(x)[:600]}"
            bad += said.startswith("FAIL")
            print(f"{name}: {said} in {time.time() - t:.1f} s", flush=True)
    print("FAILED" if bad else "all ok", bad)
