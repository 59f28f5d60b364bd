"""Compare registered queries with their SQL: ``python tests/oracle_check.py [folder] [query ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    """Comparable form: numbers of all kinds alike."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark, con, name: str, folder: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    df = entry_points.queries()[name](spark, folder)
    result = con.execute(entry_points.oracle_sql()[name])
    sql_columns = [c[0] for c in result.description]
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} against {sorted(sql_columns)}"
    kinds = [(c[0], str(c[1])) for c in result.description]
    loose = [kind for kind in kinds if any(word in kind[1] for word in ("DECIMAL", "HUGEINT"))]
    if loose:
        return f"types {loose}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(sql_columns, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    from tests.conftest import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = build_session(), connect(folder)
    names = sys.argv[2:] or list(entry_points.queries())
    known = entry_points.oracle_sql()
    for name in names:
        start = time.time()
        if name not in known:
            outcome = f"no SQL, {entry_points.queries()[name](spark, folder).count()} rows"
        else:
            outcome = differences(spark, con, name, folder) or "ok"
        print(f"{name:28s} {time.time() - start:6.1f}s  {outcome}"[:600], flush=True)


if __name__ == "__main__":
    main()
