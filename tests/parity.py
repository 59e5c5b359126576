"""Run registered queries and their SQL side by side: python -m tests.parity [folder] [name …]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def comparable(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when both frames hold the same rows."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a, b = comparable(ours), comparable(theirs)
    for column in a.columns:
        if str(a[column].dtype) != str(b[column].dtype) and not a[column].isna().any():
            return f"{column}: type {a[column].dtype} against {b[column].dtype}"
        left, right = a[column], b[column]
        unequal = (left != right) & ~(left.isna() & right.isna())
        if unequal.any():
            at = unequal.idxmax()
            return f"{column}: {int(unequal.sum())} differ, first {left[at]!r} against {right[at]!r}"
    return ""


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from themeloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("parity", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            begin = time.time()
            ours = query(spark, folder).toPandas()
            took = time.time() - begin
            if name not in sql:
                print(f"rows  {name:28} {len(ours):8} {took:6.1f}s", flush=True)
                continue
            begin = time.time()
            theirs = con.execute(sql[name]).df()
            found = difference(ours, theirs)
            bad += bool(found)
            print(f"{'DIFF' if found else 'same':5} {name:28} {len(ours):8} {took:6.1f}s  sql {time.time() - begin:5.1f}s {found[:300]}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name:28} {type(error).__name__} {str(error)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
