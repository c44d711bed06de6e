"""Run registered queries in Spark and DuckDB and compare rows (order-free)."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb
import pandas as pd


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, pd.Timestamp):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")
    return v


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, fn, sql: str | None):
    started = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return len(got), None, took, ""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), False, took, f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {n: str(t) for n, t in ((c[0], c[1]) for c in cur.description)}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        note = "" if got else "EMPTY"
        bad = [f"{n}: {t} vs {kinds[n]}" for n, t in df.dtypes if not _same_type(t, kinds[n])]
        return len(got), True, took, note + " ".join(bad)
    only_a, only_b = list((a - b).items()), list((b - a).items())
    note = (f"{len(got)} vs {len(want)} rows, {sum(v for _, v in only_a)} differ; {sorted(df.columns)}\n"
            f"   spark {sorted(only_a, key=str)[:3]}\n   sql   {sorted(only_b, key=str)[:3]}")
    return len(got), False, took, note


def _same_type(spark_type: str, duck_type: str) -> bool:
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
             "boolean": "BOOLEAN", "int": "INTEGER"}
    return pairs.get(spark_type) == duck_type


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from verimet.catalog import ORACLES, QUERIES
    from verimet.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.log.level": "ERROR"})
    con = duck(folder)
    failed = []
    for name in wanted:
        try:
            n, ok, took, note = compare(spark, con, folder, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # keep going, report at the end
            n, ok, took, note = -1, False, 0.0, f"{type(error).__name__}: {str(error)[:700]}"
        if ok is False:
            failed.append(name)
        print(f"{'ok ' if ok else '-- ' if ok is None else 'BAD'} {name:28s} {n:8d} {took:6.2f}s {note}", flush=True)
    print(len(wanted) - len(failed), "fine;", "failed:", failed)
