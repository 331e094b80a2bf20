"""Runs queries and their SQL over a data folder and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, folder):
    """None if Spark and DuckDB agree, else what differs."""
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    con.execute(sql)
    columns = [d[0] for d in con.description]
    want = rows_of(con.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        extra, lost = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only Spark {extra}; only SQL {lost}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from stallkit.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    for name, query in entry.queries().items():
        if any(name.startswith(a) for a in sys.argv[1:]):
            began = time.time()
            sql = entry.oracle_sql().get(name)
            try:
                said = compare(spark, name, query, sql, folder) if sql else f"no SQL; {query(spark, folder).count()} rows"
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__} {str(e)[:600]}"
            print(f"{name} {time.time() - began:.1f} s: {said or 'ok'}", flush=True)
