"""Compare registered queries with their SQL: ``python -m tests.oracle [--sf DIR] [name prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def cell(value):
    """One form per value, so that integer widths and number types do not matter."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, name, folder):
    """Empty text when both sides agree, else what differs."""
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    start = time.time()
    df = run(spark, folder)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return "" if got else "no rows", took, sum(got.values()), df
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want_columns, want = rows_of(columns, cursor.fetchall())
    types = {d[0]: str(d[1]) for d in cursor.description}
    wide = [c for c, t in types.items() if "HUGEINT" in t]
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", took, sum(got.values()), df
    if wide:
        return f"HUGEINT columns {wide}", took, sum(got.values()), df
    if got != want:
        extra, lack = got - want, want - got
        sample = "\n".join(
            [f"   spark {r}"[:1500] for r in list(extra)[:2]] + [f"   duck  {r}"[:1500] for r in list(lack)[:2]]
        )
        return f"{sum(extra.values())} extra, {sum(lack.values())} missing of {sum(want.values())}\n{sample}", took, 0, df
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    note = [f"{c}: {t} / {types[c]}" for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    return f"types differ: {note}" if note else "", took, sum(got.values()), df


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        folder, args = args[1], args[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in entry.queries():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            problem, took, n, _ = compare(spark, name, folder)
        except Exception as error:  # a failing query is reported, the others still run
            problem, took, n = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, 0
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name:28s} rows={n:<7d} {took:6.2f}s {problem}", flush=True)
    print(f"{bad} of the compared queries differ")
