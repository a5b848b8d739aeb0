"""Chunked scans: which chunks a range opens, empty ranges, and a chunk that cannot be read."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veriweave.sources.chunks import overlapping, read_chunks, write_chunks


def table(spark, n=1000):
    rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.concat(F.lit("t"), "id").alias("t"))
    return rows.unionByName(spark.createDataFrame([(None, 1, None)], "k bigint, v bigint, t string"))


def test_a_scan_in_chunks_is_the_plain_table(spark, tmp_path):
    write_chunks(table(spark), "k", str(tmp_path / "c"), 100)
    df = read_chunks(spark, str(tmp_path / "c"))
    assert df.schema == table(spark).schema
    assert sorted(map(str, df.collect())) == sorted(map(str, table(spark).collect()))
    assert df.filter("k = 3").count() == 1 and df.count() == 1001
    for low, high, n in ((250, 259, 10), (None, 9, 10), (990, None, 10), (5000, None, 0), (7, 7, 1), (9, 8, 0)):
        assert read_chunks(spark, str(tmp_path / "c"), low, high).count() == n, (low, high)


def test_a_range_opens_its_chunks_only(spark, tmp_path):
    write_chunks(table(spark), "k", str(tmp_path / "c"), 100)
    whole, part = read_chunks(spark, str(tmp_path / "c")), read_chunks(spark, str(tmp_path / "c"), 500, 501)
    assert whole.rdd.getNumPartitions() >= 8 and part.rdd.getNumPartitions() <= 2
    # Every other chunk is gone, and nobody asks for it.
    data = tmp_path / "c" / "data"
    for name in [p for p in os.listdir(data) if p.endswith(".parquet")]:
        if not {500, 501} & set(pq.read_table(data / name, columns=["k"])["k"].to_pylist()):
            (data / name).unlink()
    assert sorted(r["t"] for r in part.collect()) == ["t500", "t501"]
    with pytest.raises(Exception, match="cannot be read"):
        whole.count()


def test_chunks_that_overlap_a_range():
    chunks = [{"file": str(i), "low": 10 * i, "high": 10 * i + 9} for i in range(5)] + [{"file": "nulls", "low": None, "high": None}]
    left = lambda low, high: [c["file"] for c in overlapping(chunks, low, high)]
    assert left(None, None) == ["0", "1", "2", "3", "4", "nulls"]
    assert left(19, 19) == ["1"] and left(30, 40) == ["3", "4"] and left(None, 0) == ["0"] and left(49, None) == ["4"] and left(99, None) == []


def test_a_table_without_rows(spark, tmp_path):
    write_chunks(table(spark).limit(0), "k", str(tmp_path / "c"))
    df = read_chunks(spark, str(tmp_path / "c"))
    assert df.count() == 0 and df.columns == ["k", "v", "t"]
