"""A large table read in chunks of its key, as a Spark data source.

A chunked table is a folder of Parquet files, each a range of the key, with a list of their
ranges. The source reads a chunk per task. A range of keys makes tasks of the chunks that can
hold some of it, and of no others. No chunk at all gives an empty frame of the right columns; a
chunk that cannot be read fails the scan and names its range.

    write_chunks(orders, "o_orderkey", path)
    read_chunks(spark, path, 100, 200)

The range is an argument. Spark can push filters to a Python source too, but the chunks it leaves
then stay left out for later scans of the same frame without the filter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veriweave.functions.groups import partitions_of

CHUNK_ROWS = 1_000_000
_LIST, _DATA = "chunks", "data"


def write_chunks(df: DataFrame, key: str, path: str, chunk_rows: int = CHUNK_ROWS) -> None:
    """Write a table in chunks by ranges of a whole-number key, and the list of their ranges.

    Rows with one key stay together, so a key of many rows makes a larger chunk. A missing
    key comes in the first chunk and is met only by scans without a condition on the key.
    """
    root = path.rstrip("/")
    dealt = df.repartitionByRange(partitions_of(df, chunk_rows), key).sortWithinPartitions(key)
    dealt.write.parquet(f"{root}/{_DATA}")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{_DATA}")
    ranges = stored.groupBy(F.input_file_name().alias("file")).agg(
        F.min(key).cast("bigint").alias("low"), F.max(key).cast("bigint").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("missing")
    )
    facts = F.struct(F.lit(key).alias("key"), F.lit(df.schema.json()).alias("schema"))
    # A row per chunk, and one that tells the columns even of a table without rows.
    listed = ranges.select(F.to_json(F.struct("file", "low", "high", "n", "missing")).alias("value"))
    listed.unionByName(df.sparkSession.range(1).select(F.to_json(facts).alias("value"))).coalesce(1).write.text(f"{root}/{_LIST}")


def overlapping(chunks: list[dict[str, Any]], low: int | None, high: int | None) -> list[dict[str, Any]]:
    """The chunks that can hold a key from ``low`` to ``high``; all of them where neither is given."""
    if low is None and high is None:
        return chunks
    known = [c for c in chunks if c["low"] is not None]
    return [c for c in known if (low is None or c["high"] >= low) and (high is None or c["low"] <= high)]


def read_chunks(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The table, or its rows with a key from ``low`` to ``high``, lazily."""
    spark.dataSource.register(ChunkedTable)
    # The list is read by Spark, wherever it lies; chunks are read where the tasks run.
    rows = [json.loads(r["value"]) for r in spark.read.text(f"{path.rstrip('/')}/{_LIST}").collect()]
    facts = next(r for r in rows if "schema" in r)
    chunks = json.dumps(overlapping([r for r in rows if "file" in r], low, high))
    df = spark.read.format("chunked").schema(T.StructType.fromJson(json.loads(facts["schema"]))).option("chunks", chunks).load()
    for bound, holds in ((low, F.col(facts["key"]) >= low), (high, F.col(facts["key"]) <= high)):
        df = df if bound is None else df.filter(holds)
    return df


@dataclass
class Chunk(InputPartition):
    """A file and the range of keys in it."""

    file: str
    low: int | None
    high: int | None


class ChunkedTable(DataSource):
    """The format ``chunked``; option: chunks as JSON."""

    @classmethod
    def name(cls) -> str:
        return "chunked"

    def schema(self) -> str:
        raise ValueError("read it by read_chunks, which knows its columns")

    def reader(self, schema: T.StructType) -> ChunkReader:
        return ChunkReader(schema, json.loads(self.options["chunks"]))


class ChunkReader(DataSourceReader):
    """Plans a task for each chunk."""

    def __init__(self, schema: T.StructType, chunks: list[dict[str, Any]]) -> None:
        self.schema, self.chunks = schema, chunks

    def partitions(self) -> list[Chunk]:
        # A source must have a task; without chunks it is one that has nothing to read.
        return [Chunk(c["file"], c["low"], c["high"]) for c in self.chunks] or [Chunk("", None, None)]

    def read(self, partition: Chunk) -> Iterator:
        if not partition.file:
            return
        import pyarrow.parquet as pq
        from pyarrow import fs

        names = [f.name for f in self.schema.fields]
        try:
            files, name = fs.FileSystem.from_uri(partition.file)
            with files.open_input_file(name) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=10_000, columns=names):
                    yield batch.select(names)
        except Exception as cause:
            raise RuntimeError(f"chunk from {partition.low} to {partition.high} cannot be read: {partition.file}") from cause
