"""Reading and writing relational tables and reports."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.sources.metadata import union_all

# The domain tables, parents before children.
LOAD_ORDER = (
    "District",
    "Unit",
    "Court",
    "Employee",
    "CaseMaster",
    "ComplainantDetails",
    "Victim",
    "Accused",
    "ActSectionAssociation",
    "ChargesheetDetails",
    "ArrestSurrender",
)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Read a database table; with a partition column, in parallel ranges of it.

    The bounds only steer the ranges, they filter nothing.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def read_tables(spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Lazy frames of the named tables; a table that cannot be read fails the call."""
    suffix = {"parquet": ".parquet", "orc": ".orc", "json": ".json", "csv": ".csv"}[fmt]
    return {name: spark.read.format(fmt).load(f"{folder.rstrip('/')}/{name}{suffix}") for name in names}


def read_csv_tables(
    spark: SparkSession,
    folder: str,
    schemas: Mapping[str, T.StructType] | None = None,
    names: Sequence[str] = LOAD_ORDER,
    multi_line: bool = False,
) -> tuple[dict[str, DataFrame], list[str]]:
    """Frames of the CSV files that exist, in load order, and the names of the missing ones.

    Types are inferred only where no schema is given, since inference reads the file twice.
    Values with line breaks need ``multi_line``, which makes each file the work of one task.
    """
    path_type = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    frames, missing = {}, []
    for name in names:
        path = f"{folder.rstrip('/')}/{name}.csv"
        location = path_type(path)
        if not location.getFileSystem(conf).exists(location):
            missing.append(name)
            continue
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        schema = (schemas or {}).get(name)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        frames[name] = reader.csv(path)
    return frames, missing


def load_tables(frames: Mapping[str, DataFrame], database: str, mode: str = "overwrite") -> None:
    """Save frames as tables: ``overwrite`` replaces (S4), ``append`` adds to what is there."""
    for name, df in frames.items():
        target = f"{database}.{name}"
        if mode == "append" and df.sparkSession.catalog.tableExists(target):
            df = df.select(*[F.col(f"`{c}`") for c in df.sparkSession.table(target).columns])
        df.write.mode(mode).saveAsTable(target)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, counted exactly."""
    return union_all([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ])


def load_clean_table(df: DataFrame, name: str, database: str, keep_if_empty: bool = False) -> int:
    """Replace the cleaned table and return the rows written.

    With ``keep_if_empty`` an empty frame leaves the old table as it is. The rows
    are counted while they are written, so the frame is computed once.
    """
    if keep_if_empty and df.isEmpty():
        return 0
    counted = Observation(f"load_{name}")
    (
        df.observe(counted, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("overwriteSchema", "true")
        .saveAsTable(f"{database}.clean_{name}")
    )
    return int(counted.get["rows"])


def load_clean_tables(
    spark: SparkSession, frames: Mapping[str, DataFrame], database: str, keep_if_empty: bool = False
) -> DataFrame:
    """Replace every cleaned table; rows written per table."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    rows = [(name, load_clean_table(df, name, database, keep_if_empty)) for name, df in frames.items()]
    return spark.createDataFrame(rows, "table_name string, row_count bigint")


def load_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None) -> None:
    """Replace the rows of a database table and keep its definition."""
    df.write.mode("overwrite").option("truncate", "true").jdbc(url, table, properties=dict(properties or {}))


def write_report(rows: DataFrame, folder: str, name: str) -> str:
    """Write a report table as JSON lines and return where."""
    path = os.path.join(folder, name)
    rows.write.mode("overwrite").json(path)
    return path
