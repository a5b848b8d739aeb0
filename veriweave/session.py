"""Runtime settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Formatting and date parts must not depend on the cluster's local zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key holding a large share of the rows is split at run time, even where
    # the split costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Limits per key are applied before the shuffle whatever the limit is.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
    # A large table that is joined with the rows a filter leaves is thinned out by their keys ahead of its
    # shuffle, not only from 10 GB on.
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "64MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4GB",
    "spark.sql.optimizer.runtimeFilter.number.threshold": "100",
}


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package, wherever the driver was started from."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    find_package(spark)
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as
    in local tests, a temporary folder is used.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = os.path.join(tempfile.gettempdir(), f"veriweave-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back.

    For a result that several branches of a plan read: it is computed once, its plan
    is not repeated in every branch, and a lost executor does not lose it.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
