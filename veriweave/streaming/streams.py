"""The row-local operators, dedup, sync and usage statistics on streams.

Cleaning and enrichment without C9 are projections, so they take a streaming
frame as it is. Sinks can be handed a batch twice: they write under its number, or by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veriweave.functions.encoding import Encoder
from veriweave.operators.cleaning import DEFAULT_CLEANERS, clean, drop_duplicate_rows
from veriweave.operators.enrichment import enrich
from veriweave.plans.corpus import sync_points
from veriweave.session import staged
from veriweave.sources.metadata import ColumnRoles, TableMeta
from veriweave.sources.stores import VersionedTable


def clean_stream(df: DataFrame, meta: TableMeta, roles: ColumnRoles | None = None) -> DataFrame:
    """Clean and enrich a stream."""
    cleaners = [c for c in DEFAULT_CLEANERS if c is not drop_duplicate_rows]
    return enrich(clean(df, meta, roles, cleaners), meta, roles)


def deduplicate_stream(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Drop rows equal in every column to one seen within the delay (C9). State older than that is let go."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(df.columns)


def usage_by_window(log: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Queries, cache hits and mean search time per time window of a log stream."""
    real = ~F.col("cache_hit")
    return (
        log.withWatermark(time, delay)
        .groupBy(F.window(time, width))
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            F.count_if("cache_hit").alias("cache_hits"),
            F.avg(F.when(real, F.col("search_time_ms"))).alias("avg_search_time_ms"),
        )
    )


def write_by_batch(df: DataFrame, path: str) -> DataStreamWriter:
    """Append a stream to a folder per batch. A batch that is handed over again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return df.writeStream.foreachBatch(write)


def write_by_key(df: DataFrame, store: VersionedTable) -> DataStreamWriter:
    """Keep the newest row of each key of a stream in update mode."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written first: the buckets it meets and the rows are of one reading of the batch.
        store.change(staged(batch, "batch"))

    return df.writeStream.outputMode("update").foreachBatch(write)


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> int:
    """Handle all that has arrived, going on from the checkpoint; how many rows came too late for the watermark."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def sync_stream(
    documents: DataFrame,
    store: VersionedTable,
    points: VersionedTable,
    manifest: VersionedTable,
    load: Callable[[], Encoder],
    dimension: int,
    model: str,
    facts: str | None = None,
) -> DataStreamWriter:
    """Upsert arriving documents and bring points and manifest in step, batch by batch.

    A version that is older than the stored one came late and is left out. ``facts``: a folder
    for the rows and late rows of each batch, by its number.

    A batch costs what it changes: buckets of its ids are read and rewritten, no others. A
    batch that is repeated after a failure finds its documents unchanged, so it leaves the
    collection as it is.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # All parts of the newest version of each document; of a part that came twice, one.
        stamp = F.coalesce(F.col("metadata")["updated_at"], F.lit(""))
        newest = batch.groupBy("document_id").agg(F.max(stamp).alias("_newest"))
        latest = batch.join(newest, "document_id").filter(stamp == F.col("_newest")).select(*batch.columns)
        if store.exists():
            stored = store.lookup(newest, "document_id").groupBy("document_id").agg(F.max(stamp).alias("_stored"))
            held = latest.join(stored, "document_id", "left")
            late = F.coalesce(stamp < F.col("_stored"), F.lit(False))
            latest = held.filter(~late).select(*batch.columns)
        latest = staged(latest, "latest")
        if facts:
            counts = batch.agg(F.count(F.lit(1)).alias("row_count")).crossJoin(latest.agg(F.count(F.lit(1)).alias("kept")))
            counts.write.mode("overwrite").parquet(f"{facts.rstrip('/')}/batch={batch_id}")
        keys = ["document_id", "part_no"] if "part_no" in batch.columns else ["document_id"]
        store.change(latest.dropDuplicates(keys), key="document_id")
        ids = latest.select("document_id").distinct()
        sync_points(store.lookup(ids, "document_id"), points, manifest, load, dimension, model, within=ids)

    return documents.writeStream.foreachBatch(apply)
