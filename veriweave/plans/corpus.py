"""Building documents, the graph and the point collection, and keeping the points in step."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriweave.functions.encoding import Encoder
from veriweave.functions.groups import in_parts
from veriweave.functions.identifiers import name_uuid
from veriweave.operators import documents as docs
from veriweave.operators import vectors
from veriweave.operators.graph import build_graph
from veriweave.session import staged
from veriweave.sources.stores import VersionedTable, document_store


def build_corpus(
    spark: SparkSession, tables: Mapping[str, DataFrame], path: str, built_at: Column
) -> tuple[VersionedTable, DataFrame]:
    """Build, check and store all documents; the store and the build statistics."""
    checked = docs.check_documents(docs.build_documents(tables, built_at))
    store = document_store(spark, path)
    # Invalid documents are stored apart, so the statistics need no second build.
    staged = VersionedTable(spark, f"{path.rstrip('/')}_checked")
    staged.replace(checked)
    checked = staged.read()
    store.replace(docs.savable(checked))
    return store, docs.build_statistics(checked)


def store_graph(spark: SparkSession, tables: Mapping[str, DataFrame], path: str) -> tuple[VersionedTable, VersionedTable]:
    """Build and store the graph."""
    nodes, edges, _ = build_graph(tables)
    node_store = VersionedTable(spark, f"{path}/nodes", partition_by="label")
    edge_store = VersionedTable(spark, f"{path}/edges", partition_by="type")
    node_store.replace(nodes)
    edge_store.replace(edges)
    return node_store, edge_store


def versions(documents: DataFrame, by: str = "content") -> DataFrame:
    """Documents with what tells whether they changed: their content, or their time stamp.

    A row per document. The version of a document in several parts is that of all of
    them, in order.
    """
    meta = F.col("metadata")
    value = meta["updated_at"] if by == "updated_at" else vectors.content_hash(F.col("text"), meta)
    rows = documents.withColumn("version", value)
    if not in_parts(documents):
        return rows
    first = rows.filter("part_no = 0")
    if by == "updated_at":
        return first
    several = rows.filter("part_no > 0").select("document_id").distinct()
    parts = rows.select("document_id", "part_no", "version").join(several, "document_id", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "version"))), lambda p: p["version"])
    whole = parts.groupBy("document_id").agg(F.sha2(F.array_join(ordered, "\x1f"), 256).alias("_whole"))
    return first.join(whole, "document_id", "left").withColumn("version", F.coalesce("_whole", "version")).drop("_whole")


def build_points(
    documents: DataFrame,
    points: VersionedTable,
    manifest: VersionedTable,
    load: Callable[[], Encoder],
    dimension: int,
    model: str,
    by: str = "content",
) -> DataFrame:
    """Encode every document anew and rewrite the manifest; the counters."""
    # Encoding is the costly step: points and counters read one stored result of it.
    checked = staged(vectors.encode_documents(documents, load, dimension), "encoded")
    points.replace(vectors.points_from(checked))
    stored = points.read().select("document_id")
    current = versions(documents, by).join(stored, "document_id", "left_semi")
    manifest.replace(current.select("document_id", "version", F.lit(model).alias("model")))
    return vectors.encoding_counters(checked)


def sync_points(
    documents: DataFrame,
    points: VersionedTable,
    manifest: VersionedTable,
    load: Callable[[], Encoder],
    dimension: int,
    model: str,
    by: str = "content",
    within: DataFrame | None = None,
) -> DataFrame:
    """Bring points and manifest in step with the documents; counts per kind of change.

    Only new and modified documents are encoded, and only buckets of changed ids are
    rewritten. The changes are stored first, so that both rewrites and the counts are of
    one comparison. With ``within`` (document ids) nothing but those is compared and no
    other row of the manifest is read: ``documents`` then has what the store holds of them.
    """
    known = versions(documents, by)
    old = manifest.read() if within is None else manifest.lookup(within, "document_id")
    changes = staged(vectors.detect_changes(known, old, model), "changes")
    pending = changes.filter(F.col("change").isin("new", "modified"))
    gone = changes.filter("change = 'deleted'").select("document_id")
    todo = documents.join(pending.select("document_id"), "document_id", "left_semi")
    fresh = staged(vectors.points_of(todo, load, dimension), "points")
    points.change(fresh, gone.select(name_uuid(F.col("document_id")).alias("point_id")), "point_id")
    stored = points.lookup(pending.select(name_uuid(F.col("document_id")).alias("point_id")), "point_id").select("document_id")
    encoded = pending.join(stored, "document_id", "left_semi")
    # Of what was to be encoded, what has no point is not in step yet and keeps its row.
    manifest.change(encoded.select("document_id", "version", F.lit(model).alias("model")), gone, "document_id")
    return vectors.change_counts(changes)
