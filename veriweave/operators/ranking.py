"""Composite ranking and its explanation.

Hits: query_id, rank (of the search), score, document_id, document_type,
text_preview, metadata STRUCT. Triples: query_id, triple_no, node, relationship,
connected_to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.functions.dates import parse_iso
from veriweave.functions.numbers import clamp01, round_half_up

# Weight of each signal, and how much each kind of document counts.
WEIGHTS = {
    "similarity": 0.60,
    "graph_confidence": 0.15,
    "type_priority": 0.10,
    "metadata_richness": 0.10,
    "freshness": 0.05,
}
TYPE_PRIORITY = {
    "case_summary": 1.0,
    "accused_profile": 0.9,
    "victim_profile": 0.85,
    "officer_profile": 0.7,
    "district_summary": 0.6,
    "court_summary": 0.5,
}
OTHER_TYPE_PRIORITY = 0.3
MAX_RESULTS = 20


def similarity(score: Column) -> Column:
    """Cosine limited to 0..1."""
    return clamp01(score)


def type_priority(document_type: Column) -> Column:
    """How much the kind of document counts."""
    value = F.lit(OTHER_TYPE_PRIORITY)
    for kind, priority in TYPE_PRIORITY.items():
        value = F.when(document_type == kind, F.lit(priority)).otherwise(value)
    return value


def metadata_richness(metadata: Column, schema: T.StructType) -> Column:
    """Share of the metadata fields that have a value."""
    if not schema.fields:
        return F.lit(0.0)
    filled = F.lit(0)
    for f in schema.fields:
        c = metadata[f.name]
        has = c.isNotNull() & (c != "") if isinstance(f.dataType, T.StringType) else c.isNotNull()
        filled = filled + F.when(has, 1).otherwise(0)
    return filled / F.lit(float(len(schema.fields)))


def freshness(updated_at: Column, now: Column) -> Column:
    """1 for today, falling to 0 over a year of whole days; 0.5 when the date is missing or no date."""
    when = parse_iso(updated_at)
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(when)) / F.lit(86400))
    return F.coalesce(clamp01(F.lit(1.0) - days / F.lit(365.0)), F.lit(0.5))


def graph_confidence(hits: DataFrame, triples: DataFrame) -> DataFrame:
    """Per hit that a triple supports: confidence, and the relationship of the first direct mention.

    The first triple that matches at all decides: 1.0 when it names the document, 0.7
    when a longer word of it and the id contain one another.
    """
    # Both sides hold a few dozen rows per query.
    pairs = hits.select("query_id", "document_id").distinct().join(
        triples.select("query_id", "triple_no", "node", "relationship", "connected_to"), "query_id"
    )
    doc = F.lower("document_id")

    def names(column: str) -> Column:
        return F.contains(F.lower(column), doc)

    def shares(column: str) -> Column:
        words = F.split(F.lower(column), r"\s+")
        return F.exists(words, lambda w: (F.length(w) > 3) & (F.contains(doc, w) | F.contains(w, doc)))

    direct = names("node") | names("connected_to")
    confidence = F.when(direct, F.lit(1.0)).when(shares("node") | shares("connected_to"), F.lit(0.7))
    matched = pairs.withColumn("c", confidence).withColumn("d", direct).filter("c IS NOT NULL")
    return matched.groupBy("query_id", "document_id").agg(
        F.min_by("c", "triple_no").alias("graph_confidence"),
        F.min_by("relationship", F.when(F.col("d"), F.col("triple_no"))).alias("graph_relationship"),
    )


def rank(hits: DataFrame, now: Column, triples: DataFrame | None = None) -> DataFrame:
    """Add the signals, the composite score and the final rank per query."""
    meta_type = hits.schema["metadata"].dataType
    updated = F.col("metadata")["updated_at"] if "updated_at" in meta_type.names else F.lit(None).cast("string")
    scored = hits
    if triples is not None:
        scored = scored.join(graph_confidence(hits, triples), ["query_id", "document_id"], "left")
    else:
        scored = scored.withColumn("graph_confidence", F.lit(0.0)).withColumn(
            "graph_relationship", F.lit(None).cast("string")
        )
    scored = scored.withColumns({
        "similarity": similarity(F.col("score")),
        "graph_confidence": F.coalesce("graph_confidence", F.lit(0.0)),
        "type_priority": type_priority(F.col("document_type")),
        "metadata_richness": metadata_richness(F.col("metadata"), meta_type),
        "freshness": freshness(updated, now),
    })
    total = F.lit(0.0)
    for signal in ("similarity", "graph_confidence", "freshness", "type_priority", "metadata_richness"):
        total = total + F.lit(WEIGHTS[signal]) * F.col(signal)
    scored = scored.withColumn("final_score", round_half_up(total, 3)).withColumn(
        "similarity_score", round_half_up(F.col("score"), 3)
    )
    order = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), F.col("search_rank"))
    return (
        scored.withColumnRenamed("rank", "search_rank")
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .withColumn("explanation", explanation())
    )


def explanation() -> Column:
    """Contribution of each signal and the reason in words."""
    def part(signal: str) -> Column:
        return round_half_up(F.lit(WEIGHTS[signal]) * F.col(signal), 3).alias(f"{signal}_contribution")

    thousandths = F.floor(F.col("similarity") * 1000 + 0.5 + 1e-7).cast("bigint")
    shown = F.concat(
        F.floor(thousandths / 1000).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0")
    )
    reason = F.concat_ws(
        " + ",
        F.concat(F.lit("Cosine similarity ("), shown, F.lit(")")),
        F.when(F.col("type_priority") > 0.8, F.concat(F.lit("high priority type ("), F.col("document_type"), F.lit(")"))),
        F.when(F.col("graph_confidence") > 0, F.lit("corroborated by graph")),
        F.when(F.col("freshness") > 0.8, F.lit("recently updated")),
    )
    return F.struct(*[part(s) for s in WEIGHTS], reason.alias("ranking_reason"))


def rerank(ranked: DataFrame, reranker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply the caller's own ranking."""
    return ranked.transform(reranker)


def limit_results(ranked: DataFrame, max_results: int = MAX_RESULTS) -> DataFrame:
    """The first results of each query."""
    return ranked.filter(F.col("rank") <= max_results)


def explain_matches(ranked: DataFrame, entities: DataFrame) -> DataFrame:
    """Replace the reason by one that names the matched entities and the graph relationship.

    ``entities``: query_id, district, year. Where nothing can be said the reason stays.
    """
    asked = entities.select("query_id", F.col("district").alias("_district"), F.col("year").alias("_year"))
    rows = ranked.join(asked, "query_id", "left")
    meta, e = F.col("metadata"), F.col("explanation")
    share = e["similarity_contribution"]
    similar = F.when(share > 0.4, "High semantic similarity to query").when(share > 0.2, "Moderate semantic match")
    matched = F.concat_ws(
        ", ",
        F.when(F.col("_district") == meta["district"], F.concat(F.lit("District ("), F.col("_district"), F.lit(")"))),
        F.when(F.col("_year") == meta["crime_year"], F.concat(F.lit("Year ("), F.col("_year").cast("string"), F.lit(")"))),
    )
    named = F.when(matched != "", F.concat(F.lit("Matched entities: "), matched))
    graph = F.when(
        (e["graph_confidence_contribution"] > 0) & F.col("graph_relationship").isNotNull(),
        F.concat(F.lit("Corroborated by graph relationship ("), F.col("graph_relationship"), F.lit(")")),
    )
    parts = F.array_compact(F.array(similar, named, graph))
    reason = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise(e["ranking_reason"])
    return rows.withColumn("explanation", e.withField("ranking_reason", reason)).drop("_district", "_year")
