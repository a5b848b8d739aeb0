"""Search pipelines over a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.encoding import Encoder
from veriweave.functions.numbers import round_half_up
from veriweave.operators import context as ctx
from veriweave.operators import motifs, querytext, ranking, vectors
from veriweave.session import staged

METADATA_FIELDS = [f for f in vectors.PAYLOAD if f not in ("document_id", "document_type")]


@dataclass(frozen=True)
class SearchOptions:
    """How a search is done; ``now`` is a parameter so that results repeat."""

    now: Column
    top_k: int = 20
    threshold: float | None = vectors.DEFAULT_THRESHOLD
    max_results: int = ranking.MAX_RESULTS
    max_tokens: int = ctx.MAX_TOKENS


def with_metadata(hits: DataFrame) -> DataFrame:
    """Gather the payload fields that are metadata in one struct."""
    fields = [F.col(c) for c in METADATA_FIELDS if c in hits.columns]
    return hits.select(
        "query_id", "rank", "score", "document_id", "document_type", "text_preview",
        F.struct(*fields).alias("metadata"), F.col("point_id").cast("string").alias("vector_id"),
    )


def encode_queries(queries: DataFrame, load: Callable[[], Encoder]) -> DataFrame:
    """Queries with their processed text and its vector. ``queries``: query_id, text."""
    return vectors.encode(querytext.process(queries, "text", "processed"), "processed", load)


def search(points: DataFrame, queries: DataFrame, load: Callable[[], Encoder], options: SearchOptions) -> DataFrame:
    """Ranked results of each query, by meaning alone."""
    encoded = encode_queries(queries, load)
    hits = with_metadata(vectors.search(points, encoded, options.top_k, options.threshold))
    return ranking.limit_results(ranking.rank(hits, options.now), options.max_results)


def query(
    points: DataFrame, queries: DataFrame, load: Callable[[], Encoder], options: SearchOptions
) -> tuple[DataFrame, DataFrame]:
    """Ranked results, and a context text per query."""
    # The context reads the results twice, and the caller may too.
    ranked = staged(search(points, queries, load, options), "ranked")
    return ranked, ctx.build_context(ranked, options.max_tokens)


@dataclass(frozen=True)
class HybridResult:
    """What a hybrid search gives, each a table keyed by query."""

    entities: DataFrame
    results: DataFrame
    triples: DataFrame
    context: DataFrame


def hybrid(
    points: DataFrame,
    queries: DataFrame,
    tables: Mapping[str, DataFrame],
    load: Callable[[], Encoder],
    options: SearchOptions,
) -> HybridResult:
    """Search by meaning within the filters the query's entities imply, with support from the graph."""
    encoded = querytext.auto_filters(querytext.extract_entities(encode_queries(queries, load), "processed"))
    # Queries, hits and triples are each read by several of the steps that follow.
    encoded = staged(encoded, "queries")
    asked = encoded.select(
        "query_id", "vector", F.col("filter_district").alias("district"),
        F.col("filter_crime_year").alias("crime_year"), F.col("filter_document_type").alias("document_type"),
    )
    hits = vectors.search(points, asked, options.top_k, options.threshold, ("district", "crime_year", "document_type"))
    entities = encoded.drop("vector")
    triples = staged(motifs.search_entities(entities, tables), "triples")
    ranked = ranking.limit_results(
        ranking.rank(staged(with_metadata(hits), "hits"), options.now, triples), options.max_results
    )
    explained = staged(ranking.explain_matches(ranked, entities), "results")
    return HybridResult(entities, explained, triples, ctx.build_hybrid_context(explained, triples, options.max_tokens))


def hybrid_statistics(result: HybridResult) -> DataFrame:
    """Documents and graph results per query."""
    documents = result.results.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"))
    relations = result.triples.groupBy("query_id").agg(F.count(F.lit(1)).alias("graph_relationships"))
    return (
        result.entities.select("query_id").join(documents, "query_id", "left").join(relations, "query_id", "left")
        .na.fill(0, ["documents", "graph_relationships"])
    )


def explain(ranked: DataFrame, position: int) -> DataFrame:
    """The explanation of the result at a position, from 0, per query."""
    return ranked.filter(F.col("rank") == position + 1).select("query_id", "document_id", "explanation.*")


def similar_cases(points: DataFrame, k: int, threshold: float | None = None, kind: str = "case_summary") -> DataFrame:
    """For each case the cases nearest to its own vector, itself left out."""
    of_kind = vectors.filter_points(points, {"document_type": kind})
    return vectors.nearest(of_kind, of_kind.select(F.col("point_id").alias("query_id"), "vector"), k, threshold, skip_self=True)


def shaped(ranked: DataFrame) -> DataFrame:
    """Results as they are shown: four-digit scores and the preview."""
    return ranked.select(
        "query_id", "rank", "document_id", "document_type",
        round_half_up(F.col("similarity_score"), 4).alias("similarity_score"),
        round_half_up(F.col("final_score"), 4).alias("final_score"),
        F.coalesce(F.substring("text_preview", 1, vectors.PREVIEW_CHARS), F.lit("")).alias("text_preview"),
    )
