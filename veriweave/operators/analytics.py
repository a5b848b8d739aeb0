"""Request fingerprints and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.numbers import round_half_up


def fingerprint(query: Column, filters: Column, top_k: Column, threshold: Column) -> Column:
    """SHA-256 of a request; ``filters`` is a map and its order does not matter."""
    entries = F.array_sort(F.map_entries(F.coalesce(filters, F.create_map().cast("map<string,string>"))))
    pairs = F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')))
    return F.sha2(
        F.concat_ws(
            "|",
            F.concat(F.lit("q:"), query),
            F.concat(F.lit("f:{"), F.array_join(pairs, ", "), F.lit("}")),
            F.concat(F.lit("k:"), F.coalesce(top_k.cast("string"), F.lit("default"))),
            F.concat(F.lit("t:"), F.coalesce(threshold.cast("string"), F.lit("default"))),
        ),
        256,
    )


def usage_summary(log: DataFrame) -> DataFrame:
    """Totals and means over a log of queries.

    ``log``: search_time_ms, graph_time_ms, top_similarity, is_hybrid, cache_hit. Cached
    queries did not search, so they do not count in the means.
    """
    real = ~F.col("cache_hit")

    def mean(c: str, condition: Column, digits: int) -> Column:
        # Decimal sums do not depend on the order of the rows.
        total = F.sum(F.when(condition, F.col(c).cast("decimal(18,6)"))).cast("double")
        n = F.count_if(condition)
        return round_half_up(F.when(n > 0, F.coalesce(total, F.lit(0.0)) / n).otherwise(F.lit(0.0)), digits)

    hits, total = F.count_if("cache_hit"), F.count(F.lit(1))
    return log.agg(
        total.alias("total_queries"),
        F.count_if(real & F.col("is_hybrid")).alias("hybrid_queries"),
        mean("search_time_ms", real, 2).alias("avg_search_time_ms"),
        mean("graph_time_ms", real & F.col("is_hybrid"), 2).alias("avg_graph_time_ms"),
        mean("top_similarity", real, 3).alias("avg_similarity"),
        hits.alias("cache_hits"),
        F.count_if(real).alias("cache_misses"),
        round_half_up(F.when(total > 0, hits / total).otherwise(F.lit(0.0)), 3).alias("cache_hit_ratio"),
    )


def type_usage(log: DataFrame) -> DataFrame:
    """How often each kind of document was among the results (R34). ``log`` has ``result_types``."""
    return log.filter("NOT cache_hit").select(F.explode("result_types").alias("document_type")).groupBy(
        "document_type"
    ).agg(F.count(F.lit(1)).alias("hits"))


def filter_usage(log: DataFrame) -> DataFrame:
    """How often each filter was used (R34). ``log`` has ``filters``, a map."""
    return log.filter("NOT cache_hit").select(F.explode(F.map_keys("filters")).alias("filter")).groupBy("filter").agg(
        F.count(F.lit(1)).alias("uses")
    )
