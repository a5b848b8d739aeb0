"""Queries that run streams over the given tables until all has been handled."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.answers import CASE_MENTION, turns
from registry.retrieval import CORPUS_SQL, ENCODER, MODEL, DIMENSION, corpus
from veriweave.plans import corpus as corpus_plans
from veriweave.roles import read
from veriweave.session import checkpoint_dir
from veriweave.sources.stores import VersionedTable, document_store, manifest_store, point_store
from veriweave.streaming.history import history_stream
from veriweave.streaming.streams import deduplicate_stream, run_to_end, sync_stream, usage_by_window, write_by_batch, write_by_key
from veriweave.operators import questions


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _arriving(spark: SparkSession, root: str, arrivals: list[DataFrame], handle: Callable[[DataFrame], object]) -> list[int]:
    """Let rows arrive in a folder, some at a time, and the stream over it go on from where it was; late rows of each time."""
    schema: T.StructType = arrivals[0].schema
    late = []
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{root}/in")
        late.append(run_to_end(handle(spark.readStream.schema(schema).parquet(f"{root}/in")), f"{root}/checkpoint"))
    return late


def history(spark: SparkSession, sf: str) -> DataFrame:
    """The case named last before each turn, of turns that come in three lots, most of them late."""
    root, rows = _root(spark), turns(spark, sf).select("conv_id", "turn", "text", F.expr("timestamp_seconds(1700000000 + 60 * turn)").alias("said_at"))
    store = VersionedTable(spark, f"{root}/out", key="place", buckets=8)
    place = F.concat_ws(":", "conv_id", "turn")
    _arriving(
        spark, root, [rows.filter(f"turn % 3 = {i}") for i in (1, 2, 0)],
        lambda stream: write_by_key(history_stream(stream, "said_at", "1 day").withColumn("place", place), store),
    )
    return store.read().select("conv_id", "turn", "history_case")


HISTORY_SQL = (
    f"WITH t AS (SELECT conv_id, turn, nullif(regexp_extract({CASE_MENTION}, '{questions.HISTORY_CASE}', 1), '') AS said FROM conversations) SELECT conv_id, turn, "
    "last_value(said IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history_case FROM t"
)


def _told(spark: SparkSession, **counts: int) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "what string, n bigint")


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Events of which some come twice, then copies again, most of them too late, and new ones."""
    root = _root(spark)
    events = read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    first = events.unionByName(events.filter("user_id % 7 = 0"))
    second = events.filter("user_id % 5 = 0").unionByName(
        events.filter("user_id % 11 = 0").withColumn("ts", F.expr("ts + INTERVAL 400 DAYS")).withColumn("event_id", F.col("event_id") + 1_000_000_000)
    )
    late = _arriving(spark, root, [first, second], lambda stream: write_by_batch(deduplicate_stream(stream, "ts", "1 hour"), f"{root}/out"))
    kept = spark.read.parquet(f"{root}/out")
    return kept.select(F.concat(F.lit("event "), "event_id", F.lit(" "), "user_id").alias("what"), F.lit(1).cast("bigint").alias("n")).unionByName(
        _told(spark, late=sum(late), all=spark.read.parquet(f"{root}/in").count())
    )


DEDUPLICATED_SQL = """
WITH w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS w FROM events)
SELECT 'event ' || event_id || ' ' || user_id AS what, 1::BIGINT AS n FROM events
UNION ALL SELECT 'event ' || (event_id + 1000000000) || ' ' || user_id, 1 FROM events WHERE user_id % 11 = 0
UNION ALL SELECT 'late', (SELECT count(*) FROM events, w WHERE user_id % 5 = 0 AND ts <= w) + (SELECT count(*) FROM events, w WHERE user_id % 11 = 0 AND ts + INTERVAL 400 DAYS <= w)
UNION ALL SELECT 'all', count(*) + count(*) FILTER (user_id % 7 = 0) + count(*) FILTER (user_id % 5 = 0) + count(*) FILTER (user_id % 11 = 0) FROM events
"""


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Requests per day of which some come after the others: those of days that are closed are left out and counted."""
    root = _root(spark)
    log = read(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type = 'view' AS cache_hit", "CAST(value AS DOUBLE) AS search_time_ms", "user_id")
    store = VersionedTable(spark, f"{root}/out", key="day", buckets=4)
    by_day = lambda stream: usage_by_window(stream, "ts", "3 days", "1 day").select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "total_queries", "cache_hits"
    )
    _arriving(spark, root, [log.filter("user_id % 9 <> 0"), log.filter("user_id % 9 = 0")], lambda stream: write_by_key(by_day(stream), store))
    days = store.read().select(F.col("day").alias("what"), F.col("total_queries").alias("n"), "cache_hits")
    counted = days.agg(F.sum("n").alias("n")).first()["n"]
    read_in = spark.read.parquet(f"{root}/in").count()
    return days.unionByName(_told(spark, late=read_in - counted).withColumn("cache_hits", F.lit(None).cast("bigint")))


USAGE_SQL = """
WITH w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 3 DAYS AS w FROM events WHERE user_id % 9 <> 0),
l AS (SELECT date_trunc('day', ts) AS d, event_type = 'view' AS hit, user_id % 9 = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= w AS late FROM events, w)
SELECT strftime(d, '%Y-%m-%d') AS what, count(*) AS n, count(*) FILTER (hit) AS cache_hits FROM l WHERE NOT late GROUP BY 1
UNION ALL SELECT 'late', count(*) FILTER (late), NULL FROM l
"""


def synced(spark: SparkSession, sf: str) -> DataFrame:
    """A collection that follows a stream of documents: first versions, newer ones, and first versions again, which come late."""
    root = _root(spark)
    at = lambda df, stamp: df.withColumn("metadata", F.col("metadata").withField("updated_at", F.lit(stamp)))
    docs = corpus(spark, sf)
    first = at(docs.withColumn("text", F.concat(F.lit("earlier "), F.substring("text", 1, 20))), "2024-01-01")
    store, points, manifest = document_store(spark, f"{root}/docs", 8), point_store(spark, f"{root}/points", 8), manifest_store(spark, f"{root}/manifest", 8)
    nothing = at(docs, "2024-01-01").limit(0)
    store.replace(nothing)
    corpus_plans.build_points(nothing, points, manifest, ENCODER, DIMENSION, MODEL)
    _arriving(
        spark, root, [first, at(docs, "2024-02-01"), first.filter("metadata.case_id % 3 = 0")],
        lambda stream: sync_stream(stream, store, points, manifest, ENCODER, DIMENSION, MODEL, f"{root}/facts"),
    )
    facts = spark.read.parquet(f"{root}/facts")
    late = facts.select(F.lit("late").alias("point_id"), F.sum(F.col("row_count") - F.col("kept")).cast("string").alias("text_preview"))
    known = points.read().join(manifest.read().select("document_id"), "document_id", "left_semi")
    return known.select("point_id", "text_preview").unionByName(late)


SYNCED_SQL = (
    # A blank text has no vector; the point of its first version stays.
    f"WITH {CORPUS_SQL} SELECT point_id, CASE WHEN trim(text) <> '' THEN substr(text, 1, 500) ELSE substr('earlier ' || substr(text, 1, 20), 1, 500) END AS text_preview FROM corpus "
    "UNION ALL SELECT 'late', CAST(count(*) FILTER (doc_id % 3 = 0) AS VARCHAR) FROM documents"
)

QUERIES = {
    "L19_history_stream": (history, HISTORY_SQL),
    "C9_stream_dedup": (deduplicated, DEDUPLICATED_SQL),
    "R34_stream_usage": (usage, USAGE_SQL),
    "E10_stream_sync": (synced, SYNCED_SQL),
}
