"""Streams: history with late turns and a restart, sinks that are handed a batch twice, versions that come late."""

import random

from pyspark.sql import functions as F

from registry.streams import _arriving
from tests.test_retrieval import documents
from veriweave.functions.encoding import hashing_encoder
from veriweave.operators.questions import resolve_history
from veriweave.plans import corpus
from veriweave.sources.stores import VersionedTable, document_store, manifest_store, point_store
from veriweave.streaming import history
from veriweave.streaming.streams import run_to_end, sync_stream, write_by_batch, write_by_key


def test_answers_told_again_end_as_if_all_had_come_in_order():
    draw = random.Random(2)
    for _ in range(200):
        turns = {t: draw.choice((None, None, "1", "2")) for t in draw.sample(range(20), 12)}
        order = list(turns.items())
        draw.shuffle(order)
        known, told = [], {}
        while order:
            lot, order = sorted(order[:3]), order[3:]
            told |= dict(history.merged(known, lot))
            known = sorted((dict(known) | dict(lot)).items())
        assert told == dict(zip((t for t, _ in known), history.answers(known)))


def test_history_of_late_turns_after_restarts_equals_the_batch_form(spark, tmp_path):
    draw = random.Random(3)
    rows = [(c, t, draw.choice(("Case No. 12", "FIR", "Case No. 007 please", "and then?", None))) for c in range(6) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").withColumn("at", F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000))
    store = VersionedTable(spark, str(tmp_path / "out"), key="place", buckets=2)
    lots = [turns.filter("turn IN (2, 5, 8)"), turns.filter("turn IN (0, 4, 7) OR (conv_id = 1 AND turn = 3)"), turns.filter("turn IN (1, 3, 6)")]
    stream = lambda s: write_by_key(history.history_stream(s, "at", "1 day").withColumn("place", F.concat_ws(":", "conv_id", "turn")), store)
    _arriving(spark, str(tmp_path), lots, stream)
    got = sorted((r["conv_id"], r["turn"], r["history_case"]) for r in store.read().collect())
    assert got == sorted((r["conv_id"], r["turn"], r["history_case"]) for r in resolve_history(turns).collect())


def test_turns_behind_the_watermark_are_left_out_and_forgotten_ones_begin_anew(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, text string, at timestamp"
    at = lambda hour: f"2024-01-01 {hour:02d}:00:00"
    lot = lambda *rows: spark.createDataFrame([(c, t, x, h) for c, t, x, h in rows], "conv_id bigint, turn bigint, text string, h string").selectExpr(
        "conv_id", "turn", "text", "CAST(h AS TIMESTAMP) AS at"
    )
    store = VersionedTable(spark, str(tmp_path / "out"), key="place", buckets=1)
    lots = [
        lot((1, 1, "Case No. 5", at(1)), (2, 1, "Case No. 9", at(10))),
        lot((1, 0, "Case No. 4", at(2)), (2, 2, "and?", at(11))),
        # The watermark is past the idle time of the first conversation.
        lot((1, 2, "and?", at(12)), (2, 3, "and?", at(12))),
    ]
    stream = lambda s: write_by_key(
        history.history_stream(s, "at", "1 hour", idle_ms=3 * 3600 * 1000).withColumn("place", F.concat_ws(":", "conv_id", "turn")), store
    )
    _arriving(spark, str(tmp_path), lots, stream)
    assert lots[0].schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    got = {(r["conv_id"], r["turn"]): r["history_case"] for r in store.read().collect()}
    assert got == {(1, 1): None, (2, 1): None, (2, 2): "9", (1, 2): None, (2, 3): "9"}


def test_a_batch_that_comes_twice_is_written_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    for i in range(2):
        # Another checkpoint: batch 0 comes again.
        run_to_end(write_by_batch(stream, str(tmp_path / "out")), str(tmp_path / f"c{i}"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_older_versions_that_come_late_are_counted_and_left_out(spark, tmp_path):
    store, points, manifest = document_store(spark, str(tmp_path / "d"), 2), point_store(spark, str(tmp_path / "p"), 2), manifest_store(spark, str(tmp_path / "m"), 2)
    load = hashing_encoder(8)
    seed = documents(spark, ("case_summary_1", "one", "b"))
    store.replace(seed)
    corpus.build_points(store.read(), points, manifest, load, 8, "m")
    lots = [
        documents(spark, ("case_summary_1", "older", "a"), ("case_summary_2", "two", "b")),
        documents(spark, ("case_summary_2", "two again", "c"), ("case_summary_2", "between", "bb")),
    ]
    _arriving(spark, str(tmp_path), lots, lambda s: sync_stream(s, store, points, manifest, load, 8, "m", str(tmp_path / "facts")))
    assert {r["document_id"]: r["text_preview"] for r in points.read().collect()} == {"case_summary_1": "one", "case_summary_2": "two again"}
    facts = sorted((r["batch"], r["row_count"], r["kept"]) for r in spark.read.parquet(str(tmp_path / "facts")).collect())
    assert facts == [(0, 2, 1), (1, 2, 1)]
