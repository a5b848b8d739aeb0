"""Groups cut into parts, documents in parts, keys before windows, stores and raw thresholds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriweave.functions.encoding import HashingEncoder
from veriweave.functions.groups import assign_parts, in_parts, large_groups, list_in_parts, top_per_key
from veriweave.operators import documents, lookups, profiling, vectors
from veriweave.plans import corpus
from veriweave.sources.stores import VersionedTable
from veriweave.streaming.streams import deduplicate_stream

META = "struct<entity_id: string, document_type: string, updated_at: string, created_at: string>"


def test_parts_are_of_like_size_however_the_ids_lie(spark):
    members = spark.range(3000).select(F.lit("a").alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("t"))
    members = members.unionByName(spark.createDataFrame([("a", 10**15, "far"), ("b", 1, "x")], "k string, o bigint, t string"))
    large = large_groups(members, ["k"], "o", 100)
    sizes = [r["count"] for r in assign_parts(members, ["k"], "o", large, 100).filter("k = 'a'").groupBy("part").count().collect()]
    assert max(sizes) <= 200 and len(sizes) >= 20
    rows = sorted(map(tuple, list_in_parts(members, ["k"], "o", "t", ",", large, 100).filter("k = 'a'").select("part", "text").collect()))
    assert ",".join(t for _, t in rows) == ",".join([*map(str, range(3000)), "far"])
    assert large_groups(members, ["k"], "o", 5000) is None


def test_limits_per_key_come_before_the_shuffle(spark):
    df = top_per_key(spark.range(100_000).withColumn("k", F.col("id") % 2), ["k"], [F.col("id")], 5000)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_filter_by_key_before_any_exchange(spark):
    cases = spark.range(1000).selectExpr(
        "id AS CaseMasterID", "id + 10 AS CaseNo", "id + 20 AS CrimeNo", "id % 7 AS PolicePersonID", "id % 5 AS PoliceStationID", "id % 3 AS CaseStatusID"
    )
    references = spark.createDataFrame([("r", "case_id", "5"), ("s", "case_number", "17"), ("t", "crime_number", "9999")], "ref_id string, kind string, value string")
    found = lookups.find_cases(references, {"CaseMaster": cases})
    assert {r["ref_id"]: r["case_id"] for r in found.collect()} == {"r": 5, "s": 7, "t": None}
    plan = plan_of(found)
    # Read from the leaves up: the first node above a scan of the cases that moves rows comes after the key filter.
    for branch in plan.split("Range (0, 1000")[:-1]:
        above = branch.rsplit("Scan", 1)[-1]
        assert above.rfind("LeftSemi") > above.rfind("Exchange hashpartitioning") or "LeftSemi" in above


def doc_rows(spark, rows):
    return spark.createDataFrame(
        [(i, k, p, t, (i, k, "2024", "2024")) for i, k, p, t in rows], f"document_id string, document_type string, part_no bigint, text string, metadata {META}"
    )


LONG = "word " * 30


def test_documents_in_parts_are_judged_and_counted_as_one(spark):
    rows = doc_rows(spark, [
        ("case_summary_1", "case_summary", 0, "short"), ("case_summary_1", "case_summary", 1, LONG), ("case_summary_2", "case_summary", 0, LONG),
        ("case_summary_3", "case_summary", 0, " "), ("case_summary_3", "case_summary", 1, None),
    ])
    checked = documents.check_documents(rows)
    found = {(r["document_id"], r["part_no"]): [i["message"] for i in r["issues"]] for r in checked.collect()}
    assert found["case_summary_1", 0] == found["case_summary_1", 1] == found["case_summary_2", 0] == []
    assert found["case_summary_3", 0] == found["case_summary_3", 1] == ["Document text is empty"]
    assert documents.duplicate_ids(rows).count() == 0
    stats = documents.build_statistics(checked).first()
    assert (stats["generated"], stats["valid"], stats["warnings"], stats["errors"]) == (2, 2, 0, 1)
    twice = rows.unionByName(rows.filter("document_id = 'case_summary_1'"))
    assert documents.duplicate_ids(twice).first()["copies"] == 2


def test_vectors_and_versions_tell_of_all_parts(spark):
    whole = doc_rows(spark, [("case_summary_1", "case_summary", 0, "a b c a"), ("case_summary_2", "case_summary", 0, "d")])
    split = doc_rows(spark, [("case_summary_1", "case_summary", 0, "a b"), ("case_summary_1", "case_summary", 1, "c a"), ("case_summary_2", "case_summary", 0, "d")])
    other = doc_rows(spark, [("case_summary_1", "case_summary", 0, "a b"), ("case_summary_1", "case_summary", 1, "c b"), ("case_summary_2", "case_summary", 0, "d")])
    encoder = HashingEncoder(16)
    vector = lambda df: {r["document_id"]: list(r["vector"]) for r in vectors.encode_documents(df, encoder, 16).collect()}
    assert vector(split) == vector(whole) and vector(other)["case_summary_1"] != vector(whole)["case_summary_1"]
    version = lambda df: {r["document_id"]: r["version"] for r in corpus.versions(df).collect()}
    assert version(split)["case_summary_1"] != version(other)["case_summary_1"]
    assert version(split)["case_summary_2"] == version(other)["case_summary_2"]
    assert not in_parts(whole) and in_parts(split)


def test_an_encoder_that_fails_gives_null_vectors(spark):
    def load():
        import numpy as np

        def encode(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return np.ones((len(texts), 2))

        return encode

    rows = spark.createDataFrame([("bad",), ("good",)], "text string").repartition(1)
    got = vectors.encode(rows, "text", load).collect()
    assert len(got) == 2 and all(r["vector"] is None or list(r["vector"]) == [1.0, 1.0] for r in got)


def test_threshold_is_held_against_the_score_itself(spark):
    angle = 0.4999997
    points = spark.createDataFrame([(1, [angle, (1 - angle**2) ** 0.5])], "point_id bigint, vector array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, vector array<double>")
    assert vectors.nearest(points, queries, 1, 0.5).count() == 0
    assert vectors.nearest(points, queries, 1, 0.4999).first()["score"] == 0.5


def test_store_without_rows_and_old_versions(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "s"), partition_by="kind")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, kind string")
    assert not store.exists()
    store.replace(rows.limit(0))
    assert store.read().columns == ["id", "kind"] and store.read().count() == 0
    store.upsert(rows, "id")
    store.delete(rows.filter("id = 'a'").select("id"), "id")
    store.upsert(rows.select("id", F.lit("z").alias("kind")).filter("id = 'b'"), "id")
    assert [tuple(r) for r in store.read().collect()] == [("b", "z")]
    assert len(list((tmp_path / "s" / "_versions").iterdir())) == 3


def test_stream_rows_that_differ_in_time_both_stay(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at), (1, at), (1, at + dt.timedelta(seconds=5))]
    spark.createDataFrame(rows, "id bigint, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = deduplicate_stream(spark.readStream.schema("id bigint, at timestamp").parquet(str(tmp_path / "in")), "at", "1 hour")
    query = stream.writeStream.format("memory").queryName("kept_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("kept_rows").count() == 2


@pytest.mark.parametrize("last_cell", [2, 100_000])
def test_quantiles_with_nested_outliers(spark, last_cell):
    values = spark.range(2000).select(F.lit("c").alias("column_name"), F.col("id").cast("double").alias("value"))
    values = values.unionByName(spark.createDataFrame([("c", 1e30), ("c", 1e18), ("c", 1e9)], "column_name string, value double"))
    targets = spark.createDataFrame([("c", 500, 0.0, 1e30), ("c", 2001, 0.0, 1e30)], "column_name string, k bigint, lo double, hi double")
    got = {r["k"]: r["value"] for r in profiling.order_statistics(values, targets, last_cell).collect()}
    assert got == {500: 500.0, 2001: 1e18}
