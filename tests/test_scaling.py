"""Bounded tasks, thinned joins and cheap orders: what keeps large tables within their limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriweave.functions import groups
from veriweave.operators import lookups, vectors


def test_pairs_are_ordered_as_one_number_each():
    rng = np.random.default_rng(5)
    q, places = rng.integers(0, 1024, 5000), rng.integers(0, 2**32, 5000)
    scores = rng.choice([-1.0, -0.25, 0.0, 0.123456, 0.1234564, 0.999999, 1.0], 5000)
    kept = vectors._first_in_order([vectors._in_order(q[:100], scores[:100], places[:100]), vectors._in_order(q[100:], scores[100:], places[100:])], 3)
    asked, ids, told = vectors._keep([(q, places, np.round(scores, 6))], 3)
    assert (kept >> 53 == asked).all() and (kept & 0xFFFFFFFF == ids).all() and (vectors._scores_of(kept) == told).all()


def test_a_point_without_id_comes_last_among_equals():
    ids = np.array([None, "b", "a"], object)
    at, found, scores = vectors._best_of(np.array([1, 2]), np.ones((2, 1)), ids, np.ones((3, 1)), 3, None, False)
    assert list(found) == ["a", "b", None] * 2 and list(at) == [0, 0, 0, 1, 1, 1] and (scores == 1).all()


def test_rows_of_many_keys_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(groups, "LIST_ROWS", 50)
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    keys = spark.createDataFrame([(i,) for i in [*range(0, 100, 2), 0, 0, None]], "k long")
    few = groups.matching(rows, keys, "k")
    monkeypatch.setattr(groups, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(groups, "broadcast_if_small", lambda df: df)
    many = groups.matching(rows, keys, "k")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan and f"hashpartitioning(k#" in plan and ", 21)" in plan
    assert sorted(r["id"] for r in few.collect()) == sorted(r["id"] for r in many.collect()) == [i for i in range(1000) if i % 2 == 0]


def test_lists_are_made_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(groups, "LIST_ROWS", 20)
    members = spark.range(300).select((F.col("id") % 60).alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("t"))
    large, rows = groups.measured_groups(members, ["k"], "o", 100)
    assert large is None and rows == 300
    listed = groups.list_in_parts(members, ["k"], "o", "t", ",", large, 100, rows=rows)
    assert listed.rdd.getNumPartitions() == 15
    assert {r["k"]: r["text"] for r in listed.collect()} == {k: ",".join(str(i) for i in range(k, 300, 60)) for k in range(60)}
    cut, rows = groups.measured_groups(members.withColumn("k", F.lit(1)), ["k"], "o", 100)
    assert cut is not None and rows == 300


def test_large_sides_are_thinned_by_the_keys_of_a_filter(spark, tmp_path):
    asked, table = str(tmp_path / "asked"), str(tmp_path / "table")
    spark.range(1000).select("id", F.when(F.col("id") % 50 == 0, "a").otherwise("b").alias("branch")).write.parquet(asked)
    spark.range(20000).select(F.col("id").alias("key"), F.rand(1).alias("x")).write.parquet(table)
    size = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(size)
    assert before == "64MB" and spark.conf.get("spark.sql.optimizer.runtimeFilter.number.threshold") == "100"
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(size, "1KB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        people = spark.read.parquet(table).select(F.col("key").alias("employee_id"), *[F.lit(c).alias(c) for c in ("first_name", "kgid")])
        keys = spark.read.parquet(asked).filter("branch = 'a'").select(F.col("id").alias("key_value"))
        joined = people.withColumnRenamed("employee_id", "key_value").join(keys.hint("merge"), "key_value", "left_semi")
        assert "might_contain" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == 20
    finally:
        spark.conf.set(size, before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


@pytest.mark.parametrize("many", [False, True])
def test_case_context_of_few_and_many_cases(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(groups, "broadcast_if_small", lambda df: df)
    t = {
        "CaseMaster": spark.createDataFrame([(i, 10 + i, 20 + i, 5, 1, 1) for i in (1, 2, 3)], "CaseMasterID long, CrimeNo long, CaseNo long, PolicePersonID long, PoliceStationID long, CaseStatusID long"),
        "Employee": spark.createDataFrame([(5, "Ada", "K5", 2, 3)], "EmployeeID long, FirstName string, KGID string, RankID long, DesignationID long"),
        "Victim": spark.createDataFrame([(7, 1, "V", 30, 1), (6, 1, "U", None, 2)], "VictimMasterID long, CaseMasterID long, VictimName string, AgeYear long, GenderID long"),
        "Accused": spark.createDataFrame([(8, 2, "A", 40, 1, "P8")], "AccusedMasterID long, CaseMasterID long, AccusedName string, AgeYear long, GenderID long, PersonID string"),
        "ChargesheetDetails": spark.createDataFrame([(9, 2, "2024-01-02"), (10, 2, "2024-01-01")], "CSID long, CaseMasterID long, csdate string"),
    }
    got = {(r["case_id"], r["section"]): r["block"] for r in lookups.case_context(spark.createDataFrame([(1,), (2,), (2,)], "case_id long"), t).collect()}
    assert len(got) == 8 and got[1, 1] == "Victims (2):\n  - U (?, 2)\n  - V (30, 1)" and got[2, 1] == "Victims: None recorded"
    assert got[2, 2] == "Accused (1):\n  - A (40, 1, PersonID: P8)" and got[2, 3].startswith("Chargesheet: Filed on 2024-01-01")
