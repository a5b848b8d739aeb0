"""Whole answers to names, and joins and searches that stay within the limits of large tables."""

import numpy as np

from veriweave.operators import matching, motifs, vector_index, vectors
from veriweave.plans.answering import answer_questions


def tables(spark, accused):
    def t(schema, rows=()):
        return spark.createDataFrame(list(rows), schema)

    return {
        "CaseMaster": t("CaseMasterID bigint, CaseNo bigint, CrimeNo bigint, PolicePersonID bigint, PoliceStationID bigint, CaseStatusID bigint"),
        "Employee": t("EmployeeID bigint, KGID string, FirstName string, DesignationID bigint, RankID bigint"),
        "Accused": t("AccusedMasterID bigint, CaseMasterID bigint, AccusedName string, AgeYear bigint, GenderID bigint, PersonID string", accused),
        "Victim": t("VictimMasterID bigint, CaseMasterID bigint, VictimName string, AgeYear bigint, GenderID bigint"),
        "ChargesheetDetails": t("CSID bigint, CaseMasterID bigint, csdate string, cstype string, PolicePersonID bigint"),
        "ArrestSurrender": t("ArrestSurrenderID bigint, CaseMasterID bigint, ArrestSurrenderDate string"),
        "Unit": t("UnitID bigint, UnitName string"),
    }


def test_every_person_of_a_name_is_told(spark):
    people = [(i, 1000 - i, "Fiyaz Saran" if i % 2 else "FIYAZ SARAN", 30, 1, None) for i in range(1, 121)]
    people += [(7, 2, "fiyaz saran", None, 2, "P7"), (7, 11, "Fiyaz Saran", 5, None, ""), (500, 1, "Ravi Kumar", 31, 1, "A99")]
    asked = spark.createDataFrame([(1, "Fiyaz Saran"), (2, "find accused named Ravi Kumar?"), (3, "find accused named Nobody Here?")], "question_id int, text string")
    t = tables(spark, people)
    rows = sorted((r["question_id"], r["part_no"], r["found"], r["answer"], r["data"]) for r in answer_questions(asked, t).collect())
    assert [r[:3] for r in rows] == [(1, 0, True), (2, 0, True), (3, 0, False)]
    lines = rows[0][3].split("\n")
    told = sorted(((i, c) for i, c, name, *_ in people if name.lower() == "fiyaz saran"))
    assert lines[0].startswith("Found **122** accused record(s) for **Fiyaz Saran**.") and lines[-1].startswith("Specify")
    assert [(int(x.split()[2]), int(x.split()[5])) for x in lines[1:-1]] == told
    assert '"total":122' in rows[0][4] and "Specify" not in rows[1][3]
    # In several parts the text is the same, and its data come once.
    parts = sorted((r["part_no"], r["answer"], r["data"] is not None) for r in answer_questions(asked, t, part_rows=20).filter("question_id = 1").collect())
    assert len(parts) > 3 and [p[0] for p in parts] == list(range(len(parts))) and [p[2] for p in parts] == [True] + [False] * (len(parts) - 1)
    assert "".join(p[1] for p in parts) == rows[0][3]
    few = answer_questions(asked, t, by_name=50).filter("question_id = 1").first()["answer"]
    assert few.startswith("Found **50**") and few.count("AccusedMasterID") == 51


def test_no_side_of_a_search_is_broadcast_by_its_estimate(spark, monkeypatch):
    monkeypatch.setattr(matching, "TERMS_SENT", 10)
    monkeypatch.setattr("veriweave.functions.groups.BROADCAST_ROWS", 10)
    monkeypatch.setattr("veriweave.functions.groups.counted_side.__defaults__", (10, None))
    texts = spark.range(2000).selectExpr("CAST(700000 + id AS STRING) AS text", "id")
    terms = spark.range(40).selectExpr("CAST(id AS STRING) AS term")
    found = matching.containing(terms, texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert found.count() == sum(str(i) in str(700000 + j) for i in range(40) for j in range(2000))
    numbers = spark.range(300).selectExpr("id AS CaseMasterID", "CAST(700000 + id AS STRING) AS CrimeNo")
    people = spark.range(600).selectExpr("id % 300 AS CaseMasterID", "id AS AccusedMasterID", "CONCAT('P', id) AS AccusedName")
    queries = spark.range(40).selectExpr("id AS query_id", "CAST(id AS STRING) AS term")
    asked = motifs.cases_numbered(queries, {"CaseMaster": numbers, "Accused": people})
    assert "BroadcastHashJoin" not in asked._jdf.queryExecution().executedPlan().toString()
    first = {(r["query_id"], r["node"]): r["connected_to"] for r in asked.collect()}
    assert first[(7, "Case: 0")] == "P0, P300" and (39, "Case: 39") in first and len(first) == sum(
        min(3, sum(i == j or str(i) in str(700000 + j) for j in range(300))) for i in range(40))


def brute(points, queries, k):
    """(query, place) -> (point, score) by comparing all pairs."""
    out = {}
    for q, v in queries:
        scored = sorted((-round(float(np.dot(v, w)), 6), p) for p, w in points if p != q and not np.isnan(w).any())
        out |= {(q, i): (p, -s) for i, (s, p) in enumerate(scored[:k], 1)}
    return out


def unit_rows(n, seed):
    rows = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    return (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))).astype(np.float64)


def test_queries_go_to_blocks_of_cells_not_to_each_cell(spark, monkeypatch):
    rows = [(i, v) for i, v in enumerate(unit_rows(900, 3))]
    rows[5] = (5, np.full(8, np.nan))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "point_id long, vector array<double>")
    index = vector_index.build_index(df, cells=40)
    moved = []
    whole = vector_index._dealt
    monkeypatch.setattr(vector_index, "_dealt", lambda *a: moved.append(whole(*a)) or moved[-1])
    asked = df.filter("point_id % 3 = 0").withColumnRenamed("point_id", "query_id")
    found = vector_index.nearest(index, asked, 4, skip_self=True, exact=True, points_per_block=300, queries_per_block=50)
    got = {(r["query_id"], r["rank"]): (r["point_id"], r["score"]) for r in found.collect()}
    want = brute(rows, [(i, v) for i, v in rows if i % 3 == 0], 4)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    # Forty cells lie in at most four blocks, of like size.
    fill = {b: sum(index.cells[c][0] for c, _, block in moved[0] if block == b) for _, _, b in moved[0]}
    assert len(moved[0]) >= 38 and 1 < len(fill) <= 4 and max(fill.values()) < 1.2 * min(fill.values())


def test_a_floor_leaves_out_only_what_is_below_it():
    points, queries, ids = unit_rows(3000, 1), unit_rows(300, 2), np.arange(3000)
    at, found, scores = vectors._best_of(np.arange(300) + 10**6, queries, ids, points, 5, None, True)
    floors = scores.reshape(300, 5)[:, 2].copy()
    floors[:10] = -2.0
    again = vectors._best_of(np.arange(300) + 10**6, queries, ids, points, 5, None, True, floors)
    held = scores >= np.repeat(floors, 5)
    got = set(zip(*[x.tolist() for x in again]))
    assert {x for x, h in zip(zip(at.tolist(), found.tolist(), scores.tolist()), held) if h} <= got
    assert [t for t in vectors._tiles(2000, 1024)][0] == (0, 1024) and vectors._tiles(2000, 1024)[-1][1] == 2000 and len(vectors._tiles(2000, 1024)) == 5
    with_nan = points.copy()
    with_nan[::7] = np.nan
    told = vectors._best_of(np.arange(300) + 10**6, queries, ids, with_nan, 5, 0.1, False)
    assert len(told[0]) and not (told[1] % 7 == 0).any() and (told[2] >= 0.1).all()
