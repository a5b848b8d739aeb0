"""Documents, stores, graph questions, hot groups."""

import itertools
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veriweave.functions.groups import large_groups, last_known_before, list_in_parts
from veriweave.functions.identifiers import name_uuid
from veriweave.operators import documents as docs
from veriweave.operators import graph, lookups, motifs
from veriweave.operators.matching import containing
from veriweave.roles import domain_tables, person_tables
from veriweave.sources.metadata import ResolutionError
from veriweave.sources.stores import document_store, get_document, ids_of_type, rebuild_points, VersionedTable
from veriweave.sources.tables import load_tables, read_csv_tables, read_tables

SMALL = "/root/testdata/sf0.001"


def golden_case(spark):
    def t(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return {
        "District": t("DistrictID bigint, DistrictName string", (1, "Bangalore Urban")),
        "Unit": t("UnitID bigint, UnitName string, DistrictID bigint", (7, "Whitefield PS", 1)),
        "Court": t("CourtID bigint, CourtName string, DistrictID bigint", (3, "3rd ACMM Court", 1)),
        "Employee": t("EmployeeID bigint, FirstName string, KGID string, DistrictID bigint, UnitID bigint", (5, "Ramesh Kumar", "KGID123", 1, 7)),
        "CaseMaster": t(
            "CaseMasterID bigint, CrimeNo string, CaseNo string, `CrimeRegistered Date` string, PolicePersonID bigint, PoliceStationID bigint, "
            "CourtID bigint, IncidentFromDate string, IncidentToDate string, BriefFacts string",
            (1001, "CR/2024/001", None, "2024-01-15T00:00:00Z", 5, 7, 3, "2024-01-10T00:00:00Z", "2024-01-10T00:00:00Z", "Stolen laptop from cafe."),
            (1002, None, "N/A", "someday", None, None, None, None, None, " "),
        ),
        "Accused": t("AccusedMasterID bigint, CaseMasterID bigint, AccusedName string, AgeYear bigint", (1, 1001, "Suresh Patil", 28)),
        "Victim": t("VictimMasterID bigint, CaseMasterID bigint, VictimName string, AgeYear bigint", (1, 1001, "Meena Devi", 42)),
        "ComplainantDetails": t("ComplainantID bigint, CaseMasterID bigint, ComplainantName string", (1, 1001, "Meena Devi")),
        "ArrestSurrender": t("ArrestSurrenderID bigint, CaseMasterID bigint, AccusedMasterID bigint, CourtID bigint", (1, 1001, 1, 3)),
        "ChargesheetDetails": t("CSID bigint, CaseMasterID bigint, csdate string, cstype string, PolicePersonID bigint",
                                (2, 1001, "2024-03-20T00:00:00Z", "Late", 5), (1, 1001, "2024-02-20T00:00:00Z", "Final", 5)),
    }


def test_golden_case_summary(spark):
    rows = {r["document_id"]: r for r in docs.case_summaries(golden_case(spark), F.lit("t")).collect()}
    text = rows["case_summary_1001"]["text"]
    assert text.split("\n\n") == [
        "This case (Crime No. CR/2024/001) was registered at Whitefield PS in Bangalore Urban on 15 January 2024.",
        "The investigating officer is Ramesh Kumar (ID: KGID123).",
        "1 accused individual has been identified: Suresh Patil (Age: 28). There is 1 identified victim: Meena Devi (Age: 42). "
        "The complaint was filed by Meena Devi.",
        "The incident occurred on or around 10 January 2024.",
        "Brief facts of the case: Stolen laptop from cafe.",
        "A chargesheet of type Final was filed on 20 February 2024.",
        "There have been 1 arrest associated with this case.",
        "The case is assigned to 3rd ACMM Court.",
    ]
    meta = rows["case_summary_1001"]["metadata"]
    assert (meta["entity_id"], meta["crime_number"], meta["district_name"], meta["text_length"], meta["section_count"]) == (
        1001, "CR/2024/001", "Bangalore Urban", len(text), 8)
    assert rows["case_summary_1002"]["text"] == "This case was registered at an unknown police station in an unknown district on someday."


def test_long_lists_split_into_parts_with_the_same_text(spark):
    t = domain_tables(spark, SMALL)
    whole = {r["document_id"]: r for r in docs.case_summaries(t, F.lit("t")).collect()}
    parts = docs.case_summaries(t, F.lit("t"), part_rows=2).collect()
    assert max(r["part_no"] for r in parts) > 1
    texts, meta = {}, {}
    for r in sorted(parts, key=lambda r: (r["document_id"], r["part_no"])):
        texts[r["document_id"]] = texts.get(r["document_id"], "") + r["text"]
        meta[r["document_id"]] = r["metadata"]
    assert texts == {k: r["text"] for k, r in whole.items()}
    assert {k: (m["text_length"], m["section_count"], m["entity_id"]) for k, m in meta.items()} == {
        k: (r["metadata"]["text_length"], r["metadata"]["section_count"], r["metadata"]["entity_id"]) for k, r in whole.items()}


def test_case_context_in_parts(spark):
    t = domain_tables(spark, SMALL)
    ids = t["CaseMaster"].select(F.col("CaseMasterID").alias("case_id"))

    def texts(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (r["case_id"], r["section"], r["part"])):
            out[r["case_id"]] = out.get(r["case_id"], "") + "\n" + r["block"]
        return out

    assert texts(lookups.case_context(ids, t).collect()) == texts(lookups.case_context(ids, t, part_rows=2).collect())


def test_numbered_list_in_parts(spark):
    df = spark.createDataFrame([(1, i, f"p{i}") for i in range(100)] + [(2, 5, "x")], "k bigint, o bigint, t string")
    large = large_groups(df, ["k"], "o", 10)
    rows = list_in_parts(df, ["k"], "o", "t", "\n", large, 10, numbered=True).orderBy("k", "part").collect()
    text = "\n".join(r["text"] for r in rows if r["k"] == 1)
    assert text == "\n".join(f"{i + 1}. p{i}" for i in range(100)) and len(rows) == 11


def test_last_known_before_across_blocks(spark):
    data = [(c, t, t * 10 if (t * 7 + c) % 5 == 0 else None) for c in range(3) for t in range(60)]
    df = spark.createDataFrame(data, "g bigint, t bigint, v bigint")
    got = {(r["g"], r["t"]): r["last"] for r in last_known_before(df, "g", "t", "v", "last", block=7).collect()}
    for c in range(3):
        last = None
        for _, t, v in (d for d in data if d[0] == c):
            assert got[(c, t)] == last
            last = v if v is not None else last


def test_document_checks(spark):
    rows = [("case_summary_1", "case_summary", "x" * 60, (1, "case_summary")), ("case_summary_1", "case_summary", "x" * 60, (1, "case_summary")),
            ("case_summary_2", "case_summary", "short", (2, "case_summary")), ("other_3", "case_summary", " ", (None, "court_summary"))]
    df = spark.createDataFrame(rows, "document_id string, document_type string, text string, metadata struct<entity_id: bigint, document_type: string>")
    checked = docs.check_documents(df)
    found = {r["document_id"]: [i["severity"] for i in r["issues"]] for r in checked.collect()}
    assert found == {"case_summary_1": [], "case_summary_2": ["warning"], "other_3": ["error"] * 4}
    assert docs.duplicate_ids(df).first()["warnings"] == 1
    stats = docs.build_statistics(checked).first()
    assert (stats["generated"], stats["valid"], stats["warnings"], stats["errors"]) == (3, 1, 2, 1)


def test_document_store_round_trip(spark, tmp_path):
    built = docs.build_documents(golden_case(spark), F.lit("t"))
    store = document_store(spark, str(tmp_path / "docs"))
    store.replace(built)
    assert get_document(store.read(), "case_summary_1001").count() == 1 and get_document(store.read(), "odd_1").count() == 0
    assert sorted(r[0] for r in ids_of_type(store.read(), "case_summary").collect()) == ["case_summary_1001", "case_summary_1002"]
    newer = store.read().filter("document_id = 'case_summary_1001'").withColumn("text", F.lit("new"))
    store.upsert(newer, "document_id")
    assert get_document(store.read(), "case_summary_1001").first()["text"] == "new" and store.read().count() == built.count()
    store.delete(newer.select("document_id"), "document_id")
    assert store.read().count() == built.count() - 1
    points = VersionedTable(spark, str(tmp_path / "points"))
    with pytest.raises(ValueError, match="3 dimensions"):
        rebuild_points(points, spark.createDataFrame([("a", [1.0])], "point_id string, vector array<double>"), 3)


def test_csv_load(spark, tmp_path):
    (tmp_path / "District.csv").write_text("DistrictID,DistrictName\n1,Mysuru\n2,\"Udupi, west\"\n")
    frames, missing = read_csv_tables(spark, str(tmp_path))
    assert list(frames) == ["District"] and len(missing) == 10
    spark.sql(f"CREATE DATABASE vw_csv LOCATION '{tmp_path}/vw_csv'")
    load_tables(frames, "vw_csv")
    load_tables(frames, "vw_csv", mode="append")
    assert spark.table("vw_csv.District").count() == 4
    assert set(read_tables(spark, SMALL, ["region", "nation"])) == {"region", "nation"}


def test_point_id(spark):
    for name in ("case_summary_1", "é ü", ""):
        row = spark.createDataFrame([(name,)], "n string").select(name_uuid(F.col("n"))).first()
        assert row[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_graph_edges_need_both_ends(spark):
    t = golden_case(spark)
    t["ActSectionAssociation"] = spark.createDataFrame([(1001, 1, 302), (1001, 1, 302), (5, 1, 302)], "CaseMasterID bigint, ActID bigint, SectionID bigint")
    t["ArrestSurrender"] = t["ArrestSurrender"].withColumn("IOID", F.lit(5))
    nodes, edges, missing = graph.build_graph(t)
    assert missing == []
    sections = edges.filter("type = 'HAS_SECTION'").collect()
    assert [(r["src"], r["dst"]) for r in sections] == [("1001", "1:302")]
    stats = {(r["kind"], r["name"]): r["n"] for r in graph.graph_statistics(nodes, edges).collect()}
    assert stats[("nodes", "Case")] == 2 and stats[("nodes", "(all)")] == nodes.count()
    with pytest.raises(ResolutionError):
        graph.build_graph({})


def brute_together(edges, limit):
    cases = {}
    for c, p in set(edges):
        cases.setdefault(c, set()).add(p)
    shared = Counter()
    for people in cases.values():
        for a, b in itertools.permutations(people, 2):
            shared[a, b] += 1
    out = {}
    for (a, b), n in shared.items():
        out.setdefault(a, []).append((-n, b))
    return {a: sorted(v)[:limit] for a, v in out.items()}


@pytest.mark.parametrize("large_case", [500, 5, 1])
def test_together_equals_brute_force(spark, large_case):
    edges = [(c, p) for c in range(12) for p in range(40) if (p * 7 + c * 5) % (2 + c % 6) == 0]
    df = spark.createDataFrame(edges, "CaseMasterID bigint, AccusedMasterID bigint")
    ids = df.select(F.col("AccusedMasterID").alias("accused_id")).distinct()
    got = {}
    for r in motifs.appear_together(ids, df, limit=4, large_case=large_case).collect():
        got.setdefault(r["accused_id"], []).append((-r["shared_cases"], r["together_with"]))
    assert {k: sorted(v) for k, v in got.items()} == brute_together(edges, 4)


def test_containing_equals_brute_force(spark):
    texts = ["alpha", "beta", "alphabet", "b", "", "la", "ab a"]
    terms = ["a", "al", "alp", "bet", "phab", "zzz", "b", "alphabets"]
    got = containing(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in terms for b in texts if a in b)


def test_containing_joins_on_whole_terms(spark):
    # Numbers share their few runs of three digits; joined on those, these would be met in some 700,000 pairs.
    numbers = spark.range(2000).selectExpr("CAST(700000000 + id AS STRING) AS text", "id AS kept")
    long = spark.createDataFrame([("a term of more than sixteen characters, and more", -1), ("x" * 40, -2), (None, -3)], "text string, kept bigint")
    terms = [str(700000000 + i) for i in range(0, 2000, 2)] + ["more than sixteen characters", "x" * 17, "term of less than sixteen", "more", "0001999"]
    got = containing(spark.createDataFrame([(t,) for t in terms], "term string"), numbers.unionByName(long))
    want = [(str(700000000 + i), i) for i in range(0, 2000, 2)] + [("0001999", 1999), ("more", -1), ("more than sixteen characters", -1), ("x" * 17, -2)]
    assert sorted((r["term"], r["kept"]) for r in got.collect()) == sorted(want)
    assert "Contains" not in containing(spark.createDataFrame([("1",)], "term string"), numbers)._jdf.queryExecution().optimizedPlan().toString()


def test_other_cases_of_a_hub(spark):
    t = person_tables(spark, SMALL)
    hub = spark.createDataFrame([(c, 1) for c in range(50)], "CaseMasterID bigint, AccusedMasterID bigint")
    ids = spark.createDataFrame([(0,), (49,)], "case_id bigint")
    rows = motifs.connected_cases(ids, t, hub).orderBy("case_id", "rank").collect()
    assert [r["other_case"] for r in rows] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]
