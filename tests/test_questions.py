"""Lookups, question classification and answers."""

import pytest

from veriweave.operators import answers, lookups, questions
from veriweave.plans.answering import answer_questions

FIYAZ = [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]


@pytest.fixture(scope="module")
def replica(spark):
    def t(schema, rows):
        return spark.createDataFrame(rows, schema)

    return {
        "CaseMaster": t("CaseMasterID bigint, CaseNo bigint, CrimeNo bigint, PolicePersonID bigint, PoliceStationID bigint, CaseStatusID bigint",
                        [(1, 202300001, 100170200202300001, 5313, 200, 3), (2, 202300002, 100170200202300002, 5001, 201, 1),
                         (3, 202300003, 100170200202300003, None, 201, 1), (4, 202300004, 100170200202300004, 77, 201, 1)]),
        "Employee": t("EmployeeID bigint, KGID string, FirstName string, DesignationID bigint, RankID bigint",
                      [(5313, "KG10313", "Oliver", 7, 4), (5001, "KG10001", "Asha", 5, 3)]),
        "Accused": t("AccusedMasterID bigint, CaseMasterID bigint, AccusedName string, AgeYear bigint, GenderID bigint, PersonID string",
                     [(i, c, "Fiyaz Saran", 55, 1, f"A{i}") for i, c in enumerate(FIYAZ, 1)] + [(99, 2, "Ravi Kumar", 31, 1, "A99")]),
        "Victim": t("VictimMasterID bigint, CaseMasterID bigint, VictimName string, AgeYear bigint, GenderID bigint", [(1, 1, "Meera", 29, 2)]),
        "ChargesheetDetails": t("CSID bigint, CaseMasterID bigint, csdate string, cstype string, PolicePersonID bigint", []),
        "ArrestSurrender": t("ArrestSurrenderID bigint, CaseMasterID bigint, ArrestSurrenderDate string", []),
        "Unit": t("UnitID bigint, UnitName string", [(200, "West")]),
    }


CASES = [
    ("Show case 202300001", "identifier_lookup", "case_by_number", "case_number", "202300001"),
    ("case number 15", "identifier_lookup", "case_by_number", "case_number", "15"),
    ("case #42", "identifier_lookup", "case_by_number", "case_number", "42"),
    ("Officer 102", "identifier_lookup", "officer", "officer_id", "102"),
    ("employee id 55", "identifier_lookup", "officer", "officer_id", "55"),
    ("Victim 14", "identifier_lookup", "victim", "victim_id", "14"),
    ("accused 15", "identifier_lookup", "accused", "accused_id", "15"),
    ("suspect 99", "identifier_lookup", "accused", "accused_id", "99"),
    ("crime number CR/2023/001", "identifier_lookup", "case_by_crime", "crime_number", "CR/2023/001"),
    ("FIR number 12345", "identifier_lookup", "case_by_crime", "crime_number", "12345"),
    ("Who arrested accused 15?", "graph_query", "relationship", None, None),
    ("Find co-accused in these cases", "graph_query", "relationship", None, None),
    ("Show the network of related crimes", "graph_query", "relationship", None, None),
    ("Find robbery cases involving machetes", "semantic_search", "similar_cases", None, None),
    ("domestic violence cases in Bangalore", "semantic_search", "similar_cases", None, None),
    ("Find CaseNo 202300001", "identifier_lookup", "case_by_number", "case_number", "202300001"),
    ("case id 1", "identifier_lookup", "case_by_id", "case_id", "1"),
    ("CaseMasterID 1", "identifier_lookup", "case_by_id", "case_id", "1"),
    ("crime no 100170200202300001", "identifier_lookup", "case_by_crime", "crime_number", "100170200202300001"),
    ("Find officer EmployeeID 5313", "identifier_lookup", "officer", "officer_id", "5313"),
    ("Who is the investigating officer for CaseNo 202300001?", "factual_query", "officer_for_case", "case_number", "202300001"),
    ("Who is the investigating officer for that case?", "factual_query", "officer_for_case", None, None),
    ("Fiyaz Saran", "identifier_lookup", "accused_by_name", "accused_name", "Fiyaz Saran"),
    ("find accused named  Fiyaz   Saran?", "identifier_lookup", "accused_by_name", "accused_name", "Fiyaz Saran"),
    ("accused persons in Bangalore", "semantic_search", "similar_cases", None, None),
    ("Summarize case 7", "reasoning", "summarize_case", "case_number", "7"),
    ("explain the report on case id 9", "reasoning", "case_by_id", "case_id", "9"),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "question_id int, text string")
    for r in questions.detect_intent(df).collect():
        got = (r["text"], r["intent"], r["sub_intent"], r["identifier_kind"], r["identifier_value"])
        assert got == CASES[r["question_id"]]


def ask(spark, t, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")
    out = {}
    for r in answer_questions(df, t, **options).orderBy("question_id", "part_no").collect():
        out.setdefault(r["question_id"], []).append(r)
    return [out[i] for i in range(len(texts))]


def test_answers(spark, replica):
    rows = ask(
        spark, replica, "Who is the investigating officer for CaseNo 202300001?", "Fiyaz Saran", "case number 5", "crime number CR/2023/001",
        "who is the officer of case id 3", "officer of case id 4", "victims of case id 1", "victims of case id 2", "chargesheet of case id 1",
        "Officer 9", "Victim 1", "status of that case", "summarize case 202300001", "network of case id 1", "Nobody Here", "theft at night",
    )
    text = [r[0]["answer"] for r in rows]
    assert text[0] == "The investigating officer for CaseNo 202300001 is **Oliver** (EmployeeID 5313, KGID: KG10313). Designation ID: 7."
    assert text[1].startswith("Found **15** accused record(s) for **Fiyaz Saran**.") and text[1].count("\n- AccusedMasterID") == 15
    assert text[1].endswith("\nSpecify a CaseMasterID, AccusedMasterID or PersonID to narrow this down.")
    assert text[2] == "No case was found for CaseNo 5." and text[3] == "'CR/2023/001' is not a valid numeric CrimeNo."
    assert text[4] == "No investigating officer is recorded for CaseMasterID 3."
    assert text[5] == "CaseMasterID 4 references PolicePersonID 77, but no matching Employee record was found."
    assert text[6] == "Found 1 victim(s) for CaseNo 202300001:\n1. **Meera** (29 years old, Gender ID 2)"
    assert text[7] == "There are no victims listed for CaseNo 202300002."
    assert text[8] == "No chargesheet has been filed yet for CaseNo 202300001."
    assert text[9] == "No officer was found with EmployeeID 9." and text[10].startswith("### Victim Details\n- **Name:** Meera")
    assert text[11].startswith("I couldn't identify")
    summary = "".join(r["answer"] for r in rows[12])
    assert summary == (
        "### Case Summary\nCase: 202300001 | Crime (FIR): 100170200202300001 | Status: 3\nOfficer: Oliver (7, KGID: KG10313)\n"
        "Victims (1):\n  - Meera (29, 2)\nAccused (2):\n  - Fiyaz Saran (55, 1, PersonID: A1)\n  - Fiyaz Saran (55, 1, PersonID: A2)\nChargesheet: Not Filed")
    assert len(rows[13]) == 5 and text[14] == "No accused records were found for the name 'Nobody Here'."
    assert text[15] == "No specific context could be retrieved for this query."


def test_long_answers_come_in_parts(spark, replica):
    t = dict(replica, Accused=spark.createDataFrame(
        [(i, 1, f"P{i}", None, None, None) for i in range(25)],
        "AccusedMasterID bigint, CaseMasterID bigint, AccusedName string, AgeYear bigint, GenderID bigint, PersonID string"))
    whole = ask(spark, t, "accused of case id 1")[0]
    parts = ask(spark, t, "accused of case id 1", part_rows=4)[0]
    assert len(whole) == 1 and len(parts) == 7
    assert "".join(r["answer"] for r in parts) == whole[0]["answer"]
    assert whole[0]["answer"].splitlines()[25] == "25. **P24** (Age unknown, Gender unknown)"


def test_history(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "Show case 202300001"), (1, 1, "assistant", "ok"), (1, 2, "user", "its officer?"), (1, 3, "user", "CaseNo: 5"),
         (1, 4, "user", ""), (1, 5, "system", "x"), (1, 6, "user", "that case"), (2, 0, "user", "hello")],
        "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["history_case"] for r in questions.resolve_history(turns).collect()}
    assert got[(1, 0)] is None and got[(1, 2)] == "202300001" and got[(1, 3)] == "202300001" and got[(1, 6)] == "5" and got[(2, 0)] is None
    assert sorted(r["turn"] for r in questions.last_turns(turns).filter("conv_id = 1").collect()) == [1, 2, 3, 6]
    asked = spark.createDataFrame([(1, "Who is the officer for that case?", "12")], "question_id int, text string, history_case string")
    filled = questions.fill_from_history(questions.detect_intent(asked)).first()
    assert (filled["identifier_kind"], filled["identifier_value"]) == ("case_number", "12")


def test_lookups_keep_kinds_apart(spark, replica):
    refs = spark.createDataFrame([(1, "case_id", "202300001"), (2, "case_number", "202300001"), (3, "crime_number", "202300001"), (4, "case_id", "x")],
                                 "ref_id int, kind string, value string")
    assert {r["ref_id"]: r["found"] for r in lookups.find_cases(refs, replica).collect()} == {1: False, 2: True, 3: False, 4: False}
    names = spark.createDataFrame([(" fiyaz SARAN ",), ("nobody",)], "name string")
    found = lookups.accused_by_name(names, replica).collect()
    assert sum(r["found"] for r in found) == 15 and len(found) == 16


def test_citations_and_confidence(spark):
    ranked = spark.createDataFrame([(1, 1, "doc_a", "t", 0.9, "x" * 250), (1, 2, "doc_a", "t", 0.5, "y"), (1, 3, "doc_b", "t", 0.6, "short"), (2, 1, "doc_c", "t", 0.6, "s")],
                                   "query_id int, rank bigint, document_id string, document_type string, final_score double, text_preview string")
    told = spark.createDataFrame([(1, "see doc_a and doc_b"), (2, "nothing")], "query_id int, answer string")
    cited = answers.citations(ranked, told)
    snippets = {r["document_id"]: r["text_snippet"] for r in cited.collect()}
    assert snippets == {"doc_a": "x" * 200 + "...", "doc_b": "short"}
    assert {r["query_id"]: r["confidence"] for r in answers.confidence(told, cited).collect()} == {1: 0.75, 2: 0.0}


def test_validity(spark):
    df = spark.createDataFrame([("ok?",), (" a ",), ("  ",), ("",), (None,)], "text string")
    assert [r["is_valid"] for r in questions.validity(df).collect()] == [True, False, False, False, False]
