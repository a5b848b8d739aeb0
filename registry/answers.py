"""Lookup and question queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.domain_sql import domain
from registry.retrieval import RANKED_SQL, searched, turn_queries
from veriweave.operators import answers, lookups, questions
from veriweave.plans.answering import answer_questions
from veriweave.roles import domain_tables, read
from veriweave.session import staged


def _keys(spark: SparkSession, sf: str, table: str, expr: str) -> DataFrame:
    return read(spark, sf, table).selectExpr(f"{expr} AS key_value").distinct()


def l1(spark, sf):
    keys = _keys(spark, sf, "orders", "o_orderkey * 2")
    return lookups.lookup(keys, lookups.cases(domain_tables(spark, sf)), "case_id", ["case_number", "status"])


REFERENCES = {
    "spark": "CASE o_orderkey % 4 WHEN 0 THEN 'case_id' WHEN 1 THEN 'case_number' WHEN 2 THEN 'crime_number' ELSE 'case_id' END",
    "value": "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS {t}) WHEN 1 THEN CAST(202300000 + o_orderkey AS {t}) WHEN 2 THEN "
             "CAST(700000000 + o_orderkey * 2 AS {t}) ELSE 'CR/' || o_orderkey END",
}


def references(spark, sf):
    return read(spark, sf, "orders").selectExpr(
        "o_orderkey AS ref_id", f"{REFERENCES['spark']} AS kind", f"{REFERENCES['value'].format(t='STRING')} AS value"
    )


REFS_SQL = (
    f"refs AS (SELECT o_orderkey AS ref_id, {REFERENCES['spark']} AS kind, {REFERENCES['value'].format(t='VARCHAR')} AS value FROM orders),\n"
    "hits AS (SELECT r.*, c.CaseMasterID AS case_id, CaseNo AS case_number, CrimeNo AS crime_number, PolicePersonID AS police_person_id, "
    "PoliceStationID AS station_id, CaseStatusID AS status, c.CaseMasterID IS NOT NULL AS found FROM refs r LEFT JOIN CaseMaster c ON "
    "TRY_CAST(value AS BIGINT) = CASE kind WHEN 'case_id' THEN c.CaseMasterID WHEN 'case_number' THEN c.CaseNo ELSE c.CrimeNo END)"
)


def l2(spark, sf):
    return lookups.find_cases(references(spark, sf), domain_tables(spark, sf))


def l3(spark, sf):
    return lookups.find_officers(_keys(spark, sf, "orders", "o_custkey + 50"), domain_tables(spark, sf))


def l4(spark, sf):
    return lookups.find_victims(_keys(spark, sf, "lineitem", "l_orderkey * 10 + l_linenumber"), domain_tables(spark, sf))


def l5(spark, sf):
    return lookups.find_accused(_keys(spark, sf, "orders", "o_orderkey * 10 + 1"), domain_tables(spark, sf))


def l6(spark, sf):
    return lookups.victims_of_cases(_keys(spark, sf, "orders", "o_orderkey"), domain_tables(spark, sf))


def l7(spark, sf):
    return lookups.accused_of_cases(_keys(spark, sf, "orders", "o_orderkey"), domain_tables(spark, sf))


def l8(spark, sf):
    names = read(spark, sf, "part").selectExpr("CONCAT('PERSON ', p_partkey * 2) AS name")
    return lookups.accused_by_name(names, domain_tables(spark, sf)).select(
        "asked", "position", "accused_id", "case_id", "name", "found"
    )


def l9(spark, sf):
    return lookups.chargesheet_status(_keys(spark, sf, "orders", "o_orderkey"), domain_tables(spark, sf))


def _records(table: str, columns: list[str]):
    def run(spark, sf):
        rows = lookups.records_of_cases(_keys(spark, sf, "orders", "o_orderkey"), domain_tables(spark, sf), table)
        out = [F.date_format(c, "yyyy-MM-dd").alias(c) if c.lower().endswith("date") else F.col(c) for c in columns]
        return rows.select("key_value", "found", *out)

    shown = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" if c.lower().endswith("date") else c for c in columns)
    sql = domain(
        f"SELECT o_orderkey AS key_value, t.CaseMasterID IS NOT NULL AS found, {shown} FROM orders LEFT JOIN {table} t ON t.CaseMasterID = o_orderkey"
    )
    return run, sql


def _full(table: str, key: str, columns: list[str], source: str, expr: str):
    def run(spark, sf):
        rows = lookups.full_records(_keys(spark, sf, source, expr), domain_tables(spark, sf), table, key)
        return rows.select("key_value", "found", *columns)

    sql = domain(
        f"SELECT k.key_value, t.{key} IS NOT NULL AS found, {', '.join('t.' + c for c in columns)} FROM (SELECT DISTINCT {expr} AS key_value FROM {source}) k "
        f"LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(columns)}) AS rn FROM {table}) WHERE rn = 1) t "
        f"ON t.{key} = k.key_value"
    )
    return run, sql


def l13(spark, sf):
    rows = lookups.full_cases(references(spark, sf), domain_tables(spark, sf))
    record = F.from_json("record", "CaseMasterID BIGINT, name STRING, cstype STRING, IOID BIGINT")
    return rows.select("ref_id", "case_id", "section", "record_id", F.coalesce(
        record["name"], record["cstype"], record["IOID"].cast("string"), F.lit("-")).alias("detail"))


def l15(spark, sf):
    return lookups.officers_of_cases(references(spark, sf), domain_tables(spark, sf)).select(
        "ref_id", "case_id", "police_person_id", "first_name", "officer_status"
    )


def l16(spark, sf):
    ids = read(spark, sf, "orders").selectExpr("o_orderkey AS case_id")
    return lookups.case_context(ids, domain_tables(spark, sf)).select(
        "case_id", F.col("section").cast("bigint").alias("section"), "part", "block"
    )


L16_SQL = domain(
    "o AS (SELECT c.*, e.FirstName, e.KGID, e.DesignationID, e.RankID FROM CaseMaster c LEFT JOIN Employee e ON c.PolicePersonID = e.EmployeeID),\n"
    "v AS (SELECT CaseMasterID, 'Victims (' || count(*) || '):' || chr(10) || string_agg(entry, chr(10) ORDER BY id, entry) AS b FROM (SELECT CaseMasterID, "
    "VictimMasterID AS id, '  - ' || VictimName || ' (' || COALESCE(CAST(AgeYear AS VARCHAR), '?') || ', ' || GenderID || ')' AS entry FROM Victim) GROUP BY 1),\n"
    "a AS (SELECT CaseMasterID, 'Accused (' || count(*) || '):' || chr(10) || string_agg(entry, chr(10) ORDER BY id, entry) AS b FROM (SELECT CaseMasterID, "
    "AccusedMasterID AS id, '  - ' || AccusedName || ' (' || COALESCE(CAST(AgeYear AS VARCHAR), '?') || ', ' || GenderID || ', PersonID: ' || PersonID || ')' AS entry "
    "FROM Accused) GROUP BY 1),\n"
    "s AS (SELECT CaseMasterID, min(csdate) AS d FROM ChargesheetDetails GROUP BY 1)\n"
    "SELECT CaseMasterID AS case_id, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS part, 'Case: ' || CaseNo || ' | Crime (FIR): ' || CrimeNo || ' | Status: ' || "
    "CaseStatusID || COALESCE(chr(10) || 'Officer: ' || FirstName || ' (' || COALESCE(DesignationID, RankID) || ', KGID: ' || KGID || ')', '') AS block FROM o\n"
    "UNION ALL SELECT c.CaseMasterID, 1, 0, COALESCE(b, 'Victims: None recorded') FROM CaseMaster c LEFT JOIN v ON v.CaseMasterID = c.CaseMasterID\n"
    "UNION ALL SELECT c.CaseMasterID, 2, 0, COALESCE(b, 'Accused: None recorded') FROM CaseMaster c LEFT JOIN a ON a.CaseMasterID = c.CaseMasterID\n"
    "UNION ALL SELECT c.CaseMasterID, 3, 0, CASE WHEN d IS NULL THEN 'Chargesheet: Not Filed' ELSE 'Chargesheet: Filed on ' || strftime(d, '%Y-%m-%d %H:%M:%S') || "
    "' at Unknown' END FROM CaseMaster c LEFT JOIN s ON s.CaseMasterID = c.CaseMasterID"
)

# Questions made from orders: one phrasing per order, by its key.
PHRASES = [
    "'Show case ' || (202300000 + {k})", "'case id ' || {k}", "'FIR number ' || (700000000 + {k} * 2)",
    "'crime number CR/2023/' || {k}", "'Who is the investigating officer for CaseNo ' || (202300000 + {k}) || '?'",
    "'list the victims of case ' || (202300000 + {k})", "'accused in case #' || (202300000 + {k})",
    "'was the chargesheet for case no. ' || (202300000 + {k}) || ' filed'", "'status of that case'", "'status of case id ' || {k}",
    "'Officer ' || ({k} % 3000)", "'victim ' || ({k} * 10 + 1)", "'tell me about the accused id ' || ({k} * 10 + 2)",
    "'accused named Person Q' || chr(CAST(65 + {k} % 26 AS INT))", "'Fiyaz Saran'", "'theft patterns near the market'",
    "'Find co-accused in these cases'", "'Who is connected to this gang?'", "'accused persons in Bangalore'",
    "'summarize case ' || (202300000 + {k})", "'network of case ' || (202300000 + {k})", "'timeline for case id ' || {k}",
    "'co-accused on case id ' || {k}", "'explain case id ' || {k}", "'  CaseMasterID ' || {k}", "'case number 0' || {k}",
]


def phrase(key: str) -> str:
    return f"CASE {key} % {len(PHRASES)} " + " ".join(f"WHEN {i} THEN {p.format(k=key)}" for i, p in enumerate(PHRASES)) + " END"


def asked(spark, sf):
    return read(spark, sf, "orders").selectExpr("o_orderkey AS question_id", f"{phrase('o_orderkey')} AS text")


def l17(spark, sf):
    return questions.detect_intent(asked(spark, sf)).select(
        "question_id", "intent", "sub_intent", F.col("confidence").cast("double").alias("confidence")
    )


def l18(spark, sf):
    return questions.detect_intent(asked(spark, sf)).select("question_id", "identifier_kind", "identifier_value")


def _in(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


_TOPICS = "CASE " + " ".join(f"WHEN {_in(words)} THEN '{name}'" for name, words in questions.CASE_TOPICS) + " END"
_NUMBER = "CASE WHEN regexp_matches({v}, '^\\d+$') THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE {v} END"
_STOPS = ", ".join(f"'{w}'" for w in questions.NAME_STOP_WORDS)
DETECT_SQL = (
    f"asked AS (SELECT o_orderkey AS question_id, {phrase('o_orderkey')} AS text FROM orders),\n"
    "m AS (SELECT question_id, trim(text) AS raw, lower(trim(text)) AS low, "
    + ", ".join(
        f"regexp_extract(trim(text), '{_duck(questions.CASE_REFERENCE)}', {i}) AS {n}" for i, n in ((1, "kind"), (2, "word"), (3, "val"))
    )
    + ", " + ", ".join(
        f"nullif(regexp_extract(trim(text), '{_duck(p)}', 1), '') AS {n}"
        for p, n in ((questions.OFFICER_REFERENCE, "off_id"), (questions.VICTIM_REFERENCE, "vic_id"), (questions.ACCUSED_REFERENCE, "acc_id"),
                     (questions.ACCUSED_NAME, "named"), (questions.BARE_NAME, "bare"))
    )
    + " FROM asked),\n"
    "r AS (SELECT *, CASE WHEN val = '' THEN NULL WHEN regexp_replace(lower(kind), '\\s+', '', 'g') = 'casemasterid' OR (lower(kind) = 'case' AND "
    f"lower(word) = 'id') THEN 'case_id' WHEN lower(kind) = 'case' THEN 'case_number' ELSE 'crime_number' END AS ref_kind, {_NUMBER.format(v="nullif(val, '')")} AS ref_value, "
    f"{_in(questions.REASONING_WORDS)} AS reasoned, {_in(questions.GRAPH_WORDS)} AS graphy, COALESCE(named, bare) AS person FROM m),\n"
    f"t AS (SELECT *, CASE WHEN ref_kind IS NOT NULL OR {_in(questions.SPOKEN_REFERENCES)} THEN {_TOPICS} END AS topic, "
    f"CASE WHEN person IS NOT NULL AND len(list_filter(string_split_regex(lower(person), '\\s+'), lambda w: w IN ({_STOPS}))) = 0 THEN "
    "regexp_replace(person, '\\s+', ' ', 'g') END AS name FROM r),\n"
    "s AS (SELECT *, CASE WHEN topic IS NOT NULL THEN topic WHEN off_id IS NOT NULL THEN 'officer' WHEN vic_id IS NOT NULL THEN 'victim' "
    "WHEN acc_id IS NOT NULL THEN 'accused' WHEN ref_kind = 'case_id' THEN 'case_by_id' WHEN ref_kind = 'case_number' THEN 'case_by_number' "
    "WHEN ref_kind = 'crime_number' THEN 'case_by_crime' WHEN graphy THEN 'relationship' WHEN name IS NOT NULL THEN 'accused_by_name' "
    "ELSE 'similar_cases' END AS sub_intent FROM t),\n"
    "d AS (SELECT question_id, sub_intent, CASE WHEN reasoned OR sub_intent IN ('case_network', 'co_accused', 'case_timeline', 'summarize_case') THEN 'reasoning' "
    "WHEN topic IS NOT NULL THEN 'factual_query' WHEN sub_intent = 'relationship' THEN 'graph_query' WHEN sub_intent = 'similar_cases' THEN 'semantic_search' "
    "ELSE 'identifier_lookup' END AS intent, CASE WHEN topic IS NOT NULL THEN 0.95 WHEN sub_intent IN ('officer', 'victim', 'accused', 'case_by_id', "
    "'case_by_number', 'case_by_crime') THEN 0.9 WHEN sub_intent = 'relationship' THEN 0.7 WHEN sub_intent = 'accused_by_name' THEN CASE WHEN named IS NOT NULL "
    "THEN 0.85 ELSE 0.6 END ELSE 0.5 END AS confidence, CASE WHEN sub_intent IN ('officer', 'victim', 'accused') THEN sub_intent || '_id' WHEN topic IS NOT NULL OR "
    "starts_with(sub_intent, 'case_by_') THEN ref_kind WHEN sub_intent = 'accused_by_name' THEN 'accused_name' END AS identifier_kind, CASE WHEN sub_intent IN "
    "('officer', 'victim', 'accused') THEN CAST(CAST(COALESCE(off_id, vic_id, acc_id) AS BIGINT) AS VARCHAR) WHEN topic IS NOT NULL OR starts_with(sub_intent, 'case_by_') "
    "THEN ref_value WHEN sub_intent = 'accused_by_name' THEN name END AS identifier_value FROM s)"
)

CASE_MENTION = "CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Case No. ' || (1000 + conv_id) || ': ' || text ELSE text END"


def turns(spark, sf):
    return read(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", f"{CASE_MENTION} AS text")


def l19(spark, sf):
    return questions.resolve_history(turns(spark, sf)).select("conv_id", "turn", "history_case")


def l20(spark, sf):
    return questions.last_turns(turns(spark, sf)).select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


def l21(spark, sf):
    rows = answer_questions(asked(spark, sf), domain_tables(spark, sf))
    return rows.filter(~F.col("response_type").isin("context")).select("question_id", "part_no", "response_type", "found", "answer")


def l21_context(spark, sf):
    rows = answer_questions(asked(spark, sf), domain_tables(spark, sf))
    return rows.filter(F.col("response_type") == "context").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("answer")).alias("characters")
    )


def l23(spark, sf):
    rows = answer_questions(asked(spark, sf), domain_tables(spark, sf))
    parsed = F.from_json("data", "case STRUCT<case_id: BIGINT, case_number: BIGINT>, role STRING, total BIGINT, entity STRING, query STRING")
    return rows.filter("data IS NOT NULL").select(
        "question_id", "response_type", parsed["case"]["case_number"].alias("case_number"), parsed["role"].alias("role"),
        parsed["total"].alias("total"),
    )


_LABEL = "CASE identifier_kind WHEN 'case_number' THEN 'CaseNo ' WHEN 'crime_number' THEN 'CrimeNo ' ELSE 'CaseMasterID ' END || identifier_value"
_PERSON = ("'**' || {n} || '** (' || COALESCE(AgeYear || ' years old', 'Age unknown') || ', ' || 'Gender ID ' || GenderID || ')'")
ANSWER_SQL = (
    DETECT_SQL + ",\n"
    "res AS (SELECT d.*, c.*, " + _LABEL + " AS label, 'CaseNo ' || CaseNo AS flabel, regexp_matches(identifier_value, '^-*[0-9]+$') AS numeric FROM d LEFT JOIN CaseMaster c "
    "ON TRY_CAST(identifier_value AS BIGINT) = CASE identifier_kind WHEN 'case_id' THEN c.CaseMasterID WHEN 'case_number' THEN c.CaseNo WHEN 'crime_number' THEN c.CrimeNo END),\n"
    "vl AS (SELECT CaseMasterID AS cid, count(*) AS n, string_agg(pos || '. ' || entry, chr(10) ORDER BY pos) AS txt FROM (SELECT *, row_number() OVER (PARTITION BY "
    "CaseMasterID ORDER BY id, entry) AS pos FROM (SELECT CaseMasterID, VictimMasterID AS id, " + _PERSON.format(n="VictimName") + " AS entry FROM Victim)) GROUP BY 1),\n"
    "al AS (SELECT CaseMasterID AS cid, count(*) AS n, string_agg(pos || '. ' || entry, chr(10) ORDER BY pos) AS txt FROM (SELECT *, row_number() OVER (PARTITION BY "
    "CaseMasterID ORDER BY id, entry) AS pos FROM (SELECT CaseMasterID, AccusedMasterID AS id, " + _PERSON.format(n="AccusedName")
    + " || ' — PersonID ' || PersonID || ', AccusedMasterID ' || AccusedMasterID AS entry FROM Accused)) GROUP BY 1),\n"
    "cs AS (SELECT CaseMasterID AS cid, min(csdate) AS day FROM ChargesheetDetails GROUP BY 1),\n"
    "v1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY VictimMasterID ORDER BY CaseMasterID, VictimName, AgeYear NULLS FIRST, GenderID) AS rn FROM Victim) WHERE rn = 1),\n"
    "a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY AccusedMasterID ORDER BY CaseMasterID, AccusedName, AgeYear NULLS FIRST, GenderID) AS rn FROM Accused) WHERE rn = 1),\n"
    "scoped AS (SELECT res.*, e.FirstName, e.KGID, e.EmployeeID, e.DesignationID, e.RankID, vl.n AS vn, vl.txt AS vtxt, al.n AS an, al.txt AS atxt, cs.day FROM res "
    "LEFT JOIN Employee e ON e.EmployeeID = PolicePersonID LEFT JOIN vl ON vl.cid = CaseMasterID LEFT JOIN al ON al.cid = CaseMasterID LEFT JOIN cs ON cs.cid = CaseMasterID "
    "WHERE identifier_kind IN ('case_id', 'case_number', 'crime_number') AND sub_intent NOT IN ('similar_cases', 'relationship')),\n"
    "out_ AS (\n"
    "SELECT question_id, 'answer' AS response_type, false AS found, '''' || identifier_value || ''' is not a valid numeric ' || CASE identifier_kind WHEN 'case_id' THEN "
    "'CaseMasterID' WHEN 'case_number' THEN 'CaseNo' ELSE 'CrimeNo' END || '.' AS answer FROM scoped WHERE NOT numeric\n"
    "UNION ALL SELECT question_id, 'answer', false, 'No case was found for ' || label || '.' FROM scoped WHERE numeric AND CaseMasterID IS NULL\n"
    "UNION ALL SELECT question_id, 'case_details', true, '### Case Details' || chr(10) || '- **Case Number (CaseNo):** ' || CaseNo || chr(10) || "
    "'- **Crime Number (CrimeNo / FIR):** ' || CrimeNo || chr(10) || '- **Case Status ID:** ' || CaseStatusID || chr(10) || '- **Investigating Officer (PolicePersonID):** ' || "
    "COALESCE(CAST(PolicePersonID AS VARCHAR), 'Not recorded') || chr(10) || '- **Police Station ID:** ' || PoliceStationID || chr(10) || '- **Database ID (CaseMasterID):** ' || "
    "CaseMasterID FROM scoped WHERE CaseMasterID IS NOT NULL AND starts_with(sub_intent, 'case_by_')\n"
    "UNION ALL SELECT question_id, 'case_details', true, '**Case Number:** ' || CaseNo || chr(10) || '**Crime Number:** ' || CrimeNo || chr(10) || '**Status ID:** ' || CaseStatusID "
    "FROM scoped WHERE CaseMasterID IS NOT NULL AND sub_intent = 'status_for_case'\n"
    "UNION ALL SELECT question_id, CASE WHEN EmployeeID IS NULL THEN 'answer' ELSE 'officer_details' END, EmployeeID IS NOT NULL, CASE WHEN PolicePersonID IS NULL THEN "
    "'No investigating officer is recorded for ' || label || '.' WHEN EmployeeID IS NULL THEN label || ' references PolicePersonID ' || PolicePersonID || "
    "', but no matching Employee record was found.' ELSE 'The investigating officer for ' || flabel || ' is **' || FirstName || '** (EmployeeID ' || EmployeeID || ', KGID: ' || KGID || "
    "'). Designation ID: ' || COALESCE(DesignationID, RankID) || '.' END FROM scoped WHERE CaseMasterID IS NOT NULL AND sub_intent = 'officer_for_case'\n"
    "UNION ALL SELECT question_id, CASE WHEN vn IS NULL THEN 'answer' ELSE 'person_details' END, vn IS NOT NULL, COALESCE('Found ' || vn || ' victim(s) for ' || flabel || ':' || chr(10) || vtxt, "
    "'There are no victims listed for ' || flabel || '.') FROM scoped WHERE CaseMasterID IS NOT NULL AND sub_intent = 'victim_for_case'\n"
    "UNION ALL SELECT question_id, CASE WHEN an IS NULL THEN 'answer' ELSE 'person_details' END, an IS NOT NULL, COALESCE('Found ' || an || ' accused for ' || flabel || ':' || chr(10) || atxt, "
    "'There are no accused listed for ' || flabel || '.') FROM scoped WHERE CaseMasterID IS NOT NULL AND sub_intent = 'accused_for_case'\n"
    "UNION ALL SELECT question_id, 'case_details', true, CASE WHEN day IS NULL THEN 'No chargesheet has been filed yet for ' || flabel || '.' ELSE 'Yes, the chargesheet for ' || flabel || "
    "' was filed on **' || strftime(day, '%Y-%m-%d %H:%M:%S') || '**.' END FROM scoped WHERE CaseMasterID IS NOT NULL AND sub_intent = 'chargesheet_for_case'\n"
    "UNION ALL SELECT question_id, CASE WHEN EmployeeID IS NULL THEN 'answer' ELSE 'officer_details' END, EmployeeID IS NOT NULL, CASE WHEN EmployeeID IS NULL THEN "
    "'No officer was found with EmployeeID ' || identifier_value || '.' ELSE '### Officer Details' || chr(10) || '- **Name:** ' || FirstName || chr(10) || '- **KGID:** ' || KGID || chr(10) || "
    "'- **Designation ID:** ' || COALESCE(CAST(DesignationID AS VARCHAR), 'N/A') || chr(10) || '- **Rank ID:** ' || RankID || chr(10) || '- **Employee ID:** ' || EmployeeID END FROM d LEFT JOIN "
    "Employee ON EmployeeID = CAST(identifier_value AS BIGINT) WHERE sub_intent = 'officer'\n"
    "UNION ALL SELECT question_id, CASE WHEN VictimMasterID IS NULL THEN 'answer' ELSE 'person_details' END, VictimMasterID IS NOT NULL, CASE WHEN VictimMasterID IS NULL THEN "
    "'No victim was found with VictimMasterID ' || identifier_value || '.' ELSE '### Victim Details' || chr(10) || '- **Name:** ' || VictimName || chr(10) || '- **Age:** ' || "
    "COALESCE(CAST(AgeYear AS VARCHAR), 'Unknown') || chr(10) || '- **Gender ID:** ' || GenderID || chr(10) || '- **CaseMasterID:** ' || CaseMasterID || chr(10) || "
    "'- **Database ID (VictimMasterID):** ' || VictimMasterID END FROM d LEFT JOIN v1 ON VictimMasterID = CAST(identifier_value AS BIGINT) WHERE sub_intent = 'victim'\n"
    "UNION ALL SELECT question_id, CASE WHEN AccusedMasterID IS NULL THEN 'answer' ELSE 'person_details' END, AccusedMasterID IS NOT NULL, CASE WHEN AccusedMasterID IS NULL THEN "
    "'No accused was found with AccusedMasterID ' || identifier_value || '.' ELSE '### Accused Details' || chr(10) || '- **Name:** ' || AccusedName || chr(10) || '- **Age:** ' || "
    "COALESCE(CAST(AgeYear AS VARCHAR), 'Unknown') || chr(10) || '- **Gender ID:** ' || GenderID || chr(10) || '- **PersonID:** ' || PersonID || chr(10) || '- **CaseMasterID:** ' || CaseMasterID || "
    "chr(10) || '- **Database ID (AccusedMasterID):** ' || AccusedMasterID END FROM d LEFT JOIN a1 ON AccusedMasterID = CAST(identifier_value AS BIGINT) WHERE sub_intent = 'accused'\n"
    "UNION ALL SELECT question_id, 'answer', false, 'No accused records were found for the name ''' || identifier_value || '''.' FROM d WHERE sub_intent = 'accused_by_name'\n"
    "UNION ALL SELECT question_id, 'answer', false, 'I couldn''t identify which case or person you are asking about. Please include a CaseNo, CrimeNo or ID.' FROM d "
    "WHERE identifier_kind IS NULL AND sub_intent NOT IN ('similar_cases', 'relationship'))"
)



def l22_names(spark, sf):
    """The same records under names of letters only, so that the questions name them."""
    tables = domain_tables(spark, sf)
    part = read(spark, sf, "part").selectExpr("CONCAT('Person ', p_partkey) AS AccusedName", "p_name")
    tables["Accused"] = tables["Accused"].join(part, "AccusedName").drop("AccusedName").withColumnRenamed("p_name", "AccusedName")
    text = read(spark, sf, "part").selectExpr("p_partkey AS question_id", "'find accused named ' || p_name || '?' AS text")
    return answer_questions(text, tables, by_name=lookups.MAX_BY_NAME).select("question_id", "part_no", "response_type", "found", "answer")


NAMES_SQL = domain(
    "acc AS (SELECT AccusedMasterID, CaseMasterID, AgeYear, GenderID, PersonID, p_name FROM Accused JOIN part ON AccusedName = 'Person ' || p_partkey),\n"
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY AccusedMasterID, CaseMasterID, PersonID, AgeYear NULLS FIRST, GenderID) AS pos FROM acc),\n"
    "tied AS (SELECT lower(p_name) AS k, count(*) AS n, min(p_name) AS name, string_agg('- AccusedMasterID ' || AccusedMasterID || ' | CaseMasterID ' || CaseMasterID || "
    "' | PersonID ' || PersonID || ' | Age ' || COALESCE(CAST(AgeYear AS VARCHAR), 'Unknown') || ' | Gender ID ' || GenderID, chr(10) ORDER BY pos) AS lines FROM ranked WHERE pos <= 50 GROUP BY 1)\n"
    "SELECT p_partkey AS question_id, CAST(0 AS BIGINT) AS part_no, 'search_results' AS response_type, true AS found, 'Found **' || n || '** accused record(s) for **' || name || "
    "'**. A name is not a unique identity — each record below is a distinct entry:' || chr(10) || lines || chr(10) || 'Specify a CaseMasterID, AccusedMasterID or PersonID to narrow this down.' "
    "AS answer FROM part JOIN tied ON k = lower(p_name)"
)


def cited_answers(spark, sf):
    """An answer per query that cites the documents of even rank."""
    # Read for the answers and again for the citations.
    ranked = staged(searched(spark, sf), "ranked")
    cited = ranked.filter("rank % 2 = 0").groupBy("query_id").agg(
        F.concat(F.lit("See "), F.array_join(F.array_sort(F.collect_list("document_id")), ", ")).alias("answer")
    )
    return ranked, cited


def l24(spark, sf):
    ranked, cited = cited_answers(spark, sf)
    return answers.citations(ranked, cited)


def l25(spark, sf):
    ranked, cited = cited_answers(spark, sf)
    return answers.confidence(turn_queries(spark, sf), answers.citations(ranked, cited))


CITED_SQL = (
    RANKED_SQL + ",\ntop5 AS (SELECT * FROM ranked WHERE rank <= 5),\nans AS (SELECT query_id, 'See ' || string_agg(document_id, ', ' ORDER BY document_id) AS answer FROM top5 "
    "WHERE rank % 2 = 0 GROUP BY 1),\ncites AS (SELECT t.query_id, document_id, document_type, final_score AS score, CASE WHEN length(text_preview) > 200 THEN substr(text_preview, 1, 200) "
    "|| '...' ELSE text_preview END AS text_snippet FROM top5 t JOIN ans a ON a.query_id = t.query_id WHERE contains(answer, document_id))"
)


def l26(spark, sf):
    text = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '  ' WHEN 2 THEN ' ab ' ELSE NULL END"
    rows = read(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{text} AS text")
    return questions.validity(rows).select("conv_id", "turn", "reason", "is_valid")


QUERIES = {
    "L1_lookup": (
        l1,
        domain("SELECT k.key_value, CaseNo AS case_number, CaseStatusID AS status, CaseMasterID IS NOT NULL AS found FROM (SELECT DISTINCT o_orderkey * 2 AS key_value FROM orders) k "
               "LEFT JOIN CaseMaster ON CaseMasterID = key_value"),
    ),
    "L2_case_by_kind": (l2, domain(REFS_SQL + "\nSELECT * FROM hits")),
    "L3_officer": (
        l3,
        domain("SELECT k.key_value, FirstName AS first_name, KGID AS kgid, DesignationID AS designation, RankID AS rank, EmployeeID IS NOT NULL AS found FROM "
               "(SELECT DISTINCT o_custkey + 50 AS key_value FROM orders) k LEFT JOIN Employee ON EmployeeID = key_value"),
    ),
    "L4_victim": (
        l4,
        domain("SELECT k.key_value, CaseMasterID AS case_id, VictimName AS name, AgeYear AS age, GenderID AS gender, VictimMasterID IS NOT NULL AS found FROM (SELECT DISTINCT "
               "l_orderkey * 10 + l_linenumber AS key_value FROM lineitem) k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY VictimMasterID ORDER BY CaseMasterID, VictimName, "
               "AgeYear NULLS FIRST, GenderID) AS rn FROM Victim) WHERE rn = 1) v ON VictimMasterID = key_value"),
    ),
    "L5_accused": (
        l5,
        domain("SELECT k.key_value, CaseMasterID AS case_id, AccusedName AS name, AgeYear AS age, GenderID AS gender, PersonID AS person_id, AccusedMasterID IS NOT NULL AS found FROM "
               "(SELECT DISTINCT o_orderkey * 10 + 1 AS key_value FROM orders) k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY AccusedMasterID ORDER BY CaseMasterID, "
               "AccusedName, AgeYear NULLS FIRST, GenderID) AS rn FROM Accused) WHERE rn = 1) v ON AccusedMasterID = key_value"),
    ),
    "L6_victims_of_case": (
        l6,
        domain("SELECT o_orderkey AS key_value, VictimMasterID AS victim_id, VictimName AS name, AgeYear AS age, GenderID AS gender, VictimMasterID IS NOT NULL AS found FROM orders LEFT JOIN "
               "Victim ON CaseMasterID = o_orderkey"),
    ),
    "L7_accused_of_case": (
        l7,
        domain("SELECT o_orderkey AS key_value, AccusedMasterID AS accused_id, AccusedName AS name, AgeYear AS age, GenderID AS gender, PersonID AS person_id, AccusedMasterID IS NOT NULL AS found "
               "FROM orders LEFT JOIN Accused ON CaseMasterID = o_orderkey"),
    ),
    "L8_name_all": (
        l8,
        domain("a AS (SELECT 'PERSON ' || (p_partkey * 2) AS asked FROM part),\nr AS (SELECT *, row_number() OVER (PARTITION BY lower(AccusedName) ORDER BY AccusedMasterID, CaseMasterID) AS position "
               "FROM Accused)\nSELECT asked, position, AccusedMasterID AS accused_id, CaseMasterID AS case_id, AccusedName AS name, position IS NOT NULL AS found FROM a LEFT JOIN r ON lower(AccusedName) = "
               "lower(asked) AND position <= 50"),
    ),
    "L9_status_flag": (
        l9,
        domain("SELECT o_orderkey AS key_value, day IS NOT NULL AS filed, strftime(day, '%Y-%m-%d %H:%M:%S') AS date, CAST(NULL AS VARCHAR) AS court_name FROM orders LEFT JOIN (SELECT CaseMasterID, "
               "min(csdate) AS day FROM ChargesheetDetails GROUP BY 1) ON CaseMasterID = o_orderkey"),
    ),
    "L10_arrests": _records("ArrestSurrender", ["ArrestSurrenderID", "ArrestSurrenderDate", "IOID", "CourtID", "AccusedMasterID"]),
    "L11_chargesheets": _records("ChargesheetDetails", ["CSID", "csdate", "cstype", "PolicePersonID"]),
    "L12_sections": _records("ActSectionAssociation", ["ActID", "SectionID"]),
    "L13_full_case": (
        l13,
        domain(REFS_SQL + ",\nf AS (SELECT ref_id, case_id FROM hits WHERE found)\n"
               "SELECT ref_id, case_id, 'case' AS section, CAST(case_id AS VARCHAR) AS record_id, '-' AS detail FROM f UNION ALL "
               "SELECT ref_id, case_id, 'accused', CAST(AccusedMasterID AS VARCHAR), AccusedName FROM f JOIN Accused ON CaseMasterID = case_id UNION ALL "
               "SELECT ref_id, case_id, 'victim', CAST(VictimMasterID AS VARCHAR), VictimName FROM f JOIN Victim ON CaseMasterID = case_id UNION ALL "
               "SELECT ref_id, case_id, 'arrest', CAST(ArrestSurrenderID AS VARCHAR), CAST(IOID AS VARCHAR) FROM f JOIN ArrestSurrender ON CaseMasterID = case_id UNION ALL "
               "SELECT ref_id, case_id, 'chargesheet', CAST(CSID AS VARCHAR), cstype FROM f JOIN ChargesheetDetails ON CaseMasterID = case_id"),
    ),
    "L14_full_officer": _full("Employee", "EmployeeID", ["DistrictID", "UnitID", "KGID", "FirstName"], "orders", "o_custkey + 50"),
    "L14_full_complainant": _full("ComplainantDetails", "ComplainantID", ["CaseMasterID", "ComplainantName"], "orders", "o_orderkey"),
    "L15_two_hop": (
        l15,
        domain(REFS_SQL + "\nSELECT ref_id, case_id, police_person_id, FirstName AS first_name, CASE WHEN NOT found THEN 'case not found' WHEN police_person_id IS NULL THEN 'no officer recorded' "
               "WHEN EmployeeID IS NULL THEN 'officer record missing' ELSE 'officer found' END AS officer_status FROM hits LEFT JOIN Employee ON EmployeeID = police_person_id"),
    ),
    "L16_summary_text": (l16, L16_SQL),
    "L17_intent": (l17, f"WITH {DETECT_SQL} SELECT question_id, intent, sub_intent, CAST(confidence AS DOUBLE) AS confidence FROM d"),
    "L18_identifiers": (l18, f"WITH {DETECT_SQL} SELECT question_id, identifier_kind, identifier_value FROM d"),
    "L19_history": (
        l19,
        f"WITH t AS (SELECT conv_id, turn, nullif(regexp_extract({CASE_MENTION}, '{questions.HISTORY_CASE}', 1), '') AS said FROM conversations) SELECT conv_id, turn, "
        "last_value(said IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history_case FROM t",
    ),
    "L20_last_turns": (
        l20,
        f"SELECT conv_id, turn, role, md5(t) AS text_hash FROM (SELECT *, {CASE_MENTION} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) "
        "WHERE rn <= 6 AND role IN ('user', 'assistant') AND t <> ''",
    ),
    "L21_L22_answers": (
        l21, domain(ANSWER_SQL + "\nSELECT question_id, CAST(0 AS BIGINT) AS part_no, response_type, found, answer FROM out_"),
    ),
    "L21_reasoning_context": (l21_context, None),
    "L22_answers_by_name": (l22_names, NAMES_SQL),
    "L23_payload": (
        l23,
        domain(ANSWER_SQL + "\nSELECT o.question_id, o.response_type, CASE WHEN s.sub_intent NOT IN ('officer', 'victim', 'accused') THEN s.CaseNo END AS case_number, "
               "CASE s.sub_intent WHEN 'officer' THEN 'officer' WHEN 'victim' THEN 'victim' WHEN 'accused' THEN 'accused' WHEN 'victim_for_case' THEN 'victim' WHEN 'accused_for_case' "
               "THEN 'accused' END AS role, CASE s.sub_intent WHEN 'victim_for_case' THEN vl.n WHEN 'accused_for_case' THEN al.n END AS total FROM out_ o JOIN res s ON o.question_id = "
               "s.question_id LEFT JOIN vl ON vl.cid = s.CaseMasterID LEFT JOIN al ON al.cid = s.CaseMasterID WHERE o.found"),
    ),
    "L24_citations": (l24, f"WITH {CITED_SQL} SELECT * FROM cites"),
    "L25_confidence": (
        l25,
        f"WITH {CITED_SQL} SELECT t.query_id, COALESCE(floor(CAST(sum(CAST(score AS DECIMAL(18,3))) AS DOUBLE) / count(score) * 1000 + 0.5 + 1e-7) / 1000, 0.0) AS confidence FROM "
        "turns t LEFT JOIN cites c ON c.query_id = t.query_id GROUP BY 1",
    ),
    "L26_validity": (
        l26,
        "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Query cannot be entirely whitespace.' WHEN 2 THEN 'Query is too short. Please provide more detail.' "
        "ELSE 'Query cannot be empty.' END AS reason, turn % 4 = 0 AS is_valid FROM conversations",
    ),
}
