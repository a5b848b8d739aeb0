"""Graph building and graph question queries (G1-G31, GQ1-GQ14)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.domain_sql import domain
from veriweave.operators import graph, motifs
from veriweave.operators.matching import GramIndex
from veriweave.roles import domain_tables, person_tables, read
from veriweave.session import checkpoint_dir

# Columns of each node table in the order that decides which of several rows is kept.
_NODE_COLUMNS = {
    "District": ["DistrictName"], "Unit": ["UnitName", "DistrictID"], "Court": ["CourtName", "DistrictID"],
    "Employee": ["DistrictID", "UnitID", "RankID", "DesignationID", "KGID", "FirstName"],
    "CaseMaster": ["CrimeNo", "CaseNo"],
    "ComplainantDetails": ["CaseMasterID", "ComplainantName"],
    "Victim": ["CaseMasterID", "VictimName", "AgeYear", "GenderID"],
    "Accused": ["CaseMasterID", "AccusedName", "AgeYear", "GenderID", "PersonID"],
    "ActSectionAssociation": ["CaseMasterID"],
    "ChargesheetDetails": ["CaseMasterID", "csdate", "cstype", "PolicePersonID"],
    "ArrestSurrender": ["CaseMasterID", "ArrestSurrenderDate", "IOID", "CourtID", "AccusedMasterID"],
}


def _texts(names):
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in names]


def _node(spec: graph.NodeSpec):
    columns = _NODE_COLUMNS[spec.table]
    shown = [c for c in columns if not c.endswith("ate")]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = graph.node_table(domain_tables(spark, sf), spec)
        return rows.select(graph.key_text(spec.key).alias("node_key"), F.concat_ws("|", *_texts(shown)).alias("properties"))

    key = ", ".join(spec.key)
    order = ", ".join(f"{c} DESC NULLS LAST" for c in columns)
    props = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '-')" for c in shown)
    keys = ", ".join(f"CAST({c} AS VARCHAR)" for c in spec.key)
    sql = domain(
        f"SELECT concat_ws(':', {keys}) AS node_key, concat_ws('|', {props}) AS properties FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY {order}) AS rn FROM {spec.table}) WHERE rn = 1"
    )
    return run, sql


def _edge_select(spec: graph.EdgeSpec) -> str:
    by_label = {n.label: n for n in graph.NODES}
    src = ", ".join(f"CAST(t.{c} AS VARCHAR)" for c in spec.src_columns)
    dst = ", ".join(f"CAST(t.{c} AS VARCHAR)" for c in spec.dst_columns)
    conditions = [f"t.{c} IS NOT NULL" for c in spec.src_columns + spec.dst_columns]
    for label, columns in ((spec.src, spec.src_columns), (spec.dst, spec.dst_columns)):
        end = by_label[label]
        same = " AND ".join(f"e.{k} = t.{c}" for k, c in zip(end.key, columns))
        conditions.append(f"EXISTS (SELECT 1 FROM {end.table} e WHERE {same})")
    return (
        f"SELECT DISTINCT '{spec.src}' AS src_label, concat_ws(':', {src}) AS src, '{spec.type}' AS type, '{spec.dst}' AS dst_label, "
        f"concat_ws(':', {dst}) AS dst FROM {spec.table} t WHERE {' AND '.join(conditions)}"
    )


def _edge(spec: graph.EdgeSpec):
    return (lambda spark, sf: graph.edges(domain_tables(spark, sf), spec)), domain(_edge_select(spec))


def all_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, _ = graph.build_graph(domain_tables(spark, sf))
    return nodes.select("label", "node_key")


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_graph(domain_tables(spark, sf))[1]


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = graph.build_graph(domain_tables(spark, sf))
    return graph.graph_statistics(nodes, edges)


NODES_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{n.label}' AS label, concat_ws(':', {', '.join(f'CAST({k} AS VARCHAR)' for k in n.key)}) AS node_key FROM {n.table}"
    for n in graph.NODES
)
EDGES_SQL = " UNION ALL ".join(_edge_select(e) for e in graph.EDGES)


def constraints(spark: SparkSession, sf: str) -> DataFrame:
    tables = domain_tables(spark, sf)
    return graph.key_constraints(tables).join(graph.missing_keys(tables), "label").select(
        "label", "status", "violations", "rows_without_key"
    )


CONSTRAINTS_SQL = domain(" UNION ALL ".join(
    f"SELECT '{n.label}' AS label, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n AS violations, "
    f"(SELECT count(*) FROM {n.table} WHERE {n.key[0]} IS NULL) AS rows_without_key FROM (SELECT CAST(COALESCE(sum(c), 0) AS BIGINT) AS n "
    f"FROM (SELECT count(*) AS c FROM {n.table} GROUP BY {n.key[0]} HAVING count(*) > 1))"
    for n in graph.NODES if n.label != "ActSection"
))


def _ids(spark: SparkSession, sf: str, table: str, column: str, name: str) -> DataFrame:
    return read(spark, sf, table).select(F.col(column).alias(name))


def gq1(spark, sf):
    return motifs.cases_of_accused(_ids(spark, sf, "part", "p_partkey", "accused_id"), person_tables(spark, sf))


def gq2(spark, sf):
    return motifs.cases_of_officer(_ids(spark, sf, "customer", "c_custkey", "officer_id"), domain_tables(spark, sf)).select(
        "officer_id", "rank", "case_id", "crime_number", "status"
    )


def gq3(spark, sf):
    return motifs.accused_of_case(_ids(spark, sf, "orders", "o_orderkey", "case_id"), domain_tables(spark, sf))


def gq4(spark, sf):
    return motifs.victims_of_case(_ids(spark, sf, "orders", "o_orderkey", "case_id"), domain_tables(spark, sf))


def gq5(spark, sf):
    return motifs.case_network(_ids(spark, sf, "orders", "o_orderkey", "case_id"), domain_tables(spark, sf))


def gq6(spark, sf):
    rows = motifs.case_timeline(_ids(spark, sf, "orders", "o_orderkey", "case_id"), domain_tables(spark, sf))
    return rows.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


def gq7(spark, sf):
    return motifs.appear_together(
        _ids(spark, sf, "part", "p_partkey", "accused_id"), motifs.accused_edges(person_tables(spark, sf))
    )


def gq8(spark, sf):
    tables = person_tables(spark, sf)
    return motifs.connected_cases(_ids(spark, sf, "orders", "o_orderkey", "case_id"), tables, motifs.accused_edges(tables))


def _triples(df: DataFrame) -> DataFrame:
    return df.select("query_id", "node", "relationship", "connected_to", "score")


def gq9(spark, sf):
    queries = read(spark, sf, "customer").selectExpr("c_custkey AS query_id", "CONCAT('NATION_', c_nationkey + c_custkey % 2) AS district")
    return _triples(motifs.district_neighbourhood(queries, domain_tables(spark, sf)))


def gq10(spark, sf):
    queries = read(spark, sf, "customer").selectExpr("c_custkey AS query_id", "CONCAT('R#', RIGHT(c_name, 9)) AS term").unionByName(
        read(spark, sf, "customer").selectExpr("c_custkey AS query_id", "RIGHT(c_name, 3) AS term")
    )
    return _triples(motifs.officers_named(queries, domain_tables(spark, sf)))


def gq11(spark, sf):
    queries = read(spark, sf, "part").selectExpr("p_partkey AS query_id", "UPPER(SPLIT_PART(p_name, ' ', 2)) AS term")
    return _triples(motifs.accused_named(queries, person_tables(spark, sf)))


def gq12(spark, sf):
    queries = read(spark, sf, "orders").selectExpr("o_orderkey AS query_id", "CAST(o_orderkey AS STRING) AS term")
    return _triples(motifs.cases_numbered(queries, domain_tables(spark, sf)))


def gq13(spark, sf):
    queries = read(spark, sf, "part").selectExpr("p_partkey AS query_id", "CAST(p_size AS STRING) AS term")
    return _triples(motifs.sections_named(queries, domain_tables(spark, sf)))


def gq14(spark, sf):
    """Entities of each supplier: a district, a name, a case number and a section."""
    entities = read(spark, sf, "supplier").selectExpr(
        "s_suppkey AS query_id", "CONCAT('NATION_', s_nationkey) AS district", "ARRAY(RIGHT(s_name, 4)) AS names",
        "ARRAY(CAST(s_suppkey + 7000000 AS STRING), CAST(s_suppkey AS STRING)) AS case_numbers",
        "ARRAY(CAST(300 + s_suppkey % 60 AS STRING)) AS ipc_sections",
    )
    return _triples(motifs.search_entities(entities, domain_tables(spark, sf)))


_OFFICER_COUNTS = ("counts AS (SELECT FirstName AS name, count(*) AS cases FROM CaseMaster JOIN Employee ON PolicePersonID = EmployeeID "
                   "GROUP BY 1),\n")


def _officer_named(asked: str) -> str:
    return (
        f"SELECT query_id, 'Officer: ' || name AS node, 'INVESTIGATES' AS relationship, cases || ' Cases' AS connected_to, 1.0::DOUBLE AS score "
        f"FROM {asked} a JOIN (SELECT term, name, cases, row_number() OVER (PARTITION BY term ORDER BY cases DESC, name) AS rn FROM "
        f"(SELECT DISTINCT lower(term) AS term FROM {asked}) JOIN counts ON contains(lower(name), term)) r "
        f"ON lower(a.term) = r.term WHERE rn <= 3"
    )


_CASES_NUMBERED = """SELECT query_id, 'Case: ' || r.CaseMasterID AS node, 'HAS_ACCUSED' AS relationship,
  COALESCE((SELECT string_agg(name, ', ' ORDER BY pos) FROM people p WHERE p.CaseMasterID = r.CaseMasterID AND pos <= 3), 'Unknown')
    AS connected_to, 1.0::DOUBLE AS score
FROM {asked} a JOIN (SELECT term, CaseMasterID, row_number() OVER (PARTITION BY term ORDER BY CaseMasterID) AS rn FROM (
    SELECT term, CaseMasterID FROM (SELECT DISTINCT term FROM {asked}) JOIN CaseMaster ON CAST(CaseMasterID AS VARCHAR) = term
    UNION SELECT term, CaseMasterID FROM (SELECT DISTINCT term FROM {asked}) JOIN CaseMaster ON contains(CAST(CrimeNo AS VARCHAR), term))) r
  ON a.term = r.term WHERE rn <= 3"""
_PEOPLE = ("people AS (SELECT CaseMasterID, AccusedName AS name, row_number() OVER (PARTITION BY CaseMasterID ORDER BY AccusedMasterID, "
           "AccusedName) AS pos FROM (SELECT DISTINCT CaseMasterID, AccusedMasterID, AccusedName FROM Accused)),\n")
_SECTIONS = """SELECT query_id, 'IPC Section: ' || sec AS node, 'APPLIED_IN' AS relationship, cases || ' Cases' AS connected_to,
  1.0::DOUBLE AS score FROM {asked} a JOIN (SELECT term, sec, cases, row_number() OVER (PARTITION BY term ORDER BY cases DESC, sec) AS rn
  FROM (SELECT DISTINCT term FROM {asked}) JOIN (SELECT CAST(SectionID AS VARCHAR) AS sec, count(*) AS cases FROM
  (SELECT DISTINCT CaseMasterID, ActID, SectionID FROM ActSectionAssociation) GROUP BY 1) ON contains(sec, term)) r
  ON a.term = r.term WHERE rn <= 3"""
_DISTRICTS = """SELECT query_id, 'District: ' || district AS node, 'HAS_COURT/UNIT' AS relationship,
  least(3, (SELECT count(DISTINCT CourtName) FROM Court c WHERE c.DistrictID = d.DistrictID)) || ' Courts, ' ||
  least(3, (SELECT count(DISTINCT UnitName) FROM Unit u WHERE u.DistrictID = d.DistrictID)) || ' Units' AS connected_to, 1.0::DOUBLE AS score
FROM {asked} a JOIN District d ON d.DistrictName = a.district"""



def triple_sql(districts: str, names: str, numbers: str, sections: str) -> list[str]:
    """SQL of the graph results for extracted entities, in the order of the steps."""
    officer = _officer_named(names)
    accused = officer.replace("'Officer: '", "'Accused: '").replace("'INVESTIGATES'", "'INVOLVED_IN'").replace("JOIN counts", "JOIN pcounts")
    return [_DISTRICTS.format(asked=districts), officer, accused, _CASES_NUMBERED.format(asked=numbers), _SECTIONS.format(asked=sections)]


OFFICER_COUNTS, PEOPLE = _OFFICER_COUNTS, _PEOPLE

QUERIES = {
    **{f"G{i}_{s.label.lower()}_nodes": _node(s) for i, s in enumerate(graph.NODES, 1)},
    **{f"G{i}_{s.type.lower()}": _edge(s) for i, s in enumerate(graph.EDGES, 12)},
    "G29_graph_nodes": (all_nodes, domain(NODES_SQL)),
    "G29_graph_edges": (all_edges, domain(EDGES_SQL)),
    "G30_graph_stats": (
        statistics,
        domain(
            f"SELECT 'nodes' AS kind, COALESCE(label, '(all)') AS name, count(*) AS n FROM ({NODES_SQL}) GROUP BY ROLLUP(label) "
            f"UNION ALL SELECT 'relationships', COALESCE(type, '(all)'), count(*) FROM ({EDGES_SQL}) GROUP BY ROLLUP(type)"
        ),
    ),
    "G31_key_constraints": (constraints, CONSTRAINTS_SQL),
    "GQ1_cases_of_accused": (
        gq1,
        domain("SELECT accused_id, rank, case_id, CrimeNo AS crime_number, CaseStatusID AS status FROM (SELECT AccusedMasterID AS accused_id, "
               "CaseMasterID AS case_id, row_number() OVER (PARTITION BY AccusedMasterID ORDER BY CaseMasterID) AS rank FROM "
               "(SELECT DISTINCT AccusedMasterID, CaseMasterID FROM Person)) JOIN CaseMaster ON case_id = CaseMasterID WHERE rank <= 20"),
    ),
    "GQ2_officer_cases": (
        gq2,
        domain("SELECT * FROM (SELECT PolicePersonID AS officer_id, row_number() OVER (PARTITION BY PolicePersonID ORDER BY CaseMasterID) AS rank, "
               "CaseMasterID AS case_id, CrimeNo AS crime_number, CaseStatusID AS status FROM CaseMaster WHERE PolicePersonID IN "
               "(SELECT EmployeeID FROM Employee)) WHERE rank <= 50"),
    ),
    "GQ3_accused_of_case": (
        gq3,
        domain("SELECT DISTINCT CaseMasterID AS case_id, AccusedMasterID AS accused_id, AccusedName AS name, AgeYear AS age, GenderID AS gender FROM Accused"),
    ),
    "GQ4_victims_of_case": (
        gq4,
        domain("SELECT DISTINCT CaseMasterID AS case_id, VictimMasterID AS victim_id, VictimName AS name, AgeYear AS age, GenderID AS gender FROM Victim"),
    ),
    "GQ5_network": (
        gq5,
        domain("SELECT CaseMasterID AS case_id, 'accused' AS role, AccusedMasterID AS member_id, AccusedName AS member_name FROM Accused "
               "UNION SELECT CaseMasterID, 'victim', VictimMasterID, VictimName FROM Victim "
               "UNION SELECT CaseMasterID, 'officer', EmployeeID, FirstName FROM CaseMaster JOIN Employee ON PolicePersonID = EmployeeID "
               "UNION SELECT CaseMasterID, 'station', UnitID, UnitName FROM CaseMaster JOIN Unit ON PoliceStationID = UnitID"),
    ),
    "GQ6_timeline": (
        gq6,
        domain("SELECT CaseMasterID AS case_id, strftime(ArrestSurrenderDate, '%Y-%m-%d') AS event_date, 'arrest' AS event_type, "
               "ArrestSurrenderID AS event_id FROM ArrestSurrender UNION SELECT CaseMasterID, strftime(csdate, '%Y-%m-%d'), 'chargesheet', CSID "
               "FROM ChargesheetDetails"),
    ),
    "GQ7_cooccurrence": (
        gq7,
        domain("e AS (SELECT DISTINCT CaseMasterID AS c, AccusedMasterID AS p FROM Person),\n"
               "n AS (SELECT a.p AS accused_id, b.p AS together_with, count(*) AS shared_cases FROM e a JOIN e b ON a.c = b.c AND a.p <> b.p GROUP BY 1, 2)\n"
               "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accused_id ORDER BY shared_cases DESC, together_with) AS rank FROM n) WHERE rank <= 20"),
    ),
    "GQ8_two_hop": (
        gq8,
        domain("e AS (SELECT DISTINCT CaseMasterID AS c, AccusedMasterID AS p FROM Person),\n"
               "h AS (SELECT a.c AS case_id, a.p AS accused_id, b.c AS other_case, row_number() OVER (PARTITION BY a.c ORDER BY a.p, b.c) AS rank "
               "FROM e a JOIN e b ON a.p = b.p AND a.c <> b.c)\n"
               "SELECT case_id, rank, accused_id, p_name AS name, other_case FROM h LEFT JOIN part ON p_partkey = accused_id WHERE rank <= 5"),
    ),
    "GQ9_neighbourhood": (
        gq9,
        domain("asked AS (SELECT c_custkey AS query_id, 'NATION_' || (c_nationkey + c_custkey % 2) AS district FROM customer)\n"
               + _DISTRICTS.format(asked="asked")),
    ),
    "GQ10_officer_name": (
        gq10,
        domain(_OFFICER_COUNTS + "asked AS (SELECT DISTINCT * FROM (SELECT c_custkey AS query_id, 'R#' || right(c_name, 9) AS term FROM customer "
               "UNION ALL SELECT c_custkey, right(c_name, 3) FROM customer))\n" + _officer_named("asked")),
    ),
    "GQ11_accused_name": (
        gq11,
        domain("counts AS (SELECT AccusedName AS name, count(*) AS cases FROM (SELECT DISTINCT AccusedMasterID, CaseMasterID, AccusedName FROM Person) "
               "GROUP BY 1),\nasked AS (SELECT p_partkey AS query_id, upper(split_part(p_name, ' ', 2)) AS term FROM part)\n"
               + _officer_named("asked").replace("'Officer: '", "'Accused: '").replace("'INVESTIGATES'", "'INVOLVED_IN'")),
    ),
    "GQ12_case_search": (
        gq12,
        domain(_PEOPLE + "asked AS (SELECT o_orderkey AS query_id, CAST(o_orderkey AS VARCHAR) AS term FROM orders)\n"
               + _CASES_NUMBERED.format(asked="asked")),
    ),
    "GQ13_section_search": (
        gq13,
        domain("asked AS (SELECT p_partkey AS query_id, CAST(p_size AS VARCHAR) AS term FROM part)\n" + _SECTIONS.format(asked="asked")),
    ),
    "GQ14_entity_dispatch": (
        gq14,
        domain(
            _OFFICER_COUNTS + _PEOPLE
            + "ent AS (SELECT s_suppkey AS query_id, 'NATION_' || s_nationkey AS district, right(s_name, 4) AS name, s_suppkey FROM supplier),\n"
            "named AS (SELECT query_id, name AS term FROM ent),\n"
            "numbered AS (SELECT query_id, CAST(s_suppkey + 7000000 AS VARCHAR) AS term FROM ent UNION SELECT query_id, CAST(s_suppkey AS VARCHAR) FROM ent),\n"
            "sect AS (SELECT query_id, CAST(300 + s_suppkey % 60 AS VARCHAR) AS term FROM ent),\n"
            "pcounts AS (SELECT AccusedName AS name, count(*) AS cases FROM (SELECT DISTINCT AccusedMasterID, CaseMasterID, AccusedName FROM Accused) GROUP BY 1)\n"
            + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in (
                _DISTRICTS.format(asked="ent"), _officer_named("named"),
                _officer_named("named").replace("'Officer: '", "'Accused: '").replace("'INVESTIGATES'", "'INVOLVED_IN'").replace("JOIN counts", "JOIN pcounts"),
                _CASES_NUMBERED.format(asked="numbered"), _SECTIONS.format(asked="sect"),
            ))
        ),
    ),
}


def gram_index(spark: SparkSession, sf: str) -> DataFrame:
    """Names that contain a term, by a stored index that was built from some names and brought up to date with the others."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/grams/{uuid.uuid4().hex}"
    names = read(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    index = GramIndex.at(spark, root, 8)
    index.build(names.filter("length(text) % 3 > 0").unionByName(names.selectExpr("concat(text, ' gone') AS text")))
    index.update(names, names.selectExpr("concat(text, ' gone') AS text"))
    words = read(spark, sf, "part").select(F.explode(F.array(F.substring("p_name", 1, 1), F.substring("p_name", 2, 3), F.substring("p_name", 4, 9), F.concat("p_type", F.lit("?")))).alias("term"))
    return index.search(words.distinct())


QUERIES |= {
    "GQ10_GQ13_gram_index": (
        gram_index,
        "WITH terms AS (SELECT DISTINCT unnest([p_name[1:1], p_name[2:4], p_name[4:12], p_type || '?']) AS term FROM part), names AS (SELECT DISTINCT p_name AS text FROM part) "
        "SELECT term, text FROM terms JOIN names ON contains(text, term) WHERE term <> ''",
    ),
}
