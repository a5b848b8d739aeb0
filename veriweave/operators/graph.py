"""The property graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.groups import one_row_per_key
from veriweave.operators.validation import primary_key
from veriweave.sources.metadata import ResolutionError, TableMeta, union_all

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class NodeSpec:
    """A kind of node: its label, the table it comes from and its key."""

    label: str
    table: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class EdgeSpec:
    """A kind of edge: its driving table and the columns that name both ends."""

    type: str
    table: str
    src: str
    src_columns: tuple[str, ...]
    dst: str
    dst_columns: tuple[str, ...]


# The kinds of nodes (G1-G11) and edges (G12-G28), parents first.
NODES: tuple[NodeSpec, ...] = (
    NodeSpec("District", "District", ("DistrictID",)),
    NodeSpec("Unit", "Unit", ("UnitID",)),
    NodeSpec("Court", "Court", ("CourtID",)),
    NodeSpec("Employee", "Employee", ("EmployeeID",)),
    NodeSpec("Case", "CaseMaster", ("CaseMasterID",)),
    NodeSpec("Complainant", "ComplainantDetails", ("ComplainantID",)),
    NodeSpec("Victim", "Victim", ("VictimMasterID",)),
    NodeSpec("Accused", "Accused", ("AccusedMasterID",)),
    NodeSpec("ActSection", "ActSectionAssociation", ("ActID", "SectionID")),
    NodeSpec("Chargesheet", "ChargesheetDetails", ("CSID",)),
    NodeSpec("Arrest", "ArrestSurrender", ("ArrestSurrenderID",)),
)
EDGES: tuple[EdgeSpec, ...] = (
    EdgeSpec("HAS_UNIT", "Unit", "District", ("DistrictID",), "Unit", ("UnitID",)),
    EdgeSpec("HAS_COURT", "Court", "District", ("DistrictID",), "Court", ("CourtID",)),
    EdgeSpec("HAS_EMPLOYEE", "Employee", "Unit", ("UnitID",), "Employee", ("EmployeeID",)),
    EdgeSpec("WORKS_IN", "Employee", "Employee", ("EmployeeID",), "District", ("DistrictID",)),
    EdgeSpec("REGISTERED_AT", "CaseMaster", "Case", ("CaseMasterID",), "Unit", ("PoliceStationID",)),
    EdgeSpec("HEARD_IN", "CaseMaster", "Case", ("CaseMasterID",), "Court", ("CourtID",)),
    EdgeSpec("INVESTIGATES", "CaseMaster", "Employee", ("PolicePersonID",), "Case", ("CaseMasterID",)),
    EdgeSpec("HAS_ACCUSED", "Accused", "Case", ("CaseMasterID",), "Accused", ("AccusedMasterID",)),
    EdgeSpec("HAS_VICTIM", "Victim", "Case", ("CaseMasterID",), "Victim", ("VictimMasterID",)),
    EdgeSpec("HAS_COMPLAINANT", "ComplainantDetails", "Case", ("CaseMasterID",), "Complainant", ("ComplainantID",)),
    EdgeSpec("HAS_SECTION", "ActSectionAssociation", "Case", ("CaseMasterID",), "ActSection", ("ActID", "SectionID")),
    EdgeSpec("HAS_CHARGESHEET", "ChargesheetDetails", "Case", ("CaseMasterID",), "Chargesheet", ("CSID",)),
    EdgeSpec("FILES_CHARGESHEET", "ChargesheetDetails", "Employee", ("PolicePersonID",), "Chargesheet", ("CSID",)),
    EdgeSpec("HAS_ARREST", "ArrestSurrender", "Case", ("CaseMasterID",), "Arrest", ("ArrestSurrenderID",)),
    EdgeSpec("ARRESTED_PERSON", "ArrestSurrender", "Arrest", ("ArrestSurrenderID",), "Accused", ("AccusedMasterID",)),
    EdgeSpec("MADE_ARREST", "ArrestSurrender", "Employee", ("IOID",), "Arrest", ("ArrestSurrenderID",)),
    EdgeSpec("PRODUCED_IN", "ArrestSurrender", "Arrest", ("ArrestSurrenderID",), "Court", ("CourtID",)),
)
_BY_LABEL = {n.label: n for n in NODES}


def key_text(columns: tuple[str, ...]) -> Column:
    """One text for a key of one or more columns."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def _has_key(columns: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def node_table(t: Tables, spec: NodeSpec) -> DataFrame:
    """One row per key with all columns of its table (G1-G11). Rows without a key are left out."""
    return one_row_per_key(t[spec.table].filter(_has_key(spec.key)), spec.key)


def nodes(t: Tables, spec: NodeSpec) -> DataFrame:
    """Nodes of one kind as (label, node_key, properties)."""
    rows = node_table(t, spec)
    properties = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.select(F.lit(spec.label).alias("label"), key_text(spec.key).alias("node_key"), properties.alias("properties"))


def edges(t: Tables, spec: EdgeSpec) -> DataFrame:
    """Distinct edges of one kind whose both ends exist.

    An end that the driving table itself defines exists as soon as its key is not
    NULL; only the other end is looked up.
    """
    rows = t[spec.table].filter(_has_key(spec.src_columns) & _has_key(spec.dst_columns))
    pairs = rows.select(*spec.src_columns, *spec.dst_columns).distinct()
    for label, columns in ((spec.src, spec.src_columns), (spec.dst, spec.dst_columns)):
        end = _BY_LABEL[label]
        if end.table == spec.table:
            continue
        known = t[end.table].select(*[F.col(k).alias(c) for k, c in zip(end.key, columns)])
        pairs = pairs.join(known, list(columns), "left_semi")
    return pairs.select(
        F.lit(spec.src).alias("src_label"), key_text(spec.src_columns).alias("src"),
        F.lit(spec.type).alias("type"),
        F.lit(spec.dst).alias("dst_label"), key_text(spec.dst_columns).alias("dst"),
    )


def build_graph(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    """Node table, edge table and the source tables that are missing.

    Kinds whose tables are missing are left out; with no table at all the build fails.
    """
    missing = sorted({n.table for n in NODES} - set(t))
    node_parts = [nodes(t, n) for n in NODES if n.table in t]
    if not node_parts:
        raise ResolutionError(f"none of the source tables exists: {missing}")
    edge_parts = [
        edges(t, e) for e in EDGES if {e.table, _BY_LABEL[e.src].table, _BY_LABEL[e.dst].table} <= set(t)
    ]
    session = node_parts[0].sparkSession
    schema = "src_label string, src string, type string, dst_label string, dst string"
    return union_all(node_parts), union_all(edge_parts or [session.createDataFrame([], schema)]), missing


def graph_statistics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes per label and edges per type, with their totals."""
    per_label = node_rows.rollup("label").agg(F.count(F.lit(1)).alias("n"))
    per_type = edge_rows.rollup("type").agg(F.count(F.lit(1)).alias("n"))
    named = per_label.select(F.lit("nodes").alias("kind"), F.coalesce("label", F.lit("(all)")).alias("name"), "n")
    return named.unionByName(
        per_type.select(F.lit("relationships").alias("kind"), F.coalesce("type", F.lit("(all)")).alias("name"), "n")
    )


def key_constraints(t: Tables) -> DataFrame:
    """Uniqueness of the node keys in their tables (G31). Sections are keyed by pair and may repeat."""
    checks = []
    for spec in NODES:
        if spec.label != "ActSection" and spec.table in t:
            check = primary_key(t[spec.table], TableMeta(spec.table, spec.key))
            checks.append(check.withColumn("label", F.lit(spec.label)))
    return union_all(checks)


def missing_keys(t: Tables) -> DataFrame:
    """Rows per table that are no node because their key is NULL."""
    return union_all([
        t[s.table].agg(F.count_if(~_has_key(s.key)).alias("rows_without_key")).select(
            F.lit(s.label).alias("label"), "rows_without_key"
        )
        for s in NODES
        if s.table in t
    ])
