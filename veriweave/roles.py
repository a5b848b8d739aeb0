"""The benchmark tables in the roles of the domain tables.

nation, supplier, region and customer stand for districts, stations, courts and
officers; orders for cases; line items for the people, arrests, chargesheets
and sections of a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriweave.session import configure
from veriweave.sources.metadata import ForeignKey, TableMeta


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One benchmark table."""
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def domain_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The domain tables, projected from the benchmark tables."""
    nation, supplier, region, customer, orders, line = (
        read(spark, folder, n) for n in ("nation", "supplier", "region", "customer", "orders", "lineitem")
    )
    line_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias
    case_id = F.col("l_orderkey").alias("CaseMasterID")
    return {
        "District": nation.selectExpr("CAST(n_nationkey AS BIGINT) AS DistrictID", "n_name AS DistrictName"),
        "Unit": supplier.selectExpr(
            "s_suppkey AS UnitID", "s_name AS UnitName", "CAST(s_nationkey AS BIGINT) AS DistrictID"
        ),
        "Court": region.selectExpr(
            "CAST(r_regionkey AS BIGINT) AS CourtID", "r_name AS CourtName", "CAST(r_regionkey AS BIGINT) AS DistrictID"
        ),
        "Employee": customer.selectExpr(
            "c_custkey AS EmployeeID", "CAST(c_nationkey AS BIGINT) AS DistrictID", "c_custkey % 97 AS UnitID",
            "c_custkey % 5 AS RankID", "IF(c_acctbal < 0, NULL, c_custkey % 7) AS DesignationID",
            "CONCAT('KG', c_custkey) AS KGID", "c_name AS FirstName",
        ),
        "CaseMaster": orders.selectExpr(
            "o_orderkey AS CaseMasterID", "700000000 + o_orderkey AS CrimeNo", "202300000 + o_orderkey AS CaseNo",
            "o_orderdate AS `CrimeRegistered Date`",
            "IF(o_orderstatus = 'P', NULL, o_custkey) AS PolicePersonID",
            "o_custkey % 100 AS PoliceStationID", "o_orderkey % 4 AS CaseCategoryID",
            "CAST(ASCII(o_orderstatus) AS BIGINT) AS CaseStatusID", "o_orderkey % 6 AS CourtID",
            "o_orderdate AS IncidentFromDate",
            "IF(o_orderkey % 2 = 0, o_orderdate, o_orderdate + INTERVAL 1 DAY) AS IncidentToDate",
            "IF(o_orderpriority = '5-LOW', 'N/A', CONCAT('Priority ', o_orderpriority)) AS BriefFacts",
        ),
        "ComplainantDetails": orders.filter("o_orderstatus <> 'F'").selectExpr(
            "o_orderkey AS ComplainantID", "o_orderkey AS CaseMasterID", "CONCAT('Caller ', o_custkey) AS ComplainantName"
        ),
        "Victim": line.filter("l_returnflag = 'A'").select(
            line_id("VictimMasterID"), case_id, F.concat(F.lit("Resident "), F.col("l_suppkey")).alias("VictimName"),
            F.expr("IF(l_linenumber = 3, NULL, CAST(l_quantity AS BIGINT)) AS AgeYear"),
            F.expr("CAST(l_linenumber % 2 + 1 AS BIGINT) AS GenderID"),
        ),
        "Accused": line.select(
            line_id("AccusedMasterID"), case_id, F.concat(F.lit("Person "), F.col("l_partkey")).alias("AccusedName"),
            F.expr("IF(l_linenumber = 5, NULL, CAST(l_quantity AS BIGINT)) AS AgeYear"),
            F.expr("CAST(l_linenumber % 2 + 1 AS BIGINT) AS GenderID"),
            F.concat(F.lit("P"), F.col("l_partkey")).alias("PersonID"),
        ),
        "ActSectionAssociation": line.select(
            case_id, F.expr("CAST(l_linenumber AS BIGINT) AS ActID"), F.expr("CAST(300 + l_quantity AS BIGINT) AS SectionID")
        ),
        "ChargesheetDetails": line.filter("l_linestatus = 'F'").select(
            line_id("CSID"), case_id, F.col("l_shipdate").alias("csdate"), F.col("l_returnflag").alias("cstype"),
            F.col("l_suppkey").alias("PolicePersonID"),
        ),
        "ArrestSurrender": line.filter("l_returnflag = 'R'").select(
            line_id("ArrestSurrenderID"), case_id, F.col("l_shipdate").alias("ArrestSurrenderDate"),
            F.col("l_suppkey").alias("IOID"), F.expr("l_suppkey % 6 AS CourtID"), line_id("AccusedMasterID"),
        ),
    }


def person_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """As ``domain_tables``, but an accused person keeps one id across cases."""
    tables = domain_tables(spark, folder)
    line, part = read(spark, folder, "lineitem"), read(spark, folder, "part")
    names = part.selectExpr("p_partkey AS AccusedMasterID", "p_name AS AccusedName")
    edges = line.selectExpr("l_partkey AS AccusedMasterID", "l_orderkey AS CaseMasterID")
    tables["Accused"] = edges.join(names, "AccusedMasterID", "left")
    return tables


DECLARED: dict[str, TableMeta] = {
    "District": TableMeta("District", ("DistrictID",)),
    "Unit": TableMeta("Unit", ("UnitID",), (ForeignKey("DistrictID", "District", "DistrictID"),)),
    "Court": TableMeta("Court", ("CourtID",), (ForeignKey("DistrictID", "District", "DistrictID"),)),
    "Employee": TableMeta(
        "Employee", ("EmployeeID",),
        (ForeignKey("DistrictID", "District", "DistrictID"), ForeignKey("UnitID", "Unit", "UnitID")),
    ),
    "CaseMaster": TableMeta(
        "CaseMaster", ("CaseMasterID",),
        (
            ForeignKey("PoliceStationID", "Unit", "UnitID"),
            ForeignKey("CourtID", "Court", "CourtID"),
            ForeignKey("PolicePersonID", "Employee", "EmployeeID"),
        ),
        required=("PolicePersonID",),
        expected_types={"CaseMasterID": "int", "CrimeNo": "str", "CrimeRegistered Date": "datetime"},
    ),
    "ComplainantDetails": TableMeta(
        "ComplainantDetails", ("ComplainantID",), (ForeignKey("CaseMasterID", "CaseMaster", "CaseMasterID"),)
    ),
    "Victim": TableMeta("Victim", ("VictimMasterID",), (ForeignKey("CaseMasterID", "CaseMaster", "CaseMasterID"),)),
    "Accused": TableMeta("Accused", ("AccusedMasterID",), (ForeignKey("CaseMasterID", "CaseMaster", "CaseMasterID"),)),
    "ActSectionAssociation": TableMeta(
        "ActSectionAssociation", (), (ForeignKey("CaseMasterID", "CaseMaster", "CaseMasterID"),)
    ),
    "ChargesheetDetails": TableMeta(
        "ChargesheetDetails", ("CSID",),
        (
            ForeignKey("CaseMasterID", "CaseMaster", "CaseMasterID"),
            ForeignKey("PolicePersonID", "Employee", "EmployeeID"),
        ),
    ),
    "ArrestSurrender": TableMeta(
        "ArrestSurrender", ("ArrestSurrenderID",),
        (
            ForeignKey("CaseMasterID", "CaseMaster", "CaseMasterID"),
            ForeignKey("CourtID", "Court", "CourtID"),
            ForeignKey("AccusedMasterID", "Accused", "AccusedMasterID"),
        ),
    ),
}
