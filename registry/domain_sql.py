"""The domain tables as SQL, for the checking side."""

DOMAIN = """
District AS (SELECT CAST(n_nationkey AS BIGINT) AS DistrictID, n_name AS DistrictName FROM nation),
Unit AS (SELECT s_suppkey AS UnitID, s_name AS UnitName, CAST(s_nationkey AS BIGINT) AS DistrictID FROM supplier),
Court AS (SELECT CAST(r_regionkey AS BIGINT) AS CourtID, r_name AS CourtName,
                 CAST(r_regionkey AS BIGINT) AS DistrictID FROM region),
Employee AS (SELECT c_custkey AS EmployeeID, CAST(c_nationkey AS BIGINT) AS DistrictID, c_custkey % 97 AS UnitID,
                    c_custkey % 5 AS RankID,
                    CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey % 7 END AS DesignationID,
                    concat('KG', c_custkey) AS KGID, c_name AS FirstName FROM customer),
CaseMaster AS (SELECT o_orderkey AS CaseMasterID, 700000000 + o_orderkey AS CrimeNo, 202300000 + o_orderkey AS CaseNo,
                      o_orderdate AS RegisteredDate,
                      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS PolicePersonID,
                      o_custkey % 100 AS PoliceStationID, o_orderkey % 4 AS CaseCategoryID,
                      CAST(ascii(o_orderstatus) AS BIGINT) AS CaseStatusID, o_orderkey % 6 AS CourtID,
                      o_orderdate AS IncidentFromDate,
                      CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END
                          AS IncidentToDate,
                      CASE WHEN o_orderpriority = '5-LOW' THEN 'N/A' ELSE concat('Priority ', o_orderpriority) END
                          AS BriefFacts
               FROM orders),
ComplainantDetails AS (SELECT o_orderkey AS ComplainantID, o_orderkey AS CaseMasterID,
                              concat('Caller ', o_custkey) AS ComplainantName FROM orders WHERE o_orderstatus <> 'F'),
Victim AS (SELECT l_orderkey * 10 + l_linenumber AS VictimMasterID, l_orderkey AS CaseMasterID,
                  concat('Resident ', l_suppkey) AS VictimName,
                  CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS AgeYear,
                  CAST(l_linenumber % 2 + 1 AS BIGINT) AS GenderID FROM lineitem WHERE l_returnflag = 'A'),
Accused AS (SELECT l_orderkey * 10 + l_linenumber AS AccusedMasterID, l_orderkey AS CaseMasterID,
                   concat('Person ', l_partkey) AS AccusedName,
                   CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS AgeYear,
                   CAST(l_linenumber % 2 + 1 AS BIGINT) AS GenderID, concat('P', l_partkey) AS PersonID
            FROM lineitem),
ActSectionAssociation AS (SELECT l_orderkey AS CaseMasterID, CAST(l_linenumber AS BIGINT) AS ActID,
                                 CAST(300 + l_quantity AS BIGINT) AS SectionID FROM lineitem),
ChargesheetDetails AS (SELECT l_orderkey * 10 + l_linenumber AS CSID, l_orderkey AS CaseMasterID,
                              l_shipdate AS csdate, l_returnflag AS cstype, l_suppkey AS PolicePersonID
                       FROM lineitem WHERE l_linestatus = 'F'),
ArrestSurrender AS (SELECT l_orderkey * 10 + l_linenumber AS ArrestSurrenderID, l_orderkey AS CaseMasterID,
                           l_shipdate AS ArrestSurrenderDate, l_suppkey AS IOID, l_suppkey % 6 AS CourtID,
                           l_orderkey * 10 + l_linenumber AS AccusedMasterID
                    FROM lineitem WHERE l_returnflag = 'R'),
Person AS (SELECT l_partkey AS AccusedMasterID, l_orderkey AS CaseMasterID, p_name AS AccusedName
           FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
"""


def domain(body: str) -> str:
    """A query over the domain tables; ``body`` may start with further tables and a comma."""
    return f"WITH {DOMAIN.strip()},\n{body}" if body.lstrip()[:6].upper() != "SELECT" else f"WITH {DOMAIN.strip()}\n{body}"
