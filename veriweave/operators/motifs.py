"""Questions to the graph, as joins over the domain tables (GQ1-GQ14).

Each function takes a table of ids or terms, so that one job answers many
questions. Collections come as one row per member: a case or a person of any
size stays spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.functions.groups import broadcast_if_small, counted_side, top_per_key
from veriweave.operators.matching import containing
from veriweave.session import staged
from veriweave.sources.metadata import union_all

Tables = Mapping[str, DataFrame]

# How many results each question returns.
CASES_OF_ACCUSED = 20
CASES_OF_OFFICER = 50
TOGETHER = 20
OTHER_CASES = 5
PER_ENTITY = 3


def accused_edges(t: Tables) -> DataFrame:
    """Distinct (CaseMasterID, AccusedMasterID) whose case exists."""
    return (
        t["Accused"].select("CaseMasterID", "AccusedMasterID").filter("AccusedMasterID IS NOT NULL").distinct()
        .join(t["CaseMaster"].select("CaseMasterID"), "CaseMasterID", "left_semi")
    )


def _case_facts(t: Tables) -> DataFrame:
    return t["CaseMaster"].select(
        "CaseMasterID", F.col("CrimeNo").alias("crime_number"), F.col("CaseStatusID").alias("status")
    )


def cases_of_accused(ids: DataFrame, t: Tables, limit: int = CASES_OF_ACCUSED) -> DataFrame:
    """First cases of each accused person by case id (GQ1). ``ids`` has ``accused_id``."""
    edges = accused_edges(t).withColumnRenamed("AccusedMasterID", "accused_id")
    # The limit comes before the join with the cases, so a person with very many cases sends few rows.
    first = top_per_key(edges.join(ids, "accused_id", "left_semi"), ["accused_id"], [F.col("CaseMasterID")], limit)
    return first.join(_case_facts(t), "CaseMasterID").select(
        "accused_id", "rank", F.col("CaseMasterID").alias("case_id"), "crime_number", "status"
    )


def cases_of_officer(ids: DataFrame, t: Tables, limit: int = CASES_OF_OFFICER) -> DataFrame:
    """First cases each officer investigates by case id (GQ2). ``ids`` has ``officer_id``."""
    cases = t["CaseMaster"].select(
        F.col("PolicePersonID").alias("officer_id"), F.col("CaseMasterID").alias("case_id"),
        F.col("CrimeNo").alias("crime_number"), F.col("CaseStatusID").alias("status"),
    )
    known = ids.join(t["Employee"].select(F.col("EmployeeID").alias("officer_id")), "officer_id", "left_semi")
    return top_per_key(cases.join(known, "officer_id", "left_semi"), ["officer_id"], [F.col("case_id")], limit)


def _people_of_case(ids: DataFrame, people: DataFrame, key: str, name: str, out: str) -> DataFrame:
    rows = people.select(
        F.col("CaseMasterID").alias("case_id"), F.col(key).alias(out), F.col(name).alias("name"),
        F.col("AgeYear").alias("age"), F.col("GenderID").alias("gender"),
    )
    return rows.filter(F.col(out).isNotNull()).join(ids, "case_id", "left_semi").distinct()


def accused_of_case(ids: DataFrame, t: Tables) -> DataFrame:
    """Accused people on each case (GQ3). ``ids`` has ``case_id``."""
    return _people_of_case(ids, t["Accused"], "AccusedMasterID", "AccusedName", "accused_id")


def victims_of_case(ids: DataFrame, t: Tables) -> DataFrame:
    """Victims on each case (GQ4). ``ids`` has ``case_id``."""
    return _people_of_case(ids, t["Victim"], "VictimMasterID", "VictimName", "victim_id")


def case_network(ids: DataFrame, t: Tables) -> DataFrame:
    """Accused, victims, officers and stations of each case, a row per member (GQ5)."""
    cases = t["CaseMaster"].select("CaseMasterID", "CrimeNo", "PolicePersonID", "PoliceStationID").join(
        ids.select(F.col("case_id").alias("CaseMasterID")), "CaseMasterID", "left_semi"
    )

    def member(rows: DataFrame, role: str, key: str, name: str) -> DataFrame:
        return rows.select(
            F.col("CaseMasterID").alias("case_id"), F.lit(role).alias("role"),
            F.col(key).cast("bigint").alias("member_id"), F.col(name).alias("member_name"),
        ).filter("member_id IS NOT NULL")

    keys = cases.select("CaseMasterID")
    officers = cases.join(t["Employee"], F.col("PolicePersonID") == F.col("EmployeeID"))
    stations = cases.join(t["Unit"], F.col("PoliceStationID") == F.col("UnitID"))
    members = union_all([
        member(t["Accused"].join(keys, "CaseMasterID", "left_semi"), "accused", "AccusedMasterID", "AccusedName"),
        member(t["Victim"].join(keys, "CaseMasterID", "left_semi"), "victim", "VictimMasterID", "VictimName"),
        member(officers, "officer", "EmployeeID", "FirstName"),
        member(stations, "station", "UnitID", "UnitName"),
    ]).distinct()
    return members


def case_timeline(ids: DataFrame, t: Tables) -> DataFrame:
    """Arrests and chargesheets of each case, a row per event (GQ6). Sort by case and date to read it."""
    arrests = t["ArrestSurrender"].select(
        F.col("CaseMasterID").alias("case_id"), F.col("ArrestSurrenderDate").alias("event_date"),
        F.lit("arrest").alias("event_type"), F.col("ArrestSurrenderID").alias("event_id"),
    )
    sheets = t["ChargesheetDetails"].select(
        F.col("CaseMasterID").alias("case_id"), F.col("csdate").alias("event_date"),
        F.lit("chargesheet").alias("event_type"), F.col("CSID").alias("event_id"),
    )
    return arrests.unionByName(sheets).join(ids, "case_id", "left_semi").distinct()


def appear_together(ids: DataFrame, edges: DataFrame, limit: int = TOGETHER, large_case: int = 500) -> DataFrame:
    """People on the same cases as each person, most shared cases first, then by id (GQ7).

    Pairs are formed inside ordinary cases only. A case with more than ``large_case``
    people would give a pair for every two of them, so large cases are handled by
    membership: people on the same set of large cases are one class, classes are
    compared instead of people, and from each class only the lowest ids can be
    among the first results. The outcome is the same as with all pairs.
    """
    e = edges.select(F.col("CaseMasterID").alias("case"), F.col("AccusedMasterID").alias("person")).distinct()
    sizes = e.groupBy("case").agg(F.count(F.lit(1)).alias("people"))
    wanted = ids.select(F.col("accused_id").alias("person")).distinct()
    large = sizes.filter(F.col("people") > large_case).select("case")
    any_large = not large.isEmpty()
    small = e.join(large, "case", "left_anti") if any_large else e
    other = small.withColumnRenamed("person", "other")
    pairs = (
        small.join(wanted, "person", "left_semi").join(other, "case").filter("person <> other")
        .groupBy("person", "other").agg(F.count(F.lit(1)).alias("shared"))
    )
    if any_large:
        pairs = _with_large_cases(pairs, e.join(large, "case", "left_semi"), wanted, limit)
    ranked = top_per_key(pairs, ["person"], [F.col("shared").desc(), F.col("other")], limit)
    return ranked.select(
        F.col("person").alias("accused_id"), "rank", F.col("other").alias("together_with"),
        F.col("shared").alias("shared_cases"),
    )


def _with_large_cases(pairs: DataFrame, big: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Add the shared large cases to the counted pairs, and the candidates that only share large cases."""
    # A person is on few large cases compared with their number of people; a class is named by a hash of the set.
    member = big.groupBy("person").agg(F.array_sort(F.collect_set("case")).alias("cases"))
    member = member.withColumn("class", F.sha2(F.array_join("cases", ","), 256))
    classes = member.groupBy("class").agg(F.first("cases").alias("cases"))
    class_cases = classes.select("class", F.explode("cases").alias("case"))
    overlap = (
        class_cases.join(class_cases.withColumnRenamed("class", "other_class"), "case")
        .groupBy("class", "other_class").agg(F.count(F.lit(1)).alias("large_shared"))
    )
    of_person = member.select("person", "class")
    of_other = member.select(F.col("person").alias("other"), F.col("class").alias("other_class"))
    # Lowest ids per class, one more than asked for since a person is not their own company.
    lowest = top_per_key(of_other, ["other_class"], [F.col("other")], limit + 1, "position").drop("position")
    best_of_class = top_per_key(
        overlap.join(lowest, "other_class"), ["class"], [F.col("large_shared").desc(), F.col("other")],
        limit + 1, "position",
    ).select("class", "other", "large_shared")
    only_large = (
        of_person.join(wanted, "person", "left_semi").join(best_of_class, "class").filter("person <> other")
        .select("person", "other", F.col("large_shared").alias("shared"))
    )
    added = (
        pairs.join(of_person, "person", "left").join(of_other, "other", "left")
        .join(overlap, ["class", "other_class"], "left")
        .select("person", "other", (F.col("shared") + F.coalesce("large_shared", F.lit(0))).alias("shared"))
    )
    return added.unionByName(only_large).groupBy("person", "other").agg(F.max("shared").alias("shared"))


def connected_cases(ids: DataFrame, t: Tables, edges: DataFrame, limit: int = OTHER_CASES) -> DataFrame:
    """Other cases of the people on each case, first by person and case id (GQ8).

    A person's cases beyond the first ``limit + 1`` can not be among the results, so
    only those are joined.
    """
    e = edges.select(F.col("CaseMasterID").alias("case_id"), F.col("AccusedMasterID").alias("accused_id")).distinct()
    on_cases = e.join(broadcast_if_small(ids.select("case_id").distinct()), "case_id", "left_semi")
    people = broadcast_if_small(on_cases.select("accused_id").distinct())
    first = top_per_key(e.join(people, "accused_id", "left_semi"), ["accused_id"], [F.col("case_id")], limit + 1, "position").select(
        "accused_id", F.col("case_id").alias("other_case")
    )
    hops = on_cases.join(first, "accused_id").filter("case_id <> other_case")
    ranked = top_per_key(hops, ["case_id"], [F.col("accused_id"), F.col("other_case")], limit)
    names = t["Accused"].groupBy(F.col("AccusedMasterID").alias("accused_id")).agg(F.max("AccusedName").alias("name"))
    return ranked.join(names, "accused_id", "left").select("case_id", "rank", "accused_id", "name", "other_case")


def _triple(rows: DataFrame, node: Column, relationship: str, connected: Column) -> DataFrame:
    return rows.select(
        "query_id", node.alias("node"), F.lit(relationship).alias("relationship"),
        connected.alias("connected_to"), F.lit(1.0).alias("score"),
    )


def district_neighbourhood(queries: DataFrame, t: Tables) -> DataFrame:
    """Courts and units of a named district, each counted up to three (GQ9). ``queries``: query_id, district."""
    districts = t["District"].select("DistrictID", F.col("DistrictName").alias("district"))

    def capped(table: str, key: str, name: str) -> DataFrame:
        distinct = t[table].select("DistrictID", F.col(name).alias("n")).filter("n IS NOT NULL").distinct()
        return distinct.groupBy("DistrictID").agg(F.least(F.count(F.lit(1)), F.lit(PER_ENTITY)).alias(key))

    known = (
        districts.join(capped("Court", "courts", "CourtName"), "DistrictID", "left")
        .join(capped("Unit", "units", "UnitName"), "DistrictID", "left")
        .na.fill(0, ["courts", "units"])
    )
    rows = queries.filter("district IS NOT NULL").select("query_id", "district").join(known, "district")
    connected = F.format_string("%d Courts, %d Units", F.col("courts"), F.col("units"))
    return _triple(rows, F.concat(F.lit("District: "), F.col("district")), "HAS_COURT/UNIT", connected)


def _name_search(queries: DataFrame, counts: DataFrame, label: str, relationship: str) -> DataFrame:
    """Names containing a term, ignoring case, with their number of cases; three per query and term."""
    asked = queries.select("query_id", F.col("term").alias("asked"), F.lower("term").alias("term")).distinct()
    names = counts.withColumn("text", F.lower("name"))
    matched = containing(asked.select("term").distinct(), names)
    best = top_per_key(matched, ["term"], [F.col("cases").desc(), F.col("name")], PER_ENTITY)
    rows = asked.join(best, "term")
    return _triple(rows, F.concat(F.lit(label), F.col("name")), relationship,
                   F.concat(F.col("cases").cast("string"), F.lit(" Cases")))


def officers_named(queries: DataFrame, t: Tables) -> DataFrame:
    """Officers whose name contains a term (GQ10). ``queries``: query_id, term."""
    per_officer = t["CaseMaster"].groupBy(F.col("PolicePersonID").alias("EmployeeID")).agg(F.count(F.lit(1)).alias("n"))
    counts = per_officer.join(t["Employee"], "EmployeeID").groupBy(F.col("FirstName").alias("name")).agg(
        F.sum("n").alias("cases")
    )
    return _name_search(queries, counts, "Officer: ", "INVESTIGATES")


def accused_named(queries: DataFrame, t: Tables) -> DataFrame:
    """Accused people whose name contains a term (GQ11). ``queries``: query_id, term."""
    edges = t["Accused"].select("CaseMasterID", "AccusedMasterID", F.col("AccusedName").alias("name"))
    # The rows lie by case after the join, so making them distinct takes no further shuffle.
    counts = edges.join(t["CaseMaster"].select("CaseMasterID"), "CaseMasterID", "left_semi").distinct().groupBy("name").agg(
        F.count(F.lit(1)).alias("cases")
    )
    return _name_search(queries, counts.filter("name IS NOT NULL"), "Accused: ", "INVOLVED_IN")


def cases_numbered(queries: DataFrame, t: Tables) -> DataFrame:
    """Cases whose id is the term or whose crime number contains it, with up to three accused (GQ12)."""
    asked = queries.select("query_id", "term").distinct()
    terms = asked.select("term").distinct()
    cases = t["CaseMaster"].select("CaseMasterID", F.col("CrimeNo").cast("string").alias("text"))
    by_id = counted_side(terms.withColumn("CaseMasterID", F.col("term").try_cast("bigint"))).join(
        cases.select("CaseMasterID"), "CaseMasterID"
    ).filter(F.col("CaseMasterID").cast("string") == F.col("term"))
    by_number = containing(terms, cases)
    # A term may be in the numbers of most cases: only its first of each task go on to be made distinct.
    first = F.dense_rank().over(Window.partitionBy("term").orderBy("CaseMasterID"))
    matched = by_id.select("term", "CaseMasterID").unionByName(by_number.select("term", "CaseMasterID"))
    matched = matched.withColumn("first", first).filter(F.col("first") <= PER_ENTITY).select("term", "CaseMasterID").distinct()
    # Read three times below.
    best = staged(top_per_key(matched, ["term"], [F.col("CaseMasterID")], PER_ENTITY), "cases")
    people = t["Accused"].select("CaseMasterID", "AccusedMasterID", F.col("AccusedName").alias("name"))
    people = people.join(counted_side(best.select("CaseMasterID").distinct()), "CaseMasterID", "left_semi")
    # At most three names per case are collected.
    some = top_per_key(people.filter("name IS NOT NULL").distinct(), ["CaseMasterID"],
                       [F.col("AccusedMasterID"), F.col("name")], PER_ENTITY, "position")
    named = some.groupBy("CaseMasterID").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda p: p["name"]), ", ")
        .alias("names")
    )
    told = best.join(named.hint("merge"), "CaseMasterID", "left")
    rows = asked.join(counted_side(told, like=best), "term")
    return _triple(rows, F.concat(F.lit("Case: "), F.col("CaseMasterID").cast("string")), "HAS_ACCUSED",
                   F.coalesce("names", F.lit("Unknown")))


def sections_named(queries: DataFrame, t: Tables) -> DataFrame:
    """Sections whose id contains the term, with their number of cases (GQ13)."""
    asked = queries.select("query_id", "term").distinct()
    edges = t["ActSectionAssociation"].filter("ActID IS NOT NULL AND SectionID IS NOT NULL").join(
        t["CaseMaster"].select("CaseMasterID"), "CaseMasterID", "left_semi"
    ).distinct()
    counts = edges.groupBy(F.col("SectionID").cast("string").alias("text")).agg(F.count(F.lit(1)).alias("cases"))
    matched = containing(asked.select("term").distinct(), counts)
    best = top_per_key(matched, ["term"], [F.col("cases").desc(), F.col("text")], PER_ENTITY)
    rows = asked.join(best, "term")
    return _triple(rows, F.concat(F.lit("IPC Section: "), F.col("text")), "APPLIED_IN",
                   F.concat(F.col("cases").cast("string"), F.lit(" Cases")))


def search_entities(entities: DataFrame, t: Tables) -> DataFrame:
    """All graph results for extracted entities as triples (GQ14).

    ``entities``: query_id, district, names, case_numbers, ipc_sections. ``triple_no``
    numbers the results of a query: districts, officers, accused, cases, sections.
    """
    def terms(column: str) -> DataFrame:
        return entities.select("query_id", F.explode(column).alias("term"))

    parts = [
        district_neighbourhood(entities, t),
        officers_named(terms("names"), t),
        accused_named(terms("names"), t),
        cases_numbered(terms("case_numbers"), t),
        sections_named(terms("ipc_sections"), t),
    ]
    rows = union_all([p.withColumn("step", F.lit(i)) for i, p in enumerate(parts)])
    order = F.struct("step", "node", "connected_to")
    return rows.withColumn("triple_no", order)
