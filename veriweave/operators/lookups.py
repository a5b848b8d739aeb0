"""Keyed lookups (L1-L16): a table of keys joined once. A missing key gives a row with ``found = false``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.functions.groups import PART_ROWS, broadcast_if_small, keys_to_match, list_in_parts, matching, measured_groups, tasks_for, top_per_key
from veriweave.sources.metadata import coerce_values, logical_table, quoted, union_all

Tables = Mapping[str, DataFrame]

CASE_COLUMNS = ["case_id", "case_number", "crime_number", "police_person_id", "station_id", "status"]
OFFICER_COLUMNS = ["employee_id", "first_name", "kgid", "designation", "rank"]
VICTIM_COLUMNS = ["victim_id", "case_id", "name", "age", "gender"]
ACCUSED_COLUMNS = ["accused_id", "case_id", "name", "age", "gender", "person_id"]
MAX_BY_NAME = 50
BY_NAME_ORDER = ["accused_id", "case_id", "person_id", "age", "gender"]


def _with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns; optional ones the table lacks are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])


def cases(t: Tables) -> DataFrame:
    """Cases in lookup form."""
    return _with_columns(logical_table(t, "CaseMaster"), CASE_COLUMNS)


def officers(t: Tables) -> DataFrame:
    """Officers in lookup form; an unnamed officer is "Unknown"."""
    rows = _with_columns(logical_table(t, "Employee"), OFFICER_COLUMNS)
    return rows.withColumn("first_name", F.coalesce("first_name", F.lit("Unknown")))


def victims(t: Tables) -> DataFrame:
    """Victims in lookup form; an unnamed victim is "Unknown"."""
    rows = logical_table(t, "Victim").withColumnsRenamed({"case_master_id": "case_id", "victim_name": "name"})
    return _with_columns(rows, VICTIM_COLUMNS).withColumn("name", F.coalesce("name", F.lit("Unknown")))


def accused(t: Tables) -> DataFrame:
    """Accused people in lookup form; an unnamed person is "Unknown"."""
    rows = logical_table(t, "Accused").withColumnsRenamed({"case_master_id": "case_id", "accused_name": "name"})
    return _with_columns(rows, ACCUSED_COLUMNS).withColumn("name", F.coalesce("name", F.lit("Unknown")))


def lookup(
    keys: DataFrame,
    table: DataFrame,
    key: str,
    columns: Sequence[str],
    order: Sequence[Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Rows of a table for each key, with ``found`` (L1).

    ``keys`` has ``key_value`` of the column's type; with a limit, only the first
    rows of each key by the order.
    """
    rows = table.select(quoted(key).alias("key_value"), *[quoted(c) for c in columns if c != key], F.lit(True).alias("_hit"))
    if limit is not None:
        # Only rows of the keys are ranked, and limited before the join: a key with very many rows sends few.
        rows = rows.join(keys_to_match(keys.select("key_value")), "key_value", "left_semi")
        rows = top_per_key(rows, ["key_value"], order or [F.col(f"`{c}`") for c in columns if c != key], limit, "_n").drop("_n")
    joined = keys.join(rows, "key_value", "left").withColumn("found", F.coalesce("_hit", F.lit(False)))
    return joined.drop("_hit")


def typed_keys(questions: DataFrame, column: str, data_type: str) -> tuple[DataFrame, DataFrame]:
    """Questions whose key fits the column's type, as ``key_value``, and the rejected ones."""
    typed = coerce_values(questions, column, data_type, "key_value")
    return typed.filter("is_valid").drop("is_valid"), typed.filter("NOT is_valid").drop("is_valid", "key_value")


def find_cases(references: DataFrame, t: Tables) -> DataFrame:
    """The case of each reference by exactly one of id, number or crime number (L2).

    ``references``: ref_id, kind (case_id, case_number, crime_number) and value. A value
    of one kind never meets a column of another.
    """
    table = cases(t)
    parts = []
    for kind in ("case_id", "case_number", "crime_number"):
        asked = references.filter(F.col("kind") == kind)
        valid, _ = typed_keys(asked, "value", dict(table.dtypes)[kind])
        valid = valid.select("ref_id", "key_value")
        wanted = broadcast_if_small(valid.select("key_value").distinct())
        asked_rows = table.withColumn("key_value", F.col(kind)).join(wanted, "key_value", "left_semi")
        one = top_per_key(asked_rows, ["key_value"], [F.col("case_id")], 1, "_n").drop("_n")
        matched = valid.join(one, "key_value")
        parts.append(matched.select("ref_id", *CASE_COLUMNS))
    found = union_all(parts).withColumn("_hit", F.lit(True))
    return references.join(found, "ref_id", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def find_officers(keys: DataFrame, t: Tables) -> DataFrame:
    """Officers by id (L3)."""
    return lookup(keys, officers(t), "employee_id", OFFICER_COLUMNS, limit=1)


def find_victims(keys: DataFrame, t: Tables) -> DataFrame:
    """Victims by id (L4)."""
    return lookup(keys, victims(t), "victim_id", VICTIM_COLUMNS, limit=1)


def find_accused(keys: DataFrame, t: Tables) -> DataFrame:
    """Accused people by id."""
    return lookup(keys, accused(t), "accused_id", ACCUSED_COLUMNS, limit=1)


def victims_of_cases(keys: DataFrame, t: Tables) -> DataFrame:
    """All victims of each case; sort by case and id to read them in order."""
    return lookup(keys, victims(t), "case_id", VICTIM_COLUMNS)


def accused_of_cases(keys: DataFrame, t: Tables) -> DataFrame:
    """All accused of each case; sort by case and id to read them in order."""
    return lookup(keys, accused(t), "case_id", ACCUSED_COLUMNS)


def accused_named(names: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each asked name with its ``_key``, and all people of those keys. ``names`` has ``name``."""
    asked = names.select(F.col("name").alias("asked"), F.lower(F.trim("name")).alias("_key")).filter("_key <> ''").distinct()
    return asked, accused(t).withColumn("_key", F.lower("name")).join(asked.select("_key").distinct(), "_key", "left_semi")


def accused_by_name(names: DataFrame, t: Tables, limit: int = MAX_BY_NAME) -> DataFrame:
    """The first people of a name, whatever its case, by id (L8). ``names`` has ``name``.

    A name is no identity, so every match up to the limit is told; ``accused_named`` has all.
    """
    asked, rows = accused_named(names, t)
    best = top_per_key(rows, ["_key"], [F.col(c) for c in BY_NAME_ORDER], limit, "position")
    return asked.join(best, "_key", "left").withColumn("found", F.col("position").isNotNull()).drop("_key")


def chargesheet_status(keys: DataFrame, t: Tables) -> DataFrame:
    """Whether a chargesheet was filed, when and where: the earliest of the case."""
    sheets = logical_table(t, "ChargesheetDetails")
    sheets = _with_columns(sheets, ["chargesheet_id", "case_master_id", "date", "court_name"])
    # The earliest is found by sorting, a bounded number of rows per task.
    sheets = sheets.repartition(tasks_for(sheets.count()), "case_master_id")
    first = sheets.groupBy(F.col("case_master_id").alias("key_value")).agg(
        F.min(F.struct("date", "chargesheet_id", "court_name")).alias("_s")
    )
    day = F.date_format(F.col("_s")["date"], "yyyy-MM-dd HH:mm:ss")
    if dict(sheets.dtypes)["date"] == "string":
        day = F.col("_s")["date"]
    return keys.join(first, "key_value", "left").select(
        *keys.columns,
        F.col("_s").isNotNull().alias("filed"),
        day.alias("date"),
        F.col("_s")["court_name"].alias("court_name"),
    )


def records_of_cases(keys: DataFrame, t: Tables, table: str) -> DataFrame:
    """All columns of the arrests, chargesheets or sections of each case."""
    return lookup(keys, t[table], "CaseMasterID", t[table].columns)


def full_records(keys: DataFrame, t: Tables, table: str, key: str) -> DataFrame:
    """All columns of an officer, victim, accused person or complainant by id."""
    return lookup(keys, t[table], key, t[table].columns, limit=1)


def full_cases(references: DataFrame, t: Tables) -> DataFrame:
    """A case and everything recorded under it, a row per record.

    ``references`` as in ``find_cases``. Each record is JSON with all its columns.
    """
    wanted = find_cases(references, t).filter("found").select("ref_id", F.col("case_id").alias("CaseMasterID"))

    def section(name: str, table: DataFrame, record_id: Column) -> DataFrame:
        record = F.to_json(F.struct(*[quoted(c) for c in table.columns]))
        rows = table.select("CaseMasterID", F.lit(name).alias("section"), record_id.cast("string").alias("record_id"),
                            record.alias("record"))
        return wanted.join(rows, "CaseMasterID")

    people = {"accused": (accused(t), "accused_id"), "victim": (victims(t), "victim_id")}
    parts = [section("case", t["CaseMaster"], F.col("CaseMasterID"))]
    for name, (rows, key) in people.items():
        parts.append(section(name, rows.withColumn("CaseMasterID", F.col("case_id")), F.col(key)))
    parts.append(section("arrest", t["ArrestSurrender"], F.col("ArrestSurrenderID")))
    parts.append(section("chargesheet", t["ChargesheetDetails"], F.col("CSID")))
    return union_all(parts).withColumnRenamed("CaseMasterID", "case_id")


def officers_of_cases(references: DataFrame, t: Tables) -> DataFrame:
    """The officer of each referenced case, telling "none recorded" from "record missing" (L15)."""
    found = find_cases(references, t)
    staff = officers(t).withColumnRenamed("employee_id", "police_person_id").withColumn("_hit", F.lit(True))
    joined = found.join(staff, "police_person_id", "left")
    status = (
        F.when(~F.col("found"), "case not found")
        .when(F.col("police_person_id").isNull(), "no officer recorded")
        .when(F.col("_hit").isNull(), "officer record missing")
        .otherwise("officer found")
    )
    return joined.withColumn("officer_status", status).drop("_hit")


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("?"))


def _list_block(rows: DataFrame, order: str, entry: Column, title: str, part_rows: int) -> DataFrame:
    """Per case: the block of a list of people, in parts for very long lists."""
    members = rows.select("case_id", F.col(order).alias("member"), entry.alias("entry"))
    large, n_rows = measured_groups(members, ["case_id"], "member", part_rows)
    parts = list_in_parts(members, ["case_id"], "member", "entry", "\n", large, part_rows, rows=n_rows if large is not None else None)
    total, first = F.col("members"), F.lit(True)
    if large is not None:
        total = F.sum("members").over(Window.partitionBy("case_id"))
        first = F.row_number().over(Window.partitionBy("case_id").orderBy("part")) == 1
    head = F.when(first, F.concat(F.lit(f"{title} ("), total.cast("string"), F.lit("):\n"))).otherwise(F.lit(""))
    return parts.withColumn("block", F.concat(head, F.col("text"))).select("case_id", "part", "block")


def case_context(keys: DataFrame, t: Tables, part_rows: int = PART_ROWS) -> DataFrame:
    """The compact text of each case, as blocks in order.

    ``keys`` has ``case_id``. Blocks joined by line ends are the text; lists of people
    that are very long take several blocks.
    """
    base = matching(cases(t), keys.select("case_id"), "case_id")
    staff = officers(t).withColumnRenamed("employee_id", "police_person_id")
    with_officer = base.join(staff, "police_person_id", "left")
    headline = F.concat(
        F.lit("Case: "), F.col("case_number").cast("string"), F.lit(" | Crime (FIR): "),
        F.coalesce(F.col("crime_number").cast("string"), F.lit("None")), F.lit(" | Status: "),
        F.coalesce(F.col("status").cast("string"), F.lit("Unknown")),
    )
    role = F.coalesce(F.col("designation").cast("string"), F.col("rank").cast("string"), F.lit("Unknown Rank"))
    officer = F.when(
        F.col("first_name").isNotNull(),
        F.concat(F.lit("\nOfficer: "), F.col("first_name"), F.lit(" ("), role, F.lit(", KGID: "),
                 F.coalesce("kgid", F.lit("None")), F.lit(")")),
    ).otherwise(F.lit(""))
    wanted = base.select("case_id")
    victim_rows = matching(victims(t), wanted, "case_id")
    accused_rows = matching(accused(t), wanted, "case_id")
    victim_entry = F.concat(F.lit("  - "), F.col("name"), F.lit(" ("), _shown(F.col("age")), F.lit(", "),
                            _shown(F.col("gender")), F.lit(")"))
    accused_entry = F.concat(F.lit("  - "), F.col("name"), F.lit(" ("), _shown(F.col("age")), F.lit(", "),
                             _shown(F.col("gender")), F.lit(", PersonID: "),
                             _shown(F.nullif(F.col("person_id"), F.lit(""))), F.lit(")"))
    blocks = [with_officer.select("case_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("part"),
                                  F.concat(headline, officer).alias("block"))]
    for no, (rows, key, entry, title) in enumerate(
        ((victim_rows, "victim_id", victim_entry, "Victims"), (accused_rows, "accused_id", accused_entry, "Accused")), 1
    ):
        listed = _list_block(rows, key, entry, title, part_rows)
        none = wanted.join(rows.select("case_id").distinct(), "case_id", "left_anti").select(
            "case_id", F.lit(0).cast("bigint").alias("part"), F.lit(f"{title}: None recorded").alias("block")
        )
        blocks.append(listed.unionByName(none).select("case_id", F.lit(no).alias("section"), "part", "block"))
    sheet = chargesheet_status(wanted.withColumnRenamed("case_id", "key_value"), t)
    filed = F.when(
        F.col("filed"),
        F.concat(F.lit("Chargesheet: Filed on "), F.coalesce("date", F.lit("Unknown")), F.lit(" at "),
                 F.coalesce("court_name", F.lit("Unknown"))),
    ).otherwise(F.lit("Chargesheet: Not Filed"))
    blocks.append(sheet.select(F.col("key_value").alias("case_id"), F.lit(3).alias("section"),
                               F.lit(0).cast("bigint").alias("part"), filed.alias("block")))
    return union_all(blocks)
