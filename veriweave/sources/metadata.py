"""Declared keys, column roles, and names that resolve to tables and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.functions.text import strip


class ResolutionError(LookupError):
    """A table or a required column does not exist under any accepted name."""


@dataclass(frozen=True)
class ForeignKey:
    """A reference from one column to a column of another table."""

    column: str
    table: str
    ref_column: str


@dataclass(frozen=True)
class TableMeta:
    """What the data itself does not say about a table: its keys, required and typed columns."""

    name: str
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    required: tuple[str, ...] = ()
    expected_types: Mapping[str, str] = field(default_factory=dict)

    @property
    def numeric_columns(self) -> list[str]:
        """Columns declared as numbers."""
        return [c for c, kind in self.expected_types.items() if kind in ("int", "float")]


@dataclass(frozen=True)
class ColumnRoles:
    """Column roles recognised by a substring of the lower-cased name (M8)."""

    # The name parts that give a column its role.
    date: tuple[str, ...] = (
        "date", "dt", "datetime", "timestamp", "created_at",
        "updated_at", "registered_on", "occurred_on", "reported_on",
    )
    phone: tuple[str, ...] = ("phone", "mobile", "contact", "cell", "tel")
    gender: tuple[str, ...] = ("gender", "sex")
    address: tuple[str, ...] = (
        "address", "addr", "street", "city", "district",
        "state", "pincode", "zip", "locality", "area",
    )
    crime_number: tuple[str, ...] = ("fir_no", "crime_no", "fir_number", "crime_number", "case_no")
    evidence: tuple[str, ...] = (
        "narrative", "evidence", "description", "remarks", "statement", "fir_content", "complaint_text",
    )
    latitude: tuple[str, ...] = ("latitude", "lat", "coord_lat")
    longitude: tuple[str, ...] = ("longitude", "lon", "lng", "coord_lon")
    date_hint: tuple[str, ...] = ("date", "dt", "time", "stamp", "created", "updated")

    def has(self, role: str, column: str) -> bool:
        """True when the column's name gives it the role."""
        name = column.lower()
        return any(part in name for part in getattr(self, role))

    def pick(self, role: str, columns: Sequence[str]) -> list[str]:
        """The columns with the role, in order."""
        return [c for c in columns if self.has(role, c)]


@dataclass(frozen=True)
class LogicalColumn:
    """Accepted physical names of a logical column, best first."""

    candidates: tuple[str, ...]
    required: bool = True


def _col(*candidates: str, required: bool = True) -> LogicalColumn:
    return LogicalColumn(tuple(candidates), required)


# Accepted physical names per logical table and column.
LOGICAL_TABLES: dict[str, dict[str, LogicalColumn]] = {
    "CaseMaster": {
        "case_id": _col("casemasterid", "case_id", "caseid", "id"),
        "case_number": _col("caseno", "case_no", "casenumber", "case_number"),
        "crime_number": _col(
            "crimeno", "crime_no", "firno", "fir_no", "crimenumber", "crime_number", "fir_number"
        ),
        "police_person_id": _col("policepersonid", "police_person_id", "employeeid", "officerid", "io_id"),
        "station_id": _col("policestationid", "stationid", "station_id", "unitid"),
        "status": _col("casestatusid", "status", "casestatus", required=False),
    },
    "Employee": {
        "employee_id": _col("employeeid", "employee_id", "officerid", "policepersonid", "id"),
        "first_name": _col("firstname", "first_name", "name", "employeename", "officername"),
        "kgid": _col("kgid", "kgid_no", required=False),
        "designation": _col("designationid", "designation", required=False),
        "rank": _col("rankid", "rank", required=False),
    },
    "Victim": {
        "victim_id": _col("victimmasterid", "victimid", "victim_id", "id"),
        "case_master_id": _col("casemasterid", "case_master_id", "case_id"),
        "victim_name": _col("victimname", "victim_name", "name"),
        "age": _col("ageyear", "age", required=False),
        "gender": _col("genderid", "gender", "sex", required=False),
    },
    "Accused": {
        "accused_id": _col("accusedmasterid", "accusedid", "accused_id", "id"),
        "case_master_id": _col("casemasterid", "case_master_id", "case_id"),
        "accused_name": _col("accusedname", "accused_name", "name"),
        "age": _col("ageyear", "age", required=False),
        "gender": _col("genderid", "gender", "sex", required=False),
        "person_id": _col("personid", "person_id", required=False),
    },
    "ComplainantDetails": {
        "complainant_id": _col("complainantid", "complainant_id", "id"),
        "case_master_id": _col("casemasterid", "case_master_id", "case_id"),
    },
    "ArrestSurrender": {
        "arrest_id": _col("arrestsurrenderid", "arrest_id", "id"),
        "case_master_id": _col("casemasterid", "case_master_id", "case_id"),
    },
    "ChargesheetDetails": {
        "chargesheet_id": _col("csid", "chargesheetid", "chargesheet_id", "id"),
        "case_master_id": _col("casemasterid", "case_master_id", "case_id"),
        "date": _col("csdate", "chargesheetdate", "date", required=False),
        "court_name": _col("courtname", "court_name", required=False),
    },
    "ActSectionAssociation": {
        "case_master_id": _col("casemasterid", "case_master_id", "case_id"),
    },
}


def kind_of(data_type: T.DataType) -> str:
    """Short name of a Spark type, as used in declared types."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.StringType):
        return "str"
    return data_type.simpleString()


def text_columns(df: DataFrame) -> list[str]:
    """Names of the text columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the number columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def quoted(name: str) -> Column:
    """Column by its exact name, which may hold spaces or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def discover_database(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """Every table of a catalog database, by name (M1). Temporary views belong to no database."""
    return {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database) if not t.isTemporary}


def describe_columns(
    spark: SparkSession, tables: Mapping[str, DataFrame], declared: Mapping[str, TableMeta]
) -> DataFrame:
    """One row per column: type, nullability and declared keys (M1)."""
    rows = []
    for name, df in tables.items():
        meta = declared.get(name, TableMeta(name))
        foreign = {fk.column for fk in meta.foreign_keys}
        for position, f in enumerate(df.schema.fields):
            rows.append((
                name, position, f.name, f.dataType.simpleString(), kind_of(f.dataType),
                f.name not in meta.required and f.name not in meta.primary_key,
                f.name in meta.primary_key, f.name in foreign,
            ))
    schema = (
        "table_name string, position int, column_name string, data_type string, kind string, "
        "nullable boolean, is_primary_key boolean, is_foreign_key boolean"
    )
    return spark.createDataFrame(rows, schema)


def relationships(spark: SparkSession, declared: Mapping[str, TableMeta]) -> DataFrame:
    """One row per foreign key, all many-to-one (M5)."""
    rows = [
        (meta.name, fk.column, fk.table, fk.ref_column, "many-to-one")
        for meta in declared.values()
        for fk in meta.foreign_keys
    ]
    schema = (
        "source_table string, source_column string, target_table string, "
        "target_column string, relationship_type string"
    )
    return spark.createDataFrame(rows, schema)


def adjacency(relations: DataFrame) -> DataFrame:
    """Tables each table refers to; tables that refer to none have an empty list (M6)."""
    out = relations.select(F.col("source_table").alias("table_name"), F.col("target_table").alias("related"))
    ends = relations.select(F.col("target_table").alias("table_name"), F.lit(None).cast("string").alias("related"))
    return out.unionByName(ends).groupBy("table_name").agg(
        F.array_sort(F.collect_list("related")).alias("related_tables")
    )


def schema_summary(tables: Mapping[str, DataFrame], declared: Mapping[str, TableMeta]) -> DataFrame:
    """One row per table: columns, keys, references and an exact row count (M7)."""
    parts = []
    for name, df in tables.items():
        meta = declared.get(name, TableMeta(name))
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                F.lit(len(df.columns)).cast("bigint").alias("columns"),
                F.lit(",".join(meta.primary_key)).alias("primary_key"),
                F.lit(len(meta.foreign_keys)).cast("bigint").alias("foreign_keys"),
                "row_count",
            )
        )
    return union_all(parts)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name of one or more frames."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def resolve_table(
    spark: SparkSession, logical: str, clean_schema: str, source_schema: str, require_clean: bool = False
) -> DataFrame:
    """The cleaned table if it exists, else the source table; an error names what was looked for (M9)."""
    wanted = [f"{clean_schema}.clean_{logical}"]
    if not require_clean:
        wanted.append(f"{source_schema}.{logical}")
    for name in wanted:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    existing = sorted(
        f"{db}.{t.name}"
        for db in {clean_schema, source_schema}
        if spark.catalog.databaseExists(db)
        for t in spark.catalog.listTables(db)
    )
    raise ResolutionError(f"no table for '{logical}': looked for {', '.join(wanted)}; found {existing or 'none'}")


def resolve_columns(df: DataFrame, logical_columns: Mapping[str, LogicalColumn]) -> DataFrame:
    """Project onto logical names; absent optional columns are left out."""
    physical = {c.lower(): c for c in df.columns}
    selected = []
    for logical, spec in logical_columns.items():
        found = next((physical[c] for c in spec.candidates if c in physical), None)
        if found is not None:
            selected.append(quoted(found).alias(logical))
        elif spec.required:
            raise ResolutionError(
                f"required column '{logical}' not found: accepted names {list(spec.candidates)}, "
                f"existing columns {df.columns}"
            )
    return df.select(*selected)


def logical_table(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A domain table projected onto its logical columns."""
    if name not in tables:
        raise ResolutionError(f"no table for '{name}': found {sorted(tables)}")
    return resolve_columns(tables[name], LOGICAL_TABLES[name])


def coerce_values(df: DataFrame, column: str, data_type: str, out: str = "coerced") -> DataFrame:
    """Add the value cast to the key's type and whether that succeeded.

    Whole numbers must be plain digits with an optional minus; text is stripped.
    A rejected value is NULL in ``out`` and so never meets a key in a join.
    """
    text = strip(F.col(column).cast("string"))
    if data_type in ("bigint", "int", "smallint"):
        value = F.when(text.rlike(r"^-*[0-9]+$"), text.try_cast(data_type))
    elif data_type in ("double", "float") or data_type.startswith("decimal"):
        value = text.try_cast(data_type)
    else:
        value = text
    return df.withColumn(out, value).withColumn("is_valid", F.col(out).isNotNull())
