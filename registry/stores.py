"""Queries that write the given tables and read them back."""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.domain_sql import domain
from registry.quality import GIVEN
from veriweave.operators import validation
from veriweave.roles import DECLARED, domain_tables, read
from veriweave.session import checkpoint_dir, staged
from veriweave.sources import metadata, tables
from veriweave.sources.chunks import read_chunks, write_chunks
from veriweave.sources.stores import document_index, document_store, get_document, get_documents


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/entries/{uuid.uuid4().hex}"


def formats(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written in each format and read back."""
    root, orders = _root(spark), read(spark, sf, "orders")
    out = []
    for fmt in ("json", "orc", "parquet"):
        orders.write.format(fmt).save(f"{root}/orders.{fmt}")
        back = tables.read_tables(spark, root, ["orders"], fmt)["orders"]
        # JSON has no dates, so those are told as text.
        day = F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("o_orderdate")
        out.append(back.select(F.lit(fmt).alias("format"), *[day if c == "o_orderdate" else F.col(c) for c in orders.columns]))
    return metadata.union_all(out)


def csv_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All domain tables but one as CSV, read with their schema; the one without a file is told."""
    root, known = _root(spark), domain_tables(spark, sf)
    written = {n: df for n, df in known.items() if n != "Court"}
    for name, df in written.items():
        df.write.option("header", True).option("escape", '"').csv(f"{root}/{name}.csv")
    frames, missing = tables.read_csv_tables(spark, root, {n: df.schema for n, df in written.items()})
    counts = tables.row_counts(frames)
    people = frames["Accused"].agg(F.count_if(F.col("AgeYear").isNull()).alias("row_count")).select(F.lit("Accused without age").alias("table_name"), "row_count")
    lacking = spark.createDataFrame([(n, -1) for n in missing], "table_name string, row_count bigint")
    return metadata.union_all([counts, people, lacking])


_DOMAIN = (
    "District", "Unit", "Court", "Employee", "CaseMaster", "ComplainantDetails", "Victim", "Accused", "ActSectionAssociation", "ChargesheetDetails", "ArrestSurrender",
)
CSV_SQL = domain(
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in _DOMAIN if n != "Court")
    + " UNION ALL SELECT 'Accused without age', count(*) FROM Accused WHERE AgeYear IS NULL UNION ALL SELECT 'Court', -1"
)


def catalog_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables replaced, appended to and cleaned in the catalog, found again by their logical names."""
    database = f"entries_{uuid.uuid4().hex}"
    known = domain_tables(spark, sf)
    loaded = tables.load_clean_tables(spark, {n: df for n, df in known.items() if n != "Court"}, database)
    tables.load_tables({"Unit": known["Unit"], "Court": known["Court"]}, database)
    tables.load_tables({"Court": known["Court"].select("CourtName", "CourtID", "DistrictID")}, database, "append")
    found = {n: metadata.resolve_table(spark, n, database, database) for n in known}
    listed = tables.row_counts(metadata.discover_database(spark, database)).select(F.concat(F.lit("stored "), "table_name").alias("table_name"), "row_count")
    again = tables.row_counts(found).select(F.concat(F.lit("resolved "), "table_name").alias("table_name"), "row_count")
    return metadata.union_all([loaded.select(F.concat(F.lit("loaded "), "table_name").alias("table_name"), "row_count"), listed, again])


# Courts have no cleaned table and were loaded twice; units have both.
_CATALOG = (
    *[(f"loaded {n}", n, 1) for n in _DOMAIN if n != "Court"],
    *[(f"stored clean_{n.lower()}", n, 1) for n in _DOMAIN if n != "Court"],
    ("stored unit", "Unit", 1), ("stored court", "Court", 2),
    *[(f"resolved {n}", n, 2 if n == "Court" else 1) for n in _DOMAIN],
)
CATALOG_SQL = domain(" UNION ALL ".join(f"SELECT '{name}' AS table_name, {n} * count(*) AS row_count FROM {table}" for name, table, n in _CATALOG))


def _stored(spark: SparkSession, sf: str):
    """A document store that was built from labelled documents, brought up to date and cleared of some."""
    docs = read(spark, sf, "documents").select(F.concat("lang", F.lit("_"), "doc_id").alias("document_id"), F.col("lang").alias("document_type"), "text")
    labelled = read(spark, sf, "labels").select("doc_id").distinct()
    old = read(spark, sf, "documents").join(labelled, "doc_id").select(
        F.concat("lang", F.lit("_"), "doc_id").alias("document_id"), F.col("lang").alias("document_type"), F.lit("old").alias("text")
    )
    store = document_store(spark, _root(spark), 8)
    store.replace(old)
    store.upsert(docs.filter("length(text) % 2 = 0"), "document_id")
    store.delete(docs.filter("length(text) % 5 = 0").select("document_id"), "document_id")
    return store


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).read().select("document_id", "document_type", F.md5("text").alias("text_md5"))


STORED = (
    "stored AS (SELECT lang || '_' || d.doc_id AS document_id, lang AS document_type, CASE WHEN length(text) % 2 = 0 THEN text ELSE 'old' END AS text FROM documents d "
    "WHERE (length(text) % 2 = 0 OR doc_id IN (SELECT doc_id FROM labels)) AND length(text) % 5 <> 0)"
)


def indexed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Which folder holds each stored document, and whether it is found by its ids."""
    store = _stored(spark, sf).read()
    found = get_documents(store, store.select("document_id")).select("document_id", F.lit(True).alias("found"))
    index = document_index(store).select("document_id", F.regexp_extract("path", "document_type=([^/]*)/", 1).alias("folder"))
    return index.join(found, "document_id", "left")


def one_document(spark: SparkSession, sf: str) -> DataFrame:
    """A document by its id: the scan is limited to the folder of its kind."""
    docs = read(spark, sf, "documents").select(F.concat(F.lit("case_summary_"), "doc_id").alias("document_id"), F.lit("case_summary").alias("document_type"), "text")
    others = docs.select(F.regexp_replace("document_id", "case_summary", "court_summary").alias("document_id"), F.lit("court_summary").alias("document_type"), "text")
    store = document_store(spark, _root(spark), 8)
    store.replace(docs.unionByName(others))
    return get_document(store.read(), "case_summary_7").select("document_id", "document_type", F.md5("text").alias("text_md5"))


def point_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents and some that are not there, looked up in the buckets of their ids."""
    docs = read(spark, sf, "documents").select(F.concat_ws("_", "lang", "doc_id").alias("document_id"), F.col("lang").alias("document_type"), "text")
    store = document_store(spark, _root(spark), 8)
    store.replace(docs)
    ids = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").selectExpr("concat_ws('_', lang, doc_id) AS document_id")
    return store.lookup(ids.union(ids.selectExpr("concat(document_id, '_gone')"))).select("document_id", "document_type", F.md5("text").alias("text_md5"))


def bucketed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets that single changes write, and whether all others keep their folders; then every row as it is."""
    docs = read(spark, sf, "documents").select(F.concat_ws("_", "lang", "doc_id").alias("document_id"), F.col("lang").alias("document_type"), "text")
    store = document_store(spark, _root(spark), 32)
    store.replace(docs)
    one = staged(store.read().orderBy("document_id").limit(1), "one")
    steps, before = [], set(store.folders())
    for step, upserts, deletes in (
        ("upsert", one.withColumn("text", F.lit("newer")), None),
        ("delete", None, one.select("document_id")),
        ("nothing", one.limit(0), None),
        ("both", one, one.select("document_id")),
    ):
        written = store.change(upserts, deletes)
        after = set(store.folders())
        steps.append((step, written, len(before - after) <= written, store.read().count()))
        before = after
    told = spark.createDataFrame(steps, "step string, buckets bigint, others_kept boolean, row_count bigint")
    rows = store.read().select(F.concat(F.lit("row "), "document_id", F.lit(" "), F.md5("text")).alias("step"))
    return told.unionByName(rows.select("step", F.lit(None).cast("bigint").alias("buckets"), F.lit(None).cast("boolean").alias("others_kept"), F.lit(1).cast("bigint").alias("row_count")))


BUCKETED_SQL = (
    "WITH n AS (SELECT count(*) AS n FROM documents) SELECT step, buckets::BIGINT AS buckets, true AS others_kept, n - less AS row_count FROM n, "
    "(VALUES ('upsert', 1, 0), ('delete', 1, 1), ('nothing', 0, 1), ('both', 1, 0)) v(step, buckets, less) "
    "UNION ALL SELECT 'row ' || lang || '_' || doc_id || ' ' || md5(text), NULL, NULL, 1 FROM documents"
)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts written as a report and read back."""
    path = tables.write_report(tables.row_counts({n: read(spark, sf, n) for n in GIVEN}), _root(spark), "counts")
    return spark.read.schema("table_name string, row_count bigint").json(path)


def columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of every given table, as Spark reads them."""
    given = {n: read(spark, sf, n) for n in GIVEN}
    return metadata.describe_columns(spark, given, {}).select(
        "table_name", F.col("position").cast("bigint").alias("position"), "column_name", F.when(F.col("kind").startswith("array"), "array").otherwise(F.col("kind")).alias("kind")
    )


COLUMNS_SQL = (
    "SELECT table_name, CAST(ordinal_position - 1 AS BIGINT) AS position, column_name, CASE WHEN data_type LIKE '%[]' THEN 'array' WHEN data_type IN ('BIGINT', 'INTEGER', "
    "'SMALLINT', 'TINYINT') THEN 'int' WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' "
    "WHEN data_type = 'DATE' THEN 'date' WHEN data_type = 'VARCHAR' THEN 'str' ELSE data_type END AS kind FROM information_schema.columns "
    "WHERE table_name IN (" + ", ".join(f"'{n}'" for n in GIVEN) + ")"
)


def referring(spark: SparkSession, sf: str) -> DataFrame:
    """References of the domain tables with the rows that refer, and the tables each one refers to."""
    counts = tables.row_counts(domain_tables(spark, sf))
    relations = metadata.relationships(spark, DECLARED)
    near = metadata.adjacency(relations).select("table_name", F.array_join("related_tables", ",").alias("related"))
    return (
        relations.join(counts.withColumnRenamed("table_name", "source_table"), "source_table")
        .join(near.withColumnRenamed("table_name", "source_table"), "source_table")
        .select("source_table", "source_column", "target_table", "target_column", "relationship_type", "row_count", "related")
    )


_REFERENCES = (
    ("Unit", "DistrictID", "District", "DistrictID"), ("Court", "DistrictID", "District", "DistrictID"), ("Employee", "DistrictID", "District", "DistrictID"),
    ("Employee", "UnitID", "Unit", "UnitID"), ("CaseMaster", "PoliceStationID", "Unit", "UnitID"), ("CaseMaster", "CourtID", "Court", "CourtID"),
    ("CaseMaster", "PolicePersonID", "Employee", "EmployeeID"), ("ComplainantDetails", "CaseMasterID", "CaseMaster", "CaseMasterID"),
    ("Victim", "CaseMasterID", "CaseMaster", "CaseMasterID"), ("Accused", "CaseMasterID", "CaseMaster", "CaseMasterID"),
    ("ActSectionAssociation", "CaseMasterID", "CaseMaster", "CaseMasterID"), ("ChargesheetDetails", "CaseMasterID", "CaseMaster", "CaseMasterID"),
    ("ChargesheetDetails", "PolicePersonID", "Employee", "EmployeeID"), ("ArrestSurrender", "CaseMasterID", "CaseMaster", "CaseMasterID"),
    ("ArrestSurrender", "CourtID", "Court", "CourtID"), ("ArrestSurrender", "AccusedMasterID", "Accused", "AccusedMasterID"),
)
REFERRING_SQL = domain(
    "refs(source_table, source_column, target_table, target_column) AS (VALUES " + ", ".join(str(r) for r in _REFERENCES) + "),\n"
    "counts AS (" + " UNION ALL ".join(f"SELECT '{n}' AS source_table, count(*) AS row_count FROM {n}" for n in dict.fromkeys(r[0] for r in _REFERENCES)) + "),\n"
    "near AS (SELECT source_table, string_agg(target_table, ',' ORDER BY target_table) AS related FROM refs GROUP BY 1)\n"
    "SELECT refs.*, 'many-to-one' AS relationship_type, row_count, related FROM refs JOIN counts USING (source_table) JOIN near USING (source_table)"
)

def chunked(spark: SparkSession, sf: str) -> DataFrame:
    """Orders scanned in chunks: all of them, ranges of the key from the chunks that can hold them, and a range that is empty."""
    root = f"{_root(spark)}/orders"
    write_chunks(read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string").substr(1, 10)), "o_orderkey", root, 2000)
    scans = {"all": (None, None), "range": (3001, 9000), "one": (77, 77), "from": (14000, None), "none": (None, -1)}
    found = [read_chunks(spark, root, *ends).withColumn("scan", F.lit(scan)) for scan, ends in scans.items()]
    return metadata.union_all(found)


CHUNKED_SQL = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, scan FROM orders, "
    "(VALUES ('all'), ('range'), ('one'), ('from')) v(scan) WHERE CASE scan WHEN 'all' THEN true WHEN 'range' THEN o_orderkey > 3000 AND o_orderkey <= 9000 "
    "WHEN 'one' THEN o_orderkey = 77 ELSE o_orderkey >= 14000 END"
)


def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Which roles the names of all given columns have."""
    roles = metadata.ColumnRoles()
    rows = [(n, c, role) for n in GIVEN for c in read(spark, sf, n).columns for role in ROLE_PARTS if roles.has(role, c)]
    return spark.createDataFrame(rows, "table_name string, column_name string, role string")


ROLE_PARTS = {f.name: f.default for f in fields(metadata.ColumnRoles)}
ROLES_SQL = (
    "WITH parts(role, part) AS (VALUES " + ", ".join(f"('{role}', '{part}')" for role, parts in ROLE_PARTS.items() for part in parts) + ") "
    "SELECT DISTINCT table_name, column_name, role FROM information_schema.columns JOIN parts ON contains(lower(column_name), part) "
    "WHERE table_name IN (" + ", ".join(f"'{n}'" for n in GIVEN) + ")"
)


def declared_types(spark: SparkSession, sf: str) -> DataFrame:
    """Given columns whose type is not the declared one, where every column is declared a text or, if its name ends in ``key``, a number."""
    out = []
    for n in GIVEN:
        df = read(spark, sf, n)
        meta = metadata.TableMeta(n, expected_types={c: "float" if c.endswith("key") else "str" for c in df.columns if c != "embedding"})
        out.append(validation.data_types(df, meta).select(F.lit(n).alias("table_name"), "column_name", "status", "warnings", "detail"))
    return metadata.union_all(out)


TYPES_SQL = (
    f"SELECT table_name, column_name, 'fail' AS status, 1::BIGINT AS warnings, 'expected str, actual ' || kind AS detail FROM ({COLUMNS_SQL}) "
    "WHERE column_name <> 'embedding' AND NOT ends_with(column_name, 'key') AND kind <> 'str'"
)

QUERIES = {
    "S3_S17_formats": (
        formats,
        "SELECT unnest(['json', 'orc', 'parquet']) AS format, o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, "
        "o_orderpriority FROM orders",
    ),
    "S1_S2_chunked_scan": (chunked, CHUNKED_SQL),
    "S4_csv_tables": (csv_tables, CSV_SQL),
    "S5_S7_S8_M9_catalog": (catalog_tables, CATALOG_SQL),
    "S9_S13_document_store": (stored_documents, f"WITH {STORED} SELECT document_id, document_type, md5(text) AS text_md5 FROM stored"),
    "S10_get_document": (
        one_document, "SELECT 'case_summary_7' AS document_id, 'case_summary' AS document_type, md5(text) AS text_md5 FROM documents WHERE doc_id = 7",
    ),
    "S10_point_reads": (
        point_reads,
        "SELECT DISTINCT lang || '_' || d.doc_id AS document_id, lang AS document_type, md5(text) AS text_md5 FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "S9_S14_S15_bucketed_changes": (bucketed_changes, BUCKETED_SQL),
    "S10_S12_document_index": (indexed_documents, f"WITH {STORED} SELECT document_id, document_type AS folder, true AS found FROM stored"),
    "S16_report": (reports, " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in GIVEN)),
    "M1_columns": (columns, COLUMNS_SQL),
    "M8_column_roles": (column_roles, ROLES_SQL),
    "V3_data_types": (declared_types, TYPES_SQL),
    "M5_M6_references": (referring, REFERRING_SQL),
}
