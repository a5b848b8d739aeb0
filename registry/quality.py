"""Reading, cleaning, enrichment, profiling and validation queries (S, M, C, T, P, V)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.domain_sql import domain
from veriweave.functions.numbers import round_half_up
from veriweave.operators import cleaning, enrichment, profiling, sketches, validation
from veriweave.plans.etl import clean_and_enrich, load_all
from veriweave.roles import DECLARED, domain_tables, read
from veriweave.session import checkpoint_dir, staged
from veriweave.sources.metadata import (
    LOGICAL_TABLES,
    ColumnRoles,
    ForeignKey,
    TableMeta,
    coerce_values,
    logical_table,
    resolve_columns,
    schema_summary,
    union_all,
)
from veriweave.sources.stores import delete_rows, type_counts, upsert_rows
from veriweave.sources.tables import row_counts

ROLES = ColumnRoles()
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def spelled(key: str, values: Sequence[str | None]) -> str:
    """SQL for both engines: one of the texts, by the key."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {arms} END"


def strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACES}', ''), '{SPACES}$', '')"


TOKENS = ["N/A", " none ", "", "actual value", "-", "Null", "0", "Not Available", ".", "nan", "--", "x", "UNDEFINED", None]
GENDER_WORDS = ["M", "Female", "male", "MALE", " f ", "Other", "trans", "boy", "Unknown", "LADIES", "1", None]
PHONES = [
    "'+91-98765' || lpad(CAST({k} AS {text}), 5, '0')", "'098765' || lpad(CAST({k} AS {text}), 5, '0')",
    "'98765 ' || lpad(CAST({k} AS {text}), 5, '0')", "'invalid ' || CAST({k} AS {text})", "'12345'", "'none'",
    "'(91) 98765.' || lpad(CAST({k} AS {text}), 5, '0')",
]


def phone_expr(key: str, text: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {p.format(k=key, text=text)}" for i, p in enumerate(PHONES))
    return f"CASE {key} % {len(PHONES)} {arms} END"


def phone_clean_sql(c: str) -> str:
    digits = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN length({digits}) = 12 AND {digits} LIKE '91%' THEN substr({digits}, 3) "
        f"WHEN length({digits}) = 11 AND {digits} LIKE '0%' THEN substr({digits}, 2) "
        f"WHEN length({digits}) = 10 THEN {digits} ELSE {c} END"
    )


def gender_sql(c: str) -> str:
    word = f"lower({strip_sql(c)})"
    male = "', '".join(cleaning.MALE_WORDS)
    female = "', '".join(cleaning.FEMALE_WORDS)
    other = "', '".join(cleaning.OTHER_WORDS)
    return (
        f"CASE WHEN {word} IN ('{male}') THEN 'Male' WHEN {word} IN ('{female}') THEN 'Female' "
        f"WHEN {word} IN ('{other}') THEN 'Other' ELSE {c} END"
    )


def null_sql(c: str) -> str:
    tokens = "', '".join(cleaning.NULL_TOKENS)
    return f"CASE WHEN lower({strip_sql(c)}) IN ('{tokens}') THEN NULL ELSE {c} END"


# Date of an order in many spellings, by its key. Each entry: Spark format and DuckDB format.
DATE_FORMATS = [
    ("yyyy-MM-dd", "%Y-%m-%d"), ("dd-MM-yyyy", "%d-%m-%Y"), ("dd/MM/yyyy", "%d/%m/%Y"), ("MM/dd/yyyy", "%m/%d/%Y"),
    ("yyyy/MM/dd", "%Y/%m/%d"), ("dd-MMM-yyyy", "%d-%b-%Y"), ("dd MMM yyyy", "%d %b %Y"), ("dd MMMM yyyy", "%d %B %Y"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("dd-MM-yyyy HH:mm:ss", "%d-%m-%Y %H:%M:%S"),
    ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"),
]
N_DATES = len(DATE_FORMATS) + 2


def dates_spark(key: str, column: str) -> str:
    arms = " ".join(f"WHEN {i} THEN date_format({column}, \"{s}\")" for i, (s, _) in enumerate(DATE_FORMATS))
    return f"CASE {key} % {N_DATES} {arms} WHEN {N_DATES - 2} THEN 'not a date' END"


def dates_duck(key: str, column: str) -> str:
    arms = " ".join(f"WHEN {i} THEN strftime({column}, '{d}')" for i, (_, d) in enumerate(DATE_FORMATS))
    return f"CASE {key} % {N_DATES} {arms} WHEN {N_DATES - 2} THEN 'not a date' END"


def parsed_sql(c: str) -> str:
    tries = ", ".join(f"try_strptime({c}, '{d}')" for _, d in DATE_FORMATS)
    return f"COALESCE({tries})"


def _one(cleaner, table: str, exprs: Sequence[str], meta: TableMeta = TableMeta("t")):
    """A query that applies one cleaner to a projection of a table."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return cleaner(read(spark, sf, table).selectExpr(*exprs), meta, ROLES)

    return run


def whitespace_clean(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents").selectExpr("doc_id", "text AS body", "text AS narrative")
    df = cleaning.collapse_spaces(cleaning.trim_spaces(df, TableMeta("t"), ROLES), TableMeta("t"), ROLES)
    return df.select(
        "doc_id", F.md5("body").alias("body_hash"), F.length("body").cast("bigint").alias("body_length"),
        F.length("narrative").cast("bigint").alias("narrative_length"),
    )


def dates_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = read(spark, sf, "orders").selectExpr("o_orderkey", f"{dates_spark('o_orderkey', 'o_orderdate')} AS crime_date")
    iso = cleaning.normalise_dates(raw, TableMeta("t"), ROLES).withColumnRenamed("crime_date", "iso_text")
    both = iso.join(cleaning.convert_dates(raw, TableMeta("t"), ROLES), "o_orderkey")
    return both.select("o_orderkey", "iso_text", F.date_format("crime_date", "yyyy-MM-dd HH:mm:ss").alias("value"))


DIRTY_META = TableMeta(
    "dirty", ("row_id",), expected_types={"row_id": "int", "amount": "float", "crime_date": "datetime"}
)


def dirty_exprs(engine: str) -> list[str]:
    text = "STRING" if engine == "spark" else "VARCHAR"
    dates = dates_spark if engine == "spark" else dates_duck
    day = dates("o_orderkey", "o_orderdate")
    return [
        "o_custkey AS row_id",
        f"{spelled('o_custkey', ['  fir/1/2024  ', 'FIR  2 2024', 'Cr/3'])} AS fir_no",
        f"{day.replace('o_orderkey', 'o_custkey')} AS crime_date",
        f"{spelled('o_custkey', GENDER_WORDS)} AS gender",
        f"{phone_expr('o_custkey', text)} AS phone",
        f"{spelled('o_custkey', ['  kept   as is ', 'N/A', ' x '])} AS narrative",
        f"{spelled('o_custkey', ['Open ', ' Closed', '', 'Under   Investigation', 'none'])} AS status",
        f"{spelled('o_custkey', ['12.5', 'abc', ' 7 ', '-', '1e3'])} AS amount",
    ]


def dirty_table(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    # One date per customer, so that a customer's rows repeat.
    one = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("o_orderdate"))
    return orders.select("o_custkey").join(one, "o_custkey").selectExpr(*dirty_exprs("spark"))


DIRTY_SQL = (
    "dirty AS (SELECT " + ", ".join(dirty_exprs("duck"))
    + " FROM (SELECT o_custkey, min(o_orderdate) OVER (PARTITION BY o_custkey) AS o_orderdate FROM orders)),\n"
    "nulled AS (SELECT row_id, " + ", ".join(
        f"{null_sql(c)} AS {c}" for c in ("fir_no", "crime_date", "gender", "phone", "narrative", "status", "amount")
    ) + " FROM dirty),\n"
    "spaced AS (SELECT row_id, narrative, " + ", ".join(
        f"regexp_replace({strip_sql(c)}, '{SPACES}', ' ', 'g') AS {c}"
        for c in ("fir_no", "crime_date", "gender", "phone", "status", "amount")
    ) + " FROM nulled),\n"
    f"cleaned AS (SELECT DISTINCT row_id, upper(fir_no) AS fir_no, {parsed_sql('crime_date')} AS crime_date, "
    f"{gender_sql('gender')} AS gender, {phone_clean_sql('phone')} AS phone, narrative, status, amount FROM spaced)"
)


def cleaned_chain(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.clean(dirty_table(spark, sf), DIRTY_META)
    return out.withColumn("crime_date", F.date_format("crime_date", "yyyy-MM-dd HH:mm:ss"))


def enriched_chain(spark: SparkSession, sf: str) -> DataFrame:
    out = clean_and_enrich(dirty_table(spark, sf), DIRTY_META)
    return out.select(
        "row_id", "crime_year", "crime_month", "crime_week", "crime_weekday", "crime_hour", "is_weekend",
        "is_night_crime", "search_text",
    )


ENRICHED_SQL = f"""WITH {DIRTY_SQL}
SELECT row_id, CAST(year(crime_date) AS BIGINT) AS crime_year, CAST(month(crime_date) AS BIGINT) AS crime_month,
       CAST(week(crime_date) AS BIGINT) AS crime_week, dayname(crime_date) AS crime_weekday,
       CAST(hour(crime_date) AS BIGINT) AS crime_hour, COALESCE(isodow(crime_date) >= 6, false) AS is_weekend,
       COALESCE(hour(crime_date) < 6 OR hour(crime_date) >= 22, false) AS is_night_crime,
       nullif(concat_ws(' | ', 'fir_no: ' || fir_no, 'gender: ' || gender, 'phone: ' || phone,
              'narrative: ' || {strip_sql('narrative')}, 'status: ' || status,
              'crime_weekday: ' || dayname(crime_date)), '') AS search_text
FROM cleaned"""


def _enrich(enricher, table: str, exprs: Sequence[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = enricher(read(spark, sf, table).selectExpr(*exprs), TableMeta("t"), ROLES)
        return out.select(*[c for c in out.columns if not c.endswith("_dt") and c not in ("started", "ended")])

    return run


def duration(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("incident_end"))
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, o_custkey % 1000, 7)")).alias("incident_start"),
    )
    out = enrichment.add_duration(line.join(orders, "l_orderkey"), TableMeta("t"), ROLES)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "incident_duration_hours")


def address(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    df = read(spark, sf, "customer").join(nation, "c_nationkey").selectExpr(
        "c_custkey", "IF(c_custkey % 3 = 0, '  ', CONCAT(c_name, ' ')) AS street_address", "c_nationkey AS district_id",
        "IF(c_custkey % 5 = 0, NULL, state) AS state",
    )
    return enrichment.add_address(df, TableMeta("t"), ROLES).select("c_custkey", "canonical_address")


def search_text(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "part").selectExpr(
        "p_partkey", "p_name", "IF(p_partkey % 4 = 0, ' ', p_brand) AS p_brand", "IF(p_partkey % 7 = 0, NULL, p_type) AS p_type"
    )
    return enrichment.add_search_text(df, TableMeta("t"), ROLES).select("p_partkey", "search_text")


# Columns with gaps, for the checks that count missing values.
GAPS = [
    "l_orderkey", "l_linenumber", "CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity",
    "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_extendedprice * (CASE WHEN l_linenumber = 7 THEN 40 ELSE 1 END) AS l_extendedprice",
]
MESSY = [
    "doc_id",
    "CASE WHEN doc_id % 3 = 0 THEN ' ' || source ELSE source || '  x' END AS source",
    "text",
    "CASE WHEN doc_id % 10 = 0 THEN 'soon' ELSE lang END AS updated_on",
]


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").selectExpr(*GAPS)


def messy(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").selectExpr(*MESSY)


GAPPY_SQL = "gappy AS (SELECT " + ", ".join(GAPS) + " FROM lineitem)"
MESSY_SQL = "messy AS (SELECT " + ", ".join(MESSY) + " FROM documents)"
BAD_SQL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}\x{fffd}]"


def shape(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.shape(read(spark, sf, "lineitem")).select("row_count", "column_count", "column_name")


def bad_dates(spark: SparkSession, sf: str) -> DataFrame:
    raw = read(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{dates_spark('o_orderkey', 'o_orderdate')} AS reported_time", "o_orderpriority AS updated_by"
    )
    return profiling.invalid_dates(raw).select("column_name", F.col("value").cast("bigint").alias("invalid"))


def outliers(spark: SparkSession, sf: str) -> DataFrame:
    found = profiling.iqr_outliers(gappy(spark, sf).drop("l_orderkey"))
    return found.select(
        "column_name", round_half_up(F.col("lower_bound"), 3).alias("lower_bound"), round_half_up(F.col("upper_bound"), 3).alias("upper_bound"),
        "outlier_count",
    )


def event_outliers(spark: SparkSession, sf: str) -> DataFrame:
    found = profiling.iqr_outliers(read(spark, sf, "events"), ["value", "user_id"])
    return found.select(
        "column_name", round_half_up(F.col("lower_bound"), 3).alias("lower_bound"), round_half_up(F.col("upper_bound"), 3).alias("upper_bound"),
        "outlier_count",
    )


def _outlier_sql(source: str, columns: Sequence[str], prefix: str = "") -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS column_name, lo, hi, CAST(count(*) FILTER (v < lo OR v > hi) AS BIGINT) AS outlier_count FROM "
            f"(SELECT v, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q1, q3 FROM "
            f"(SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL), "
            f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 "
            f"FROM {source})) WHERE q1 <> q3 GROUP BY 1, 2, 3"
        )
    body = " UNION ALL ".join(parts)
    return (
        f"{prefix}SELECT column_name, floor(lo * 1000 + 0.5 + 1e-7) / 1000 AS lower_bound, floor(hi * 1000 + 0.5 + 1e-7) / 1000 AS upper_bound, outlier_count "
        f"FROM ({body}) WHERE outlier_count > 0"
    )


COORDS = ["c_custkey", "c_acctbal / 100 AS latitude", "c_acctbal / 40 AS lng", "c_name"]


def coords(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.coordinates(read(spark, sf, "customer").selectExpr(*COORDS)).select(
        "column_name", F.col("value").cast("bigint").alias("out_of_range")
    )


def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = profiling.column_statistics(read(spark, sf, "orders"), ["o_custkey", "o_totalprice", "o_orderstatus"])
    return stats.select("column_name", "metric", round_half_up(F.col("value"), 3).alias("value"))


COLUMN_STATS_SQL = " UNION ALL ".join(
    [
        f"SELECT '{c}' AS column_name, m AS metric, floor(CAST(v AS DOUBLE) * 1000 + 0.5 + 1e-7) / 1000 AS value FROM (SELECT unnest([{metrics}]) AS m, "
        f"unnest([{values}]) AS v FROM orders)"
        for c, metrics, values in (
            (
                c, "'null_count', 'min', 'max', 'mean', 'std', 'unique_count'",
                f"CAST(count(*) - count({c}) AS DOUBLE), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), "
                f"avg(CAST({c} AS DOUBLE)), stddev_samp(CAST({c} AS DOUBLE)), CAST(count(DISTINCT {c}) AS DOUBLE)",
            )
            for c in ("o_custkey", "o_totalprice")
        )
    ]
    + [
        "SELECT 'o_orderstatus' AS column_name, m AS metric, v AS value FROM (SELECT unnest(['null_count', 'unique_count']) AS m, "
        "unnest([CAST(count(*) - count(o_orderstatus) AS DOUBLE), CAST(count(DISTINCT o_orderstatus) AS DOUBLE)]) AS v FROM orders)"
    ]
)


def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.text_statistics(read(spark, sf, "documents")).select(
        "column_name", "metric", round_half_up(F.col("value"), 3).alias("value")
    )


def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.top_values(read(spark, sf, "customer").unionByName(
        read(spark, sf, "customer").filter("c_acctbal > 5000")
    ).select("c_mktsegment", "c_name"))


TOP_SQL = "WITH twice AS (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_acctbal > 5000)\n" + " UNION ALL ".join(
    f"(SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank "
    f"FROM twice GROUP BY {c} QUALIFY rank <= 5)"
    for c in ("c_mktsegment", "c_name")
)


PROFILED = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "user_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
    "conversations": "conv_id",
}
_COLUMNS = {
    "region": "r_regionkey# r_name", "nation": "n_nationkey# n_name n_regionkey#", "customer": "c_custkey# c_name c_nationkey# c_acctbal# c_mktsegment",
    "supplier": "s_suppkey# s_name s_nationkey# s_acctbal#", "part": "p_partkey# p_name p_brand p_type p_size# p_retailprice#",
    "orders": "o_orderkey# o_custkey# o_orderstatus o_totalprice# o_orderdate! o_orderpriority",
    "lineitem": "l_orderkey# l_partkey# l_suppkey# l_linenumber# l_quantity# l_extendedprice# l_discount# l_tax# l_returnflag l_linestatus l_shipdate!",
    "events": "event_id# ts! user_id# event_type value# props", "documents": "doc_id# text lang source n_chars#", "pages": "page_id# url html",
    "benchmark": "item_id# text", "labels": "doc_id# quality# toxic#", "conversations": "conv_id# turn# role text",
}


def full_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding on every given table (embeddings, which are arrays, left to E2 and E13)."""
    tables = {n: read(spark, sf, n) for n in PROFILED}
    rows = profiling.profile_all(tables, {n: TableMeta(n, (k,)) for n, k in PROFILED.items()})
    return rows.select("table_name", "column_name", "metric", round_half_up(F.col("value"), 3).alias("value"))


def _rounded(c: str) -> str:
    return f"floor(CAST({c} AS DOUBLE) * 1000 + 0.5 + 1e-7) / 1000"


def _profile_sql() -> str:
    parts = []

    def row(table: str, column: str, metric: str, value: str, only: str = "") -> None:
        parts.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, {metric} AS metric, CAST({value} AS DOUBLE) AS value FROM {table}{only}")

    for table, key in PROFILED.items():
        row(table, "", "'rows'", "count(*)")
        parts.append(
            f"SELECT '{table}', '', 'duplicate_rows', CAST((SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS DOUBLE)"
        )
        parts.append(
            f"SELECT '{table}', '', 'duplicate_count', CAST(COALESCE(sum(n), 0) AS DOUBLE) FROM (SELECT count(*) AS n FROM {table} GROUP BY {key} HAVING count(*) > 1)"
        )
        for column in _COLUMNS[table].split():
            c, kind = column.rstrip("#!"), column[-1] if column[-1] in "#!" else ""
            row(table, c, "'null_count'", f"count(*) - count({c})")
            row(table, c, "'unique_count'", f"count(DISTINCT {c})", f" HAVING count({c}) > 0")
            row(table, c, "'missing'", f"count(*) - count({c})", f" HAVING count(*) > count({c})")
            if kind == "#":
                for metric, value in (("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"avg(CAST({c} AS DOUBLE))"), ("std", f"stddev_samp(CAST({c} AS DOUBLE))")):
                    row(table, c, f"'{metric}'", _rounded(value))
                parts.append(
                    f"SELECT '{table}', '{c}', 'outliers', CAST(n AS DOUBLE) FROM (SELECT count(*) AS n FROM {table}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b, count({c}) AS known FROM {table}) WHERE known >= 10 AND a <> b AND "
                    f"({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) WHERE n > 0"
                )
            elif not kind:
                row(table, c, "'avg_length'", _rounded(f"avg(length({c}))"))
                row(table, c, "'leading_trailing_spaces'", f"count(*) FILTER ({c} <> {strip_sql(c)})", f" HAVING count(*) FILTER ({c} <> {strip_sql(c)}) > 0")
                row(table, c, "'multiple_spaces'", f"count(*) FILTER (contains({c}, '  '))", f" HAVING count(*) FILTER (contains({c}, '  ')) > 0")
                bad = f"count(*) FILTER (regexp_matches({c}, '{BAD_SQL}'))"
                row(table, c, "'bad_characters'", bad, f" HAVING {bad} > 0")
                parts.append(
                    f"SELECT * FROM (SELECT '{table}' AS table_name, '{c}' AS column_name, 'top: ' || {c} AS metric, CAST(count(*) AS DOUBLE) AS value FROM {table} "
                    f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 5)"
                )
    return " UNION ALL ".join(parts)


LINE_META = TableMeta("lineitem", ("l_orderkey", "l_linenumber"))


SKETCHED = {
    "events": ("CAST(ts AS DATE)", "event_id# user_id# event_type value# props"),
    "orders": ("o_orderpriority", "o_orderkey# o_custkey# o_orderstatus o_totalprice#"),
    "documents": ("source", "doc_id# text lang n_chars#"),
}


def sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of the parts of three tables, stored part by part and merged: what is exact, and whether estimates keep their bounds."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/sketches/{uuid.uuid4().hex}"
    out = []
    for name, (part, columns) in SKETCHED.items():
        df = read(spark, sf, name)
        names = [c.rstrip("#") for c in columns.split()]
        store = sketches.sketch_store(spark, f"{root}/{name}", 4)
        rows = df.select(F.expr(part).alias("part"), *names)
        # First an earlier state of some parts, then every part as it is.
        sketches.store_parts(store, rows.filter(F.xxhash64("part") % 2 == 0).limit(100), F.col("part"))
        sketches.store_parts(store, rows, F.col("part"))
        told = sketches.estimates(staged(sketches.merge(store.read()), "merged"))
        exact = profiling.value_counts(df, names)
        unique = exact.groupBy("column_name").agg(F.count(F.lit(1)).alias("_n")).withColumn("metric", F.lit("unique_count"))
        # How many values are below and up to each estimated quantile.
        medians = told.filter("metric IN ('median', 'length_median')").select("column_name", "metric", "value")
        numbers = {c.rstrip("#") for c in columns.split() if c.endswith("#")}
        cells = F.array(*[
            F.struct(F.lit(c).alias("column_name"), (F.col(c) if c in numbers else F.length(c)).cast("double").alias("v")) for c in names
        ])
        ranks = df.select(F.inline(cells)).filter("v IS NOT NULL").join(F.broadcast(medians), "column_name").groupBy("column_name", "metric").agg(
            (F.count_if(F.col("v") < F.col("value")) / F.count(F.lit(1))).alias("_below"), (F.count_if(F.col("v") <= F.col("value")) / F.count(F.lit(1))).alias("_upto")
        )
        held = told.join(unique, ["column_name", "metric"], "left").join(ranks, ["column_name", "metric"], "left")
        # Twice the rank error: 99 % confidence is for one side and one quantile.
        kept = F.coalesce(F.col("_n").between(F.col("lower"), F.col("upper")), (F.col("_below") <= 0.5 + 2 * sketches.RANK_ERROR) & (F.col("_upto") >= 0.5 - 2 * sketches.RANK_ERROR))
        estimate = F.col("metric").isin("unique_count", "median", "length_median")
        out.append(
            held.filter(estimate | F.col("metric").isin("rows", "missing", "min", "max", "mean", "std", "length_min", "length_max", "length_mean"))
            .select(
                F.lit(name).alias("table_name"), "column_name", "metric",
                F.when(~estimate, round_half_up(F.col("value"), 3)).alias("value"), F.when(estimate, kept).alias("within_bounds"),
            )
        )
    return union_all(out)


def _sketched_sql() -> str:
    parts = []
    for table, (_, columns) in SKETCHED.items():
        for column in columns.split():
            c = column.rstrip("#")
            v, prefix = (c, "") if column.endswith("#") else (f"length({c})", "length_")
            exact = [("rows", "count(*)"), ("missing", f"count(*) - count({c})"), (f"{prefix}min", f"min({v})"), (f"{prefix}max", f"max({v})"),
                     (f"{prefix}mean", f"avg(CAST({v} AS DOUBLE))")] + ([("std", f"stddev_samp(CAST({v} AS DOUBLE))")] if not prefix else [])
            parts += [f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{m}' AS metric, {_rounded(e)} AS value, NULL::BOOLEAN AS within_bounds FROM {table}" for m, e in exact]
            parts += [f"SELECT '{table}', '{c}', '{m}', NULL, true" for m in ("unique_count", f"{prefix}median")]
    return " UNION ALL ".join(parts)


def pk_unique(spark: SparkSession, sf: str) -> DataFrame:
    return validation.primary_key(read(spark, sf, "lineitem"), LINE_META).select("check", "status", "violations", "errors")


def fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    tables = domain_tables(spark, sf)
    out = validation.foreign_keys(tables["CaseMaster"], DECLARED["CaseMaster"], tables)
    return out.select("column_name", "status", "violations", "errors", "detail")


def fk_recent(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose order is not among the open ones."""
    parent = read(spark, sf, "orders").filter("o_orderstatus = 'O'")
    meta = TableMeta("lineitem", foreign_keys=(ForeignKey("l_orderkey", "orders", "o_orderkey"),))
    return validation.foreign_keys(read(spark, sf, "lineitem"), meta, {"orders": parent}).select(
        "column_name", "status", "violations", "errors", "detail"
    )


FK_SQL = domain(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status,
    count(*) AS violations, CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS BIGINT) AS errors,
    COALESCE((SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM CaseMaster
      WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {r} FROM {p}) ORDER BY 1 LIMIT 10)), '') AS detail
    FROM (SELECT DISTINCT {c} FROM CaseMaster WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {r} FROM {p}))"""
    for c, p, r in (("PoliceStationID", "Unit", "UnitID"), ("CourtID", "Court", "CourtID"),
                    ("PolicePersonID", "Employee", "EmployeeID"))
))

SHIFTED = ["event_id", "CASE WHEN user_id % 50 = 0 THEN ts + INTERVAL 20 YEARS WHEN user_id % 51 = 0 THEN ts - INTERVAL 200 YEARS ELSE ts END AS ts"]


def date_range(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "events").selectExpr(*SHIFTED)
    return validation.date_ranges(df).select("column_name", "status", "violations", "warnings", "detail")


def coordinate_check(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "customer").selectExpr(*COORDS)
    return validation.coordinates(df).select("column_name", "status", "violations", "errors", "detail")


def required(spark: SparkSession, sf: str) -> DataFrame:
    meta = TableMeta("gappy", required=("l_quantity", "l_returnflag", "l_orderkey"))
    return validation.required_columns(gappy(spark, sf), meta).select("column_name", "status", "violations", "errors")


def categories(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "customer").selectExpr("c_custkey", f"{spelled('c_custkey', GENDER_WORDS)} AS gender")
    return validation.unexpected_categories(cleaning.normalise_gender(df, TableMeta("t"), ROLES), "gender").select("value", "rank")


def v8_report(spark: SparkSession, sf: str) -> DataFrame:
    tables = domain_tables(spark, sf)
    return validation.report(validation.validate_all(tables, DECLARED)).select("table_name", "total_errors", "total_warnings")


# Keys, columns that must have a value, and references, as the checking side knows them.
_RULES = {
    "District": ("DistrictID", (), ()),
    "Unit": ("UnitID", (), (("DistrictID", "District", "DistrictID"),)),
    "Court": ("CourtID", (), (("DistrictID", "District", "DistrictID"),)),
    "Employee": ("EmployeeID", (), (("DistrictID", "District", "DistrictID"), ("UnitID", "Unit", "UnitID"))),
    "CaseMaster": (
        "CaseMasterID", ("PolicePersonID",),
        (("PoliceStationID", "Unit", "UnitID"), ("CourtID", "Court", "CourtID"), ("PolicePersonID", "Employee", "EmployeeID")),
    ),
    "ComplainantDetails": ("ComplainantID", (), (("CaseMasterID", "CaseMaster", "CaseMasterID"),)),
    "Victim": ("VictimMasterID", (), (("CaseMasterID", "CaseMaster", "CaseMasterID"),)),
    "Accused": ("AccusedMasterID", (), (("CaseMasterID", "CaseMaster", "CaseMasterID"),)),
    "ActSectionAssociation": ("", (), (("CaseMasterID", "CaseMaster", "CaseMasterID"),)),
    "ChargesheetDetails": ("CSID", (), (("CaseMasterID", "CaseMaster", "CaseMasterID"), ("PolicePersonID", "Employee", "EmployeeID"))),
    "ArrestSurrender": (
        "ArrestSurrenderID", (),
        (("CaseMasterID", "CaseMaster", "CaseMasterID"), ("CourtID", "Court", "CourtID"), ("AccusedMasterID", "Accused", "AccusedMasterID")),
    ),
}
_DATES = {
    "CaseMaster": ("RegisteredDate", "IncidentFromDate", "IncidentToDate"), "ChargesheetDetails": ("csdate",), "ArrestSurrender": ("ArrestSurrenderDate",),
}


def _v8_part(name: str) -> str:
    key, required, references = _RULES[name]
    flags = [f"SELECT count(*) > 0 FROM {name} WHERE {c} IS NULL" for c in ((key,) if key else ()) + required]
    if key:
        flags.append(f"SELECT count(*) > 0 FROM (SELECT 1 FROM {name} GROUP BY {key} HAVING count(*) > 1)")
    flags += [f"SELECT count(*) > 0 FROM {name} WHERE {c} NOT IN (SELECT {r} FROM {p} WHERE {r} IS NOT NULL)" for c, p, r in references]
    dates = [f"SELECT count(*) > 0 FROM {name} WHERE {c} < DATE '1900-01-01' OR {c} > DATE '2035-12-31'" for c in _DATES.get(name, ())]
    errors = " + ".join(f"CAST(({f}) AS BIGINT)" for f in flags)
    # A crime number is declared a text and is a number.
    warnings = " + ".join([f"CAST(({d}) AS BIGINT)" for d in dates] + ["1" if name == "CaseMaster" else "0"])
    return f"SELECT '{name}' AS table_name, {errors} AS total_errors, CAST({warnings} AS BIGINT) AS total_warnings"


V8_SQL = domain(" UNION ALL ".join(_v8_part(name) for name in _RULES))


def type_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text does not fit the declared type, over the whole table."""
    df = read(spark, sf, "orders").selectExpr("o_orderkey", f"{spelled('o_orderkey', ['12', ' 7 ', 'x1', '-3', '1.5', ''])} AS raw")
    return coerce_values(df, "raw", "bigint").select("o_orderkey", "coerced", "is_valid")


def m7_summary(spark: SparkSession, sf: str) -> DataFrame:
    return schema_summary(domain_tables(spark, sf), DECLARED).select("table_name", "columns", "primary_key", "foreign_keys", "row_count")


M7_SQL = domain(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CAST({n} AS BIGINT) AS columns, '{','.join(DECLARED[name].primary_key)}' AS primary_key, "
    f"CAST({len(DECLARED[name].foreign_keys)} AS BIGINT) AS foreign_keys, count(*) AS row_count FROM {name}"
    for name, n in (
        ("District", 2), ("Unit", 3), ("Court", 3), ("Employee", 7), ("CaseMaster", 12), ("ComplainantDetails", 3),
        ("Victim", 5), ("Accused", 6), ("ActSectionAssociation", 3), ("ChargesheetDetails", 5), ("ArrestSurrender", 6),
    )
))


def m10_logical(spark: SparkSession, sf: str) -> DataFrame:
    return logical_table(domain_tables(spark, sf), "CaseMaster")


def m10_seed_names(spark: SparkSession, sf: str) -> DataFrame:
    """The same logical columns from a table in other spelling, without the optional one."""
    df = read(spark, sf, "orders").selectExpr(
        "o_orderkey AS Case_ID", "o_custkey AS IO_ID", "o_orderpriority AS FIR_No", "o_orderkey + 5 AS Case_No", "o_custkey % 9 AS Station_ID"
    )
    return resolve_columns(df, LOGICAL_TABLES["CaseMaster"])


GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def s6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return row_counts({n: read(spark, sf, n) for n in GIVEN})


def s12_types(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").withColumnRenamed("lang", "document_type")
    return type_counts(docs)


def s14_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Labels replaced by those of the embeddings with the same id, the others added."""
    old = read(spark, sf, "labels").selectExpr("doc_id AS point_id", "CAST(quality AS BIGINT) AS label")
    new = read(spark, sf, "embeddings").selectExpr("vec_id AS point_id", "CAST(label + 10 AS BIGINT) AS label")
    return upsert_rows(old, new, "point_id")


def s15_delete(spark: SparkSession, sf: str) -> DataFrame:
    old = read(spark, sf, "documents").selectExpr("doc_id AS point_id", "source")
    return delete_rows(old, read(spark, sf, "labels").selectExpr("doc_id AS point_id"), "point_id")


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a run that cleans and loads every domain table, and of one in which the sixth table fails."""
    tables = domain_tables(spark, sf)
    whole, _ = load_all(spark, tables, DECLARED, f"run_{uuid.uuid4().hex}")
    broken = dict(tables)
    broken["ComplainantDetails"] = tables["ComplainantDetails"].withColumn("ComplainantID", F.raise_error(F.lit("unreadable")).cast("bigint"))
    some, _ = load_all(spark, broken, DECLARED, f"run_{uuid.uuid4().hex}")
    columns = ["status", "tables_discovered", "tables_extracted", "tables_cleaned", "tables_loaded", "total_rows_read", "total_rows_loaded", "total_rows_rejected", "relationships_discovered"]
    return union_all([validation.run_summary(f, DECLARED).select(*columns, F.col("error").isNotNull().alias("told")) for f in (whole, some)])


def _run_sql() -> str:
    names = list(DECLARED)
    count = {n: f"(SELECT count(*) FROM {n})" for n in names}
    kept = {n: f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {n}))" for n in names}
    before = names[: names.index("ComplainantDetails")]

    def run(status: str, read: list[str], loaded: list[str], told: bool) -> str:
        total = lambda of, some: "CAST((" + " + ".join(of[n] for n in some) + ") AS BIGINT)"
        return (
            f"SELECT '{status}' AS status, {len(names)}::BIGINT AS tables_discovered, {len(read)}::BIGINT AS tables_extracted, {len(loaded)}::BIGINT AS tables_cleaned, "
            f"{len(loaded)}::BIGINT AS tables_loaded, {total(count, read)} AS total_rows_read, {total(kept, loaded)} AS total_rows_loaded, "
            f"{total(count, loaded)} - {total(kept, loaded)} AS total_rows_rejected, "
            f"{sum(len(DECLARED[n].foreign_keys) for n in read)}::BIGINT AS relationships_discovered, {str(told).lower()} AS told"
        )

    # Counting needs no value, so the table that fails was read and is not loaded.
    return run("success", names, names, False) + " UNION ALL " + run("failed", [*before, "ComplainantDetails"], before, True)


_RUN_SQL = _run_sql()
TOKEN_EXPRS = ["c_custkey", f"{spelled('c_custkey', TOKENS)} AS raw", "c_name AS narrative"]
CODE_EXPRS = ["c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN '  fir/' || c_name || '  x ' ELSE lower(c_name) END AS fir_no"]
NUMBER_EXPRS = ["event_id", f"{spelled('event_id', ['12.5', 'abc', ' 7 ', '-3', '1e3', '', None])} AS amount"]

QUERIES = {
    "S6_row_counts": (
        s6_counts,
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}"
                           for n in GIVEN),
    ),
    "S12_type_counts": (s12_types, "SELECT lang AS document_type, count(*) AS documents FROM documents GROUP BY 1"),
    "S14_upsert": (
        s14_upsert,
        "SELECT doc_id AS point_id, CAST(quality AS BIGINT) AS label FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) "
        "UNION ALL SELECT vec_id, CAST(label + 10 AS BIGINT) FROM embeddings",
    ),
    "S15_delete": (
        s15_delete, "SELECT doc_id AS point_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    ),
    "M7_schema_summary": (m7_summary, M7_SQL),
    "M10_logical_columns": (
        m10_logical,
        domain("SELECT CaseMasterID AS case_id, CaseNo AS case_number, CrimeNo AS crime_number, PolicePersonID AS police_person_id, "
               "PoliceStationID AS station_id, CaseStatusID AS status FROM CaseMaster"),
    ),
    "M10_other_spelling": (
        m10_seed_names,
        "SELECT o_orderkey AS case_id, o_custkey AS police_person_id, o_orderpriority AS crime_number, o_orderkey + 5 AS case_number, "
        "o_custkey % 9 AS station_id FROM orders",
    ),
    "M11_coerce_keys": (
        type_mismatch,
        f"SELECT o_orderkey, v AS coerced, v IS NOT NULL AS is_valid FROM (SELECT o_orderkey, CASE WHEN regexp_matches(trim(raw), "
        f"'^-*[0-9]+$') THEN TRY_CAST(trim(raw) AS BIGINT) END AS v FROM (SELECT o_orderkey, "
        f"{spelled('o_orderkey', ['12', ' 7 ', 'x1', '-3', '1.5', ''])} AS raw FROM orders))",
    ),
    "C1_null_tokens": (
        _one(cleaning.normalise_nulls, "customer", TOKEN_EXPRS),
        f"SELECT c_custkey, {null_sql('raw')} AS raw, narrative FROM (SELECT {', '.join(TOKEN_EXPRS)} FROM customer)",
    ),
    "C2_C3_whitespace": (
        whitespace_clean,
        f"SELECT doc_id, md5(t) AS body_hash, CAST(length(t) AS BIGINT) AS body_length, CAST(length(text) AS BIGINT) AS narrative_length "
        f"FROM (SELECT doc_id, text, regexp_replace({strip_sql('text')}, '{SPACES}', ' ', 'g') AS t FROM documents)",
    ),
    "C4_gender_map": (
        _one(cleaning.normalise_gender, "customer", ["c_custkey", f"{spelled('c_custkey', GENDER_WORDS)} AS gender"]),
        f"SELECT c_custkey, {gender_sql('gender')} AS gender FROM (SELECT c_custkey, {spelled('c_custkey', GENDER_WORDS)} AS gender FROM customer)",
    ),
    "C5_phone": (
        _one(cleaning.normalise_phones, "customer", ["c_custkey", f"{phone_expr('c_custkey', 'STRING')} AS phone"]),
        f"SELECT c_custkey, {phone_clean_sql('phone')} AS phone FROM (SELECT c_custkey, {phone_expr('c_custkey', 'VARCHAR')} AS phone FROM customer)",
    ),
    "C6_upper_code": (
        _one(cleaning.normalise_codes, "customer", CODE_EXPRS),
        f"SELECT c_custkey, regexp_replace(upper(trim(fir_no)), '\\s+', ' ', 'g') AS fir_no FROM (SELECT {', '.join(CODE_EXPRS)} FROM customer)",
    ),
    "C7_C8_dates": (
        dates_clean,
        f"SELECT o_orderkey, COALESCE(strftime(p, '%Y-%m-%dT%H:%M:%S'), raw) AS iso_text, strftime(p, '%Y-%m-%d %H:%M:%S') AS value "
        f"FROM (SELECT o_orderkey, raw, {parsed_sql('raw')} AS p FROM (SELECT o_orderkey, {dates_duck('o_orderkey', 'o_orderdate')} AS raw FROM orders))",
    ),
    "C9_dedup": (
        _one(cleaning.drop_duplicate_rows, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"]),
        "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem",
    ),
    "C10_numeric_cast": (
        _one(cleaning.convert_numbers, "events", NUMBER_EXPRS, TableMeta("t", expected_types={"amount": "float"})),
        f"SELECT event_id, TRY_CAST(trim(amount) AS DOUBLE) AS amount FROM (SELECT {', '.join(NUMBER_EXPRS)} FROM events)",
    ),
    "C11_chain": (
        cleaned_chain,
        f"WITH {DIRTY_SQL} SELECT row_id, fir_no, strftime(crime_date, '%Y-%m-%d %H:%M:%S') AS crime_date, gender, phone, narrative, "
        "status, TRY_CAST(trim(amount) AS DOUBLE) AS amount FROM cleaned",
    ),
    "T1_date_parts": (
        _enrich(enrichment.add_date_parts, "orders", ["o_orderkey", f"{dates_spark('o_orderkey', 'o_orderdate')} AS crime_dt"]),
        f"SELECT o_orderkey, CAST(year(p) AS BIGINT) AS crime_year, CAST(month(p) AS BIGINT) AS crime_month, CAST(week(p) AS BIGINT) AS "
        f"crime_week, dayname(p) AS crime_weekday FROM (SELECT o_orderkey, {parsed_sql('raw')} AS p FROM (SELECT o_orderkey, "
        f"{dates_duck('o_orderkey', 'o_orderdate')} AS raw FROM orders))",
    ),
    "T2_hour": (
        _enrich(enrichment.add_hour, "events", ["event_id", "ts AS ts_dt"]),
        "SELECT event_id, CAST(hour(ts) AS BIGINT) AS crime_hour FROM events",
    ),
    "T3_weekend": (
        _enrich(enrichment.add_weekend, "events", ["event_id", "IF(user_id % 9 = 0, NULL, ts) AS ts_dt"]),
        "SELECT event_id, COALESCE(isodow(CASE WHEN user_id % 9 = 0 THEN NULL ELSE ts END) >= 6, false) AS is_weekend FROM events",
    ),
    "T4_night": (
        _enrich(enrichment.add_night, "events", ["event_id", "IF(user_id % 9 = 0, NULL, ts) AS ts_dt"]),
        "SELECT event_id, COALESCE(h < 6 OR h >= 22, false) AS is_night_crime FROM (SELECT event_id, "
        "hour(CASE WHEN user_id % 9 = 0 THEN NULL ELSE ts END) AS h FROM events)",
    ),
    "T5_duration_hours": (
        duration,
        "SELECT l_orderkey, l_linenumber, l_partkey, floor(((epoch_us(l_shipdate) - epoch_us(o_orderdate + to_minutes(o_custkey % 1000) + "
        "INTERVAL 7 SECOND)) / 3.6e9) * 100 + 0.5 + 1e-7) / 100 AS incident_duration_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "T6_address": (
        address,
        "SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, CAST(c_nationkey AS VARCHAR), "
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE n_name END) AS canonical_address FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "T7_search_text": (
        search_text,
        "SELECT p_partkey, concat_ws(' | ', 'p_name: ' || p_name, CASE WHEN p_partkey % 4 <> 0 THEN 'p_brand: ' || p_brand END, "
        "CASE WHEN p_partkey % 7 <> 0 THEN 'p_type: ' || p_type END) AS search_text FROM part",
    ),
    "T8_chain": (enriched_chain, ENRICHED_SQL),
    "P1_shape": (
        shape,
        "SELECT (SELECT count(*) FROM lineitem) AS row_count, CAST(11 AS BIGINT) AS column_count, unnest(['l_orderkey', 'l_partkey', "
        "'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) "
        "AS column_name",
    ),
    "P2_missing": (
        lambda spark, sf: profiling.missing_values(gappy(spark, sf)),
        f"WITH {GAPPY_SQL} " + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
            f"floor((count(*) - count({c})) / count(*) * 100 * 100 + 0.5 + 1e-7) / 100 AS missing_pct FROM gappy"
            for c in ("l_quantity", "l_returnflag")
        ),
    ),
    "P3_dup_rows": (
        lambda spark, sf: profiling.duplicate_rows(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")),
        "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) "
        "AS duplicate_rows",
    ),
    "P4_pk_dups": (
        lambda spark, sf: profiling.duplicate_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "SELECT CAST(sum(n) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    ),
    "P5_whitespace": (
        lambda spark, sf: profiling.whitespace(messy(spark, sf)),
        f"WITH {MESSY_SQL} SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, 'leading_trailing_spaces' AS metric, CAST(count(*) FILTER ({c} <> {strip_sql(c)}) AS DOUBLE) AS value "
            f"FROM messy UNION ALL SELECT '{c}', 'multiple_spaces', CAST(count(*) FILTER (contains({c}, '  ')) AS DOUBLE) FROM messy"
            for c in ("source", "text", "updated_on")
        ) + ") WHERE value > 0",
    ),
    "P6_encoding": (
        lambda spark, sf: profiling.encoding(messy(spark, sf).withColumn(
            "lead", F.concat(F.col("source"), F.when(F.col("doc_id") % 7 == 0, F.lit("\x01")).otherwise(F.lit(""))))),
        f"WITH {MESSY_SQL} SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, 'bad_characters' AS metric, CAST(count(*) FILTER (regexp_matches({e}, '{BAD_SQL}')) AS DOUBLE) AS value FROM messy"
            for c, e in (("source", "source"), ("text", "text"), ("updated_on", "updated_on"),
                         ("lead", "source || CASE WHEN doc_id % 7 = 0 THEN chr(1) ELSE '' END"))
        ) + ") WHERE value > 0",
    ),
    "P7_bad_dates": (
        bad_dates,
        f"SELECT * FROM (SELECT 'reported_time' AS column_name, count(*) FILTER (raw IS NOT NULL AND {parsed_sql('raw')} IS NULL) AS invalid FROM "
        f"(SELECT {dates_duck('o_orderkey', 'o_orderdate')} AS raw FROM orders) UNION ALL SELECT 'updated_by', count(*) FROM orders)",
    ),
    "P8_iqr_outliers": (outliers, _outlier_sql("gappy", ["l_linenumber", "l_quantity", "l_extendedprice"], f"WITH {GAPPY_SQL} ")),
    "P8_iqr_events": (event_outliers, _outlier_sql("events", ["value", "user_id"])),
    "P9_ranges": (
        coords,
        "SELECT * FROM (SELECT 'latitude' AS column_name, count(*) FILTER (abs(c_acctbal / 100) > 90) AS out_of_range FROM customer "
        "UNION ALL SELECT 'lng', count(*) FILTER (abs(c_acctbal / 40) > 180) FROM customer) WHERE out_of_range > 0",
    ),
    "P10_column_stats": (column_stats, COLUMN_STATS_SQL),
    "P11_text_stats": (
        text_stats,
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, 'avg_length' AS metric, floor(avg(length({c})) * 1000 + 0.5 + 1e-7) / 1000 AS value FROM documents"
                           for c in ("text", "lang", "source")),
    ),
    "P11_top_values": (top_values, TOP_SQL),
    "P12_profile_all": (full_profile, _profile_sql()),
    "P10_P12_sketches": (sketched, _sketched_sql()),
    "V1_pk_unique": (
        pk_unique,
        "SELECT 'pk_uniqueness' AS \"check\", 'fail' AS status, CAST(sum(n) AS BIGINT) AS violations, CAST(1 AS BIGINT) AS errors FROM "
        "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    ),
    "V2_fk_orphans": (fk_orphans, FK_SQL),
    "V2_fk_line_items": (
        fk_recent,
        "WITH o AS (SELECT DISTINCT l_orderkey AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) "
        "SELECT 'l_orderkey' AS column_name, 'fail' AS status, count(*) AS violations, CAST(1 AS BIGINT) AS errors, "
        "(SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT v FROM o ORDER BY v LIMIT 10)) AS detail FROM o",
    ),
    "V4_date_range": (
        date_range,
        f"WITH s AS (SELECT {', '.join(SHIFTED)} FROM events) SELECT 'ts' AS column_name, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, "
        "n AS violations, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings, strftime(lo, '%Y-%m-%d %H:%M:%S') || ' to ' || "
        "strftime(hi, '%Y-%m-%d %H:%M:%S') AS detail FROM (SELECT count(*) FILTER (ts < TIMESTAMP '1900-01-01' OR ts > TIMESTAMP '2035-12-31') AS n, "
        "min(ts) AS lo, max(ts) AS hi FROM s)",
    ),
    "V5_coordinates": (
        coordinate_check,
        "SELECT column_name, CASE WHEN violations > 0 THEN 'fail' ELSE 'pass' END AS status, violations, "
        "CAST(CASE WHEN violations > 0 THEN 1 ELSE 0 END AS BIGINT) AS errors, detail FROM (SELECT 'latitude' AS column_name, "
        "count(*) FILTER (abs(c_acctbal / 100) > 90) AS violations, '-90..90' AS detail FROM customer UNION ALL SELECT 'lng', "
        "count(*) FILTER (abs(c_acctbal / 40) > 180), '-180..180' FROM customer)",
    ),
    "V6_required": (
        required,
        f"WITH {GAPPY_SQL} SELECT column_name, CASE WHEN violations > 0 THEN 'fail' ELSE 'pass' END AS status, violations, "
        "CAST(CASE WHEN violations > 0 THEN 1 ELSE 0 END AS BIGINT) AS errors FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS violations FROM gappy" for c in ("l_quantity", "l_returnflag", "l_orderkey")
        ) + ")",
    ),
    "V7_categories": (
        categories,
        f"SELECT value, row_number() OVER (ORDER BY value) AS rank FROM (SELECT DISTINCT {gender_sql('g')} AS value FROM (SELECT "
        f"{spelled('c_custkey', GENDER_WORDS)} AS g FROM customer)) WHERE value IS NOT NULL AND value NOT IN ('Male', 'Female', 'Other')",
    ),
    "V8_report": (v8_report, V8_SQL),
    "V9_run_summary": (
        run_report,
        domain(_RUN_SQL),
    ),
}
