"""Integrity checks (V1-V9). Every check gives rows of the same form.

Row: check, column_name, status, violations, errors, warnings, detail.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.functions.dates import is_time_type
from veriweave.functions.groups import top_per_key
from veriweave.operators.profiling import coordinate_limits, count_where, duplicate_keys
from veriweave.session import staged
from veriweave.sources.metadata import ColumnRoles, TableMeta, kind_of, quoted, union_all

# The accepted date range, the accepted genders, and how many samples a report shows.
FIRST_DATE = "1900-01-01"
LAST_DATE = "2035-12-31"
GENDERS = ("Male", "Female", "Other")
ORPHAN_SAMPLES = 10
CATEGORY_SAMPLES = 20

_COMPATIBLE = {
    "int": {"int", "float"},
    "float": {"int", "float"},
    "str": {"str"},
    "datetime": {"datetime", "date"},
    "date": {"datetime", "date"},
    "bool": {"bool"},
}


def _row(check: str, column: str, violations: Column, errors: Column, warnings: Column, detail: Column) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        F.lit(column).alias("column_name"),
        F.when((errors > 0) | (warnings > 0), "fail").otherwise("pass").alias("status"),
        violations.cast("bigint").alias("violations"),
        errors.cast("bigint").alias("errors"),
        warnings.cast("bigint").alias("warnings"),
        detail.cast("string").alias("detail"),
    ]


def _flag(c: Column) -> Column:
    return F.when(c > 0, 1).otherwise(0)


def primary_key(df: DataFrame, meta: TableMeta) -> DataFrame:
    """Rows that share their key with another row; one error if there are any (V1)."""
    n = F.col("duplicate_count")
    return duplicate_keys(df, meta.primary_key).select(
        *_row("pk_uniqueness", ",".join(meta.primary_key), n, _flag(n), F.lit(0), F.lit(""))
    )


def orphan_values(child: DataFrame, column: str, parent: DataFrame, ref_column: str) -> DataFrame:
    """Distinct non-NULL values of the child column that the parent lacks."""
    wanted = child.select(quoted(column).alias("value")).filter("value IS NOT NULL").distinct()
    known = parent.select(quoted(ref_column).alias("value")).filter("value IS NOT NULL").distinct()
    return wanted.join(known, "value", "left_anti")


def foreign_keys(df: DataFrame, meta: TableMeta, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Orphaned values per reference, with the smallest few as samples (V2).

    A reference to a table or column that is not there is skipped with a warning.
    """
    parts = []
    for fk in meta.foreign_keys:
        if fk.column not in df.columns:
            continue
        parent = tables.get(fk.table)
        if parent is None or fk.ref_column not in parent.columns:
            reason = f"{fk.table}.{fk.ref_column} is not available"
            skipped = df.sparkSession.range(1).select(
                *_row("fk_integrity", fk.column, F.lit(0), F.lit(0), F.lit(1), F.lit(reason))
            )
            parts.append(skipped.withColumn("status", F.lit("skipped")))
            continue
        orphans = orphan_values(df, fk.column, parent, fk.ref_column)
        ranked = top_per_key(
            orphans.withColumn("column", F.lit(fk.column)), ["column"], [F.col("value")], ORPHAN_SAMPLES
        )
        samples = ranked.agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("value").cast("string").alias("s")))),
                                     lambda r: r["s"]), ",").alias("samples")
        )
        counted = orphans.agg(F.count(F.lit(1)).alias("n")).withColumn("samples", F.lit(None).cast("string"))
        both = counted.unionByName(samples.withColumn("n", F.lit(0).cast("bigint")))
        row = both.agg(F.max("n").alias("n"), F.max("samples").alias("samples"))
        n = F.col("n")
        parts.append(row.select(*_row("fk_integrity", fk.column, n, _flag(n), F.lit(0), F.col("samples"))))
    return union_all(parts)


def data_types(df: DataFrame, meta: TableMeta) -> DataFrame:
    """Columns whose type differs from the declared one; a warning each (V3)."""
    actual = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    rows = [
        ("data_types", c, "fail", 1, 0, 1, f"expected {kind}, actual {actual[c]}")
        for c, kind in meta.expected_types.items()
        if c in actual and actual[c] not in _COMPATIBLE.get(kind, {actual[c]})
    ]
    schema = (
        "check string, column_name string, status string, violations bigint, "
        "errors bigint, warnings bigint, detail string"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def _summarise(df: DataFrame, checks: list[tuple[str, str, Column, bool, Column]]) -> DataFrame | None:
    """One aggregation for all checks: (check, column, violations, is_error, detail)."""
    if not checks:
        return None
    aggregates = []
    for i, (_, _, violations, _, detail) in enumerate(checks):
        aggregates += [violations.alias(f"v{i}"), detail.cast("string").alias(f"d{i}")]
    row = df.agg(*aggregates)
    cells = []
    for i, (check, column, _, is_error, _) in enumerate(checks):
        n = F.col(f"v{i}")
        none = F.lit(0)
        cells.append(F.struct(*_row(check, column, n, _flag(n) if is_error else none,
                                    none if is_error else _flag(n), F.col(f"d{i}"))))
    return row.select(F.inline(F.array(*cells)))


def _date_checks(df: DataFrame) -> list[tuple[str, str, Column, bool, Column]]:
    out = []
    for f in df.schema.fields:
        if not is_time_type(f.dataType):
            continue
        c = quoted(f.name)
        outside = (c < F.lit(FIRST_DATE).cast(f.dataType)) | (c > F.lit(LAST_DATE).cast(f.dataType))
        fmt = "yyyy-MM-dd HH:mm:ss"
        found = F.concat_ws(
            " to ", F.date_format(F.min(c).cast("timestamp"), fmt), F.date_format(F.max(c).cast("timestamp"), fmt)
        )
        out.append(("date_ranges", f.name, count_where(outside), False, found))
    return out


def date_ranges(df: DataFrame) -> DataFrame | None:
    """Dates outside the accepted range, with the range found; a warning per column (V4)."""
    return _summarise(df, _date_checks(df))


def _coordinate_checks(df: DataFrame, roles: ColumnRoles) -> list[tuple[str, str, Column, bool, Column]]:
    return [
        ("coordinates", c, count_where(F.abs(quoted(c)) > limit), True, F.lit(f"-{limit:g}..{limit:g}"))
        for c, limit in coordinate_limits(df, roles)
    ]


def coordinates(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame | None:
    """Coordinates out of range; an error per column (V5)."""
    return _summarise(df, _coordinate_checks(df, roles or ColumnRoles()))


def _required_checks(df: DataFrame, meta: TableMeta) -> list[tuple[str, str, Column, bool, Column]]:
    columns = [c for c in dict.fromkeys(meta.primary_key + meta.required) if c in df.columns]
    return [("required_columns", c, count_where(quoted(c).isNull()), True, F.lit("")) for c in columns]


def required_columns(df: DataFrame, meta: TableMeta) -> DataFrame | None:
    """NULLs in columns that must have a value; an error per column (V6)."""
    return _summarise(df, _required_checks(df, meta))


def unexpected_categories(df: DataFrame, column: str, allowed: tuple[str, ...] = GENDERS) -> DataFrame:
    """Distinct values of a column outside the allowed set, smallest first, as samples (V7)."""
    found = (
        df.select(quoted(column).alias("value"))
        .filter(F.col("value").isNotNull() & ~F.col("value").isin(*allowed))
        .distinct()
        .withColumn("column_name", F.lit(column))
    )
    return top_per_key(found, ["column_name"], [F.col("value")], CATEGORY_SAMPLES)


def categories(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame | None:
    """Unexpected values in gender columns; a warning per column (V7).

    Only text columns are checked: a numeric code is not a spelling error.
    """
    roles = roles or ColumnRoles()
    parts = []
    for f in df.schema.fields:
        if not (roles.has("gender", f.name) and isinstance(f.dataType, T.StringType)):
            continue
        bad = df.filter(quoted(f.name).isNotNull() & ~quoted(f.name).isin(*GENDERS))
        distinct = bad.select(quoted(f.name).alias("value")).distinct()
        samples = unexpected_categories(df, f.name).agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("samples"))
        both = distinct.agg(F.count(F.lit(1)).alias("n")).withColumn("samples", F.lit(None).cast("string")).unionByName(
            samples.withColumn("n", F.lit(0).cast("bigint"))
        )
        counted = both.agg(F.max("n").alias("n"), F.max("samples").alias("samples"))
        n = F.col("n")
        parts.append(counted.select(*_row("categorical_values", f.name, n, F.lit(0), _flag(n), F.col("samples"))))
    return union_all(parts) if parts else None


def validate(
    df: DataFrame, meta: TableMeta, tables: Mapping[str, DataFrame], roles: ColumnRoles | None = None
) -> DataFrame:
    """All checks on one table. The row-level ones share one aggregation (V1-V7)."""
    roles = roles or ColumnRoles()
    row_checks = _date_checks(df) + _coordinate_checks(df, roles) + _required_checks(df, meta)
    parts = [_summarise(df, row_checks), categories(df, roles), data_types(df, meta)]
    if meta.primary_key:
        parts.append(primary_key(df, meta))
    if meta.foreign_keys:
        parts.append(foreign_keys(df, meta, tables))
    return union_all([p for p in parts if p is not None]).withColumn("table_name", F.lit(meta.name))


def report(checks: DataFrame) -> DataFrame:
    """Errors and warnings per table (V8)."""
    return checks.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("checks"),
        F.sum("errors").cast("bigint").alias("total_errors"),
        F.sum("warnings").cast("bigint").alias("total_warnings"),
    )


# What the scan of a table gives: a row per distinct value of each column set that a check looks
# at (``fact``), and one row with the measures of its row-level checks.
_ROW_LEVEL = -1
_FACTS = "table_name string, fact int, value string, n bigint, measures array<struct<rule:int,violations:bigint,detail:string>>"


@dataclass(frozen=True)
class _Rule:
    """A row-level check: the rows that break it, and what it tells besides."""

    check: str
    column: str
    broken: Column
    is_error: bool
    detail: str | None = None


@dataclass
class _Plan:
    """The checks of one table: row-level rules, and the column sets whose values are needed, by their place."""

    meta: TableMeta
    rules: list[_Rule]
    facts: list[tuple[str, ...]]

    def fact(self, *columns: str) -> int:
        if columns not in self.facts:
            self.facts.append(columns)
        return self.facts.index(columns)


def _plan(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> _Plan:
    rules = []
    for f in df.schema.fields:
        if is_time_type(f.dataType):
            c = quoted(f.name)
            outside = (c < F.lit(FIRST_DATE).cast(f.dataType)) | (c > F.lit(LAST_DATE).cast(f.dataType))
            rules.append(_Rule("date_ranges", f.name, outside, False))
    rules += [_Rule("coordinates", c, F.abs(quoted(c)) > limit, True, f"-{limit:g}..{limit:g}") for c, limit in coordinate_limits(df, roles)]
    needed = [c for c in dict.fromkeys(meta.primary_key + meta.required) if c in df.columns]
    rules += [_Rule("required_columns", c, quoted(c).isNull(), True, "") for c in needed]
    return _Plan(meta, rules, [])


def _scan(df: DataFrame, plan: _Plan) -> DataFrame:
    """One pass over a table: distinct values of every fact with their counts, and all measures.

    A row becomes one row for its measures and one for each fact, and tasks sum them up before
    the shuffle, so a key that holds a third of the rows is one row of each task.
    """
    n = len(plan.rules)
    flags = [F.when(r.broken, 1).otherwise(0).cast("bigint").alias(f"f{i}") for i, r in enumerate(plan.rules)]
    times = [quoted(r.column).cast("timestamp").alias(f"d{i}") for i, r in enumerate(plan.rules) if r.check == "date_ranges"]
    keys = []
    for k, columns in enumerate(plan.facts):
        texts = [quoted(c).cast("string") for c in columns]
        # Several columns: NULL is told from any text, so that rows of equal keys meet.
        value = texts[0] if len(texts) == 1 else F.to_json(F.array(*texts))
        keys.append(value.alias(f"k{k}"))
    wide = df.select(*flags, *times, *keys)
    dated = [i for i, r in enumerate(plan.rules) if r.check == "date_ranges"]

    def cell(fact: int) -> Column:
        own = fact == _ROW_LEVEL
        return F.struct(
            F.lit(fact).alias("fact"), (F.lit(None).cast("string") if own else F.col(f"k{fact}")).alias("value"),
            *[(F.col(f"f{i}") if own else F.lit(None).cast("bigint")).alias(f"f{i}") for i in range(n)],
            *[(F.col(f"d{i}") if own else F.lit(None).cast("timestamp")).alias(f"d{i}") for i in dated],
        )

    long = wide.select(F.inline(F.array(cell(_ROW_LEVEL), *[cell(k) for k in range(len(plan.facts))])))
    sums = [F.coalesce(F.sum(f"f{i}"), F.lit(0)).alias(f"f{i}") for i in range(n)]
    ranges = [x for i in dated for x in (F.min(f"d{i}").alias(f"lo{i}"), F.max(f"d{i}").alias(f"hi{i}"))]
    counted = long.groupBy("fact", "value").agg(F.count(F.lit(1)).alias("n"), *sums, *ranges)

    def detail(i: int) -> Column:
        if i not in dated:
            return F.lit(plan.rules[i].detail)
        fmt = "yyyy-MM-dd HH:mm:ss"
        return F.concat_ws(" to ", F.date_format(f"lo{i}", fmt), F.date_format(f"hi{i}", fmt))

    kind = "array<struct<rule:int,violations:bigint,detail:string>>"
    told = [F.struct(F.lit(i).alias("rule"), F.col(f"f{i}").alias("violations"), detail(i).alias("detail")) for i in range(n)]
    measures = F.when(F.col("fact") == _ROW_LEVEL, F.array(*told).cast(kind)) if told else F.lit(None).cast(kind)
    return counted.select(F.lit(plan.meta.name).alias("table_name"), "fact", "value", "n", measures.alias("measures"))


def validate_all(
    tables: Mapping[str, DataFrame], declared: Mapping[str, TableMeta], roles: ColumnRoles | None = None
) -> DataFrame:
    """All checks on every table, from one scan of each (V1-V7).

    The scan counts the distinct values of keys, references and categories and measures the
    row-level checks in one aggregation. References are then settled by one grouping of
    those values, in which the values of a parent take part once however many refer to it.
    The counted values are written to the shared folder, as every check reads them.
    """
    roles = roles or ColumnRoles()
    plans = {name: _plan(df, declared.get(name, TableMeta(name)), roles) for name, df in tables.items()}
    # What is told of each check where no value breaks it: (table, check, column, is_error, note).
    asked, skipped, keyed, categorical, sides = [], [], [], [], []
    for name, plan in plans.items():
        df, meta = tables[name], plan.meta
        kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        if meta.primary_key:
            column = ",".join(meta.primary_key)
            asked.append((meta.name, "pk_uniqueness", column, True))
            keyed.append((meta.name, plan.fact(*meta.primary_key), column))
        for f in df.schema.fields:
            if roles.has("gender", f.name) and isinstance(f.dataType, T.StringType):
                asked.append((meta.name, "categorical_values", f.name, False))
                categorical.append((meta.name, plan.fact(f.name), f.name))
        for fk in meta.foreign_keys:
            if fk.column not in df.columns:
                continue
            parent = tables.get(fk.table)
            if parent is None or fk.ref_column not in parent.columns:
                skipped.append((meta.name, fk.column, f"{fk.table}.{fk.ref_column} is not available"))
                continue
            asked.append((meta.name, "fk_integrity", fk.column, True))
            parent_kind = kind_of(parent.schema[fk.ref_column].dataType)
            real = not ({kinds[fk.column], parent_kind} <= {"int"} or kinds[fk.column] == parent_kind)
            domain = f"{fk.table}.{fk.ref_column}" + (":double" if real and {kinds[fk.column], parent_kind} <= {"int", "float"} else "")
            sides.append((meta.name, plan.fact(fk.column), domain, f"{meta.name}|{fk.column}"))
            sides.append((plans[fk.table].meta.name, plans[fk.table].fact(fk.ref_column), domain, None))
    scans = [_scan(tables[name], plan) for name, plan in plans.items()]
    facts = staged(union_all(scans), "facts")
    return _told(facts, plans, asked, skipped, keyed, categorical, sides).unionByName(
        union_all([data_types(tables[name], plan.meta).withColumn("table_name", F.lit(plan.meta.name)) for name, plan in plans.items()])
    )


def _told(facts, plans, asked, skipped, keyed, categorical, sides) -> DataFrame:
    """The rows of all checks, from the counted values."""
    spark = facts.sparkSession

    def listed(rows: Sequence[tuple], ddl: str) -> DataFrame:
        # As many rows as checks are declared.
        return F.broadcast(spark.createDataFrame(list(rows), ddl))

    rules = [(p.meta.name, i, r.check, r.column, r.is_error) for p in plans.values() for i, r in enumerate(p.rules)]
    rule_rows = listed(rules, "table_name string, rule int, check string, column_name string, is_error boolean")
    rows = facts.filter(F.col("fact") == _ROW_LEVEL).select("table_name", F.inline("measures"))
    measured = rule_rows.join(rows, ["table_name", "rule"], "left")
    measured = measured.select("table_name", "check", "column_name", "is_error", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("detail", F.lit("")).alias("detail"))

    pk = facts.join(listed(keyed, "table_name string, fact int, column_name string"), ["table_name", "fact"])
    doubled = pk.groupBy("table_name", "column_name").agg(F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("violations"))
    found = doubled.select("table_name", F.lit("pk_uniqueness").alias("check"), "column_name", "violations", F.lit("").alias("detail"))

    categories_ = facts.join(listed(categorical, "table_name string, fact int, column_name string"), ["table_name", "fact"])
    odd = categories_.filter(F.col("value").isNotNull() & ~F.col("value").isin(*GENDERS)).withColumn("place", F.col("value"))
    found = found.unionByName(_sampled(odd, "categorical_values", CATEGORY_SAMPLES, ", "))

    refs = facts.join(listed(sorted(set(sides), key=str), "table_name string, fact int, domain string, child string"), ["table_name", "fact"])
    value = F.when(F.col("domain").endswith(":double"), F.col("value").try_cast("double").cast("string")).otherwise(F.col("value"))
    # Sets hold no more than the references that are declared to one column.
    met = refs.filter("value IS NOT NULL").groupBy("domain", value.alias("value")).agg(
        F.max(F.col("child").isNull()).alias("known"), F.collect_set("child").alias("children")
    )
    orphans = met.filter(~F.col("known")).select(F.explode("children").alias("child"), "value").select(
        F.substring_index("child", "|", 1).alias("table_name"), F.expr("substr(child, length(substring_index(child, '|', 1)) + 2)").alias("column_name"),
        "value", F.struct(F.col("value").try_cast("bigint").alias("i"), F.col("value").try_cast("double").alias("d"), F.col("value").alias("t")).alias("place"),
    )
    found = found.unionByName(_sampled(orphans, "fk_integrity", ORPHAN_SAMPLES, ","))

    skeleton = listed(asked, "table_name string, check string, column_name string, is_error boolean")
    checked = skeleton.join(found, ["table_name", "check", "column_name"], "left").select(
        "table_name", "check", "column_name", "is_error", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("detail", F.lit("")).alias("detail")
    )
    all_of = checked.unionByName(measured)
    flag = _flag(F.col("violations"))
    out = all_of.select(
        "check", "column_name", F.when(F.col("violations") > 0, "fail").otherwise("pass").alias("status"), F.col("violations").cast("bigint").alias("violations"),
        F.when(F.col("is_error"), flag).otherwise(0).cast("bigint").alias("errors"), F.when(F.col("is_error"), 0).otherwise(flag).cast("bigint").alias("warnings"),
        F.col("detail").cast("string").alias("detail"), "table_name",
    )
    if skipped:
        more = listed(skipped, "table_name string, column_name string, detail string").select(
            F.lit("fk_integrity").alias("check"), "column_name", F.lit("skipped").alias("status"), F.lit(0).cast("bigint").alias("violations"),
            F.lit(0).cast("bigint").alias("errors"), F.lit(1).cast("bigint").alias("warnings"), "detail", "table_name",
        )
        out = out.unionByName(more)
    return out


def _sampled(rows: DataFrame, check: str, samples: int, separator: str) -> DataFrame:
    """Rows (table_name, column_name, value, place) counted per column, with the first few values as detail."""
    keys = ["table_name", "column_name"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("violations"))
    first = top_per_key(rows, keys, [F.col("place")], samples).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda r: r["value"]), separator).alias("detail")
    )
    return counts.join(first, keys).select("table_name", F.lit(check).alias("check"), "column_name", "violations", "detail")


def run_summary(facts: DataFrame, declared: Mapping[str, TableMeta]) -> DataFrame:
    """One row on a run, from what was measured of each table (V9).

    ``facts``: table_name, rows_read, rows_loaded and error (NULL where the table was loaded); a
    table that could not be read has no rows_read. A table that fails ends the run, so
    tables after it have neither.
    """
    known = _references(declared)
    read, loaded = F.count("rows_read"), F.count("rows_loaded")
    return facts.agg(
        F.when(F.count("error") > 0, "failed").when(loaded < F.count(F.lit(1)), "incomplete").otherwise("success").alias("status"),
        F.count(F.lit(1)).alias("tables_discovered"), read.alias("tables_extracted"), loaded.alias("tables_cleaned"), loaded.alias("tables_loaded"),
        F.coalesce(F.sum("rows_read"), F.lit(0)).cast("bigint").alias("total_rows_read"),
        F.coalesce(F.sum("rows_loaded"), F.lit(0)).cast("bigint").alias("total_rows_loaded"),
        F.coalesce(F.sum(F.when(F.col("rows_loaded").isNotNull(), F.col("rows_read") - F.col("rows_loaded"))), F.lit(0)).cast("bigint").alias("total_rows_rejected"),
        F.coalesce(F.sum(F.when(F.col("rows_read").isNotNull(), F.coalesce(known[F.col("table_name")], F.lit(0)))), F.lit(0)).cast("bigint").alias("relationships_discovered"),
        F.max("error").alias("error"),
    )


def _references(declared: Mapping[str, TableMeta]) -> Column:
    """How many references each declared table has, as a map."""
    pairs = [F.lit(x) for m in declared.values() for x in (m.name, len(m.foreign_keys))]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(0))
