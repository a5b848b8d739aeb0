"""Profiling (P1-P12). Reports are tidy tables with one row per finding.

Checks that look at single rows share one aggregation per table. Nothing sorts
or gathers a whole column in one task; exact quantiles are found by narrowing
histograms. Values and rows are counted by two 64-bit hashes, so no text is a
shuffle key; only texts that can be among the most frequent are looked up again.
``sketches`` has the form that needs no shuffle of values at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.functions.dates import parse_lenient
from veriweave.functions.groups import top_per_key
from veriweave.functions.numbers import round_half_up
from veriweave.functions.text import strip
from veriweave.sources.metadata import (
    ColumnRoles,
    TableMeta,
    numeric_columns,
    quoted,
    text_columns,
    union_all,
)

# Fixed value: control characters other than tab and line ends, C1 controls, and the replacement character.
BAD_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]"
HISTOGRAM_CELLS = 4096


def count_where(condition: Column) -> Column:
    """Number of rows where the condition holds, 0 for an empty table."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _measure(df: DataFrame, measures: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Evaluate all measures in one aggregation; one row (column_name, metric, value) each."""
    if not measures:
        return df.sparkSession.createDataFrame([], "column_name string, metric string, value double")
    row = df.agg(*[agg.cast("double").alias(f"m{i}") for i, (_, _, agg) in enumerate(measures)])
    cells = F.array(*[
        F.struct(F.lit(col).alias("column_name"), F.lit(metric).alias("metric"), F.col(f"m{i}").alias("value"))
        for i, (col, metric, _) in enumerate(measures)
    ])
    return row.select(F.inline(cells))


def shape(df: DataFrame) -> DataFrame:
    """Row count, and each column with its type."""
    described = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"))
                 for f in df.schema.fields]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), F.inline(F.array(*described))
    )


def missing_values(df: DataFrame) -> DataFrame:
    """NULL count and percentage of the columns that have NULLs."""
    counts = [count_where(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"m{i}").alias("missing_count"),
            round_half_up(F.col(f"m{i}") / F.col("total") * 100, 2).alias("missing_pct"),
        )
        for i, c in enumerate(df.columns)
    ])
    return row.filter("total > 0").select(F.inline(cells)).filter("missing_count > 0")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    groups = df.groupBy(*_row_hashes(df.columns)).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once, counting every one of them."""
    groups = df.groupBy(*[quoted(c) for c in keys]).count()
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).cast("bigint").alias("duplicate_count")
    )


def _whitespace_measures(df: DataFrame) -> list[tuple[str, str, Column]]:
    out = []
    for c in text_columns(df):
        out.append((c, "leading_trailing_spaces", count_where(quoted(c) != strip(quoted(c)))))
        out.append((c, "multiple_spaces", count_where(quoted(c).contains("  "))))
    return out


def whitespace(df: DataFrame) -> DataFrame:
    """Values with outer white space and values with repeated spaces, per text column (P5)."""
    return _measure(df, _whitespace_measures(df)).filter("value > 0")


def _encoding_measures(df: DataFrame) -> list[tuple[str, str, Column]]:
    return [(c, "bad_characters", count_where(quoted(c).rlike(BAD_CHARACTERS))) for c in text_columns(df)]


def encoding(df: DataFrame) -> DataFrame:
    """Values with control or replacement characters, per text column."""
    return _measure(df, _encoding_measures(df)).filter("value > 0")


def _date_measures(df: DataFrame, roles: ColumnRoles) -> list[tuple[str, str, Column]]:
    columns = roles.pick("date_hint", text_columns(df))
    return [
        (c, "invalid_dates", count_where(quoted(c).isNotNull() & parse_lenient(strip(quoted(c))).isNull()))
        for c in columns
    ]


def invalid_dates(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """Values that are not dates, per text column whose name hints at one."""
    return _measure(df, _date_measures(df, roles or ColumnRoles())).filter("value > 0")


def coordinate_limits(df: DataFrame, roles: ColumnRoles) -> list[tuple[str, float]]:
    """Number columns that hold a latitude or a longitude, with the greatest absolute value allowed."""
    out = []
    for c in numeric_columns(df):
        if roles.has("latitude", c):
            out.append((c, 90.0))
        elif roles.has("longitude", c):
            out.append((c, 180.0))
    return out


def _coordinate_measures(df: DataFrame, roles: ColumnRoles) -> list[tuple[str, str, Column]]:
    return [
        (c, "out_of_range", count_where(F.abs(quoted(c)) > limit)) for c, limit in coordinate_limits(df, roles)
    ]


def coordinates(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """Latitudes beyond 90 and longitudes beyond 180 degrees."""
    return _measure(df, _coordinate_measures(df, roles or ColumnRoles())).filter("value > 0")


def long_numbers(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    """Non-missing numbers as rows (column_name, value); NaN counts as missing."""
    cells = F.array(*[
        F.struct(F.lit(table + c).alias("column_name"), quoted(c).cast("double").alias("value")) for c in columns
    ])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _local(state: DataFrame) -> DataFrame:
    """A frame of a few rows per column, fetched, so that the next pass does not repeat the passes before it."""
    return state.sparkSession.createDataFrame(state.collect(), state.schema)


LAST_CELL = 100_000
_STATE = "column_name string, k bigint, lo double, hi double, below bigint, held bigint"


def order_statistics(values: DataFrame, targets: DataFrame, last_cell: int = LAST_CELL) -> DataFrame:
    """Exact k-th smallest value (k from 0) per column.

    ``values`` has (column_name, value); ``targets`` has (column_name, k, lo, hi), the
    range of the column, and a few rows per column. A histogram of the range that must
    hold the k-th value picks the cell it lies in, again and again until every such
    cell has few values, whose distinct ones are counted. Each pass is one scan, and
    the state between passes is a few rows.
    """
    state = targets.withColumn("below", F.lit(0).cast("bigint"))
    rows = None
    while rows is None or any(r["held"] > last_cell and r["lo"] < r["hi"] for r in rows):
        width = F.col("hi") - F.col("lo")
        place = F.floor((F.col("value") - F.col("lo")) / width * HISTOGRAM_CELLS)
        cell = F.when(width > 0, F.least(place, F.lit(HISTOGRAM_CELLS - 1))).otherwise(F.lit(0))
        rows = _pick(values, state.select("column_name", "k", "lo", "hi", "below"), cell).collect()
        state = values.sparkSession.createDataFrame(rows, _STATE)
    if all(r["lo"] == r["hi"] for r in rows):
        return state.select("column_name", "k", F.col("lo").alias("value"))
    return _pick(values, state, F.col("value")).select("column_name", "k", F.col("lo").alias("value"))


def _pick(values: DataFrame, state: DataFrame, cell: Column) -> DataFrame:
    """For each target the cell of its range that holds the k-th value, as the new range."""
    ranges = F.broadcast(state.select("column_name", "lo", "hi").distinct())
    cells = (
        values.join(ranges, "column_name")
        .filter(F.col("value").between(F.col("lo"), F.col("hi")))
        .withColumn("cell", cell)
        .groupBy("column_name", "lo", "hi", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
    )
    upto = Window.partitionBy("column_name", "lo", "hi").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("n").over(upto))
    rank = F.col("k") - F.col("below")
    return (
        cells.join(F.broadcast(state), ["column_name", "lo", "hi"])
        .filter((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")))
        .select(
            "column_name", "k",
            F.col("first").alias("lo"), F.col("last").alias("hi"),
            (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("held"),
        )
    )


def quantiles(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (column_name, n, p, quantile)."""
    sizes = values.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    wanted = (
        _local(sizes).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("position", F.col("p") * (F.col("n") - 1))
        .withColumn("k_low", F.floor("position"))
        .withColumn("k_high", F.ceil("position"))
    )
    targets = wanted.select("column_name", "lo", "hi", F.explode(F.array("k_low", "k_high")).alias("k")).distinct()
    found = _local(order_statistics(values, targets))
    low = found.select("column_name", F.col("k").alias("k_low"), F.col("value").alias("v_low"))
    high = found.select("column_name", F.col("k").alias("k_high"), F.col("value").alias("v_high"))
    share = F.col("position") - F.col("k_low")
    return (
        wanted.join(F.broadcast(low), ["column_name", "k_low"])
        .join(F.broadcast(high), ["column_name", "k_high"])
        .select(
            "column_name", "n", "p",
            (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * share).alias("quantile"),
        )
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values beyond 1.5 interquartile ranges of the quartiles, per number column.

    Columns with fewer than 10 values or no spread are skipped.
    """
    return _outliers(long_numbers(df, columns or numeric_columns(df)))


def _outliers(values: DataFrame) -> DataFrame:
    quartiles = quantiles(values, (0.25, 0.75))
    fences = (
        quartiles.groupBy("column_name", "n")
        .agg(F.min_by("quantile", "p").alias("q1"), F.max_by("quantile", "p").alias("q3"))
        .filter((F.col("n") >= 10) & (F.col("q3") != F.col("q1")))
        .select(
            "column_name",
            (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
            (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"),
        )
    )
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    # One row of fences per column.
    return (
        values.join(F.broadcast(fences), "column_name")
        .groupBy("column_name", "lower_bound", "upper_bound")
        .agg(count_where(outside).alias("outlier_count"))
        .filter("outlier_count > 0")
    )


def _hashes(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes: values with equal pairs are taken as equal."""
    return [F.xxhash64(*values).alias("k1"), F.xxhash64(F.lit(1), *values).alias("k2")]


def _row_hashes(columns: Sequence[str]) -> list[Column]:
    """Hashes of several columns. Hashes pass over NULLs, so where they are is hashed too."""
    return _hashes(*[quoted(c) for c in columns], *[quoted(c).isNull() for c in columns])


# Characters of a text that are kept with its count, to settle most ties without the text.
HEAD = 64


def _long_texts(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    """Texts longer than their head, by column: (column_name, value)."""
    cells = [F.when(F.length(quoted(c)) > HEAD, F.struct(F.lit(table + c).alias("column_name"), quoted(c).alias("value"))) for c in columns]
    return df.select(F.inline(F.array_compact(F.array(*cells))))


def _value_keys(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    """Non-missing values by column, as hashes and the beginning of their text."""
    texts = set(text_columns(df))
    spelled = df.select(*[quoted(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)])
    cells = [
        F.struct(
            F.lit(table + c).alias("column_name"), *_hashes(F.col(f"v{i}")),
            (F.substring(f"v{i}", 1, HEAD) if c in texts else F.lit(None).cast("string")).alias("head"),
            (F.length(f"v{i}") <= HEAD).alias("whole"),
        )
        for i, c in enumerate(columns)
    ]
    # The length of a missing value is NULL, its hash is not.
    return spelled.select(F.inline(F.array(*cells))).filter(F.col("whole").isNotNull())


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("column_name", "k1", "k2").agg(F.min("head").alias("head"), F.min("whole").alias("whole"), F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value occurs, per column: (column_name, k1, k2, head, whole, n).

    Values are equal where both hashes of their text are. ``head`` begins the text of text
    columns; ``whole`` tells whether that is all of it.
    """
    return _counted(_value_keys(df, columns))


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs and distinct values of every column; range, mean and deviation of numbers (P10)."""
    names = list(columns or df.columns)
    return _measure(df, _column_measures(df, names)).unionByName(_unique_counts(value_counts(df, names)))


def _column_measures(df: DataFrame, names: Sequence[str]) -> list[tuple[str, str, Column]]:
    numbers = set(numeric_columns(df))
    measures = []
    for c in names:
        measures.append((c, "null_count", count_where(quoted(c).isNull())))
        if c in numbers:
            v = quoted(c).cast("double")
            measures += [
                (c, "min", F.min(v)),
                (c, "max", F.max(v)),
                (c, "mean", F.avg(v)),
                (c, "std", F.stddev_samp(v)),
            ]
    return measures


def _unique_counts(counts: DataFrame) -> DataFrame:
    distinct = counts.groupBy("column_name").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return distinct.select("column_name", F.lit("unique_count").alias("metric"), "value")


def _text_measures(df: DataFrame, names: Sequence[str]) -> list[tuple[str, str, Column]]:
    return [(c, "avg_length", F.avg(F.length(quoted(c)))) for c in names]


def text_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Average length of text columns."""
    return _measure(df, _text_measures(df, list(columns or text_columns(df))))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The most frequent values of text columns; equal counts go by value."""
    names = list(columns or text_columns(df))
    return _top(_long_texts(df, names), value_counts(df, names), n)


def _top(long_texts: DataFrame, counts: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent values of text columns.

    Counts and heads leave the few that can be among them (more only where long texts begin
    alike). Those that are longer than their head are read again.
    """
    place = F.rank().over(Window.partitionBy("column_name").orderBy(F.col("n").desc(), "head"))
    able = counts.withColumn("place", place).filter(F.col("place") <= n)
    short = able.filter("whole").select("column_name", F.col("head").alias("value"), "n")
    keyed = long_texts.select("column_name", "value", *_hashes(F.col("value")))
    read = keyed.join(able.filter("NOT whole").select("column_name", "k1", "k2", "n"), ["column_name", "k1", "k2"])
    whole = read.groupBy("column_name", "k1", "k2", "n").agg(F.min("value").alias("value")).select("column_name", "value", "n")
    return top_per_key(short.unionByName(whole), ["column_name"], [F.col("n").desc(), F.col("value")], n)


def profile(df: DataFrame, meta: TableMeta, roles: ColumnRoles | None = None) -> DataFrame:
    """All findings on one table as (table_name, column_name, check, metric, value)."""
    return profile_all({meta.name: df}, {meta.name: meta}, roles)


def _scan(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Everything that looks at single rows, in one aggregation: (column_name, check, metric, value)."""
    issues = [("", "rows", F.count(F.lit(1)))]
    issues += [(c, "missing", count_where(quoted(c).isNull())) for c in df.columns]
    issues += _whitespace_measures(df) + _encoding_measures(df)
    issues += _date_measures(df, roles) + _coordinate_measures(df, roles)
    statistics = _column_measures(df, df.columns) + _text_measures(df, text_columns(df))
    is_statistic = F.col("metric").isin(sorted({metric for _, metric, _ in statistics}))
    found = _measure(df, issues + statistics).filter(is_statistic | (F.col("value") > 0) | (F.col("metric") == "rows"))
    return found.withColumn("check", F.when(is_statistic, "statistics").otherwise("scan"))


# Between the names of a table and of its column, while columns of all tables are counted together.
_OF = "\x1f"


def profile_all(tables: Mapping[str, DataFrame], declared: Mapping[str, TableMeta], roles: ColumnRoles | None = None) -> DataFrame:
    """Findings on every table.

    Values, rows, keys and numbers of all tables are counted together: one shuffle each,
    however many tables there are, and one search for all quantiles.
    """
    roles = roles or ColumnRoles()
    metas = {name: declared.get(name, TableMeta(name)) for name in tables}

    def named(rows: DataFrame, check: str) -> DataFrame:
        """Columns told by table and column."""
        at = F.split("column_name", _OF)
        return rows.select(at[0].alias("table_name"), at[1].alias("column_name"), F.lit(check).alias("check"), "metric", F.col("value").cast("double").alias("value"))

    parts = [
        union_all([_scan(df, roles).select(F.lit(metas[n].name).alias("table_name"), "column_name", "check", "metric", "value") for n, df in tables.items()])
    ]
    texts = {n: text_columns(df) for n, df in tables.items() if text_columns(df)}
    others = {n: [c for c in df.columns if c not in texts.get(n, ())] for n, df in tables.items()}
    for columns in (texts, {n: c for n, c in others.items() if c}):
        if columns:
            counts = _counted(union_all([_value_keys(tables[n], c, metas[n].name + _OF) for n, c in columns.items()]))
            parts.append(named(_unique_counts(counts), "statistics"))
    if texts:
        counts = _counted(union_all([_value_keys(tables[n], c, metas[n].name + _OF) for n, c in texts.items()]))
        top = _top(union_all([_long_texts(tables[n], c, metas[n].name + _OF) for n, c in texts.items()]), counts)
        parts.append(named(top.select("column_name", F.concat(F.lit("top: "), F.col("value")).alias("metric"), F.col("n").alias("value")), "statistics"))
    parts.append(named(_doubles(tables, metas), "duplicates"))
    numbers = {n: numeric_columns(df) for n, df in tables.items() if numeric_columns(df)}
    if numbers:
        outliers = _outliers(union_all([long_numbers(tables[n], columns, metas[n].name + _OF) for n, columns in numbers.items()]))
        parts.append(named(outliers.select("column_name", F.lit("outliers").alias("metric"), F.col("outlier_count").alias("value")), "outliers"))
    return union_all(parts).select("table_name", "column_name", "check", "metric", "value")


def _doubles(tables: Mapping[str, DataFrame], metas: Mapping[str, TableMeta]) -> DataFrame:
    """Duplicate rows and rows of duplicate keys of every table (P3, P4): (column_name, metric, value)."""
    hashed, asked = [], []
    for n, df in tables.items():
        sets = [("duplicate_rows", df.columns)] + ([("duplicate_count", metas[n].primary_key)] if metas[n].primary_key else [])
        for metric, columns in sets:
            asked.append((metas[n].name + _OF, metric))
            hashed.append(df.select(F.lit(metas[n].name + _OF).alias("column_name"), F.lit(metric).alias("metric"), *_row_hashes(columns)))
    groups = union_all(hashed).groupBy("column_name", "metric", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    # Rows beyond the first of their set; all rows of a key that several have.
    more = F.when(F.col("metric") == "duplicate_rows", F.col("n") - 1).when(F.col("n") > 1, F.col("n")).otherwise(0)
    found = groups.groupBy("column_name", "metric").agg(F.sum(more).alias("value"))
    every = F.broadcast(found.sparkSession.createDataFrame(asked, "column_name string, metric string"))
    return found.join(every, ["column_name", "metric"], "right").select("column_name", "metric", F.coalesce("value", F.lit(0)).alias("value"))
