"""Derived columns (T1-T8). Row-local: none of these shuffles.

Each function leaves a table alone that lacks the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.dates import is_time_type, to_timestamp_any
from veriweave.functions.numbers import round_half_up
from veriweave.functions.text import blank_to_null
from veriweave.sources.metadata import ColumnRoles, TableMeta, quoted, text_columns

# Name parts that mark the start and the end of an incident, in order of preference.
DURATION_NAMES = (
    ("start", "end"),
    ("from", "to"),
    ("begin", "finish"),
    ("reported", "resolved"),
    ("occurrence", "closure"),
)

Enricher = Callable[[DataFrame, TableMeta, ColumnRoles], DataFrame]


def weekend(c: Column) -> Column:
    """True on Saturday and Sunday; a missing date is not a weekend."""
    return F.coalesce(F.weekday(c) >= 5, F.lit(False))


def night(c: Column) -> Column:
    """True from 22:00 to 05:59; a missing time is not night (T4)."""
    hour = F.hour(c)
    return F.coalesce((hour < 6) | (hour >= 22), F.lit(False))


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, two decimals (T5)."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return round_half_up(micros / F.lit(3.6e9), 2)


def joined_address(columns: Sequence[Column]) -> Column:
    """Non-blank parts joined by a comma; NULL when there are none."""
    return F.nullif(F.concat_ws(", ", *[blank_to_null(c.cast("string")) for c in columns]), F.lit(""))


def labelled_text(columns: Sequence[tuple[str, Column]]) -> Column:
    """``name: value`` of the non-blank columns joined by a bar; NULL when there are none."""
    parts = [F.concat(F.lit(f"{name}: "), blank_to_null(c)) for name, c in columns]
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


def _time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_time_type(f.dataType)]


def add_date_parts(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """Year, month, ISO week and weekday name of the first date column."""
    found = [f for f in df.schema.fields if is_time_type(f.dataType) or roles.has("date", f.name)]
    if not found:
        return df
    when = to_timestamp_any(quoted(found[0].name), found[0].dataType)
    return df.withColumns({
        "crime_year": F.year(when).cast("bigint"),
        "crime_month": F.month(when).cast("bigint"),
        "crime_week": F.weekofyear(when).cast("bigint"),
        "crime_weekday": F.date_format(when, "EEEE"),
    })


def add_hour(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """Hour of the first timestamp column."""
    times = _time_columns(df)
    return df.withColumn("crime_hour", F.hour(quoted(times[0])).cast("bigint")) if times else df


def add_weekend(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """Weekend flag of the first timestamp column."""
    times = _time_columns(df)
    return df.withColumn("is_weekend", weekend(quoted(times[0]))) if times else df


def add_night(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """Night flag of the first timestamp column (T4)."""
    times = _time_columns(df)
    return df.withColumn("is_night_crime", night(quoted(times[0]))) if times else df


def add_duration(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """Hours between the first pair of start and end columns (T5)."""
    times = _time_columns(df)
    for start_part, end_part in DURATION_NAMES:
        start = next((c for c in times if start_part in c.lower()), None)
        end = next((c for c in times if end_part in c.lower()), None)
        if start and end and start != end:
            return df.withColumn("incident_duration_hours", hours_between(quoted(start), quoted(end)))
    return df


def add_address(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """All address-named columns in one."""
    names = roles.pick("address", df.columns)
    return df.withColumn("canonical_address", joined_address([quoted(c) for c in names])) if names else df


def add_search_text(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """All text columns in one, each with its name."""
    names = text_columns(df)
    return df.withColumn("search_text", labelled_text([(c, quoted(c)) for c in names])) if names else df


DEFAULT_ENRICHERS: tuple[Enricher, ...] = (
    add_date_parts,
    add_hour,
    add_weekend,
    add_night,
    add_duration,
    add_address,
    add_search_text,
)


def enrich(
    df: DataFrame,
    meta: TableMeta,
    roles: ColumnRoles | None = None,
    enrichers: Sequence[Enricher] = DEFAULT_ENRICHERS,
) -> DataFrame:
    """Apply enrichers in order (T8). Pass ``DEFAULT_ENRICHERS + (mine,)`` to add one."""
    for enricher in enrichers:
        df = df.transform(enricher, meta, roles or ColumnRoles())
    return df
