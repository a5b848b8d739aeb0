"""Cleaning (C1-C11).

C1-C8 are column expressions, so a whole chain is one projection. C9 is the
only shuffle. C10 comes after C9 because duplicates are judged on the text form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.dates import parse_date_text, parse_iso, parse_lenient
from veriweave.functions.groups import spread_if_small
from veriweave.functions.text import collapse, strip
from veriweave.sources.metadata import ColumnRoles, TableMeta, numeric_columns, quoted, text_columns

# Texts that mean "no value", and the words for each gender.
NULL_TOKENS = (
    "", "null", "none", "n/a", "na", "nan", "nil", "undefined",
    "not available", "not applicable", "-", "--", ".",
)
MALE_WORDS = ("m", "male", "man", "boy", "gents", "masculine")
FEMALE_WORDS = ("f", "female", "woman", "girl", "ladies", "feminine")
OTHER_WORDS = ("o", "other", "transgender", "trans", "non-binary")

Cleaner = Callable[[DataFrame, TableMeta, ColumnRoles], DataFrame]


def null_token(c: Column) -> Column:
    """NULL for a text that means "no value", else the text unchanged."""
    return F.when(~F.lower(strip(c)).isin(*NULL_TOKENS), c)


def gender_word(c: Column) -> Column:
    """Male, Female or Other for a known word, else the text unchanged (C4)."""
    word = F.lower(strip(c))
    return (
        F.when(word.isin(*MALE_WORDS), "Male")
        .when(word.isin(*FEMALE_WORDS), "Female")
        .when(word.isin(*OTHER_WORDS), "Other")
        .otherwise(c)
    )


def phone_number(c: Column) -> Column:
    """The ten digits of a phone number, else the text unchanged."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    # A leading 91 is the country code of a 12-digit number, a leading 0 the trunk prefix of an 11-digit one.
    local = F.regexp_extract(digits, r"^(?:91|0)?([0-9]{10})$", 1)
    return F.coalesce(F.nullif(local, F.lit("")), c)


def reference_code(c: Column) -> Column:
    """Upper case with single spaces."""
    return collapse(F.upper(strip(c)))


def iso_date_text(c: Column) -> Column:
    """ISO 8601 text of a date in any accepted spelling, else the text unchanged."""
    value = strip(c)
    parsed = F.coalesce(parse_date_text(value), parse_iso(value))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), c)


def date_value(c: Column) -> Column:
    """Timestamp of a date text, NULL when it is not a date."""
    return parse_lenient(strip(c)).cast("timestamp_ntz")


def _map_columns(df: DataFrame, columns: Sequence[str], rule: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: rule(quoted(c)) for c in columns}) if columns else df


def normalise_nulls(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C1 on every text column, evidence included."""
    return _map_columns(df, text_columns(df), null_token)


def trim_spaces(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C2 on every text column but evidence."""
    return _map_columns(df, [c for c in text_columns(df) if not roles.has("evidence", c)], strip)


def collapse_spaces(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C3 on every text column but evidence."""
    return _map_columns(df, [c for c in text_columns(df) if not roles.has("evidence", c)], collapse)


def normalise_gender(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C4 on text columns named for gender."""
    return _map_columns(df, roles.pick("gender", text_columns(df)), gender_word)


def normalise_phones(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C5 on text columns named for a phone."""
    return _map_columns(df, roles.pick("phone", text_columns(df)), phone_number)


def normalise_codes(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C6 on text columns named for a case or crime number."""
    return _map_columns(df, roles.pick("crime_number", text_columns(df)), reference_code)


def normalise_dates(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C7 on text columns named for a date."""
    return _map_columns(df, roles.pick("date", text_columns(df)), iso_date_text)


def convert_dates(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """C8 on text columns named for a date."""
    return _map_columns(df, roles.pick("date", text_columns(df)), date_value)


def drop_duplicate_rows(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """Drop rows equal in every column (C9). Equal rows are alike, so which one stays does not matter."""
    return df.dropDuplicates()


def convert_numbers(df: DataFrame, meta: TableMeta, roles: ColumnRoles) -> DataFrame:
    """Text to number in columns declared as numbers; what is not a number becomes NULL."""
    already = set(numeric_columns(df))
    pending = [c for c in meta.numeric_columns if c in df.columns and c not in already]
    return _map_columns(df, pending, lambda c: strip(c.cast("string")).try_cast("double"))


DEFAULT_CLEANERS: tuple[Cleaner, ...] = (
    normalise_nulls,
    trim_spaces,
    collapse_spaces,
    normalise_gender,
    normalise_phones,
    normalise_codes,
    normalise_dates,
    convert_dates,
    drop_duplicate_rows,
    convert_numbers,
)


def clean(
    df: DataFrame, meta: TableMeta, roles: ColumnRoles | None = None, cleaners: Sequence[Cleaner] = DEFAULT_CLEANERS
) -> DataFrame:
    """Apply cleaners in order (C11). Pass ``DEFAULT_CLEANERS + (mine,)`` to add one."""
    df = spread_if_small(df)
    for cleaner in cleaners:
        df = df.transform(cleaner, meta, roles or ColumnRoles())
    return df
