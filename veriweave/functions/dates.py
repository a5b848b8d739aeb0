"""Date and time column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted spellings, in order of preference. Day-first comes
# before month-first. Each pattern has the shape a value must have, so that the
# parser only runs where it can succeed.
_DATE_SPELLINGS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d-M-yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d/M/yyyy H:m:s"),
]
_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?$"


def parse_date_text(c: Column) -> Column:
    """Timestamp of a date written in any accepted spelling, else NULL."""
    tries = [F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt))) for shape, fmt in _DATE_SPELLINGS]
    return F.coalesce(*tries)


def parse_iso(c: Column) -> Column:
    """Timestamp of an ISO 8601 text, else NULL."""
    return F.when(c.rlike(_ISO_SHAPE), c.try_cast("timestamp"))


def parse_lenient(c: Column) -> Column:
    """Timestamp of a text in ISO 8601 or any accepted spelling, else NULL."""
    return F.coalesce(parse_iso(c), parse_date_text(c))


def to_timestamp_any(c: Column, data_type: T.DataType) -> Column:
    """Timestamp of a date, timestamp or text column, else NULL."""
    if isinstance(data_type, T.StringType):
        return parse_lenient(c)
    return c.cast("timestamp")


def long_date(c: Column, data_type: T.DataType) -> Column:
    """``15 January 2024``; a text that is not ISO 8601 stays as it is, NULL stays NULL."""
    fmt = "dd MMMM yyyy"
    if isinstance(data_type, T.StringType):
        return F.when(c != "", F.coalesce(F.date_format(parse_iso(c), fmt), c))
    return F.date_format(c.cast("timestamp"), fmt)


def is_time_type(data_type: T.DataType) -> bool:
    """True for timestamps and dates."""
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))
