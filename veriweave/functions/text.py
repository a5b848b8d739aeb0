"""Column expressions for text. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Unicode white space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = f"[{WHITE_SPACE}]+"


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse(c: Column) -> Column:
    """Turn each run of white space into one space."""
    return F.regexp_replace(c, _SPACE_RUN, " ")


def blank_to_null(c: Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def presentable(c: Column, default: str | None = None) -> Column:
    """Text fit for a sentence: NULL, blank, ``none`` and ``n/a`` give the default."""
    raw = c.cast("string")
    text = F.when(~F.lower(raw).isin("none", "n/a"), F.nullif(strip(raw), F.lit("")))
    return text if default is None else F.coalesce(text, F.lit(default))


def plural(count: Column, one: str, many: str) -> Column:
    """Choose the word form for a count."""
    return F.when(count == 1, F.lit(one)).otherwise(F.lit(many))


def sentence(*parts: Column) -> Column:
    """Join the parts that are not NULL with spaces and close with a period, unless there is one."""
    return F.regexp_replace(F.concat_ws(" ", *parts), r"([^.])\z", "$1.")


def join_sections(sections: Sequence[Column]) -> Column:
    """Join the sections that are present with an empty line between them."""
    return F.concat_ws("\n\n", *sections)


def count_present(columns: Sequence[Column]) -> Column:
    """How many of the columns are not NULL."""
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total


def heading(c: Column) -> Column:
    """``case_summary`` -> ``Case Summary``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def or_default(c: Column, default: str) -> Column:
    """Value as text; NULL and the empty string give the default."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))
