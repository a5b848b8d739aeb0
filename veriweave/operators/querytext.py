"""Query texts: normal form, expansion, entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.text import collapse, strip

# Abbreviations, districts, kinds of crime and document words, in order of preference.
ABBREVIATIONS = {
    "fir": "first information report",
    "ipc": "indian penal code",
    "crpc": "code of criminal procedure",
    "ps": "police station",
    "io": "investigating officer",
    "sho": "station house officer",
    "kgid": "karnataka government id",
}
DISTRICTS = (
    "bagalkot", "ballari", "belagavi", "bengaluru", "bengaluru rural", "bidar", "chamarajanagar", "chikkaballapur",
    "chikkamagaluru", "chitradurga", "dakshina kannada", "davanagere", "dharwad", "gadag", "hassan", "haveri",
    "kalaburagi", "kodagu", "kolar", "koppal", "mandya", "mysuru", "raichur", "ramanagara", "shivamogga",
    "tumakuru", "udupi", "uttara kannada", "vijayanagara", "vijayapura", "yadgir",
)
CRIME_TYPES = (
    "theft", "murder", "robbery", "dacoity", "assault", "rape", "kidnapping", "fraud", "cyber", "cheating", "riot",
    "arson", "burglary", "extortion", "dowry", "homicide", "corruption", "smuggling", "trafficking", "narcotics",
    "drugs",
)
DOCUMENT_WORDS = {
    "case": "case_summary",
    "accused": "accused_profile",
    "victim": "victim_profile",
    "officer": "officer_profile",
    "district": "district_summary",
    "court": "court_summary",
}
# Patterns for case numbers (whole match, then group 1), sections and names, and words that are no name.
CASE_PATTERNS = (r"\bcr/\d+/\d{4}\b", r"\bcrime no\.?\s*\d+\b", r"\bfir\s+no\.?\s*\d+\b")
CASE_IN_CONTEXT = r"\bcase\s+(\d+/\d{4})\b"
SECTION_PATTERN = r"\b(?:ipc|section|sec\.?)\s+(\d{3}[A-Za-z]?)\b"
NAME_PATTERNS = (
    r"\b(?:officer|inspector|constable|si|pi)\s+([a-z]+(?:\s+[a-z]+)?)\b",
    r"\b(?:accused|culprit|criminal)\s+([a-z]+(?:\s+[a-z]+)?)\b",
    r"\b(?:victim|complainant)\s+([a-z]+(?:\s+[a-z]+)?)\b",
)
NOT_NAMES = ("in", "at", "the", "a", "an", "is", "was", "for", "of")
YEAR_PATTERN = r"\b(199[0-9]|20[0-2][0-9]|2030)\b"


def compatibility_form(c: Column) -> Column:
    """Unicode NFKC, for which Spark has no function (R1). Plain ASCII text stays in the JVM."""
    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return nfkc(c)


def normalise(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the stripped, NFKC, single-spaced, lower-case text; NULL gives the empty text."""
    folded = F.lower(collapse(compatibility_form(strip(F.col(text)))))
    return df.withColumn(out, F.coalesce(strip(folded), F.lit("")))


def expand(df: DataFrame, column: str) -> DataFrame:
    """Write out the abbreviations in a text column, one after the other (R2)."""
    for short, long in ABBREVIATIONS.items():
        # One projection per step, so that each step reads the text once.
        df = df.withColumn(column, F.regexp_replace(F.col(column), rf"(?U)\b{short}\b", long))
    return df


def process(df: DataFrame, text: str, out: str = "processed") -> DataFrame:
    """Add the normalised and expanded query text."""
    return expand(normalise(df, text, out), out)


def _first_of(c: Column, words: tuple[str, ...]) -> Column:
    """The first word of the list that occurs as a whole word."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)) & c.rlike(rf"(?U)\b{w}\b"), F.lit(w)) for w in words])


def district_of(c: Column) -> Column:
    """First known district in the text, as a name; the old spelling of Bengaluru counts."""
    known = F.initcap(_first_of(c, DISTRICTS))
    return F.coalesce(known, F.when(c.rlike(r"(?U)\bbangalore\b"), F.lit("Bengaluru")))


def crime_type_of(c: Column) -> Column:
    """First known kind of crime in the text."""
    return _first_of(c, CRIME_TYPES)


def year_of(c: Column) -> Column:
    """First year from 1990 to 2030 in the text."""
    return F.regexp_extract(c, YEAR_PATTERN, 1).try_cast("bigint")


def case_numbers_of(c: Column) -> Column:
    """Distinct case numbers in the text."""
    whole = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in CASE_PATTERNS]
    return F.array_distinct(F.concat(*whole, F.regexp_extract_all(c, F.lit(CASE_IN_CONTEXT), F.lit(1))))


def sections_of(c: Column) -> Column:
    """Distinct section numbers in the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(SECTION_PATTERN), F.lit(1)))


def names_of(c: Column) -> Column:
    """Distinct names that follow a title."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in NAME_PATTERNS])
    return F.array_distinct(F.transform(F.filter(found, lambda n: ~n.isin(*NOT_NAMES)), F.initcap))


def document_type_of(c: Column) -> Column:
    """Kind of document the text asks for."""
    return F.coalesce(*[
        F.when(F.contains(c, F.lit(w)) & c.rlike(rf"(?U)\b{w}(?:s)?\b"), F.lit(kind))
        for w, kind in DOCUMENT_WORDS.items()
    ])


def extract_entities(df: DataFrame, text: str = "processed") -> DataFrame:
    """Add all entities of a text, and their tags ``kind:value``."""
    c = F.lower(F.col(text))
    found = df.withColumns({
        "district": district_of(c),
        "crime_type": crime_type_of(c),
        "year": year_of(c),
        "case_numbers": case_numbers_of(c),
        "ipc_sections": sections_of(c),
        "names": names_of(c),
        "document_type": document_type_of(c),
    })
    single = [
        F.concat(F.lit(f"{tag}:"), F.col(column).cast("string"))
        for tag, column in (
            ("district", "district"), ("crime_type", "crime_type"), ("year", "year"), ("document_type", "document_type"),
        )
    ]
    many = [
        F.transform(column, lambda v, tag=tag: F.concat(F.lit(f"{tag}:"), v))
        for tag, column in (("case", "case_numbers"), ("ipc", "ipc_sections"), ("name", "names"))
    ]
    return found.withColumn("entities", F.array_compact(F.concat(F.array(*single), *many)))


def auto_filters(df: DataFrame, caller_gave: Column | None = None) -> DataFrame:
    """Add the filter columns of a query from its entities, unless the caller gave filters."""
    gave = F.coalesce(caller_gave, F.lit(False)) if caller_gave is not None else F.lit(False)
    return df.withColumns({
        "filter_district": F.when(~gave, F.col("district")),
        "filter_crime_year": F.when(~gave, F.col("year")),
        "filter_document_type": F.when(~gave, F.col("document_type")),
    })
