"""Questions in words: intent, identifiers, conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.groups import last_known_before, top_per_key
from veriweave.functions.text import collapse, strip

# Patterns and word lists that decide what a question asks for.
_ID_WORD = r"(?:number|num|no\.?|id|#)?"
_LEAD_IN = (
    r"(?:(?:show|find|get|lookup|search|display|fetch)\s+(?:me\s+)?(?:the\s+|all\s+)?"
    r"|who\s+is\s+(?:the\s+)?|tell\s+me\s+about\s+(?:the\s+)?|details\s+(?:of|for)\s+(?:the\s+)?"
    r"|info(?:rmation)?\s+(?:on|about)\s+(?:the\s+)?)?"
)
CASE_REFERENCE = (
    r"(?i)\b(case\s*master\s*id|case|fir|cr|crime)\s*(" + _ID_WORD + r")\s*[:#]?\s*"
    r"(\d+(?:/[A-Za-z0-9]+)*|[A-Za-z]{1,4}/[A-Za-z0-9/\-]*\d+)\b"
)
OFFICER_REFERENCE = (
    r"(?i)^" + _LEAD_IN + r"(?:investigating\s+officer|officer|employee|police\s*person|io)\s*"
    r"(?:employee\s*|police\s*person\s*)?" + _ID_WORD + r"\s*[:#]?\s*(\d+)\s*\??$"
)
VICTIM_REFERENCE = r"(?i)^" + _LEAD_IN + r"victim\s*(?:master\s*)?" + _ID_WORD + r"\s*[:#]?\s*(\d+)\s*\??$"
ACCUSED_REFERENCE = (
    r"(?i)^" + _LEAD_IN + r"(?:accused|suspect)\s*(?:master\s*)?" + _ID_WORD + r"\s*[:#]?\s*(\d+)\s*\??$"
)
ACCUSED_NAME = (
    r"(?i)^" + _LEAD_IN + r"(?:accused|suspect)s?\s+"
    r"(?:named?\s+|called\s+|records?\s+(?:for|of)\s+|with\s+(?:the\s+)?name\s+)?"
    r"([A-Za-z][A-Za-z.'\-]*(?:\s+[A-Za-z][A-Za-z.'\-]*){0,3})\s*\??$"
)
BARE_NAME = r"^([A-Z][a-z.'\-]+(?:\s+[A-Z][a-z.'\-]+){1,3})\s*\??$"
NAME_STOP_WORDS = (
    "in", "of", "for", "with", "from", "at", "by", "and", "or", "to", "on", "the", "a", "an",
    "case", "cases", "who", "was", "were", "is", "are", "list", "all", "persons", "person",
    "people", "records", "record", "details", "involved", "arrested", "network", "related",
)
REASONING_WORDS = (
    "summarize", "summary", "explain", "compare", "report", "briefing",
    "generate", "analysis", "synthesize", "difference", "similarities",
)
GRAPH_WORDS = (
    "related", "connected", "linked", "network", "co-accused", "coaccused", "gang", "together", "arrested by",
    "who arrested", "investigated by", "who investigated", "appear together", "repeat offender", "collaboration",
    "timeline", "chronolog",
)
SPOKEN_REFERENCES = ("that case", "this case", "the case")
# What is asked about a case, first match wins.
CASE_TOPICS = (
    ("case_network", ("network", "connections", "criminal network")),
    ("co_accused", ("co-accused", "co accused", "associates", "accomplices")),
    ("case_timeline", ("timeline", "chronology", "sequence")),
    ("summarize_case", ("summarize", "summary", "brief")),
    ("officer_for_case", ("officer", "investigat")),
    ("victim_for_case", ("victim",)),
    ("accused_for_case", ("accused", "suspect")),
    ("chargesheet_for_case", ("chargesheet", "charge sheet")),
    ("status_for_case", ("status",)),
)
ALWAYS_REASONED = ("case_network", "co_accused", "case_timeline", "summarize_case")
HISTORY_CASE = r"(?i)\b(?:case\s*(?:number|no\.?)?|caseno)\s*[:#\-*\s]*(\d+)\b"
SEMANTIC_TOP_K = 10


def _any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def _group(c: Column, pattern: str, index: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def case_reference(df: DataFrame, text: str) -> DataFrame:
    """Add ``ref_kind`` and ``ref_value`` of the first case reference in the text.

    A case id, a case number and a crime number are three different things.
    """
    staged = df.withColumns({
        "_kind": F.regexp_replace(F.lower(F.regexp_extract(text, CASE_REFERENCE, 1)), r"\s+", ""),
        "_word": F.lower(F.regexp_extract(text, CASE_REFERENCE, 2)),
        "ref_value": _group(F.col(text), CASE_REFERENCE, 3),
    })
    kind = (
        F.when(F.col("ref_value").isNull(), F.lit(None))
        .when((F.col("_kind") == "casemasterid") | ((F.col("_kind") == "case") & (F.col("_word") == "id")), "case_id")
        .when(F.col("_kind") == "case", "case_number")
        .otherwise("crime_number")
    )
    # A number keeps its value, not its spelling.
    number = F.when(F.col("ref_value").rlike(r"^\d+$"), F.regexp_replace("ref_value", r"^0+(?=\d)", ""))
    return staged.withColumns({"ref_kind": kind, "ref_value": F.coalesce(number, F.col("ref_value"))}).drop("_kind", "_word")


def detect_intent(questions: DataFrame, text: str = "text") -> DataFrame:
    """Add intent, sub-intent, identifier and confidence of each question."""
    rows = questions.withColumn("_raw", strip(F.col(text)))
    rows = case_reference(rows, "_raw").withColumn("_low", F.lower("_raw"))
    low, raw = F.col("_low"), F.col("_raw")
    named = _group(raw, ACCUSED_NAME)
    rows = rows.withColumns({
        "_reason": _any(low, REASONING_WORDS),
        "_graph": _any(low, GRAPH_WORDS),
        "_case": F.col("ref_kind").isNotNull() | _any(low, SPOKEN_REFERENCES),
        "_officer": _group(raw, OFFICER_REFERENCE),
        "_victim": _group(raw, VICTIM_REFERENCE),
        "_accused": _group(raw, ACCUSED_REFERENCE),
        "_named": named,
        "_bare": _group(raw, BARE_NAME),
    })
    topic = F.lit(None).cast("string")
    for name, words in reversed(CASE_TOPICS):
        topic = F.when(_any(low, words), F.lit(name)).otherwise(topic)
    person = F.coalesce("_named", "_bare")
    is_name = F.coalesce(
        ~F.exists(F.split(F.lower(person), r"\s+"), lambda w: w.isin(*NAME_STOP_WORDS)), F.lit(False)
    )
    rows = rows.withColumn("_topic", F.when(F.col("_case"), topic)).withColumn("_name", F.when(is_name, collapse(person)))
    by_id = F.coalesce("_officer", "_victim", "_accused")
    sub = (
        F.when(F.col("_topic").isNotNull(), F.col("_topic"))
        .when(F.col("_officer").isNotNull(), "officer")
        .when(F.col("_victim").isNotNull(), "victim")
        .when(F.col("_accused").isNotNull(), "accused")
        .when(F.col("ref_kind") == "case_id", "case_by_id")
        .when(F.col("ref_kind") == "case_number", "case_by_number")
        .when(F.col("ref_kind") == "crime_number", "case_by_crime")
        .when(F.col("_graph"), "relationship")
        .when(F.col("_name").isNotNull(), "accused_by_name")
        .otherwise("similar_cases")
    )
    rows = rows.withColumn("sub_intent", sub)
    s = F.col("sub_intent")
    plain = (
        F.when(F.col("_topic").isNotNull(), "factual_query")
        .when(s == "relationship", "graph_query")
        .when(s == "similar_cases", "semantic_search")
        .otherwise("identifier_lookup")
    )
    entity = s.isin("officer", "victim", "accused")
    about_case = F.col("_topic").isNotNull() | s.startswith("case_by_")
    return rows.withColumns({
        "intent": F.when(F.col("_reason") | s.isin(*ALWAYS_REASONED), "reasoning").otherwise(plain),
        "identifier_kind": F.when(entity, F.concat(s, F.lit("_id"))).when(about_case, F.col("ref_kind"))
        .when(s == "accused_by_name", "accused_name"),
        "identifier_value": F.when(entity, F.regexp_replace(by_id, r"^0+(?=\d)", ""))
        .when(about_case, F.col("ref_value")).when(s == "accused_by_name", F.col("_name")),
        "confidence": F.when(F.col("_topic").isNotNull(), 0.95).when(entity | s.startswith("case_by_"), 0.9)
        .when(s == "relationship", 0.7)
        .when(s == "accused_by_name", F.when(F.col("_named").isNotNull(), 0.85).otherwise(0.6)).otherwise(0.5),
    }).drop(
        "_raw", "_low", "_reason", "_graph", "_case", "_officer", "_victim", "_accused", "_named", "_bare",
        "_topic", "_name", "ref_kind", "ref_value",
    )


def said_case(text: Column) -> Column:
    """The case number that a text names, NULL where it names none."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, HISTORY_CASE, 1), F.lit("")), r"^0+(?=\d)", "")


def resolve_history(turns: DataFrame, text: str = "text") -> DataFrame:
    """Add the case number named last before each turn of its conversation.

    ``turns``: conv_id, turn and the text.
    """
    said = turns.withColumn("_case_said", said_case(F.col(text)))
    return last_known_before(said, "conv_id", "turn", "_case_said", "history_case").drop("_case_said")


def fill_from_history(detected: DataFrame) -> DataFrame:
    """Give questions without an identifier the case number of their history."""
    missing = F.col("identifier_kind").isNull() & F.col("history_case").isNotNull()
    return detected.withColumns({
        "identifier_value": F.when(missing, F.col("history_case")).otherwise(F.col("identifier_value")),
        "identifier_kind": F.when(missing, F.lit("case_number")).otherwise(F.col("identifier_kind")),
    })


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last turns of each conversation, then only what user and assistant said."""
    recent = top_per_key(turns, ["conv_id"], [F.col("turn").desc()], n, "from_end")
    return recent.filter(F.col("role").isin("user", "assistant") & F.col("text").isNotNull() & (F.col("text") != ""))


def validity(questions: DataFrame, text: str = "text") -> DataFrame:
    """Add the stripped question, whether it can be asked, and if not why."""
    cleaned = strip(F.col(text))
    reason = (
        F.when(F.col(text).isNull() | (F.col(text) == ""), "Query cannot be empty.")
        .when(cleaned == "", "Query cannot be entirely whitespace.")
        .when(F.length(cleaned) < 3, "Query is too short. Please provide more detail.")
    )
    return questions.withColumns({"cleaned": cleaned, "reason": reason, "is_valid": reason.isNull()})
