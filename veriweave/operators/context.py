"""Context texts from ranked results under a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.functions.text import heading
from veriweave.sources.stores import DOCUMENT_TYPES

MAX_TOKENS = 4000
# A document is cut rather than left out when more than this many tokens remain.
MIN_REMAINING = 20
OPENING = "=== RETRIEVED CONTEXT ===\n"
CLOSING = "=== END CONTEXT ==="


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.coalesce(F.floor(F.length(text) / F.lit(4)), F.lit(0))


def deduplicate(ranked: DataFrame) -> DataFrame:
    """The best-ranked row of each document per query."""
    first = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))
    return ranked.withColumn("_first", first).filter("_first = 1").drop("_first")


def _type_position(kind: Column) -> Column:
    value = F.lit(len(DOCUMENT_TYPES))
    for i, name in enumerate(DOCUMENT_TYPES):
        value = F.when(kind == name, F.lit(i)).otherwise(value)
    return value


def group_headers(unique: DataFrame) -> DataFrame:
    """Add the place of the document's group, its place in the group, and the group's header."""
    group = Window.partitionBy("query_id", "document_type")
    title = heading(F.col("document_type"))
    titles = F.when(title.endswith("y"), F.regexp_replace(title, r"y\z", "ies")).otherwise(F.concat(title, F.lit("s")))
    n = F.count(F.lit(1)).over(group)
    header = F.concat(
        F.lit("--- "), titles, F.lit(" ("), n.cast("string"), F.lit(" document"),
        F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(") ---\n"),
    )
    return unique.withColumns({
        "group_no": _type_position(F.col("document_type")),
        "in_group": F.row_number().over(group.orderBy("rank")),
        "header": header,
    })


def fit_budget(grouped: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The lines that fit the budget, as (query_id, line_no, text).

    The first document that does not fit is cut if enough of the budget remains, and
    ends the context of its query.
    """
    label = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] (Score: "), F.col("final_score").cast("string"), F.lit(") "),
        heading(F.col("document_type")), F.lit(" "), F.col("document_id"), F.lit("\n"),
    )
    rows = grouped.withColumn("label", label).withColumn(
        "body", F.concat("label", F.coalesce("text_preview", F.lit("")), F.lit("\n\n"))
    )
    rows = rows.withColumns({
        "header_cost": F.when(F.col("in_group") == 1, estimate_tokens(F.col("header"))).otherwise(F.lit(0)),
        "body_cost": estimate_tokens(F.col("body")),
    })
    order = Window.partitionBy("query_id").orderBy("group_no", "document_type", "rank")
    used = F.lit(len(OPENING) // 4) + F.sum(F.col("header_cost") + F.col("body_cost")).over(order)
    rows = rows.withColumn("used", used).withColumn("used_before", F.col("used") - F.col("body_cost"))
    rows = rows.withColumns({
        "position": F.row_number().over(order),
        "earlier_fit": F.coalesce(F.lag("used").over(order) < max_tokens, F.lit(True)),
    })
    fits = F.col("used") < max_tokens
    header_fits = F.col("used_before") < max_tokens
    remaining = F.lit(max_tokens) - F.col("used_before")
    cut = F.concat(
        "label",
        F.substring("text_preview", F.lit(1), F.greatest(remaining * 4, F.lit(0)).cast("int")),
        F.lit("... [TRUNCATED]\n\n"),
    )
    shown_header = F.when((F.col("in_group") == 1) & header_fits, F.col("header"))
    shown_body = F.when(fits, F.col("body")).when(header_fits & (remaining > MIN_REMAINING), cut)
    return (
        rows.filter("earlier_fit")
        .select("query_id", F.col("position").alias("line_no"), F.concat_ws("\n", shown_header, shown_body).alias("text"))
        .filter("text <> ''")
    )


def build_context(ranked: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One context text per query (R26). The budget bounds what is collected."""
    lines = fit_budget(group_headers(deduplicate(ranked)), max_tokens)
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda line: line["text"]), "\n"
    )
    queries = ranked.select("query_id").distinct()
    built = lines.groupBy("query_id").agg(body.alias("body"))
    text = F.concat_ws("\n", F.lit(OPENING), F.col("body"), F.lit(CLOSING))
    return queries.join(built, "query_id", "left").select("query_id", text.alias("context"))


def build_hybrid_context(ranked: DataFrame, triples: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The context with the graph results of the query as a list.

    A query without triples keeps its plain context; one without documents has only the list.
    """
    plain = build_context(ranked, max_tokens)
    unique = triples.groupBy("query_id", "node", "relationship", "connected_to").agg(F.min("triple_no").alias("no"))
    line = F.concat(
        F.lit("• "), F.col("node"), F.lit(" -["), F.col("relationship"), F.lit("]-> "), F.col("connected_to")
    )
    listed = unique.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("text")))), lambda t: t["text"]), "\n"
        ).alias("graph")
    )
    joined = plain.join(listed, "query_id", "full_outer")
    opened = F.regexp_replace(F.coalesce("context", F.lit("")), rf"\n?{CLOSING}\z", "")
    merged = F.concat(opened, F.lit("\n\n--- Graph Relationships ---\n"), F.col("graph"), F.lit(f"\n\n{CLOSING}"))
    return joined.select("query_id", F.when(F.col("graph").isNull(), F.col("context")).otherwise(merged).alias("context"))
