"""Vector, query text, ranking, context and analytics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.domain_sql import domain
from registry.graph import OFFICER_COUNTS, PEOPLE, triple_sql
from veriweave.functions.encoding import DIMENSION, hashing_encoder
from veriweave.functions.identifiers import name_uuid
from veriweave.operators import analytics, context, querytext, ranking, vector_index, vectors
from veriweave.plans import corpus as corpus_plans
from veriweave.plans import retrieval as plans
from veriweave.roles import domain_tables, read
from veriweave.session import staged

ENCODER = hashing_encoder(DIMENSION)
MODEL = "hashing-64"
NOW = "2024-12-01 00:00:00"
R3 = "floor(({}) * 1000 + 0.5 + 1e-7) / 1000"

# The documents table as a corpus with metadata; the expressions serve both engines.
KIND = "CASE lang WHEN 'en' THEN 'case_summary' WHEN 'es' THEN 'accused_profile' WHEN 'de' THEN 'court_summary' ELSE 'note' END"
DISTRICT = "CASE doc_id % 4 WHEN 0 THEN 'Mysuru' WHEN 1 THEN 'Udupi' WHEN 2 THEN 'Bengaluru' END"
FIELDS = {
    "case_id": ("doc_id", "BIGINT"),
    "crime_number": ("CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'CR/' || doc_id END", "VARCHAR"),
    "district": (DISTRICT, "VARCHAR"),
    "police_station": ("source", "VARCHAR"),
    "crime_year": ("2018 + doc_id % 7", "BIGINT"),
    "crime_month": ("doc_id % 12 + 1", "BIGINT"),
    "crime_category": ("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 4 END", "BIGINT"),
    "major_crime": ("NULL", "BIGINT"),
    "minor_crime": ("NULL", "BIGINT"),
    "court": ("CASE WHEN lang = 'de' THEN 'Court of ' || source END", "VARCHAR"),
    "officer": ("CASE WHEN doc_id % 2 = 0 THEN n_chars END", "BIGINT"),
    "created_at": ("'2024-01-01T00:00:00+00:00'", "VARCHAR"),
    "updated_at": (
        "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'yesterday' ELSE '2024-' || lpad(CAST(doc_id % 11 + 1 AS {text}), 2, '0') "
        "|| '-15T12:00:00+00:00' END", "VARCHAR",
    ),
}


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with metadata, as the builders would give them."""
    d = read(spark, sf, "documents")
    spark_type = {"BIGINT": "BIGINT", "VARCHAR": "STRING"}
    fields = [
        F.expr(f"CAST({sql.format(text='STRING')} AS {spark_type[kind]})").alias(vectors.PAYLOAD[name])
        for name, (sql, kind) in FIELDS.items()
    ]
    document_id = F.expr(f"({KIND}) || '_' || doc_id")
    return d.select(
        document_id.alias("document_id"), F.expr(KIND).alias("document_type"), "text",
        F.struct(document_id.alias("document_id"), F.expr(KIND).alias("document_type"), *fields).alias("metadata"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The point collection, stored as it would be."""
    return staged(vectors.points_of(corpus(spark, sf), ENCODER, DIMENSION), "points")


POINT_ID = (
    "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || "
    "lower(printf('%x', (('0x' || substr(h, 17, 1))::INT & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
)
CORPUS_SQL = (
    "corpus AS (SELECT *, (" + POINT_ID + ") AS point_id FROM (SELECT *, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || "
    f"encode(document_id)) AS h FROM (SELECT doc_id, ({KIND}) || '_' || doc_id AS document_id, {KIND} AS document_type, text, "
    + ", ".join(f"CAST({sql.format(text='VARCHAR')} AS {kind}) AS {name}" for name, (sql, kind) in FIELDS.items())
    + " FROM documents)))"
)


def vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """Hashed word counts at unit length, as the encoder makes them, in SQL."""
    return (
        f"{name} AS (SELECT k AS {key}, CAST(list(w ORDER BY place) AS FLOAT[]) AS vector FROM (SELECT k, place, "
        f"CASE WHEN norm > 0 THEN n / norm ELSE 0 END AS w FROM (SELECT g.k, g.place, COALESCE(c.n, 0) AS n, "
        f"sqrt(sum(COALESCE(c.n, 0) * COALESCE(c.n, 0)) OVER (PARTITION BY g.k)) AS norm FROM (SELECT {key} AS k, place FROM {source}, "
        f"range({DIMENSION}) r(place)) g LEFT JOIN (SELECT k, place, count(*) AS n FROM (SELECT k, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) "
        f"% {DIMENSION} AS place FROM (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[^ \\t\\r\\n\\f\\x0b]+')) AS tok FROM {source})) "
        f"GROUP BY 1, 2) c ON c.k = g.k AND c.place = g.place)) GROUP BY k)"
    )


COSINE = (
    "round(CASE WHEN list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) > 0 AND list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) > 0 THEN "
    "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * "
    "sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))) ELSE 0 END, 6)"
)
POINTS_SQL = CORPUS_SQL + ",\n" + vectors_sql("cv", "corpus", "document_id", "text") + (
    ",\npoints AS (SELECT corpus.*, cv.vector, substr(text, 1, 500) AS text_preview FROM corpus JOIN cv USING (document_id) "
    "WHERE trim(text) <> '')"
)


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    df = vectors.encode(read(spark, sf, "documents").select("doc_id", "text"), "text", ENCODER)
    return df.select("doc_id", F.posexplode("vector").alias("place", "w")).filter("w <> 0").select(
        "doc_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("w").cast("double"), 6).alias("weight")
    )


BROKEN_VECTOR = {
    "spark": "CASE label % 5 WHEN 0 THEN embedding WHEN 1 THEN slice(embedding, 1, 32) WHEN 2 THEN concat(slice(embedding, 1, 63), "
             "array(float('nan'))) WHEN 3 THEN concat(slice(embedding, 1, 62), array(float('inf'), float('nan'))) END",
    "duck": "CASE label % 5 WHEN 0 THEN embedding WHEN 1 THEN embedding[1:32] WHEN 2 THEN embedding[1:63] || ['nan'::FLOAT] "
            "WHEN 3 THEN embedding[1:62] || ['inf'::FLOAT, 'nan'::FLOAT] END",
}


def broken(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "embeddings").selectExpr(
        "vec_id", f"{BROKEN_VECTOR['spark']} AS vector", "IF(vec_id % 4 = 0, ' ', CONCAT('doc ', vec_id)) AS text"
    )
    return vectors.check_vectors(df, "text", "vector", 64)


BROKEN_SQL = (
    f"broken AS (SELECT vec_id, {BROKEN_VECTOR['duck']} AS vector, CASE WHEN vec_id % 4 = 0 THEN ' ' ELSE 'doc ' || vec_id END AS text "
    "FROM embeddings),\nchecked AS (SELECT vec_id, vector, concat_ws('; ', CASE WHEN trim(text) = '' THEN 'Source document text is empty' END, "
    "CASE WHEN vector IS NULL THEN 'Generated vector is null' END, CASE WHEN len(vector) <> 64 THEN 'Dimension mismatch: expected 64, got ' || "
    "len(vector) END, CASE WHEN len(list_filter(vector, lambda v: isnan(v))) > 0 THEN 'Vector contains NaN values' END, "
    "CASE WHEN len(list_filter(vector, lambda v: isinf(v))) > 0 THEN 'Vector contains Infinity values' END) AS issues FROM broken)"
)


def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "documents").selectExpr("doc_id", "source || '_é_' || doc_id AS name")
    return names.select("doc_id", name_uuid(F.col("name")).alias("point_id"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    df = corpus(spark, sf)
    return df.select(*vectors.payload(F.col("metadata"), F.col("text")))


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    df = corpus(spark, sf).select(*vectors.payload(F.col("metadata"), F.col("text")))
    conditions = {"document_type": ["case_summary", "accused_profile"], "district": "Mysuru", "crime_category": None}
    return vectors.filter_points(df, conditions).select("document_id", "document_type", "district")


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean vector of its embeddings."""
    e = read(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("query_id"), F.posexplode("embedding"))
    mean = e.groupBy("query_id", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    return mean.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector")
    )


def embedding_points(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("label")
    )


def topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.search(embedding_points(spark, sf), label_queries(spark, sf), 10, None)


def topk_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.search(embedding_points(spark, sf), label_queries(spark, sf), 25, 0.1)


def similar(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a case: its nearest others."""
    p = embedding_points(spark, sf)
    return vectors.nearest(p, p.select(F.col("point_id").alias("query_id"), "vector"), 5, skip_self=True)


def similar_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """As ``similar``, with more queries than travel to every task: points and queries meet block by block."""
    p = embedding_points(spark, sf)
    asked = p.select(F.col("point_id").alias("query_id"), "vector")
    return vectors.nearest(p, asked, 5, skip_self=True, broadcast_queries=100, points_per_block=500)


_MEANS = (
    "q AS (SELECT query_id, list(m ORDER BY pos) AS vector FROM (SELECT CAST(label AS BIGINT) AS query_id, pos, avg(CAST(v AS DOUBLE)) AS m "
    "FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
)


def _top_sql(queries: str, points_from: str, k: int, where: str = "TRUE") -> str:
    cosine = COSINE.format(a="q.vector", b="p.vector")
    return (
        f"SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM "
        f"(SELECT q.query_id, p.point_id, {cosine} AS score FROM {queries} q, {points_from} p WHERE {where}) "
    )


def e8_documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", "text", "lang"), 256).alias("version")).select(
        F.col("doc_id").cast("string").alias("document_id"), "version"
    )


def e8_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as of an earlier run: poor ones had another text, toxic ones left the store since."""
    d = read(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", "text", "lang"), 256).alias("h"))
    rows = read(spark, sf, "labels").join(d, "doc_id").selectExpr(
        "CAST(IF(toxic = 1, doc_id + 100000000, doc_id) AS STRING) AS document_id", "IF(quality = 1, h, 'old') AS version",
        f"IF(doc_id % 10 = 7, 'other', '{MODEL}') AS model",
    )
    return rows


E8_SQL = (
    "now_ AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text || '|' || lang) AS version FROM documents),\n"
    "then_ AS (SELECT CAST(CASE WHEN toxic = 1 THEN l.doc_id + 100000000 ELSE l.doc_id END AS VARCHAR) AS document_id, CASE WHEN quality = 1 "
    f"THEN sha256(text || '|' || lang) ELSE 'old' END AS version, CASE WHEN l.doc_id % 10 = 7 THEN 'other' ELSE '{MODEL}' END AS model "
    "FROM labels l JOIN documents d ON l.doc_id = d.doc_id),\n"
    "changes AS (SELECT COALESCE(n.document_id, t.document_id) AS document_id, n.version, CASE WHEN t.document_id IS NULL THEN 'new' "
    f"WHEN n.document_id IS NULL THEN 'deleted' WHEN n.version = t.version AND model = '{MODEL}' THEN 'unchanged' ELSE 'modified' END AS change "
    "FROM now_ n FULL JOIN then_ t ON n.document_id = t.document_id)"
)


def sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.detect_changes(e8_documents(spark, sf), e8_manifest(spark, sf), MODEL)


def sync_manifest(spark: SparkSession, sf: str) -> DataFrame:
    changes = sync_diff(spark, sf)
    return vectors.merge_manifest(
        e8_manifest(spark, sf), changes.filter("change IN ('new', 'modified')"), changes.filter("change = 'deleted'"), MODEL
    )


def sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.change_counts(sync_diff(spark, sf))


def build_counters(spark: SparkSession, sf: str) -> DataFrame:
    df = vectors.encode(corpus(spark, sf), "text", ENCODER)
    return vectors.encoding_counters(vectors.check_vectors(df, "text", "vector", DIMENSION))


def content_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuild that only moves the time stamps leaves every content version as it was."""
    first = corpus_plans.versions(corpus(spark, sf))
    later = corpus_plans.versions(corpus(spark, sf).withColumn("metadata", F.col("metadata").withField("updated_at", F.lit("2025"))))
    both = first.select("document_id", "version").join(later.select("document_id", F.col("version").alias("again")), "document_id")
    return both.select("document_id", (F.col("version") == F.col("again")).alias("same"))


# Query texts from the conversations, with known words put around them.
WORDS = [
    "Murder cases in Mysuru 2021, FIR no 45", "Show theft at udupi, case 123/2024 under IPC 302 and sec 420", "Officer Supplier of bangalore",
    "accused  ramesh kumar was seen by inspector sharma in 2023", "victim in bengaluru rural, cr/77/2019", "the PS and the SHO, crpc",
]


def spelled_words(key: str) -> str:
    return f"CASE {key} % {len(WORDS)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"


TURN_ID = "(conv_id * 1000 + turn)"


def turn_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What was said in the conversations, every turn, after a phrase with known words."""
    return read(spark, sf, "conversations").selectExpr(
        f"{TURN_ID} AS query_id", f"' ' || ({spelled_words(TURN_ID)}) || '  ' || text AS text"
    )


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return querytext.normalise(turn_queries(spark, sf), "text", "processed").select("query_id", "processed")


def expanded(spark: SparkSession, sf: str) -> DataFrame:
    return querytext.process(turn_queries(spark, sf), "text", "processed").select("query_id", "processed")


_W = r"[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+"
_NORMAL = f"trim(lower(regexp_replace(text, '{_W}', ' ', 'g')))"


def _expand_sql(c: str) -> str:
    for short, long in querytext.ABBREVIATIONS.items():
        c = f"regexp_replace({c}, '\\b{short}\\b', '{long}', 'g')"
    return c


TURNS_SQL = (
    f"turns AS (SELECT {TURN_ID} AS query_id, ' ' || ({spelled_words(TURN_ID)}) || '  ' || text AS text FROM conversations),\n"
    f"processed AS (SELECT query_id, {_expand_sql(_NORMAL)} AS p FROM turns)"
)


def _title(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _first_sql(words) -> str:
    return "COALESCE(" + ", ".join(f"CASE WHEN regexp_matches(p, '\\b{w}\\b') THEN '{w}' END" for w in words) + ")"


def _all_sql(patterns_and_groups) -> str:
    lists = [f"regexp_extract_all(p, '{p}', {g})" for p, g in patterns_and_groups]
    joined = lists[0]
    for one in lists[1:]:
        joined = f"list_concat({joined}, {one})"
    return joined


def _unicode_edges(pattern: str) -> str:
    """Word edges that count letters beyond ASCII as letters, which the SQL engine's own do not."""
    word = r"0-9A-Za-z_\p{L}"
    return "(?:^|[^" + word + "])" + pattern[2:-2] + "(?:[^" + word + "]|$)"


_CASES = _all_sql([(p, 0) for p in querytext.CASE_PATTERNS] + [(querytext.CASE_IN_CONTEXT, 1)])
_NAMES = _all_sql([(_unicode_edges(p), 1) for p in querytext.NAME_PATTERNS])
_STOP = ", ".join(f"'{w}'" for w in querytext.NOT_NAMES)
ENTITIES_SQL = (
    f"entities AS (SELECT query_id, p, COALESCE({_title(_first_sql(querytext.DISTRICTS))}, CASE WHEN regexp_matches(p, '\\bbangalore\\b') "
    f"THEN 'Bengaluru' END) AS district, {_first_sql(querytext.CRIME_TYPES)} AS crime_type, "
    f"TRY_CAST(regexp_extract(p, '{querytext.YEAR_PATTERN}', 1) AS BIGINT) AS year, "
    f"list_sort(list_distinct({_CASES})) AS case_numbers, list_sort(list_distinct(regexp_extract_all(p, '{querytext.SECTION_PATTERN}', 1))) AS "
    f"ipc_sections, list_sort(list_distinct(list_transform(list_filter({_NAMES}, lambda n: n NOT IN ({_STOP})), lambda n: {_title('n')}))) AS names, "
    "COALESCE(" + ", ".join(f"CASE WHEN regexp_matches(p, '\\b{w}(?:s)?\\b') THEN '{k}' END" for w, k in querytext.DOCUMENT_WORDS.items())
    + ") AS document_type FROM processed)"
)


def entities(spark: SparkSession, sf: str) -> DataFrame:
    found = querytext.extract_entities(querytext.process(turn_queries(spark, sf), "text", "processed"), "processed")

    def joined(c: str):
        return F.array_join(F.array_sort(c), ",").alias(c)

    return found.select(
        "query_id", "district", "crime_type", "year", joined("case_numbers"), joined("ipc_sections"), joined("names"),
        "document_type", F.size("entities").cast("bigint").alias("n_entities"),
    )


def auto_filters(spark: SparkSession, sf: str) -> DataFrame:
    found = querytext.extract_entities(querytext.process(turn_queries(spark, sf), "text", "processed"), "processed")
    return querytext.auto_filters(found, F.col("query_id") % 3 == 0).select(
        "query_id", "filter_district", "filter_crime_year", "filter_document_type"
    )


def options(**changes) -> plans.SearchOptions:
    return plans.SearchOptions(now=F.lit(NOW).cast("timestamp"), **{"top_k": 8, "threshold": 0.2, "max_results": 5, **changes})


def searched(spark: SparkSession, sf: str) -> DataFrame:
    return plans.search(points(spark, sf), turn_queries(spark, sf), ENCODER, options())


# Metadata fields that count for richness, in the order of the payload.
_RICH = " + ".join(
    f"CASE WHEN {n} IS NOT NULL" + (f" AND {n} <> ''" if kind == "VARCHAR" else "") + " THEN 1 ELSE 0 END"
    for n, (_, kind) in FIELDS.items()
)
_PRIORITY = "CASE document_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranking.TYPE_PRIORITY.items()) + " ELSE 0.3 END"
_UPDATED = "TRY_CAST(replace(updated_at, '+00:00', '') AS TIMESTAMP)"
_FRESH = (
    f"CASE WHEN {_UPDATED} IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - floor((epoch(TIMESTAMP '{NOW}') - epoch({_UPDATED})) "
    "/ 86400) / 365.0)) END"
)
HITS_SQL = (
    TURNS_SQL + ",\n" + POINTS_SQL + ",\n" + vectors_sql("q", "processed", "query_id", "p")
    + ",\nscored AS (" + _top_sql("q", "points", 8) + "),\nhits AS (SELECT query_id, score, rank AS search_rank, points.* FROM scored JOIN points "
    "USING (point_id) WHERE score >= 0.2 AND rank <= 8)"
)


def _signals(hits: str, graph: str = "0.0") -> str:
    return (
        f"signals AS (SELECT *, greatest(0.0, least(1.0, score)) AS sim, {graph} AS graph, {_PRIORITY} AS pri, ({_RICH}) / 13.0 AS rich, "
        f"{_FRESH} AS fresh FROM {hits}),\nranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, search_rank) "
        f"AS rank FROM (SELECT *, {R3.format('0.60 * sim + 0.15 * graph + 0.05 * fresh + 0.10 * pri + 0.10 * rich')} AS final_score, "
        f"{R3.format('score')} AS similarity_score FROM signals))"
    )


RANKED_SQL = HITS_SQL + ",\n" + _signals("hits")


def r_rank(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf).select(
        "query_id", "rank", "document_id", "similarity_score", "final_score",
        F.round("metadata_richness", 6).alias("richness"), F.round("freshness", 6).alias("freshness"), "type_priority",
    )


_SIGNALS_OUT = ("round(rich, 6) AS richness, round(fresh, 6) AS freshness, CAST(pri AS DOUBLE) AS type_priority")


def r_explain(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("explanation")
    return searched(spark, sf).select(
        "query_id", "rank", e["similarity_contribution"].alias("similarity_contribution"),
        e["metadata_richness_contribution"].alias("richness_contribution"),
        e["freshness_contribution"].alias("freshness_contribution"), e["type_priority_contribution"].alias("type_contribution"),
        e["ranking_reason"].alias("reason"),
    )


_REASON = (
    f"concat_ws(' + ', 'Cosine similarity (' || printf('%.3f', {R3.format('sim')}) || ')', CASE WHEN pri > 0.8 THEN 'high priority type (' || "
    "document_type || ')' END, CASE WHEN graph > 0 THEN 'corroborated by graph' END, CASE WHEN fresh > 0.8 THEN 'recently updated' END)"
)


def r_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a query and of its repetition: the better rank of each document stays."""
    ranked = staged(searched(spark, sf), "ranked")
    twice = ranked.unionByName(ranked.withColumn("rank", F.col("rank") + 5))
    unique = context.deduplicate(twice)
    return context.group_headers(unique).select("query_id", "document_id", "rank", "header", F.col("in_group").cast("bigint").alias("in_group"))


def r_budget(spark: SparkSession, sf: str) -> DataFrame:
    lines = context.fit_budget(context.group_headers(context.deduplicate(searched(spark, sf))), 420)
    return lines.select("query_id", F.col("line_no").cast("bigint").alias("line_no"), "text")


def r_context(spark: SparkSession, sf: str) -> DataFrame:
    _, text = plans.query(points(spark, sf), turn_queries(spark, sf), ENCODER, options(max_tokens=420))
    return text


_TITLE = "array_to_string(list_transform(string_split(document_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
_ORDER = "CASE document_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(
    ("case_summary", "accused_profile", "victim_profile", "officer_profile", "district_summary", "court_summary"))) + " ELSE 6 END"


def _context_sql(ranked: str, limit: int, budget: int, prefix: str = "") -> str:
    return (
        f"{prefix}grouped AS (SELECT *, {_ORDER} AS gno, row_number() OVER (PARTITION BY query_id, document_type ORDER BY rank) AS in_group, "
        f"'--- ' || CASE WHEN ends_with({_TITLE}, 'y') THEN {_TITLE}[:-2] || 'ies' ELSE {_TITLE} || 's' END || ' (' || "
        "count(*) OVER (PARTITION BY query_id, document_type) || ' document' || CASE WHEN count(*) OVER (PARTITION BY query_id, document_type) > 1 "
        f"THEN 's' ELSE '' END || ') ---' || chr(10) AS header, '[' || rank || '] (Score: ' || final_score || ') ' || {_TITLE} || ' ' || document_id || "
        f"chr(10) AS label FROM {ranked} WHERE rank <= {limit}),\n"
        "costed AS (SELECT *, label || text_preview || chr(10) || chr(10) AS body, CASE WHEN in_group = 1 THEN length(header) // 4 ELSE 0 END AS hc, "
        "length(label || text_preview || chr(10) || chr(10)) // 4 AS bc FROM grouped),\n"
        "run AS (SELECT *, 6 + sum(hc + bc) OVER (PARTITION BY query_id ORDER BY gno, document_type, rank) AS used, "
        "row_number() OVER (PARTITION BY query_id ORDER BY gno, document_type, rank) AS line_no FROM costed),\n"
        f"kept AS (SELECT *, used - bc AS used_before, COALESCE(lag(used) OVER (PARTITION BY query_id ORDER BY line_no) < {budget}, true) AS ok FROM run),\n"
        f"lines AS (SELECT query_id, line_no, concat_ws(chr(10), CASE WHEN in_group = 1 AND used_before < {budget} THEN header END, CASE WHEN used < {budget} "
        f"THEN body WHEN used_before < {budget} AND {budget} - used_before > 20 THEN label || substr(text_preview, 1, CAST(({budget} - used_before) * 4 AS BIGINT)) "
        "|| '... [TRUNCATED]' || chr(10) || chr(10) END) AS text FROM kept WHERE ok)"
    )


CONTEXT_SQL = RANKED_SQL + ",\n" + _context_sql("ranked", 5, 420)
_JOINED = (
    "'=== RETRIEVED CONTEXT ===' || chr(10) || chr(10) || COALESCE(string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY line_no) || chr(10), '') "
    "|| '=== END CONTEXT ==='"
)


def r_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return plans.hybrid(points(spark, sf), turn_queries(spark, sf), domain_tables(spark, sf), ENCODER, options())


def hybrid_results(spark: SparkSession, sf: str) -> DataFrame:
    return r_hybrid(spark, sf).results.select(
        "query_id", "rank", "document_id", "final_score", "graph_confidence", F.col("explanation.ranking_reason").alias("reason")
    )


def hybrid_context(spark: SparkSession, sf: str) -> DataFrame:
    return r_hybrid(spark, sf).context


def hybrid_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return plans.hybrid_statistics(r_hybrid(spark, sf))


def graph_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking with triples: each query's triples name some of the documents it may find."""
    hits = plans.with_metadata(
        vectors.search(points(spark, sf), plans.encode_queries(turn_queries(spark, sf), ENCODER), 8, 0.2)
    )
    docs = read(spark, sf, "documents").selectExpr("doc_id", f"{KIND} AS kind")
    triples = turn_queries(spark, sf).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).selectExpr(
        "query_id", "query_id % 10 * 97 + i * 13 AS doc_id", "i"
    ).join(docs, "doc_id").selectExpr(
        "query_id", "i AS triple_no", "IF(i % 2 = 0, 'Case: ' || kind || '_' || doc_id, 'Accused: summary ' || doc_id) AS node",
        "IF(i % 2 = 0, 'HAS_ACCUSED', 'INVOLVED_IN') AS relationship", "CAST(i AS STRING) || ' Cases' AS connected_to",
    )
    ranked = ranking.rank(hits, F.lit(NOW).cast("timestamp"), triples)
    return ranked.select("query_id", "rank", "document_id", "final_score", "graph_confidence", "graph_relationship")


_TRIPLES = (
    "triples AS (SELECT query_id, i AS triple_no, CASE WHEN i % 2 = 0 THEN 'Case: ' || kind || '_' || doc_id ELSE 'Accused: summary ' || doc_id END AS node, "
    "CASE WHEN i % 2 = 0 THEN 'HAS_ACCUSED' ELSE 'INVOLVED_IN' END AS relationship, i || ' Cases' AS connected_to FROM "
    "(SELECT query_id, i, query_id % 10 * 97 + i * 13 AS want FROM turns, range(10) r(i)) JOIN "
    f"(SELECT doc_id, {KIND} AS kind FROM documents) ON doc_id = want)"
)
_SHARES = (
    "len(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: length(w) > 3 AND (contains(lower(document_id), w) OR "
    "contains(w, lower(document_id))))) > 0"
)
GRAPH_SQL = HITS_SQL + ",\n" + _TRIPLES + (
    ",\npairs AS (SELECT h.query_id, h.document_id, t.*EXCLUDE (query_id), contains(lower(node), lower(document_id)) OR contains(lower(connected_to), "
    "lower(document_id)) AS direct FROM hits h JOIN triples t ON h.query_id = t.query_id),\n"
    "conf AS (SELECT query_id, document_id, arg_min(c, triple_no) AS graph_confidence, arg_min(CASE WHEN direct THEN relationship END, "
    "CASE WHEN direct THEN triple_no END) AS graph_relationship FROM (SELECT *, CASE WHEN direct THEN 1.0 WHEN "
    + _SHARES.format(c="node") + " OR " + _SHARES.format(c="connected_to")
    + " THEN 0.7 END AS c FROM pairs) WHERE c IS NOT NULL GROUP BY 1, 2),\n"
    "withg AS (SELECT h.*, CAST(COALESCE(graph_confidence, 0) AS DOUBLE) AS graph_confidence, graph_relationship FROM hits h LEFT JOIN conf USING "
    "(query_id, document_id)),\n" + _signals("withg", "graph_confidence")
)


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    log = read(spark, sf, "events")
    filters = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event"), F.col("event_type"))
    return log.select(
        "event_id",
        analytics.fingerprint(
            F.concat(F.lit("user "), F.col("user_id").cast("string")), filters,
            F.when(F.col("user_id") % 2 == 0, F.lit(10)), F.when(F.col("user_id") % 3 == 0, F.lit("0.5")),
        ).alias("fingerprint"),
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr(
        "CAST(value AS DOUBLE) AS search_time_ms", "value / 2 AS graph_time_ms", "(user_id % 100) / 100.0D AS top_similarity",
        "event_type = 'click' AS is_hybrid", "event_type = 'view' AS cache_hit",
        "ARRAY('case_summary', IF(user_id % 2 = 0, 'court_summary', 'case_summary')) AS result_types",
        "IF(user_id % 3 = 0, MAP('district', 'x', 'court', 'y'), MAP('officer', 'z')) AS filters",
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.usage_summary(request_log(spark, sf))


def usage_types(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.type_usage(request_log(spark, sf))


def usage_filters(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.filter_usage(request_log(spark, sf))


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    return plans.shaped(searched(spark, sf))


def explained(spark: SparkSession, sf: str) -> DataFrame:
    return plans.explain(searched(spark, sf), 1).select("query_id", "document_id", "ranking_reason")


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The caller's own order: by kind of document, then by the rank so far."""
    def by_kind(df: DataFrame) -> DataFrame:
        from veriweave.functions.groups import top_per_key

        return top_per_key(df, ["query_id"], [F.col("document_type"), F.col("rank")], 5, "new_rank")

    return ranking.rerank(searched(spark, sf), by_kind).select("query_id", "document_id", "new_rank")


_MATCHED = (
    "concat_ws(', ', CASE WHEN asked_district = district THEN 'District (' || asked_district || ')' END, CASE WHEN asked_year = crime_year THEN 'Year (' || asked_year || ')' END)"
)
_TOLD = (
    f"CASE WHEN {R3.format('0.60 * sim')} > 0.4 THEN 'High semantic similarity to query' WHEN {R3.format('0.60 * sim')} > 0.2 THEN 'Moderate semantic match' END"
)


def _confidence_sql(hits: str) -> str:
    return (
        f"pairs AS (SELECT h.query_id, h.document_id, t.*EXCLUDE (query_id), contains(lower(node), lower(document_id)) OR contains(lower(connected_to), "
        f"lower(document_id)) AS direct FROM {hits} h JOIN triples t ON h.query_id = t.query_id),\n"
        "conf AS (SELECT query_id, document_id, arg_min(c, triple_no) AS graph_confidence, arg_min(CASE WHEN direct THEN relationship END, "
        "CASE WHEN direct THEN triple_no END) AS graph_relationship FROM (SELECT *, CASE WHEN direct THEN 1.0 WHEN "
        + _SHARES.format(c="node") + " OR " + _SHARES.format(c="connected_to")
        + " THEN 0.7 END AS c FROM pairs) WHERE c IS NOT NULL GROUP BY 1, 2),\n"
        f"withg AS (SELECT h.*, CAST(COALESCE(graph_confidence, 0) AS DOUBLE) AS graph_confidence, graph_relationship FROM {hits} h LEFT JOIN conf USING "
        "(query_id, document_id)),\n" + _signals("withg", "graph_confidence")
    )


# Hits within the filters that the entities imply, and the triples of the entities, numbered in their order.
_ASKED = (
    "(qs.district IS NULL OR qs.district = p.district) AND (qs.year IS NULL OR qs.year = p.crime_year) AND "
    "(qs.document_type IS NULL OR qs.document_type = p.document_type)"
)
HYBRID_SQL = (
    TURNS_SQL + ",\n" + ENTITIES_SQL + ",\n" + POINTS_SQL + ",\n" + vectors_sql("q", "processed", "query_id", "p") + ",\nscored AS ("
    + _top_sql("q", "points", 8, _ASKED).replace("FROM q q, points p", "FROM q q JOIN entities qs ON qs.query_id = q.query_id, points p")
    + "),\nhits AS (SELECT query_id, score, rank AS search_rank, points.* FROM scored JOIN points USING (point_id) WHERE score >= 0.2 AND rank <= 8),\n"
    + OFFICER_COUNTS + PEOPLE
    + "asked_district AS (SELECT query_id, district FROM entities WHERE district IS NOT NULL),\n"
    "named AS (SELECT DISTINCT query_id, unnest(names) AS term FROM entities),\n"
    "numbered AS (SELECT DISTINCT query_id, unnest(case_numbers) AS term FROM entities),\n"
    "sect AS (SELECT DISTINCT query_id, unnest(ipc_sections) AS term FROM entities),\n"
    "pcounts AS (SELECT AccusedName AS name, count(*) AS cases FROM (SELECT DISTINCT AccusedMasterID, CaseMasterID, AccusedName FROM Accused) GROUP BY 1),\n"
    "triples AS (SELECT query_id, node, relationship, connected_to, row_number() OVER (PARTITION BY query_id ORDER BY step, node, connected_to) AS triple_no FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS step, * FROM ({sql})" for i, sql in enumerate(triple_sql(
        "asked_district", "named", "numbered", "sect"))) + ")),\n"
    + _confidence_sql("hits")
)

QUERIES = {
    "E1_encode": (
        encoded,
        f"WITH {vectors_sql('v', 'documents', 'doc_id', 'text')} SELECT doc_id, place, weight FROM (SELECT doc_id, CAST(generate_subscripts(vector, 1) - 1 "
        "AS BIGINT) AS place, round(CAST(unnest(vector) AS DOUBLE), 6) AS weight FROM v) WHERE weight <> 0",
    ),
    "E2_vector_checks": (
        lambda spark, sf: broken(spark, sf).select("vec_id", F.array_join("issues", "; ").alias("issues"), "is_valid"),
        f"WITH {BROKEN_SQL} SELECT vec_id, issues, issues = '' AS is_valid FROM checked",
    ),
    "E3_point_id": (
        point_ids,
        f"SELECT doc_id, {POINT_ID} AS point_id FROM (SELECT doc_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '_é_' || doc_id)) "
        "AS h FROM documents)",
    ),
    "E4_payload": (
        payloads,
        f"WITH {CORPUS_SQL} SELECT document_id, document_type, {', '.join(FIELDS)}, substr(text, 1, 500) AS text_preview FROM corpus",
    ),
    "E5_filter": (
        filtered,
        f"WITH {CORPUS_SQL} SELECT document_id, document_type, district FROM corpus WHERE document_type IN ('case_summary', 'accused_profile') "
        "AND district = 'Mysuru' AND crime_category IS NULL",
    ),
    "E6_topk": (
        topk,
        f"WITH {_MEANS}, p AS (SELECT vec_id AS point_id, embedding AS vector, CAST(label AS BIGINT) AS label FROM embeddings), t AS ("
        + _top_sql("q", "p", 10) + ") SELECT t.*, label FROM t JOIN p USING (point_id) WHERE rank <= 10",
    ),
    "E7_threshold": (
        topk_threshold,
        f"WITH {_MEANS}, p AS (SELECT vec_id AS point_id, embedding AS vector, CAST(label AS BIGINT) AS label FROM embeddings), t AS ("
        + _top_sql("q", "p", 25) + ") SELECT t.*, label FROM t JOIN p USING (point_id) WHERE rank <= 25 AND score >= 0.1",
    ),
    "E8_sync_diff": (sync_diff, f"WITH {E8_SQL} SELECT document_id, change, version FROM changes"),
    "E9_manifest": (
        sync_manifest,
        f"WITH {E8_SQL} SELECT t.document_id, t.version, t.model FROM then_ t JOIN changes c ON t.document_id = c.document_id WHERE change = 'unchanged' "
        f"UNION ALL SELECT document_id, version, '{MODEL}' FROM changes WHERE change IN ('new', 'modified')",
    ),
    "E10_sync_counts": (
        sync_counts,
        f"WITH {E8_SQL} SELECT " + ", ".join(f"count(*) FILTER (change = '{c}') AS {c}_documents" for c in ("new", "modified", "deleted", "unchanged"))
        + " FROM changes",
    ),
    "E10_content_versions": (content_versions, f"WITH {CORPUS_SQL} SELECT document_id, true AS same FROM corpus"),
    "E12_counters": (
        build_counters,
        "SELECT count(*) AS documents_processed, count(*) AS embeddings_generated, count(*) FILTER (trim(text) <> '') AS vectors_uploaded, "
        "count(*) FILTER (trim(text) <> '') AS valid, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (trim(text) = '') AS errors FROM documents",
    ),
    "E13_collection": (
        lambda spark, sf: vectors.collection_statistics(points(spark, sf)),
        "SELECT count(*) AS points, CAST(64 AS BIGINT) AS min_dimension, CAST(64 AS BIGINT) AS max_dimension FROM documents WHERE trim(text) <> ''",
    ),
    "R1_normalise": (normalised, f"WITH {TURNS_SQL} SELECT query_id, {_NORMAL} AS processed FROM turns"),
    "R2_abbrev": (expanded, f"WITH {TURNS_SQL} SELECT query_id, p AS processed FROM processed"),
    "R3_R10_entities": (
        entities,
        f"WITH {TURNS_SQL}, {ENTITIES_SQL} SELECT query_id, district, crime_type, year, array_to_string(case_numbers, ',') AS case_numbers, "
        "array_to_string(ipc_sections, ',') AS ipc_sections, array_to_string(names, ',') AS names, document_type, CAST(len(case_numbers) + "
        "len(ipc_sections) + len(names) + (district IS NOT NULL)::INT + (crime_type IS NOT NULL)::INT + (year IS NOT NULL)::INT + "
        "(document_type IS NOT NULL)::INT AS BIGINT) AS n_entities FROM entities",
    ),
    "R12_auto_filters": (
        auto_filters,
        f"WITH {TURNS_SQL}, {ENTITIES_SQL} SELECT query_id, " + ", ".join(
            f"CASE WHEN query_id % 3 <> 0 THEN {c} END AS {a}"
            for c, a in (("district", "filter_district"), ("year", "filter_crime_year"), ("document_type", "filter_document_type"))
        ) + " FROM entities",
    ),
    "R13_R18_rank": (
        r_rank, f"WITH {RANKED_SQL} SELECT query_id, rank, document_id, similarity_score, final_score, {_SIGNALS_OUT} FROM ranked WHERE rank <= 5",
    ),
    "R14_graph_confidence": (
        graph_rank,
        f"WITH {GRAPH_SQL} SELECT query_id, rank, document_id, final_score, graph_confidence, graph_relationship FROM ranked",
    ),
    "R19_rerank": (
        reranked,
        f"WITH {RANKED_SQL} SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY document_type, rank) AS new_rank FROM ranked "
        "WHERE rank <= 5",
    ),
    "R21_explain": (
        r_explain,
        f"WITH {RANKED_SQL} SELECT query_id, rank, {R3.format('0.60 * sim')} AS similarity_contribution, {R3.format('0.10 * rich')} AS richness_contribution, "
        f"{R3.format('0.05 * fresh')} AS freshness_contribution, {R3.format('0.10 * pri')} AS type_contribution, {_REASON} AS reason FROM ranked WHERE rank <= 5",
    ),
    "R23_R24_groups": (
        r_dedup,
        f"WITH {RANKED_SQL}, {_context_sql('ranked', 5, 420)} SELECT query_id, document_id, rank, header, in_group FROM grouped",
    ),
    "R25_budget": (r_budget, f"WITH {CONTEXT_SQL} SELECT query_id, line_no, text FROM lines WHERE text <> ''"),
    "R26_context": (r_context, f"WITH {CONTEXT_SQL} SELECT query_id, {_JOINED} AS context FROM lines GROUP BY query_id"),
    "R30_hybrid": (hybrid_results, domain(
        f"{HYBRID_SQL},\ntold AS (SELECT *, {_TOLD} AS a, nullif({_MATCHED}, '') AS m, {_REASON} AS base, CASE WHEN graph > 0 AND graph_relationship IS NOT NULL "
        "THEN 'Corroborated by graph relationship (' || graph_relationship || ')' END AS g FROM ranked JOIN (SELECT query_id, district AS asked_district, "
        "year AS asked_year FROM entities) USING (query_id) WHERE rank <= 5)\nSELECT query_id, rank, document_id, final_score, graph_confidence, "
        "CASE WHEN a IS NULL AND m IS NULL AND g IS NULL THEN base ELSE concat_ws('. ', a, 'Matched entities: ' || m, g) || '.' END AS reason FROM told"
    )),
    "R27_R30_hybrid_context": (hybrid_context, domain(
        f"{HYBRID_SQL}, {_context_sql('ranked', 5, 4000)},\nplain AS (SELECT query_id, {_JOINED} AS context FROM lines GROUP BY query_id),\n"
        "listed AS (SELECT query_id, string_agg('• ' || node || ' -[' || relationship || ']-> ' || connected_to, chr(10) ORDER BY no) AS graph FROM "
        "(SELECT query_id, node, relationship, connected_to, min(triple_no) AS no FROM triples GROUP BY ALL) GROUP BY query_id)\n"
        "SELECT COALESCE(p.query_id, l.query_id) AS query_id, CASE WHEN graph IS NULL THEN context ELSE regexp_replace(COALESCE(context, ''), "
        "'\\n?=== END CONTEXT ===$', '') || chr(10) || chr(10) || '--- Graph Relationships ---' || chr(10) || graph || chr(10) || chr(10) || "
        "'=== END CONTEXT ===' END AS context FROM plain p FULL JOIN listed l ON p.query_id = l.query_id"
    )),
    "R30_hybrid_stats": (hybrid_statistics, domain(
        f"{HYBRID_SQL}\nSELECT query_id, COALESCE(d, 0) AS documents, COALESCE(g, 0) AS graph_relationships FROM turns LEFT JOIN "
        "(SELECT query_id, count(*) AS d FROM ranked WHERE rank <= 5 GROUP BY 1) USING (query_id) LEFT JOIN "
        "(SELECT query_id, count(*) AS g FROM triples GROUP BY 1) USING (query_id)"
    )),
    "R31_explain_one": (
        explained, f"WITH {RANKED_SQL} SELECT query_id, document_id, {_REASON} AS ranking_reason FROM ranked WHERE rank = 2",
    ),
    "R32_similar_cases": (
        similar,
        "WITH p AS (SELECT vec_id AS point_id, embedding AS vector FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings) "
        "SELECT * FROM (" + _top_sql("q", "p", 5, "q.query_id <> p.point_id") + ") WHERE rank <= 5",
    ),
    "R32_similar_cases_blocks": (
        similar_blocks,
        "WITH p AS (SELECT vec_id AS point_id, embedding AS vector FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings) "
        "SELECT * FROM (" + _top_sql("q", "p", 5, "q.query_id <> p.point_id") + ") WHERE rank <= 5",
    ),
    "R33_fingerprint": (
        fingerprints,
        "SELECT event_id, sha256('q:user ' || user_id || '|f:{\"event\": \"' || event_type || '\", \"k\": \"' || json_extract_string(props, '$.k') || '\"}|k:' || "
        "CASE WHEN user_id % 2 = 0 THEN '10' ELSE 'default' END || '|t:' || CASE WHEN user_id % 3 = 0 THEN '0.5' ELSE 'default' END) AS fingerprint FROM events",
    ),
    "R34_usage": (
        usage,
        "WITH l AS (SELECT CAST(value AS DECIMAL(18,6)) AS s, CAST(value / 2 AS DECIMAL(18,6)) AS g, CAST((user_id % 100) / 100.0 AS DECIMAL(18,6)) AS t, "
        "event_type = 'click' AS hy, event_type = 'view' AS hit FROM events) SELECT count(*) AS total_queries, count(*) FILTER (hy AND NOT hit) AS hybrid_queries, "
        "floor(CAST(sum(s) FILTER (NOT hit) AS DOUBLE) / count(*) FILTER (NOT hit) * 100 + 0.5 + 1e-7) / 100 AS avg_search_time_ms, "
        "floor(CAST(sum(g) FILTER (hy AND NOT hit) AS DOUBLE) / count(*) FILTER (hy AND NOT hit) * 100 + 0.5 + 1e-7) / 100 AS avg_graph_time_ms, "
        "floor(CAST(sum(t) FILTER (NOT hit) AS DOUBLE) / count(*) FILTER (NOT hit) * 1000 + 0.5 + 1e-7) / 1000 AS avg_similarity, "
        "count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS cache_misses, "
        "floor(count(*) FILTER (hit) / count(*) * 1000 + 0.5 + 1e-7) / 1000 AS cache_hit_ratio FROM l",
    ),
    "R34_types": (
        usage_types,
        "SELECT document_type, count(*) AS hits FROM (SELECT unnest(['case_summary', CASE WHEN user_id % 2 = 0 THEN 'court_summary' ELSE 'case_summary' END]) "
        "AS document_type FROM events WHERE event_type <> 'view') GROUP BY 1",
    ),
    "R34_filters": (
        usage_filters,
        "SELECT filter, count(*) AS uses FROM (SELECT unnest(CASE WHEN user_id % 3 = 0 THEN ['district', 'court'] ELSE ['officer'] END) AS filter FROM events "
        "WHERE event_type <> 'view') GROUP BY 1",
    ),
    "R35_shaped": (
        shaped,
        f"WITH {RANKED_SQL} SELECT query_id, rank, document_id, document_type, similarity_score, final_score, text_preview FROM ranked WHERE rank <= 5",
    ),
}


def wrong_dimension(spark: SparkSession, sf: str) -> DataFrame:
    from veriweave.sources.stores import points_with_wrong_dimension

    rows = broken(spark, sf).select(F.col("vec_id").alias("point_id"), "vector").filter("vector IS NOT NULL")
    return points_with_wrong_dimension(rows, 64).select("point_id", F.size("vector").cast("bigint").alias("dimension"))


def explained_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = querytext.extract_entities(querytext.process(turn_queries(spark, sf), "text", "processed"), "processed")
    told = ranking.explain_matches(searched(spark, sf), found)
    return told.select("query_id", "rank", F.col("explanation.ranking_reason").alias("reason"))


def sync_apply(spark: SparkSession, sf: str) -> DataFrame:
    """A collection built from earlier texts, brought in step with the documents as they are."""
    from veriweave.session import checkpoint_dir
    from veriweave.sources.stores import manifest_store, point_store

    root = f"{checkpoint_dir(spark).rstrip('/')}/sync/{uuid.uuid4().hex}"
    store, manifest = point_store(spark, f"{root}/points", 16), manifest_store(spark, f"{root}/manifest", 16)
    now = corpus(spark, sf)
    labelled = read(spark, sf, "labels").selectExpr("doc_id", "toxic", "quality")
    earlier = now.join(labelled, F.col("metadata")["case_id"] == F.col("doc_id")).select(
        F.when(F.col("toxic") == 1, F.concat("document_id", F.lit("_gone"))).otherwise(F.col("document_id")).alias("document_id"),
        "document_type", F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit("an earlier text")).alias("text"), "metadata",
    )
    earlier = earlier.withColumn("metadata", F.col("metadata").withField("document_id", F.col("document_id")))
    corpus_plans.build_points(earlier, store, manifest, ENCODER, DIMENSION, MODEL)
    corpus_plans.sync_points(now, store, manifest, ENCODER, DIMENSION, MODEL)
    return store.read().select("point_id", "document_id", "text_preview").join(
        manifest.read().select("document_id", "version"), "document_id", "left"
    ).select("point_id", "document_id", "text_preview", F.col("version").isNotNull().alias("in_manifest"))


QUERIES |= {
    "S18_wrong_dimension": (
        wrong_dimension,
        f"WITH {BROKEN_SQL} SELECT vec_id AS point_id, CAST(len(vector) AS BIGINT) AS dimension FROM broken WHERE len(vector) <> 64",
    ),
    "R22_explain_matches": (
        explained_matches,
        f"WITH {RANKED_SQL}, {ENTITIES_SQL}, told AS (SELECT query_id, rank, {_TOLD} AS a, nullif({_MATCHED}, '') AS m, {_REASON} AS reason FROM ranked r "
        "JOIN (SELECT query_id, district AS asked_district, year AS asked_year FROM entities) USING (query_id) WHERE rank <= 5) SELECT query_id, rank, CASE WHEN a IS NULL AND m IS NULL THEN reason ELSE "
        "concat_ws('. ', a, 'Matched entities: ' || m) || '.' END AS reason FROM told",
    ),
    "E10_E11_sync_apply": (
        sync_apply,
        f"WITH {CORPUS_SQL} SELECT point_id, document_id, substr(text, 1, 500) AS text_preview, true AS in_manifest FROM corpus WHERE trim(text) <> ''",
    ),
}


def _index(spark: SparkSession, sf: str) -> vector_index.VectorIndex:
    return vector_index.build_index(embedding_points(spark, sf))


def _every_twentieth(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_points(spark, sf).filter("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")


def index_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth embedding against all, by the cells that can hold one of its nearest."""
    return vector_index.nearest(_index(spark, sf), _every_twentieth(spark, sf), 10, skip_self=True, exact=True)


def index_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same within the query's label and above a score, by small parts of cells."""
    return vector_index.nearest(
        _index(spark, sf), _every_twentieth(spark, sf), 4, 0.1, ("label",), skip_self=True, exact=True, points_per_block=50, queries_per_block=3
    )


def index_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a case: its nearest others, by the index."""
    index = _index(spark, sf)
    return vector_index.nearest(index, index.points.select(F.col("point_id").alias("query_id"), "vector"), 5, skip_self=True, exact=True)


def index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the nearest of every twentieth embedding the measured number of probes finds, and that each hit is told with its score."""
    asked, points = _every_twentieth(spark, sf), embedding_points(spark, sf)
    index = vector_index.tuned(_index(spark, sf), 10)
    truth = staged(vectors.nearest(points, asked, 10, skip_self=True), "truth")
    found = staged(vector_index.nearest(index, asked, 10, skip_self=True), "found")
    measured = vector_index.recall(found, truth)
    same = found.join(truth.select("query_id", "point_id", F.col("score").alias("exact")), ["query_id", "point_id"]).agg(F.count_if(F.col("score") != F.col("exact")).alias("off"))
    return measured.crossJoin(same).select("queries", "neighbours", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("off") == 0).alias("scores_equal"))


def index_grown(spark: SparkSession, sf: str) -> DataFrame:
    """An index of the even ids with the odd ones added later: cells as they were fitted, nothing missed."""
    points = embedding_points(spark, sf)
    index = vector_index.add_points(vector_index.build_index(points.filter("point_id % 2 = 0")), points.filter("point_id % 2 = 1"))
    return vector_index.nearest(index, _every_twentieth(spark, sf), 10, skip_self=True, exact=True)


_TWENTIETH = (
    "p AS (SELECT vec_id AS point_id, embedding AS vector, CAST(label AS BIGINT) AS label FROM embeddings), "
    "q AS (SELECT point_id AS query_id, vector, label FROM p WHERE point_id % 20 = 0)"
)
_INDEXED_SQL = f"WITH {_TWENTIETH} SELECT * FROM (" + _top_sql("q", "p", 10, "query_id <> point_id") + ") WHERE rank <= 10"

QUERIES |= {
    "E6_index_exact": (index_exact, _INDEXED_SQL),
    "E7_index_filtered": (
        index_filtered,
        f"WITH {_TWENTIETH}, s AS (SELECT q.query_id, p.point_id, {COSINE.format(a='q.vector', b='p.vector')} AS score FROM q JOIN p ON q.label = p.label "
        "AND query_id <> point_id) SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s "
        "WHERE score >= 0.1 QUALIFY rank <= 4",
    ),
    "R32_index_similar": (
        index_similar,
        "WITH p AS (SELECT vec_id AS point_id, embedding AS vector FROM embeddings), q AS (SELECT point_id AS query_id, vector FROM p) SELECT * FROM ("
        + _top_sql("q", "p", 5, "query_id <> point_id") + ") WHERE rank <= 5",
    ),
    "E6_index_recall": (
        index_recall,
        "SELECT count(*) AS queries, sum(least(10, (SELECT count(*) - 1 FROM embeddings)))::BIGINT AS neighbours, true AS recall_reached, true AS scores_equal "
        "FROM embeddings WHERE vec_id % 20 = 0",
    ),
    "E6_index_grown": (index_grown, _INDEXED_SQL),
}
