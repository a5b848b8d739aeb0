"""Vectors, query texts, ranking, contexts, sync and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriweave.functions.encoding import hashing_encoder
from veriweave.operators import analytics, context, querytext, ranking, vectors
from veriweave.plans import corpus, retrieval
from veriweave.sources.metadata import TableMeta
from veriweave.sources.stores import VersionedTable
from veriweave.streaming.streams import clean_stream, deduplicate_stream, sync_stream, usage_by_window



def now():
    return F.lit("2024-12-01 00:00:00").cast("timestamp")

META = "struct<updated_at: string, district: string, crime_year: bigint>"


def hits(spark, *rows):
    full = [("q", i + 1, score, doc, kind, text, meta or (None, None, None)) for i, (score, doc, kind, text, meta) in enumerate(rows)]
    return spark.createDataFrame(
        full, f"query_id string, rank bigint, score double, document_id string, document_type string, text_preview string, metadata {META}"
    )


def order(df):
    return [r["document_id"] for r in df.orderBy("rank").collect()]


def test_type_priority_beats_similarity(spark):
    ranked = ranking.rank(hits(spark, (0.95, "d2", "court_summary", "", None), (0.9, "d1", "case_summary", "", None)), now())
    assert order(ranked) == ["d1", "d2"]
    assert "high priority type (case_summary)" in ranked.filter("rank = 1").first()["explanation"]["ranking_reason"]


def test_newer_document_first(spark):
    old, new = ("2023-12-02T00:00:00+00:00", None, None), ("2024-12-01T00:00:00+00:00", None, None)
    ranked = ranking.rank(hits(spark, (0.8, "old", "case_summary", "", old), (0.8, "new", "case_summary", "", new),
                               (0.8, "odd", "case_summary", "", ("soon", None, None))), now())
    assert order(ranked)[0] == "new"
    assert {r["document_id"]: r["freshness"] for r in ranked.collect()} == {"old": 0.0, "new": 1.0, "odd": 0.5}


def test_graph_support(spark):
    triples = spark.createDataFrame([("q", 0, "Other: thing", "R", "x"), ("q", 1, "Case: case_123", "HAS_ACCUSED", "John Doe")],
                                    "query_id string, triple_no int, node string, relationship string, connected_to string")
    ranked = ranking.rank(hits(spark, (0.8, "case_456", "case_summary", "", None), (0.8, "case_123", "case_summary", "", (None, "Udupi", 2021))), now(), triples)
    first = ranked.filter("rank = 1").first()
    assert (first["document_id"], first["graph_confidence"], first["graph_relationship"]) == ("case_123", 1.0, "HAS_ACCUSED")
    entities = spark.createDataFrame([("q", "Udupi", 2021)], "query_id string, district string, year bigint")
    reason = ranking.explain_matches(ranked, entities).filter("rank = 1").first()["explanation"]["ranking_reason"]
    assert reason == ("High semantic similarity to query. Matched entities: District (Udupi), Year (2021). "
                      "Corroborated by graph relationship (HAS_ACCUSED).")


def ranked_rows(spark, *rows):
    return spark.createDataFrame([("q", *r) for r in rows],
                                 "query_id string, rank bigint, final_score double, document_id string, document_type string, text_preview string")


def test_context_groups_and_duplicates(spark):
    rows = ranked_rows(spark, (1, 0.9, "c1", "case_summary", "Case 1 text"), (2, 0.8, "a1", "accused_profile", "Accused 1 text"),
                       (3, 0.7, "c2", "case_summary", "Case 2 text"), (4, 0.6, "c1", "case_summary", "again"))
    text = context.build_context(rows).first()["context"]
    assert text == (
        "=== RETRIEVED CONTEXT ===\n\n--- Case Summaries (2 documents) ---\n\n[1] (Score: 0.9) Case Summary c1\nCase 1 text\n\n\n"
        "[3] (Score: 0.7) Case Summary c2\nCase 2 text\n\n\n--- Accused Profiles (1 document) ---\n\n"
        "[2] (Score: 0.8) Accused Profile a1\nAccused 1 text\n\n\n=== END CONTEXT ===")
    triples = spark.createDataFrame([("q", 0, "Case: c1", "HAS_ACCUSED", "John Doe"), ("q", 1, "Case: c1", "HAS_ACCUSED", "John Doe")],
                                    "query_id string, triple_no int, node string, relationship string, connected_to string")
    merged = context.build_hybrid_context(rows, triples).first()["context"]
    assert merged.count("• Case: c1 -[HAS_ACCUSED]-> John Doe") == 1 and merged.endswith("\n\n=== END CONTEXT ===")
    assert merged.startswith(text[: -len("\n=== END CONTEXT ===")])


def test_context_cuts_the_document_that_does_not_fit(spark):
    long = "Very long text that will definitely exceed the small token limit we just set above because it keeps going and going and going."
    assert "... [TRUNCATED]" in context.build_context(ranked_rows(spark, (1, 0.9, "c1", "case_summary", long)), 45).first()["context"]
    assert "TRUNCATED" not in context.build_context(ranked_rows(spark, (1, 0.9, "c1", "case_summary", long)), 30).first()["context"]


@pytest.mark.parametrize("text, expected", [
    ("Show cases in Mysuru", {"district": "Mysuru", "document_type": "case_summary"}),
    ("What happened in bangalore?", {"district": "Bengaluru"}), ("Bengaluru Rural", {"district": "Bengaluru"}),
    ("Show theft in udupi", {"crime_type": "theft", "district": "Udupi"}), ("Robbery in 2023", {"year": 2023, "crime_type": "robbery"}),
    ("Details for cr/123/2023 and fir no 456", {"case_numbers": ["cr/123/2023", "fir no 456"]}),
    ("Cases under ipc 302 and sec 420", {"ipc_sections": ["302", "420"]}),
    ("Accused ramesh kumar was arrested by inspector sharma", {"names": ["Sharma", "Ramesh Kumar"], "document_type": "accused_profile"}),
    ("Show officer profiles for bengaluru", {"document_type": "officer_profile", "district": "Bengaluru"}),
])
def test_entities(spark, text, expected):
    row = querytext.extract_entities(spark.createDataFrame([(text,)], "processed string")).first()
    for key, value in expected.items():
        assert row[key] == value


def test_query_text(spark):
    df = spark.createDataFrame([("  The FIR  of  ＰＳ x ",), (None,), ("firm",)], "text string")
    assert [r[0] for r in querytext.process(df, "text").select("processed").collect()] == [
        "the first information report of police station x", "", "firm"]


@pytest.mark.parametrize("path", ["broadcast", "blocks"])
def test_nearest_equals_brute_force(spark, path):
    rng = np.random.default_rng(5)
    base = rng.integers(-2, 3, size=(60, 4)).astype(float)  # small integers: many equal scores and zero vectors
    points = spark.createDataFrame([(i, [float(x) for x in v], f"g{i % 3}") for i, v in enumerate(base)], "point_id bigint, vector array<float>, grp string")
    queries = points.select(F.col("point_id").alias("query_id"), "vector", F.when(F.col("point_id") % 2 == 0, F.col("grp")).alias("grp"))
    got = {}
    blocks = {} if path == "broadcast" else {"broadcast_queries": 7, "points_per_block": 9}
    for r in vectors.nearest(points, queries, 4, 0.1, ("grp",), skip_self=True, **blocks).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["point_id"], r["score"]))
    norm = np.linalg.norm(base, axis=1, keepdims=True)
    unit = np.divide(base, norm, out=np.zeros_like(base), where=norm > 0)
    for q in range(60):
        want = sorted((-round(float(unit[q] @ unit[p]), 6), p) for p in range(60)
                      if p != q and round(float(unit[q] @ unit[p]), 6) >= 0.1 and (q % 2 or p % 3 == q % 3))[:4]
        assert [(p, s) for _, p, s in sorted(got.get(q, []))] == [(p, pytest.approx(-s)) for s, p in want]


def test_few_large_blocks_where_there_would_be_many():
    # Each side is copied once for every block of the other.
    assert [vectors.blocks_of(n, 50_000, vectors.LARGE_POINT_BLOCK) for n in (0, 1, 50_000, 500_000, 3_000_000, 4_000_000)] == [1, 1, 1, 10, 16, 20]
    assert vectors.blocks_of(100_000, 3, 200_000) == vectors.FEW_BLOCKS


@pytest.mark.parametrize("skip_self", [False, True])
def test_best_of_many_tiles_with_copies_and_repeated_ids(skip_self):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 3, size=(90, 5)).astype(float)
    points, queries = vectors._unit(list(base[rng.integers(90, size=2600)])), vectors._unit(list(base[rng.integers(90, size=300)]))
    points[7] = np.nan
    ids, asked = rng.integers(1300, size=2600), rng.integers(1300, size=300)
    key, wanted = rng.integers(1, 3, size=2600), rng.integers(0, 3, size=300)
    assert len(vectors._few_copies(ids, points, 6)) <= 90 * 6 + 1
    at, found, scores = vectors._best(asked, queries, [wanted], ids, points, [key], 6, 0.2, skip_self)
    cosines = np.nan_to_num(queries @ points.T, nan=-1)
    for q in range(300):
        want = sorted((-round(float(s), 6), int(i)) for s, i, k in zip(cosines[q], ids, key)
                      if s >= 0.2 and wanted[q] in (0, k) and not (skip_self and i == asked[q]))[:6]
        assert [(i, s) for i, s in zip(found[at == q], scores[at == q])] == [(i, pytest.approx(-s)) for s, i in want]


def test_vector_checks_and_filters(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("t", [1.0, 2.0]), (" ", [1.0, 2.0]), ("t", None), ("t", [1.0]), ("t", [nan, inf])], "text string, vector array<double>")
    assert [len(r["issues"]) for r in vectors.check_vectors(df, "text", "vector", 2).collect()] == [0, 1, 1, 1, 2]
    tagged = spark.createDataFrame([("a", [1]), ("b", []), (None, None)], "k string, tags array<int>")
    assert vectors.filter_points(tagged, {"k": ["a", "b"], "tags": None}).first()["k"] == "b"
    assert vectors.filter_points(tagged, {"k": None}).count() == 1 and vectors.filter_points(tagged, {}).count() == 3


def test_change_detection(spark):
    store = spark.createDataFrame([("doc1", "v1"), ("doc2", "v2"), ("doc4", "v1")], "document_id string, version string")
    manifest = spark.createDataFrame([("doc1", "v1", "m"), ("doc2", "v1", "m"), ("doc3", "v1", "m")], "document_id string, version string, model string")
    assert {r["document_id"]: r["change"] for r in vectors.detect_changes(store, manifest, "m").collect()} == {
        "doc1": "unchanged", "doc2": "modified", "doc3": "deleted", "doc4": "new"}
    other = vectors.change_counts(vectors.detect_changes(store, manifest, "m2")).first()
    assert (other["modified_documents"], other["unchanged_documents"]) == (2, 0)


def documents(spark, *rows):
    names = {source: None for source in vectors.PAYLOAD.values()}
    fields = ", ".join(f"{n} string" for n in names)
    data = [(i, i.rsplit("_", 1)[0], t, tuple({**names, "document_id": i, "document_type": i.rsplit("_", 1)[0], "updated_at": u}[n] for n in names)) for i, t, u in rows]
    return spark.createDataFrame(data, f"document_id string, document_type string, text string, metadata struct<{fields}>")


def test_sync_encodes_only_what_changed(spark, tmp_path):
    points, manifest = (VersionedTable(spark, str(tmp_path / n)) for n in ("points", "manifest"))
    load = hashing_encoder(8)
    first = documents(spark, ("case_summary_1", "one two", "a"), ("case_summary_2", "two", "a"), ("case_summary_3", " ", "a"))
    counts = corpus.build_points(first, points, manifest, load, 8, "m").first()
    assert (counts["documents_processed"], counts["valid"], counts["errors"]) == (3, 2, 1)
    again = documents(spark, ("case_summary_1", "one two", "b"), ("case_summary_4", "four", "b"))
    done = corpus.sync_points(again, points, manifest, load, 8, "m").first()
    assert (done["new_documents"], done["modified_documents"], done["deleted_documents"], done["unchanged_documents"]) == (1, 0, 1, 1)
    assert sorted(r[0] for r in points.read().select("document_id").collect()) == ["case_summary_1", "case_summary_4"]
    assert manifest.read().count() == 2
    by_time = corpus.sync_points(documents(spark, ("case_summary_1", "one two", "c")), points, manifest, load, 8, "m", by="updated_at").first()
    assert by_time["modified_documents"] == 1


def test_search_pipelines(spark):
    load = hashing_encoder(64)
    points = vectors.points_of(documents(spark, ("case_summary_1", "stolen laptop from cafe", None), ("case_summary_2", "burnt barn", None),
                                         ("court_summary_3", "stolen laptop", None)), load, 64)
    queries = spark.createDataFrame([(1, "Stolen LAPTOP"), (2, "zzz")], "query_id bigint, text string")
    options = retrieval.SearchOptions(now=now(), top_k=5, threshold=0.3)
    ranked, text = retrieval.query(points, queries, load, options)
    assert [r["document_id"] for r in ranked.filter("query_id = 1").orderBy("rank").collect()] == ["court_summary_3", "case_summary_1"]
    assert "--- Case Summaries (1 document) ---" in text.filter("query_id = 1").first()["context"]
    assert retrieval.explain(ranked, 1).first()["document_id"] == "case_summary_1"
    assert retrieval.similar_cases(points, 1).count() == 2


def test_fingerprint_ignores_filter_order(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({"a": "2"},)], "f map<string,string>")
    keys = [r[0] for r in df.select(analytics.fingerprint(F.lit("q"), F.col("f"), F.lit(None), F.lit(None))).collect()]
    assert keys[0] == keys[1] != keys[2]


def run_stream(writer, folder):
    query = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_streams(spark, tmp_path):
    schema = "row_id bigint, gender string, created_at timestamp"
    rows = [(1, " m ", dt.datetime(2024, 1, 6, 23)), (1, " m ", dt.datetime(2024, 1, 6, 23, 1)), (2, "N/A", dt.datetime(2024, 1, 8, 12))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    cleaned = clean_stream(source, TableMeta("t"))
    run_stream(cleaned.writeStream.format("memory").queryName("vw_clean"), tmp_path / "c1")
    out = sorted(spark.table("vw_clean").select("gender", "is_weekend", "is_night_crime").collect(), key=str)
    assert [tuple(r) for r in out] == [("Male", True, True), ("Male", True, True), (None, False, False)]
    unique = deduplicate_stream(source, "created_at", "1 hour")
    run_stream(unique.writeStream.format("memory").queryName("vw_unique"), tmp_path / "c2")
    assert spark.table("vw_unique").count() == 3  # rows that differ in time are no copies
    log = source.selectExpr("created_at AS ts", "gender = 'N/A' AS cache_hit", "CAST(row_id AS DOUBLE) AS search_time_ms")
    run_stream(usage_by_window(log, "ts", "10 minutes", "1 hour").writeStream.outputMode("complete").format("memory").queryName("vw_usage"), tmp_path / "c3")
    assert {r["window"]["start"].hour: (r["total_queries"], r["cache_hits"]) for r in spark.table("vw_usage").collect()} == {23: (2, 0), 12: (1, 1)}


def test_sync_stream(spark, tmp_path):
    store, points, manifest = (VersionedTable(spark, str(tmp_path / n)) for n in ("docs", "points", "manifest"))
    load = hashing_encoder(8)
    seed = documents(spark, ("case_summary_1", "one", "a"))
    store.replace(seed)
    corpus.build_points(store.read(), points, manifest, load, 8, "m")
    documents(spark, ("case_summary_1", "changed", "b"), ("case_summary_2", "two", "b")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seed.schema).parquet(str(tmp_path / "in"))
    run_stream(sync_stream(stream, store, points, manifest, load, 8, "m"), tmp_path / "c")
    assert {r["document_id"]: r["text_preview"] for r in points.read().collect()} == {"case_summary_1": "changed", "case_summary_2": "two"}
