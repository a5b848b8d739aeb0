"""The inverted file against all pairs; stores that rewrite and read only the buckets they meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriweave.functions.encoding import hashing_encoder
from veriweave.operators import vector_index, vectors
from veriweave.sources import stores
from veriweave.sources.metadata import discover_database

ROWS = "point_id bigint, vector array<float>, kind string"


def clustered(spark, n=600, dim=12):
    rng = np.random.default_rng(3)
    homes = rng.normal(size=(7, dim))
    rows = []
    for i in range(n):
        v = homes[0 if i % 3 else rng.integers(7)] + rng.normal(size=dim) * rng.choice([0.05, 0.5, 2.0])
        rows.append((i, [float(x) for x in (v * rng.choice([0.5, 1, 40]))], "ab"[i % 2]))
    rows += [(n, [0.0] * dim, "a"), (n + 1, [0.0] * dim, "b"), (n + 2, None, "a"), (n + 3, rows[5][1], "a"), (n + 4, rows[5][1], "b")]
    return spark.createDataFrame(rows, ROWS)


def plain(df):
    return sorted(tuple(r) for r in df.select("query_id", "point_id", "score", "rank").collect())


@pytest.mark.parametrize("k,threshold,equal_on", [(7, None, ()), (4, 0.3, ()), (5, None, ("kind",)), (3, -0.1, ("kind",))])
def test_exact_search_equals_all_pairs(spark, k, threshold, equal_on):
    points = clustered(spark)
    index = vector_index.build_index(points, cells=9)
    asked = points.filter("point_id % 5 = 0").select(F.col("point_id").alias("query_id"), "vector", F.when(F.col("point_id") % 2 == 0, F.col("kind")).alias("kind"))
    want = plain(vectors.nearest(points, asked, k, threshold, equal_on, skip_self=True))
    assert plain(vector_index.nearest(index, asked, k, threshold, equal_on, skip_self=True, exact=True)) == want
    # A third of the points is in one cell: cut in parts, nothing changes.
    cut = vector_index.nearest(index, asked, k, threshold, equal_on, skip_self=True, exact=True, points_per_block=40, queries_per_block=7)
    assert plain(cut) == want


def test_a_full_cell_is_cut_in_few_parts(spark):
    # As parts of 3 queries, the points of this cell would be copied 2000 times.
    parts = vector_index._parts({0: 6000, 1: 8}, 3, 65_536)
    rows = spark.createDataFrame([(0,), (1,), (2,)], "cell int").select("cell", parts.alias("n"))
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 16), (1, 3), (2, 1)]


def test_probes_reach_the_recall_asked_for(spark):
    points = clustered(spark).filter("vector IS NOT NULL")
    index = vector_index.tuned(vector_index.build_index(points, cells=16), 5, recall=0.95)
    asked = points.filter("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector")
    found = vector_index.nearest(index, asked, 5, skip_self=True)
    measured = vector_index.recall(found, vectors.nearest(points, asked, 5, skip_self=True)).first()
    assert measured["recall"] >= 0.9 and index.probes < 16


def test_a_cell_that_cannot_help_is_not_met(spark):
    rng = np.random.default_rng(4)
    homes = np.eye(6)
    rows = [(i, [float(x) for x in homes[i % 6] + rng.normal(size=6) * 0.01], "a") for i in range(120)]
    points = spark.createDataFrame(rows, ROWS)
    index = vector_index.build_index(points, cells=6)
    asked = points.limit(1).select(F.col("point_id").alias("query_id"), "vector", F.lit(0.9).alias("floor"))
    assert vector_index._routes(index, asked, 1, beyond=True).count() == 0
    assert vector_index._routes(index, asked.withColumn("floor", F.lit(-2.0)), 1, beyond=True).count() == 5


def test_index_grows_and_replaces(spark):
    points = clustered(spark).filter("vector IS NOT NULL")
    index = vector_index.build_index(points.filter("point_id < 500"), cells=8)
    moved = points.filter("point_id >= 490").withColumn("vector", F.transform("vector", lambda x: -x))
    grown = vector_index.add_points(index, moved)
    now = points.filter("point_id < 490").unionByName(moved)
    asked = now.filter("point_id % 7 = 0").select(F.col("point_id").alias("query_id"), "vector")
    assert plain(vector_index.nearest(grown, asked, 5, exact=True)) == plain(vectors.nearest(now, asked, 5))
    assert sum(n for n, _ in grown.cells.values()) == now.count()


def test_index_of_nothing(spark):
    nothing = spark.createDataFrame([], ROWS)
    index = vector_index.build_index(nothing)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, vector array<float>")
    assert vector_index.nearest(index, asked, 3, exact=True).count() == 0


def test_one_evaluation_of_the_encoder(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    df = vectors.encode(spark.read.parquet(str(tmp_path / "d")), "text", hashing_encoder(8))
    plan = df.select("doc_id", F.posexplode("vector").alias("place", "w")).filter("w <> 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def documents(spark, n=400):
    return spark.range(n).select(
        F.concat(F.element_at(F.array(F.lit("case_summary_"), F.lit("court_summary_")), (F.col("id") % 2 + 1).cast("int")), "id").alias("document_id"),
        F.element_at(F.array(F.lit("case_summary"), F.lit("court_summary")), (F.col("id") % 2 + 1).cast("int")).alias("document_type"),
        F.concat(F.lit("text "), "id").alias("text"),
    )


def files(store):
    return set(store.read().inputFiles())


def test_a_change_rewrites_the_buckets_it_meets(spark, tmp_path):
    store = stores.document_store(spark, str(tmp_path / "d"), 16)
    store.replace(documents(spark))
    before = files(store)
    newer = spark.createDataFrame([("case_summary_10", "case_summary", "newer"), ("court_summary_9999", "court_summary", "added")], store.read().schema)
    written = store.change(newer, spark.createDataFrame([("court_summary_11",)], "document_id string"))
    after = files(store)
    assert written <= 3 and len(before - after) <= 2 * written and len(before & after) >= 2 * (16 - written)
    rows = {r["document_id"]: r["text"] for r in store.read().collect()}
    assert rows["case_summary_10"] == "newer" and rows["court_summary_9999"] == "added" and "court_summary_11" not in rows and len(rows) == 400
    assert store.change(newer.limit(0)) == 0 and files(store) == after


def test_point_reads_open_one_bucket(spark, tmp_path):
    store = stores.document_store(spark, str(tmp_path / "d"), 16)
    store.replace(documents(spark))
    one = store.lookup(["case_summary_10"])
    assert [r["text"] for r in one.collect()] == ["text 10"] and len(one.inputFiles()) <= 2 < len(files(store))
    ids = spark.createDataFrame([("case_summary_10",), ("court_summary_11",), ("court_summary_11",), ("gone",)], "document_id string")
    assert sorted(r["text"] for r in store.lookup(ids).collect()) == ["text 10", "text 11"]
    assert store.lookup([]).count() == 0 and store.lookup(["gone"]).count() == 0
    # The files carry a bloom filter on the key.
    import pyarrow.parquet as pq

    path = next(iter(files(store))).removeprefix("file:").replace("///", "/").replace("%3D", "=")
    assert pq.ParquetFile(path).metadata.num_rows > 0 and b"document_id" in open(path, "rb").read()


def test_a_write_that_was_not_pointed_to_changes_nothing(spark, tmp_path, monkeypatch):
    store = stores.document_store(spark, str(tmp_path / "d"), 8)
    store.replace(documents(spark, 50))
    before = sorted(map(tuple, store.read().collect()))
    with monkeypatch.context() as m:
        m.setattr(stores.VersionedTable, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.change(documents(spark, 60).withColumn("text", F.lit("half")))
    assert sorted(map(tuple, store.read().collect())) == before
    store.change(documents(spark, 60).withColumn("text", F.lit("whole")))
    assert {r["text"] for r in store.read().collect()} == {"whole"} and store.read().count() == 60


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    store = stores.VersionedTable(spark, str(tmp_path / "wide"), key="document_id", buckets=1)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        store.replace(spark.range(0, 4000, 1, 8).selectExpr("CAST(id AS STRING) AS document_id", "sha2(CAST(id AS STRING), 256) AS text"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len({r[0] for r in store.read().select(F.input_file_name()).collect()}) > 1
    assert store.read().count() == 4000 and store.lookup(["17"]).count() == 1


def test_old_versions_go_and_shared_buckets_stay(spark, tmp_path):
    store = stores.document_store(spark, str(tmp_path / "d"), 8)
    store.replace(documents(spark, 80))
    for i in range(6):
        store.change(documents(spark, 80).filter(f"text = 'text {i}'").withColumn("text", F.lit(f"new {i}")))
    rows = {r["document_id"]: r["text"] for r in store.read().collect()}
    assert len(rows) == 80 and all(rows[f"{'court' if i % 2 else 'case'}_summary_{i}"] == f"new {i}" for i in range(6))
    assert len(list((tmp_path / "d" / "_versions").iterdir())) == 3
    store.delete(store.read().select("document_id"), "document_id")
    assert store.read().count() == 0 and store.read().columns == ["document_id", "document_type", "text"]
    with pytest.raises(ValueError):
        store.upsert(documents(spark, 3), "text")


def test_discovery_passes_over_temporary_views(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS vw_views")
    spark.range(3).write.mode("overwrite").saveAsTable("vw_views.kept")
    spark.range(3).createOrReplaceTempView("only_a_view")
    try:
        assert list(discover_database(spark, "vw_views")) == ["kept"]
    finally:
        spark.catalog.dropTempView("only_a_view")


def test_gram_index_follows_its_texts(spark, tmp_path):
    from veriweave.operators.matching import GramIndex, containing

    frame = lambda column, *values: spark.createDataFrame([(v,) for v in values], f"{column} string")
    index = GramIndex.at(spark, str(tmp_path / "g"), 32)
    index.build(frame("text", "Ramesh Kumar", "Asha", "aaaa", "é ü", ""))
    terms = frame("term", "ram", "Kumar", "a", "aa", "aaa", "é", "zz", "", "Ana")
    changes = [(("Ana Kumar", "aaaa"), ("Asha", "nobody")), (("Ana Kumar",), ("Asha",)), ((), ("aaaa",))]
    texts = {"Ramesh Kumar", "Asha", "aaaa", "é ü", ""}
    for added, removed in changes:
        before = set(index.postings.folders())
        index.update(frame("text", *added), frame("text", *removed))
        assert len(before - set(index.postings.folders())) < 32
        texts = texts - set(removed) | set(added)
        want = sorted(map(tuple, containing(terms, frame("text", *texts)).collect()))
        assert sorted(map(tuple, index.search(terms).collect())) == want
    counts = {r["gram"]: r["n"] for r in index.frequency.read().collect()}
    assert counts["Kum"] == 2 and "aaa" not in counts and "sha" not in counts
