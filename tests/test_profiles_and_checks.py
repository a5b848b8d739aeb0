"""Profiles from sketches and by hashes; all checks from one scan; runs that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_quality import ACCUSED_META, CASE_META, accused_table, case_table
from veriweave.operators import profiling, sketches, validation
from veriweave.plans.etl import run_etl
from veriweave.sources.metadata import ForeignKey, TableMeta


def numbers(spark, n=20_000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i % 5, float(x), f"w{int(k)}" if k < 500 else None) for i, (x, k) in enumerate(zip(rng.normal(size=n) * 10, rng.zipf(1.5, size=n)))]
    return spark.createDataFrame(rows, "day int, x double, word string")


def told(df):
    return {(r["column_name"], r["metric"]): r for r in df.collect()}


def test_merged_sketches_are_those_of_the_union(spark):
    df = numbers(spark)
    by_day = sketches.sketch(df, by=["day"])
    assert by_day.count() == 10
    merged = told(sketches.estimates(sketches.merge(by_day)))
    at_once = told(sketches.estimates(sketches.sketch(df, columns=["x", "word"])))
    rows = df.collect()
    x = np.array([r["x"] for r in rows])
    words = [r["word"] for r in rows if r["word"]]
    for found in (merged, at_once):
        assert found["x", "rows"]["value"] == len(rows) and found["word", "missing"]["value"] == len(rows) - len(words)
        assert found["x", "min"]["value"] == x.min() and found["x", "max"]["value"] == x.max()
        assert found["x", "mean"]["value"] == pytest.approx(x.mean()) and found["x", "std"]["value"] == pytest.approx(x.std(ddof=1))
        for c, n in (("x", len(set(x))), ("word", len(set(words)))):
            assert found[c, "unique_count"]["lower"] <= n <= found[c, "unique_count"]["upper"]
        for p, metric in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            assert abs((x <= found["x", metric]["value"]).mean() - p) <= 2 * sketches.RANK_ERROR
        q1, q3 = np.quantile(x, [0.25, 0.75])
        outside = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
        assert found["x", "outliers"]["lower"] <= outside <= found["x", "outliers"]["upper"]
        top = max(set(words), key=words.count)
        assert found["word", f"top: {top}"]["lower"] <= words.count(top) <= found["word", f"top: {top}"]["upper"]


def test_a_part_profiled_again_replaces_its_own(spark, tmp_path):
    df = numbers(spark, 3000)
    store = sketches.sketch_store(spark, str(tmp_path / "s"), 4)
    sketches.store_parts(store, df.withColumn("x", F.lit(5.0)).filter("day < 2"), F.col("day"))
    before = set(store.folders())
    sketches.store_parts(store, df.filter("day = 3"), F.col("day"))
    assert len(before - set(store.folders())) <= 1
    sketches.store_parts(store, df, F.col("day"))
    found = told(sketches.estimates(sketches.merge(store.read())))
    assert found["x", "rows"]["value"] == 3000 and found["x", "min"]["value"] == df.agg(F.min("x")).first()[0]
    one_day = told(sketches.estimates(store.read().filter("part = '3'")))
    assert one_day["x", "rows"]["value"] == 600


def test_sketches_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, float("nan"), None), (1, None, "é" * 500), (None, 2.0, "")], "a int, b double, c string")
    found = told(sketches.estimates(sketches.merge(sketches.sketch(odd))))
    assert found["a", "missing"]["value"] == 2 and found["b", "max"]["value"] == 2.0 and found["c", "length_max"]["value"] == 500
    empty = told(sketches.estimates(sketches.sketch(odd.limit(0))))
    assert empty["a", "rows"]["value"] == 0 and ("a", "median") not in empty


def test_top_values_of_long_texts_that_begin_alike(spark):
    start = "x" * 80
    rows = [start + "b"] * 3 + [start + "a"] * 3 + [start + c for c in "zyxwvu"] + ["short"] * 2 + [None, "", ""]
    df = spark.createDataFrame([(v,) for v in rows], "t string")
    got = [(r["value"], r["n"]) for r in sorted(profiling.top_values(df).collect(), key=lambda r: r["rank"])]
    assert got == [(start + "a", 3), (start + "b", 3), ("", 2), ("short", 2), (start + "u", 1)]
    assert profiling.column_statistics(df, ["t"]).filter("metric = 'unique_count'").first()["value"] == 10


def test_duplicate_rows_with_missing_values(spark):
    rows = [(None, "a"), ("a", None), (None, "a"), (None, None), (None, None), ("a", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert profiling.duplicate_rows(df).first()[0] == 2
    found = {(r["check"], r["metric"]): r["value"] for r in profiling.profile(df, TableMeta("t", ("x",))).collect()}
    assert found["duplicates", "duplicate_rows"] == 2 and found["duplicates", "duplicate_count"] == 6


def comparable(df):
    return sorted(tuple(str(r[c]) for c in ("table_name", "check", "column_name", "status", "violations", "errors", "warnings", "detail")) for r in df.collect())


def test_one_scan_tells_what_the_checks_tell_one_by_one(spark):
    people = spark.createDataFrame(
        [(1, 1, "Male", 10.0), (1, 2, "M", 99.0), (2, 7, None, None), (None, 8, "x", 11.5), (None, None, "Female", 1.0), (3, 8, "x", 2.0)],
        "id bigint, case_id bigint, gender string, score double",
    )
    meta = TableMeta("People", ("id",), (ForeignKey("case_id", "CaseMaster", "case_id"), ForeignKey("score", "Numbers", "n"), ForeignKey("id", "Nowhere", "id")), required=("gender",))
    pairs = spark.createDataFrame([(1, None), (1, None), (None, "1"), (2, "a")], "a bigint, b string")
    tables = {"CaseMaster": case_table(spark), "Accused": accused_table(spark), "People": people, "Pairs": pairs, "Numbers": spark.createDataFrame([(10,), (1,), (None,)], "n int")}
    declared = {"CaseMaster": CASE_META, "Accused": ACCUSED_META, "People": meta, "Pairs": TableMeta("Pairs", ("a", "b"))}
    one_by_one = [validation.validate(df, declared.get(n, TableMeta(n)), tables) for n, df in tables.items()]
    want = sorted(x for df in one_by_one for x in comparable(df))
    got = comparable(validation.validate_all(tables, declared))
    assert [g for g in got if "score" not in g] == [w for w in want if "score" not in w]
    # Whole numbers of two types are compared as numbers.
    score = next(g for g in got if g[2] == "score" and g[1] == "fk_integrity")
    assert score[4] == "3"
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert all(r[4] == "0" for r in comparable(validation.validate_all(empty, declared)) if r[1] != "data_types")


def test_each_table_is_scanned_once(spark, tmp_path, monkeypatch):
    for n, df in (("CaseMaster", case_table(spark)), ("Accused", accused_table(spark))):
        df.write.parquet(str(tmp_path / n))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("CaseMaster", "Accused")}
    plans = []
    kept = validation.staged
    monkeypatch.setattr(validation, "staged", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    validation.validate_all(tables, {"CaseMaster": CASE_META, "Accused": ACCUSED_META})
    assert len(plans) == 1 and plans[0].count("FileScan parquet") == 2


def test_a_run_with_a_failing_table_tells_so(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS vw_failing LOCATION '{tmp_path}/db'")
    broken = accused_table(spark).withColumn("name", F.raise_error(F.lit("no such page")).cast("string"))
    tables = {"CaseMaster": case_table(spark).unionByName(case_table(spark).limit(1)), "Accused": broken, "Later": case_table(spark)}
    with pytest.raises(Exception, match="no such page"):
        run_etl(spark, tables, {"CaseMaster": CASE_META, "Accused": ACCUSED_META}, "vw_failing", str(tmp_path))
    row = spark.read.json(f"{tmp_path}/summary").first()
    assert (row["status"], row["tables_discovered"], row["tables_extracted"], row["tables_loaded"]) == ("failed", 3, 2, 1)
    assert (row["total_rows_read"], row["total_rows_loaded"], row["total_rows_rejected"]) == (10, 5, 1) and row["error"].startswith("Accused: ")
