"""Cleaning, enrichment, profiling and validation on small literal tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriweave.operators import cleaning, enrichment, profiling, validation
from veriweave.plans.etl import clean_and_enrich, run_etl
from veriweave.sources.metadata import (
    ColumnRoles,
    ForeignKey,
    ResolutionError,
    TableMeta,
    adjacency,
    coerce_values,
    describe_columns,
    discover_database,
    relationships,
    resolve_columns,
    resolve_table,
    LOGICAL_TABLES,
)

ROLES = ColumnRoles()
CASE_META = TableMeta(
    "CaseMaster", ("case_id",), expected_types={"case_id": "int", "crime_date": "datetime", "latitude": "float"}
)
ACCUSED_META = TableMeta(
    "Accused", ("accused_id",), (ForeignKey("case_id", "CaseMaster", "case_id"),), expected_types={"age": "int"}
)


def case_table(spark):
    rows = [
        (1, "  fir/001/2024  ", "2024-01-15 10:30:00", "  Mysuru  ", "123 Main St", "M", "+91-9876543210", "  A  narrative ", "Open", 19.076, 72.877),
        (2, "FIR/002/2024", "15/02/2024", "Delhi", "456 Oak Ave", "Female", "09876543211", "Another", "Closed", 28.704, 77.102),
        (3, "fir 003 2024", "2024-03-20", "  Udupi  ", "789 Pine Rd", "male", "9876543212", "Third", "Open", 12.972, 77.594),
        (4, "FIR/004/2024", "invalid-date", "NULL", None, "MALE", "91 9876543213", None, "", 91.5, 200.0),
        (5, "FIR/005/2024", "2024-05-01 23:45:00", "Chennai", "321 Elm St", "f", "invalid", "Fifth", "Under Investigation", None, None),
    ]
    return spark.createDataFrame(
        rows,
        "case_id bigint, fir_no string, crime_date string, district string, address string, gender string, phone string, "
        "narrative string, status string, latitude double, longitude double",
    )


def accused_table(spark):
    rows = [(1, 1, "  John Doe  ", "m", "25"), (2, 2, "Jane   Smith", "F", "30"), (3, 3, "Bob", "Male", "35"), (4, 99, "Alice", "FEMALE", None)]
    return spark.createDataFrame(rows, "accused_id bigint, case_id bigint, name string, gender string, age string")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def one_column(spark, name, items):
    return spark.createDataFrame([(v,) for v in items], f"{name} string")


def test_null_tokens(spark):
    df = one_column(spark, "v", ["NULL", "N/A", "none", "", "actual_value", "-", " .\t"])
    assert values(cleaning.normalise_nulls(df, CASE_META, ROLES), "v") == [None, None, None, None, "actual_value", None, None]


def test_spaces_leave_evidence_alone(spark):
    df = spark.createDataFrame([("  a \t b ", "  kept  as is ")], "city string, narrative string")
    out = cleaning.collapse_spaces(cleaning.trim_spaces(df, CASE_META, ROLES), CASE_META, ROLES).first()
    assert out["city"] == "a b" and out["narrative"] == "  kept  as is "


def test_gender_phone_code(spark):
    genders = cleaning.normalise_gender(one_column(spark, "gender", ["M", "Female", "male", "MALE", "f", "Other", "x"]), CASE_META, ROLES)
    assert values(genders, "gender") == ["Male", "Female", "Male", "Male", "Female", "Other", "x"]
    phones = one_column(spark, "phone", ["+91-9876543210", "09876543211", "9876543212", "91 9876543213", "invalid"])
    assert values(cleaning.normalise_phones(phones, CASE_META, ROLES), "phone") == [
        "9876543210", "9876543211", "9876543212", "9876543213", "invalid",
    ]
    codes = one_column(spark, "fir_no", ["  fir/001/2024  ", "a \t b"])
    assert values(cleaning.normalise_codes(codes, CASE_META, ROLES), "fir_no") == ["FIR/001/2024", "A B"]


@pytest.mark.parametrize("text, iso", [
    ("2024-1-5", "2024-01-05T00:00:00"), ("5-2-2024", "2024-02-05T00:00:00"), ("05/02/2024", "2024-02-05T00:00:00"),
    ("02/15/2024", "2024-02-15T00:00:00"), ("2024/2/5", "2024-02-05T00:00:00"), ("05-feb-2024", "2024-02-05T00:00:00"),
    ("5 Feb 2024", "2024-02-05T00:00:00"), ("5 February 2024", "2024-02-05T00:00:00"),
    ("2024-02-05 10:11:12", "2024-02-05T10:11:12"), ("5/2/2024 1:2:3", "2024-02-05T01:02:03"), ("32/13/2024", "32/13/2024"),
])
def test_date_spellings(spark, text, iso):
    out = cleaning.normalise_dates(one_column(spark, "crime_date", [f" {text} "]), CASE_META, ROLES).first()[0]
    assert out == (iso if iso != text else f" {text} ")


def test_chain_and_enrichment(spark):
    raw = case_table(spark).unionByName(case_table(spark).limit(1))
    rows = {r["case_id"]: r for r in clean_and_enrich(raw, CASE_META).collect()}
    assert len(rows) == 5
    assert rows[1]["crime_date"] == dt.datetime(2024, 1, 15, 10, 30) and rows[4]["crime_date"] is None
    assert rows[1]["narrative"] == "  A  narrative " and rows[4]["district"] is None and rows[4]["status"] is None
    assert (rows[2]["crime_year"], rows[2]["crime_month"], rows[2]["crime_week"], rows[2]["crime_weekday"]) == (2024, 2, 7, "Thursday")
    assert rows[5]["is_night_crime"] and not rows[1]["is_night_crime"] and not rows[4]["is_weekend"]
    assert rows[1]["canonical_address"] == "Mysuru, 123 Main St"
    assert "crime_weekday: Monday" in rows[1]["search_text"] and "canonical_address: Mysuru" in rows[1]["search_text"]


def test_duplicates_are_judged_before_numbers(spark):
    df = spark.createDataFrame([("35",), ("35.0",), ("35",), ("abc",)], "age string")
    out = cleaning.clean(df, TableMeta("t", expected_types={"age": "int"}))
    assert sorted(values(out, "age"), key=str) == [35.0, 35.0, None]


def test_added_cleaner_runs_last(spark):
    extra = cleaning.DEFAULT_CLEANERS + (lambda df, meta, roles: df.withColumn("seen", F.lit(1)),)
    assert "seen" in cleaning.clean(accused_table(spark), ACCUSED_META, cleaners=extra).columns


def test_duration(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 16))], "from_time timestamp, to_time timestamp")
    assert enrichment.add_duration(df, CASE_META, ROLES).first()["incident_duration_hours"] == 6.0


def test_profile_findings(spark):
    found = {(r["column_name"], r["metric"]): r["value"] for r in profiling.profile(case_table(spark), CASE_META).collect()}
    assert found[("", "rows")] == 5 and found[("", "duplicate_rows")] == 0 and found[("", "duplicate_count")] == 0
    assert found[("address", "missing")] == 1 and found[("crime_date", "invalid_dates")] == 1
    assert found[("fir_no", "leading_trailing_spaces")] == 1 and found[("narrative", "multiple_spaces")] == 1
    assert found[("latitude", "out_of_range")] == 1 and found[("longitude", "out_of_range")] == 1
    assert found[("gender", "unique_count")] == 5


@pytest.mark.parametrize("seed, shape", [(1, "normal"), (2, "ties"), (3, "wide")])
def test_quantiles_equal_numpy(spark, seed, shape):
    rng = np.random.default_rng(seed)
    data = {"normal": rng.normal(size=997), "ties": rng.integers(0, 4, 500).astype(float),
            "wide": np.concatenate([10.0 ** rng.uniform(-30, 30, 300), [-1e18]])}[shape]
    df = spark.createDataFrame([("c", float(v)) for v in data], "column_name string, value double")
    for row in profiling.quantiles(df, (0.0, 0.25, 0.5, 0.75, 1.0)).collect():
        assert row["quantile"] == pytest.approx(np.quantile(data, row["p"]), rel=1e-12)


def test_outliers_need_ten_values_and_spread(spark):
    few = spark.createDataFrame([(float(i),) for i in range(9)] , "x double")
    flat = spark.createDataFrame([(1.0,)] * 20 + [(9.0,)], "x double")
    assert profiling.iqr_outliers(few).count() == 0 and profiling.iqr_outliers(flat).count() == 0
    spread = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,)], "x double")
    assert profiling.iqr_outliers(spread).first()["outlier_count"] == 1


def test_validation(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    row = validation.primary_key(ids, TableMeta("t", ("id",))).first()
    assert (row["status"], row["violations"], row["errors"]) == ("fail", 2, 1)
    tables = {"CaseMaster": case_table(spark), "Accused": accused_table(spark)}
    fk = validation.foreign_keys(tables["Accused"], ACCUSED_META, tables).first()
    assert (fk["violations"], fk["detail"]) == (1, "99")
    skipped = validation.foreign_keys(tables["Accused"], ACCUSED_META, {}).first()
    assert (skipped["status"], skipped["warnings"]) == ("skipped", 1)
    dates = spark.createDataFrame([(dt.datetime(1800, 1, 1),), (dt.datetime(2040, 1, 1),), (dt.datetime(2024, 1, 1),)], "d timestamp")
    assert validation.date_ranges(dates).first()["violations"] == 2
    wrong = validation.unexpected_categories(one_column(spark, "gender", ["Male", "Unknown", "XYZ", None]), "gender")
    assert sorted(values(wrong, "value")) == ["Unknown", "XYZ"]
    types = validation.data_types(tables["Accused"], ACCUSED_META).first()
    assert (types["column_name"], types["warnings"]) == ("age", 1)
    totals = {r["table_name"]: r for r in validation.report(validation.validate_all(
        tables, {"CaseMaster": CASE_META, "Accused": ACCUSED_META})).collect()}
    assert totals["Accused"]["total_errors"] == 1 and totals["CaseMaster"]["total_errors"] == 2


def test_metadata(spark):
    declared = {"CaseMaster": CASE_META, "Accused": ACCUSED_META}
    columns = describe_columns(spark, {"Accused": accused_table(spark)}, declared)
    assert columns.filter("is_foreign_key").first()["column_name"] == "case_id"
    graph = {r["table_name"]: r["related_tables"] for r in adjacency(relationships(spark, declared)).collect()}
    assert graph == {"Accused": ["CaseMaster"], "CaseMaster": []}
    typed = coerce_values(one_column(spark, "k", [" 12 ", "x", "-3", "1.5", None]), "k", "bigint")
    assert [tuple(r) for r in typed.select("coerced", "is_valid").collect()] == [
        (12, True), (None, False), (-3, True), (None, False), (None, False)]
    with pytest.raises(ResolutionError, match="case_number"):
        resolve_columns(spark.createDataFrame([(1,)], "CaseMasterID bigint"), LOGICAL_TABLES["CaseMaster"])


def test_etl_run_and_name_resolution(spark, tmp_path):
    spark.sql(f"CREATE DATABASE vw_test LOCATION '{tmp_path}/vw_test'")
    tables = {"CaseMaster": case_table(spark), "Accused": accused_table(spark)}
    run = run_etl(spark, tables, {"CaseMaster": CASE_META, "Accused": ACCUSED_META}, "vw_test", str(tmp_path))
    summary = run.summary.first()
    assert (summary["tables_loaded"], summary["total_rows_loaded"], summary["relationships_discovered"]) == (2, 9, 1)
    assert spark.read.json(f"{tmp_path}/validation").count() == run.checks.count()
    assert "clean_casemaster" in {n.lower() for n in discover_database(spark, "vw_test")}
    assert resolve_table(spark, "Accused", "vw_test", "vw_none").count() == 4
    with pytest.raises(ResolutionError, match="vw_test.clean_Nothing"):
        resolve_table(spark, "Nothing", "vw_test", "vw_test", require_clean=True)
