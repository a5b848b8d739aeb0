"""The cleaning run: read, profile, clean, enrich, validate, load, summarise."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veriweave.operators.cleaning import clean
from veriweave.operators.enrichment import enrich
from veriweave.operators.profiling import profile_all
from veriweave.operators.validation import report, run_summary, validate_all
from veriweave.sources.metadata import ColumnRoles, TableMeta
from veriweave.sources.tables import load_clean_table, write_report


@dataclass(frozen=True)
class PipelineRun:
    """What a run hands on: the cleaned tables and its reports."""

    tables: Mapping[str, DataFrame]
    profile: DataFrame
    checks: DataFrame
    report: DataFrame
    summary: DataFrame


def clean_and_enrich(df: DataFrame, meta: TableMeta, roles: ColumnRoles | None = None) -> DataFrame:
    """One table cleaned (C11) and enriched (T8), still lazy."""
    return enrich(clean(df, meta, roles), meta, roles)


def load_all(
    spark: SparkSession, raw: Mapping[str, DataFrame], declared: Mapping[str, TableMeta], database: str, roles: ColumnRoles | None = None
) -> tuple[DataFrame, Exception | None]:
    """Clean, enrich and load every table, with what was measured of each, and the failure that ended the run if one did (V9).

    Facts: table_name, rows_read, rows_loaded, error. Rows read are counted by a scan of their
    own, for which Parquet reads footers only; rows loaded are observed on the plan that
    writes them, in its last stage, where a task that is repeated counts once.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    rows, failed = [], None
    for name, df in raw.items():
        read = loaded = error = None
        if failed is None:
            try:
                read = df.count()
                loaded = load_clean_table(clean_and_enrich(df, declared.get(name, TableMeta(name)), roles), name, database)
            except Exception as cause:
                failed, error = cause, f"{name}: {str(cause).splitlines()[0] if str(cause) else type(cause).__name__}"
        rows.append((name, read, loaded, error))
    return spark.createDataFrame(rows, "table_name string, rows_read bigint, rows_loaded bigint, error string"), failed


def run_etl(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    declared: Mapping[str, TableMeta],
    database: str,
    report_folder: str | None = None,
    roles: ColumnRoles | None = None,
) -> PipelineRun:
    """A full run over the given tables; any failing table fails the run, after its summary is written.

    The cleaned tables are written first and the checks read them back, so nothing
    is cleaned twice and a lost executor costs no more than its own tasks.
    """
    facts, failed = load_all(spark, raw, declared, database, roles)
    summary = run_summary(facts, {n: declared.get(n, TableMeta(n)) for n in raw})
    if failed is not None:
        if report_folder:
            write_report(summary, report_folder, "summary")
        raise failed
    tables = {n: spark.table(f"{database}.clean_{n}") for n in raw}
    findings = profile_all(raw, declared)
    checks = validate_all(tables, declared, roles)
    totals = report(checks)
    if report_folder:
        for name, rows in (("profile", findings), ("validation", checks), ("summary", summary)):
            write_report(rows, report_folder, name)
    return PipelineRun(tables, findings, checks, totals, summary)
