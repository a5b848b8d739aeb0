"""Profiles that can be kept and put together: mergeable sketches per column.

One aggregation over a table gives a row per column with its counts and three sketches: distinct
values, quantiles, and frequent values. No value is shuffled, only sketches are, and their size
does not depend on the table. Sketches of parts of a table (a day, a source) are stored by part, a
part that is profiled again replaces its own, and any parts merge to the profile of their union.

Numbers are described by their values, all other columns by the lengths of their texts; distinct
and frequent values are those of the text. How far the estimates may be off:

* distinct values: a standard error of ``DISTINCT_ERROR`` of the value (HyperLogLog, 2**14 registers);
* quantiles: ranks are off by at most ``RANK_ERROR`` of the rows, with 99 % confidence (KLL); outliers by that and 1 / ``GRID`` at both fences;
* frequent values: counts are off by at most 3.5 / ``TRACKED`` of the rows, and every value above that is listed.
  Texts are told by their first ``HEAD`` characters; those that begin alike count together.

Counts, least, greatest, mean and deviation are exact. ``profiling`` has the exact form of the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriweave.operators.profiling import HEAD
from veriweave.sources.metadata import numeric_columns, quoted
from veriweave.sources.stores import VersionedTable

LOG_REGISTERS = 14
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
KLL_SIZE = 1024
RANK_ERROR = 0.0027
TRACKED = 1024
# Quantiles that tell how many rows lie beyond the fences of outliers.
GRID = 500
FREQUENT_ERROR = 3.5 / TRACKED

_FIELDS = ("column_name", "kind", "n", "missing", "distinct_values", "quantiles", "frequent", "least", "most", "mean", "squares")


def sketch(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Sketches of every column, per value of the ``by`` columns: one scan, one aggregation."""
    names = [c for c in (columns or df.columns) if c not in by]
    numbers = set(numeric_columns(df))
    # A column each for the text and the number of a value, so that it is spelled once.
    spelled = []
    for i, c in enumerate(names):
        text = quoted(c).cast("string")
        number = quoted(c).cast("double") if c in numbers else F.length(text).cast("double")
        spelled += [text.alias(f"t{i}"), F.when(~F.isnan(number), number).alias(f"v{i}")]
    rows = df.select(*[quoted(c) for c in by], *spelled)
    measures: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i in range(len(names)):
        measures += [
            F.count_if(F.col(f"t{i}").isNull()).alias(f"missing{i}"),
            F.hll_sketch_agg(f"t{i}", F.lit(LOG_REGISTERS)).alias(f"d{i}"),
            F.kll_sketch_agg_double(f"v{i}", F.lit(KLL_SIZE)).alias(f"q{i}"),
            F.expr(f"approx_top_k_accumulate(substring(t{i}, 1, {HEAD}), {TRACKED})").alias(f"f{i}"),
            F.min(f"v{i}").alias(f"least{i}"), F.max(f"v{i}").alias(f"most{i}"), F.avg(f"v{i}").alias(f"mean{i}"),
            (F.var_pop(f"v{i}") * F.count(f"v{i}")).alias(f"squares{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit("number" if c in numbers else "text").alias("kind"), F.col("n"), F.col(f"missing{i}").alias("missing"),
            F.col(f"d{i}").alias("distinct_values"), F.col(f"q{i}").alias("quantiles"), F.col(f"f{i}").alias("frequent"),
            F.col(f"least{i}").alias("least"), F.col(f"most{i}").alias("most"), F.col(f"mean{i}").alias("mean"), F.col(f"squares{i}").alias("squares"),
        )
        for i, c in enumerate(names)
    ]
    return rows.groupBy(*[quoted(c) for c in by]).agg(*measures).select(*[quoted(c) for c in by], F.inline(F.array(*cells)))


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the union of parts: of all of them, or per value of the ``by`` columns."""
    keys = [*by, "column_name", "kind"]
    known = F.col("n") - F.col("missing")
    # Deviations are taken from the common mean, which is a sum over the few rows of a column.
    mean = F.sum(F.col("mean") * known).over(Window.partitionBy(*keys)) / F.sum(F.when(F.col("mean").isNotNull(), known)).over(Window.partitionBy(*keys))
    centred = sketches.withColumn("_mean", mean).withColumn("_squares", F.col("squares") + known * (F.col("mean") - F.col("_mean")) ** 2)
    merged = centred.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.hll_union_agg("distinct_values").alias("distinct_values"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.max("_mean").alias("mean"), F.sum("_squares").alias("squares"),
    )
    return merged.select(*by, *_FIELDS)


def estimates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What sketches tell: (by, column_name, metric, value, lower, upper); the exact ones have equal bounds."""
    n = F.col("n") - F.col("missing")
    some = n > 0
    distinct = F.hll_sketch_estimate("distinct_values").cast("double")

    def quantile(p: float) -> Column:
        return F.kll_sketch_get_quantile_double("quantiles", F.lit(float(min(max(p, 0.0), 1.0))))

    def told(metric: str, value: Column, lower: Column | None = None, upper: Column | None = None, only: Column | None = None) -> Column:
        one = F.struct(
            F.lit(metric).alias("metric"), value.cast("double").alias("value"),
            (value if lower is None else lower).cast("double").alias("lower"), (value if upper is None else upper).cast("double").alias("upper"),
        )
        return F.when(F.lit(True) if only is None else only, one)

    # Evenly spaced quantiles, of which as many lie beyond the fences as rows do.
    spaced = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    wide = sketches.withColumn("_q1", F.when(some, quantile(0.25))).withColumn("_q3", F.when(some, quantile(0.75)))
    wide = wide.withColumn("_grid", F.when(some, spaced))
    spread = F.col("_q3") - F.col("_q1")
    beyond = F.filter("_grid", lambda v: (v < F.col("_q1") - 1.5 * spread) | (v > F.col("_q3") + 1.5 * spread))
    outside = F.size(beyond) / (GRID + 1) * n
    off = 2 * (RANK_ERROR + 1 / GRID) * n
    number = F.col("kind") == "number"
    prefix = F.when(number, "").otherwise("length_")
    cells = [
        told("rows", F.col("n")), told("missing", F.col("missing")),
        told("unique_count", distinct, distinct * (1 - 4 * DISTINCT_ERROR), distinct * (1 + 4 * DISTINCT_ERROR)),
        told("min", F.col("least"), only=some), told("max", F.col("most"), only=some), told("mean", F.col("mean"), only=some),
        told("std", F.sqrt(F.col("squares") / (n - 1)), only=n > 1),
        *[told(name, quantile(p), quantile(p - RANK_ERROR), quantile(p + RANK_ERROR), only=some) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
        told("outliers", outside, F.greatest(F.lit(0.0), outside - off), outside + off, only=some & (n >= 10) & (spread > 0) & number),
    ]
    tidy = wide.select(*by, "column_name", prefix.alias("_p"), F.inline(F.array_compact(F.array(*cells))))
    described = F.col("metric").isin("min", "max", "mean", "std", "q1", "median", "q3")
    metrics = tidy.withColumn("metric", F.when(described, F.concat("_p", "metric")).otherwise(F.col("metric"))).drop("_p")
    tops = sketches.filter(some).select(*by, "column_name", "n", F.inline(F.expr("approx_top_k_estimate(frequent, 5)")))
    top = tops.select(
        *by, "column_name", F.concat(F.lit("top: "), "item").alias("metric"), F.col("count").cast("double").alias("value"),
        (F.col("count") - F.col("n") * FREQUENT_ERROR).alias("lower"), (F.col("count") + F.col("n") * FREQUENT_ERROR).alias("upper"),
    )
    return metrics.unionByName(top)


def sketch_store(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    """Sketches by part of a table (``part``: a day, a source)."""
    return VersionedTable(spark, path, key="part", buckets=buckets)


def store_parts(store: VersionedTable, df: DataFrame, part: Column) -> int:
    """Profile the parts that the rows belong to and put them in place of what was known of those parts; how many buckets were written."""
    return store.change(sketch(df.withColumn("part", part.cast("string")), by=["part"]))
