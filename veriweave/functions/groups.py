"""Keyed groups of any size.

One key may hold a third of all rows. Nothing here gathers such a group in one
task: large groups are cut into parts, and running values are carried from
block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 10_000
BROADCAST_ROWS = 100_000
MAX_PARTS = 4000
# Rows that one task gathers into lists, about.
LIST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most ``max_rows`` rows.

    The count stops at the bound. Beyond it the hint is left out and the join is
    a shuffled one.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def counted_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, like: DataFrame | None = None) -> DataFrame:
    """A side of a join that is broadcast only after a count, of ``like`` where that has as many rows, and else merged.

    Spark's estimate of either side does not decide: it goes by the bytes of files, and knows
    neither how many rows they hold nor how many an explode makes of each.
    """
    counted = df if like is None else like
    return df.hint("merge") if broadcast_if_small(counted, max_rows) is counted else F.broadcast(df)


def keys_to_match(keys: DataFrame) -> DataFrame:
    """The side of a semi join that gives the keys: a counted few distinct ones are broadcast.

    More are left as they are, as only rows that come straight from a filter thin out the
    other side ahead of its shuffle.
    """
    distinct = keys.distinct()
    few = broadcast_if_small(distinct)
    return keys if few is distinct else few


def matching(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``: where these are many, about ``LIST_ROWS`` rows per task, dealt by the key."""
    known = keys_to_match(keys)
    if known is keys:
        rows, known = rows.repartition(tasks_for(rows.count()), key), keys.hint("merge")
    return rows.join(known, key, "left_semi")


def spread_if_small(df: DataFrame, max_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """Spread an input of less than one file split over all cores, ahead of work that is heavy per row.

    Larger inputs already come in many splits and are left as they are, without a shuffle.
    """
    if df.isStreaming:
        return df
    estimated = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimated)) > max_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def partitions_of(df: DataFrame, rows_each: int) -> int:
    """Partitions of about so many rows, by a count."""
    return max(1, -(-df.count() // rows_each))


def large_groups(members: DataFrame, keys: Sequence[str], order: str, part_rows: int = PART_ROWS) -> DataFrame | None:
    """Where the groups above ``part_rows`` are cut: ``_cuts``, quantiles of the order column; None when there are none.

    Runs one count over the key, so that the common case needs no join at all. Quantiles
    cut a group into parts of like size however its members lie.
    """
    return measured_groups(members, keys, order, part_rows)[0]


def measured_groups(
    members: DataFrame, keys: Sequence[str], order: str, part_rows: int = PART_ROWS
) -> tuple[DataFrame | None, int]:
    """What ``large_groups`` gives, and the number of all rows from the same count."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    above = F.col("_n") > part_rows
    large = sizes.filter(above)
    found = sizes.agg(F.count_if(above).alias("groups"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    rows = found["rows"] or 0
    if not found["groups"]:
        return None, rows
    n_parts = min(-(-found["most"] // part_rows), MAX_PARTS)
    asked = F.broadcast(large) if found["groups"] <= BROADCAST_ROWS else large
    shares = [i / n_parts for i in range(1, n_parts)]
    cuts = members.join(asked.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(order, shares, 20 * n_parts).alias("_all")
    )
    # Smaller groups take every second, third, ... of the cuts.
    step = F.greatest(F.floor(F.lit(n_parts) / F.ceil(F.col("_n") / part_rows)), F.lit(1))
    chosen = F.array_distinct(F.filter("_all", lambda c, i: (i + 1) % step == 0))
    large = cuts.select(*keys, chosen.alias("_cuts"))
    return (F.broadcast(large) if found["groups"] <= BROADCAST_ROWS // n_parts else large), rows


def assign_parts(
    members: DataFrame, keys: Sequence[str], order: str, large: DataFrame | None, part_rows: int = PART_ROWS
) -> DataFrame:
    """Add ``part``: 0 for ordinary groups, a range of the order column for large ones.

    Parts follow the order column, so the parts of a key, taken in order, hold the
    members in order.
    """
    if large is None:
        return members.withColumn("part", F.lit(0).cast("bigint"))
    joined = members.join(large, list(keys), "left")
    part = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return joined.withColumn("part", F.when(F.col("_cuts").isNull(), 0).otherwise(part).cast("bigint")).drop("_cuts")


def tasks_for(rows: int) -> int:
    """Tasks that list about ``LIST_ROWS`` members each."""
    return max(1, -(-rows // LIST_ROWS))


def list_in_parts(
    members: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    separator: str,
    large: DataFrame | None,
    part_rows: int = PART_ROWS,
    numbered: bool = False,
    rows: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """One row per key and part: the texts joined in order, and how many there are.

    ``large`` comes from ``large_groups``; without large groups each key has one part.
    With ``numbered`` each text starts with its position in the key's list, from 1. With
    ``rows``, how many members there are, a task lists about ``LIST_ROWS`` of them; else
    the tasks grow with the members. Members of equal order follow the ``ties``, then the text.
    """
    tasks = [] if rows is None else [tasks_for(rows)]
    if large is None:
        grouping = list(keys)
        if tasks:
            members = members.repartition(*tasks, *grouping)
    else:
        grouping = [*keys, "part"]
        # Large keys spread over as many tasks as they have parts.
        members = assign_parts(members, keys, order, large, part_rows).repartition(*tasks, *grouping)
    then = [F.col(c).alias(f"o{i}") for i, c in enumerate(ties)]
    grouped = members.groupBy(*grouping).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *then, F.col(text).alias("t")))).alias("_m")
    )
    sized = grouped.withColumn("members", F.size("_m").cast("bigint")).withColumn("_before", F.lit(0).cast("bigint"))
    if large is None:
        sized = sized.withColumn("part", F.lit(0).cast("bigint"))
    elif numbered:
        upto = F.sum("members").over(Window.partitionBy(*keys).orderBy("part"))
        sized = sized.withColumn("_before", upto - F.col("members"))

    def line(m: Column, i: Column) -> Column:
        return F.concat((F.col("_before") + i + 1).cast("string"), F.lit(". "), m["t"]) if numbered else m["t"]

    return sized.select(*keys, "part", "members", F.array_join(F.transform("_m", line), separator).alias("text"))


def last_known_before(
    df: DataFrame, group: str, order: str, value: str, out: str, block: int = 10_000
) -> DataFrame:
    """Add the latest non-NULL ``value`` on an earlier row of the group.

    The order column is cut into blocks. Inside a block a window finds the value;
    between blocks one row per block carries it on.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    inside = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    known = F.when(F.col(value).isNotNull(), F.col(order))
    tails = blocks.groupBy(group, "_block").agg(F.max_by(value, known).alias("_tail"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(group, "_block", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    return (
        local.join(carried, [group, "_block"], "left")
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_block", "_local", "_carried")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their position.

    Spark limits each group inside every input partition before the shuffle, so
    a key of any size sends at most ``n`` rows per partition.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position.cast("bigint")).filter(F.col(rank) <= n)


def one_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep one row per key: the greatest by the remaining columns, so that the choice repeats."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates()
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_best"))
    return best.select(*keys, *[F.col("_best").getField(c).alias(c) for c in rest]).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def in_parts(documents: DataFrame) -> bool:
    """Whether any document comes in several parts (``part_no`` above 0).

    Documents that were built without splitting carry the constant 0, for which no job
    runs; stored ones are asked by the statistics of their files.
    """
    return "part_no" in documents.columns and not documents.filter("part_no > 0").isEmpty()
