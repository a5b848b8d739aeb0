"""Nearest neighbours by an inverted file.

Points belong to the cell of the centre they are nearest to. Centres are fitted on a bounded
sample; every point is assigned. A query meets the points of the cells whose centres are nearest
to it, so the rows shuffled are the points and the queries times the cells each one probes, not
points times blocks of queries. How many cells to probe is measured on a sample of points, for the
recall that is asked for.

The exact mode goes on from there: a cell with radius r around a centre at angle a from the query
holds nothing nearer than ``a - r``, so only cells that can still hold one of the k best are met.

A cell of any size is met in parts, and a cell that many queries ask for meets them in parts.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.functions.groups import top_per_key
from veriweave.operators.vectors import LARGE_POINT_BLOCK, LARGE_QUERY_BLOCK, _by_value, _unit, blocks_of, keys_of
from veriweave.session import staged

# The sample that centres are fitted on, the most centres, and the rounds of the fit.
SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
ROUNDS = 12
# Points that tell how many cells to probe.
TUNING_QUERIES = 256
# What meets in one task.
POINTS_PER_BLOCK = 50_000
QUERIES_PER_BLOCK = 4096
# Cells beyond the first are met in so many blocks where larger ones would leave cores idle.
FEW_FAR_BLOCKS = 4
_AT_ONCE = 1024
# Vectors without a direction have a cell of their own; their cosine with anything is 0.
NOWHERE = -1
# Scores are told to six decimals, so a cell is met if it can reach the k-th best to within that.
_ROUNDING = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """Points with their ``cell``, and what is known of the cells."""

    points: DataFrame
    centres: np.ndarray
    # Cell -> number of points and greatest angle to its centre. No more cells than MAX_CELLS + 1.
    cells: dict[int, tuple[int, float]] = field(repr=False)
    probes: int = 1


def _by_hash(df: DataFrame, n: int, seed: int) -> DataFrame:
    """A sample that is the same whenever it is drawn: the n points of least hash."""
    return df.orderBy(F.xxhash64(F.col("point_id").cast("string"), F.lit(seed)), "point_id").limit(n)


def fit_centres(points: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of about the root of the number of points, by spherical k-means on a sample of at most ``sample_rows``."""
    known = points.filter("vector IS NOT NULL")
    cells = cells or max(1, round(known.count() ** 0.5))
    rows = _by_hash(known.select("point_id", "vector"), sample_rows, 17).collect()
    if not rows:
        return np.zeros((0, 0))
    unit = _unit([r["vector"] for r in rows])
    unit = unit[(unit * unit).sum(axis=1) > 0]
    cells = min(cells, MAX_CELLS, len(unit))
    if not cells:
        return np.zeros((0, unit.shape[1]))
    # Started from points that lie apart: each next one the farthest of a few drawn ones.
    draw = np.random.default_rng(17)
    centres = unit[[int(draw.integers(len(unit)))]]
    nearest = unit @ centres[0]
    for _ in range(cells - 1):
        some = draw.integers(len(unit), size=8)
        centres = np.concatenate([centres, unit[[some[np.argmin(nearest[some])]]]])
        nearest = np.maximum(nearest, unit @ centres[-1])
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        moved = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _shipped():
    """The helpers travel with the task, so that workers need not find this package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return _by_value()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _directions(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Points that have a vector, with ``cell`` and ``angle`` to its centre. No shuffle; other columns pass as they are."""
    _shipped()
    known = points.filter("vector IS NOT NULL")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _directions(_matrix(batch.column(batch.schema.get_field_index("vector"))))
            cosines = own @ centres.T if len(centres) else np.zeros((len(own), 1))
            cell = np.argmax(cosines, axis=1).astype(np.int32)
            angle = np.arccos(np.clip(cosines[np.arange(len(own)), cell], -1, 1))
            lost = ~own.any(axis=1)
            more = [pa.array(np.where(lost, NOWHERE, cell), pa.int32()), pa.array(np.where(lost, 0.0, angle))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "angle"])

    schema = T.StructType([*known.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return known.mapInArrow(placed, schema)


def cell_facts(points: DataFrame) -> dict[int, tuple[int, float]]:
    """Points and radius of every cell that has points."""
    rows = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
    return {r["cell"]: (r["n"], r["radius"]) for r in rows}


def build_index(points: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Fit centres, assign every point, and store the points by cell in the shared folder. ``points``: point_id, vector, any others."""
    centres = fit_centres(points, cells, sample_rows)
    stored = staged(assign(points, centres), "indexed")
    return VectorIndex(stored, centres, cell_facts(stored))


def add_points(index: VectorIndex, points: DataFrame) -> VectorIndex:
    """The index with more points: assigned to the centres it has, which stay as they were fitted; a point that was known is replaced."""
    fresh = assign(points, index.centres)
    kept = index.points.join(points.select("point_id"), "point_id", "left_anti")
    stored = staged(kept.unionByName(fresh), "indexed")
    return VectorIndex(stored, index.centres, cell_facts(stored), index.probes)


def _routes(index: VectorIndex, queries: DataFrame, probes: int, beyond: bool = False) -> DataFrame:
    """Cells each query meets: the ``probes`` nearest, or ``beyond`` those the others that can reach its ``floor``."""
    _shipped()
    numbers = np.array(sorted(c for c in index.cells if c != NOWHERE), np.int32)
    centres = index.centres[numbers] if len(numbers) else np.zeros((0, index.centres.shape[1]))
    radius = np.array([index.cells[int(c)][1] for c in numbers])
    nowhere = NOWHERE in index.cells
    kind = dict(queries.dtypes)["query_id"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index("query_id"))
            own = _directions(_matrix(batch.column(batch.schema.get_field_index("vector"))))
            cosines = own @ centres.T if len(centres) else np.zeros((len(own), 0))
            rank = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1, kind="stable")
            open_ = rank < probes
            if beyond:
                floor = batch.column(batch.schema.get_field_index("floor")).to_numpy(zero_copy_only=False)
                open_ = ~open_ & _open(own, floor, centres, radius, np.zeros(len(numbers), bool))
            q, c = np.nonzero(open_)
            cells, ranks = numbers[c], rank[q, c]
            if nowhere and beyond:
                lost = np.flatnonzero(floor <= _ROUNDING)
                q, cells = np.concatenate([q, lost]), np.concatenate([cells, np.full(len(lost), NOWHERE, np.int32)])
                ranks = np.concatenate([ranks, np.full(len(lost), len(numbers))])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(q)), pa.array(cells, pa.int32()), pa.array(ranks, pa.int32())], names=["query_id", "cell", "cell_rank"]
            )

    schema = f"query_id {kind}, cell int, cell_rank int"
    return queries.select("query_id", "vector", *(["floor"] if beyond else [])).mapInArrow(routed, schema)


def _open(own: np.ndarray, floor: np.ndarray, centres: np.ndarray, radius: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Which cells can hold a point that reaches the floor of a query, as queries by cells; ``lost`` names the cell of no direction."""
    out = np.zeros((len(own), len(centres)), bool)
    own = own[:, :centres.shape[1]]
    # A cell with a point that has no angle is open to all.
    wide = np.where(np.isnan(radius), np.pi, radius)
    for i in range(0, len(own), _AT_ONCE):
        some = own[i:i + _AT_ONCE]
        # Nothing in a cell is nearer than its centre less its radius; what has no direction scores 0.
        reach = np.cos(np.maximum(0, np.arccos(np.clip(some @ centres.T, -1, 1)) - wide - 1e-9))
        reach = np.where(some.any(axis=1)[:, None] & ~lost, reach, 0.0)
        out[i:i + _AT_ONCE] = reach >= floor[i:i + _AT_ONCE, None] - _ROUNDING
    return out


def _parts(counts: dict[int, int], per_block: int, large: int) -> Column:
    """How many parts the rows of a cell are met in; 1 where the cell is not named."""
    several = {c: blocks_of(n, per_block, large) for c, n in counts.items() if n > per_block}
    if not several:
        return F.lit(1)
    named = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    return F.coalesce(named[F.col("cell")], F.lit(1))


def _met(index: VectorIndex, queries: DataFrame, routes: DataFrame, names: list[str], k: int, threshold: float | None, skip_self: bool,
         points_per_block: int, queries_per_block: int) -> DataFrame:
    """The k best points of each query in each part of the cells it is routed to."""
    best, unit, _ = _shipped()
    asked = {r["cell"]: r["count"] for r in routes.groupBy("cell").count().collect()}
    p_parts = _parts({c: n for c, (n, _) in index.cells.items()}, points_per_block, LARGE_POINT_BLOCK)
    q_parts = _parts(asked, queries_per_block, LARGE_QUERY_BLOCK)

    def cut(key: str, parts: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), parts).cast("int")

    def every(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), parts - 1))

    # A cell that nobody asks for stays where it is.
    p = index.points.filter(F.col("cell").isin(*asked)) if len(asked) < len(index.cells) else index.points
    p = p.select("point_id", F.col("vector").alias("v"), "cell", *names).withColumn("pp", cut("point_id", p_parts)).withColumn("qp", every(q_parts))
    q = queries.select("query_id", "vector", *names).join(routes.select("query_id", "cell"), "query_id")
    q = q.withColumn("qp", cut("query_id", q_parts)).withColumn("pp", every(p_parts))
    kinds = dict(queries.dtypes)["query_id"], dict(index.points.dtypes)["point_id"]

    def local(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "point_id": [], "score": []})
        ids = asked["query_id"].to_numpy()
        at, point_ids, scores = best(
            ids, unit(asked["vector"].tolist()), [asked[n].to_numpy() for n in names],
            points["point_id"].to_numpy(), unit(points["v"].tolist()), [points[n].to_numpy() for n in names], k, threshold, skip_self,
        )
        return pd.DataFrame({"query_id": ids[at], "point_id": point_ids, "score": scores})

    keys = ["cell", "pp", "qp"]
    schema = f"query_id {kinds[0]}, point_id {kinds[1]}, score double"
    return p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(local, schema)


def _few_blocks(rows: int, per_block: int, large: int) -> int:
    """As ``blocks_of``, but a few large blocks: each block of one side is a copy of the other."""
    return max(1, min(-(-rows // per_block), max(FEW_FAR_BLOCKS, -(-rows // large))))


def _dealt(sizes: dict[int, int], parts: dict[int, int], blocks: int) -> list[tuple[int, int, int]]:
    """Parts of cells dealt to blocks of like size, as (cell, part, block): the next largest to the least block."""
    units = sorted(((n / parts.get(c, 1), c, i) for c, n in sizes.items() for i in range(parts.get(c, 1))), key=lambda u: (-u[0], u[1:]))
    fill = [(0.0, b) for b in range(blocks)]
    dealt = []
    for n, cell, part in units:
        held, block = heapq.heappop(fill)
        dealt.append((cell, part, block))
        heapq.heappush(fill, (held + n, block))
    return dealt


def _met_beyond(index: VectorIndex, queries: DataFrame, names: list[str], k: int, threshold: float | None, skip_self: bool,
                points_per_block: int, queries_per_block: int) -> DataFrame:
    """The best points of each query, up to k of each cell or block of cells, in all cells that can hold a point that reaches its ``floor``.

    Cells are dealt to a few blocks, and a query goes once to each block that has an open cell
    of its own, not once to each cell; the open cells are told apart inside the block. So the rows
    that are moved grow with the blocks, however many cells a query has to meet.
    """
    best, unit, _ = _shipped()
    sizes = {c: n for c, (n, _) in index.cells.items()}
    n_blocks = _few_blocks(sum(sizes.values()), points_per_block, LARGE_POINT_BLOCK)
    parts = {c: -(-n // points_per_block) for c, n in sizes.items() if n > points_per_block}
    dealt = _dealt(sizes, parts, n_blocks)
    numbers = np.array(sorted(sizes), np.int32)
    lost = numbers == NOWHERE
    centres = np.where(lost[:, None], 0.0, index.centres[np.where(lost, 0, numbers)]) if len(index.centres) else np.zeros((len(numbers), index.centres.shape[1]))
    radius = np.array([index.cells[int(c)][1] for c in numbers])
    place = {int(c): i for i, c in enumerate(numbers)}
    holds = np.zeros((len(numbers), n_blocks), bool)
    for cell, _, block in dealt:
        holds[place[cell], block] = True

    def opened(batch: pa.RecordBatch) -> np.ndarray:
        own = _directions(_matrix(batch.column(batch.schema.get_field_index("vector"))))
        return _open(own, batch.column(batch.schema.get_field_index("floor")).to_numpy(zero_copy_only=False), centres, radius, lost)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, blocks = np.zeros(len(numbers), np.int64), np.zeros(n_blocks, np.int64)
        for batch in batches:
            if batch.num_rows:
                open_ = opened(batch)
                cells += open_.sum(axis=0)
                blocks += (open_.astype(np.float32) @ holds.astype(np.float32) > 0).sum(axis=0)
        rows = [("cell", int(c), int(n)) for c, n in zip(numbers, cells)] + [("block", b, int(n)) for b, n in enumerate(blocks)]
        yield pa.RecordBatch.from_pylist([{"kind": a, "no": b, "n": n} for a, b, n in rows if n], schema=pa.schema([("kind", pa.string()), ("no", pa.int32()), ("n", pa.int64())]))

    found = queries.select("vector", "floor").mapInArrow(counted, "kind string, no int, n bigint").groupBy("kind", "no").agg(F.sum("n").alias("n")).collect()
    asked_cells = {r["no"] for r in found if r["kind"] == "cell"}
    most = max((r["n"] for r in found if r["kind"] == "block"), default=0)
    q_parts = _few_blocks(most, queries_per_block, LARGE_QUERY_BLOCK)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            to = opened(batch).astype(np.float32) @ holds.astype(np.float32) > 0
            for block in range(n_blocks):
                at = pa.array(np.flatnonzero(to[:, block]))
                if len(at):
                    rows = batch.take(at)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(at), block, np.int32))], names=[*rows.schema.names, "block"])

    q = queries.select("query_id", "vector", *names, "floor")
    q = q.mapInArrow(sent, T.StructType([*q.schema.fields, T.StructField("block", T.IntegerType())]))
    q = q.withColumn("qp", F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(q_parts)).cast("int"))
    # A cell that nobody asks for stays where it is.
    units = index.points.sparkSession.createDataFrame([u for u in dealt if u[0] in asked_cells], "cell int, part int, block int")
    named = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else None
    of_cell = F.lit(1) if named is None else F.coalesce(named[F.col("cell")], F.lit(1))
    p = index.points.select("point_id", F.col("vector").alias("v"), "cell", *names)
    p = p.withColumn("part", F.pmod(F.xxhash64(F.col("point_id").cast("string")), of_cell).cast("int")).join(F.broadcast(units), ["cell", "part"])
    p = p.drop("part").withColumn("qp", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    kinds = dict(queries.dtypes)["query_id"], dict(index.points.dtypes)["point_id"]

    def local(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "point_id": [], "score": []})
        ids, own, floor = asked["query_id"].to_numpy(), unit(asked["vector"].tolist()), asked["floor"].to_numpy()
        keys = [asked[n].to_numpy() for n in names]
        of, cells = points["cell"].to_numpy(), np.unique(points["cell"].to_numpy())
        near = np.searchsorted(numbers, cells)
        open_ = _open(own, floor, centres[near], radius[near], lost[near])

        def meet(at: np.ndarray, rows: np.ndarray):
            some = points.iloc[rows]
            q_at, point_ids, scores = best(
                ids[at], own[at], [key[at] for key in keys], some["point_id"].to_numpy(), unit(some["v"].tolist()), [some[n].to_numpy() for n in names],
                k, threshold, skip_self, floor[at],
            )
            return at[q_at], point_ids, scores

        # Where most cells are open, all are met at once: to meet a cell that is not open changes nothing.
        if open_.mean() > 0.25:
            told = [meet(np.arange(len(ids)), np.arange(len(points)))]
        else:
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], cells, side="right")
            told = [meet(np.flatnonzero(open_[:, i]), rows) for i, rows in enumerate(np.split(order, ends[:-1]))]
        at, point_ids, scores = (np.concatenate([t[i] for t in told]) for i in range(3))
        return pd.DataFrame({"query_id": ids[at], "point_id": point_ids, "score": scores})

    schema = f"query_id {kinds[0]}, point_id {kinds[1]}, score double"
    return p.groupBy("block", "qp").cogroup(q.groupBy("block", "qp")).applyInPandas(local, schema)


def nearest(
    index: VectorIndex,
    queries: DataFrame,
    k: int,
    threshold: float | None = None,
    equal_on: Sequence[str] = (),
    skip_self: bool = False,
    exact: bool = False,
    points_per_block: int = POINTS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """The k points of greatest cosine per query: (query_id, point_id, score, rank), as ``vectors.nearest`` gives them.

    Without ``exact`` only the index's probes are met, and a neighbour in another cell is missed.
    With it the result is that of comparing every query with every point.
    """
    asked, keyed, names = keys_of(queries, index.points, equal_on)
    asked = staged(asked, "asked")
    index = VectorIndex(keyed, index.centres, index.cells, index.probes)
    near = staged(_routes(index, asked, index.probes), "routes")
    order = [F.col("score").desc(), F.col("point_id")]
    meet = dict(names=names, k=k, threshold=threshold, skip_self=skip_self, points_per_block=points_per_block, queries_per_block=queries_per_block)
    found = top_per_key(_met(index, asked, near, **meet), ["query_id"], order, k)
    if not exact:
        return found
    found = staged(found, "near")
    # The k-th best score so far; none yet where fewer were found.
    lowest = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    least = F.lit(-2.0 if threshold is None else float(threshold))
    floored = asked.join(lowest, "query_id", "left").withColumn("floor", F.when(F.col("n") >= k, F.greatest("kth", least)).otherwise(least)).drop("kth", "n")
    floored = floored.filter("query_id IS NOT NULL")
    several = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    if not several.isEmpty():
        # Rows of one id are met by each other's cells, as they were before.
        copies = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int")))
        floored = floored.join(several, "query_id", "left").withColumn("_copy", copies).drop("copies", "_copy")
    floored = staged(floored, "floored")
    # Cells that were met first are met again with the others, so that no pair comes twice.
    return top_per_key(_met_beyond(index, floored, **meet), ["query_id"], order, k)


def tuned(index: VectorIndex, k: int, recall: float = 0.95, queries: int = TUNING_QUERIES) -> VectorIndex:
    """The index with as many probes as find the given share of the k nearest of a sample of its points.

    The sample is searched exactly. A neighbour is found by so many probes as its cell has
    places in the order of its query; the probes are the quantile of those places.
    """
    sample = staged(_by_hash(index.points, queries, 29).select(F.col("point_id").alias("query_id"), "vector"), "tuning")
    truth = nearest(index, sample, k, skip_self=True, exact=True)
    cells = truth.join(index.points.select("point_id", "cell"), "point_id").select("query_id", "cell")
    places = cells.join(_routes(index, sample, len(index.cells)), ["query_id", "cell"])
    found = places.agg(F.percentile(F.col("cell_rank"), recall).alias("place")).first()["place"]
    return VectorIndex(index.points, index.centres, index.cells, max(1, int(np.ceil(found or 0)) + 1))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries, neighbours there are, and the share of them that was found."""
    hit = found.select("query_id", "point_id", F.lit(1).alias("_hit"))
    return truth.join(hit, ["query_id", "point_id"], "left").agg(
        F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("_hit") / F.count(F.lit(1))).alias("recall")
    )
