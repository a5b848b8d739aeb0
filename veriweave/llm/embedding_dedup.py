"""Embedding near-dedup: all pairs of a label above a cosine, by dual traversal of cover trees.

Unit vectors with a cosine of c are sqrt(2 - 2c) apart, so links are pairs within a distance. Equal
vectors of a label become one class first. The classes of a label are cut into blocks of about
``BLOCK_ROWS``: by the nearest of some of its vectors where a label has several blocks, so that a
block lies close together, then by hash. Each block gets a cover tree: a node's children are
vectors of the node, more than half its radius apart, that cover the rest within half its radius;
the first child is the node's own centre. Vectors are laid in tree order, so a node is a range of
them, and its covering radius is measured.

Two trees are gone through together. A pair of nodes whose centres are further apart than the
distance asked plus both radii has no link. One whose centres are closer than the distance asked
less both radii has nothing but links: they are counted by the ranges, and one vector is tied to
all others, without a row for each pair. Any other pair is met child by child. A pair of single
vectors is settled by its cosine. Bounds keep a margin for rounding, and cosines at the threshold
are computed again vector by vector.

Pairs of blocks that the roots' bound allows are the units of work. Each gives, per class, a number
of linked rows, and ties enough for the components.

Defined results: vectors that are null, empty or all zero, or hold a null or non-finite component,
and rows without a label, link with nothing; vectors of different length never link. Every row
counts, equal rows too. An empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.llm.common import prepare, settled
from veriweave.llm.graph_components import components

THRESHOLD = 0.93
BLOCK_ROWS = 4096
# Vectors that attract the others of a label with many blocks, at most.
SEEDS = 64
# Distances of unit vectors are known to within 3e-8 (the root of twice the rounding of a cosine).
_MARGIN = 1e-7
_CHUNK = 1024


def usable(vector: str) -> Column:
    """Whether a vector has a direction: components, all finite, not all zero."""
    v = F.col(vector)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & plain & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither vanish nor overflow.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def _net(unit: np.ndarray, half: float) -> list[np.ndarray]:
    """Rows by the first centre within ``half``, each centre first; centres are further apart than that."""
    if half <= 5 * _MARGIN:
        # Below the rounding of a distance every vector stands alone.
        return list(np.arange(len(unit))[:, None])
    groups, left = [], np.arange(len(unit))
    while len(left):
        # The next rows that may be centres, all at once.
        far = _distances(unit[left], unit[left[:_CHUNK]])
        free = np.ones(len(left), bool)
        for k in range(far.shape[1]):
            if free[k]:
                inside = free & (far[:, k] <= half)
                inside[k] = True
                groups.append(left[inside])
                free &= ~inside
        left = left[free]
    return groups


class CoverTree:
    """Nested levels of centres with halving radii over the rows of a matrix of unit vectors.

    ``order``: rows in tree order. Per node: its range ``start:end`` in that order (the centre is
    at ``start``), its measured radius, and its children ``first:first + n``.
    """

    def __init__(self, unit: np.ndarray) -> None:
        n = len(unit)
        self.order = np.arange(n)
        start, end, radius, first, count = [0], [n], [0.0], [0], [0]
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            if b - a > 1:
                ids = self.order[a:b]
                far = _distances(unit[ids], unit[ids[:1]])[:, 0]
                far[0] = 0
                radius[at] = float(far.max())
                groups = _net(unit[ids], radius[at] / 2)
                first[at], count[at] = len(start), len(groups)
                place = a
                for g in groups:
                    start.append(place)
                    place += len(g)
                    end.append(place)
                radius += [0.0] * len(groups)
                first += [0] * len(groups)
                count += [0] * len(groups)
                self.order[a:b] = ids[np.concatenate(groups)]
            at += 1
        self.start, self.end, self.radius = np.array(start), np.array(end), np.array(radius)
        self.first, self.count = np.array(first), np.array(count)


class Ties:
    """Components of what has been tied so far: the least member of each vector's."""

    def __init__(self, n: int) -> None:
        self.least, self.open, self.size = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Tie pairs; many are settled together."""
        self.open.append((i, j))
        self.size += len(i)
        if self.size > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        i, j = (np.concatenate([x[k] for x in self.open] or [np.empty(0, np.int64)]).astype(np.int64) for k in (0, 1))
        self.open, self.size, least = [], 0, self.least
        while len(i):
            a, b = least[i], least[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = least[least]
                if np.array_equal(up, least):
                    break
                least[:] = up
        return least


def links_within(ta: CoverTree, ua: np.ndarray, wa: np.ndarray, tb: CoverTree, ub: np.ndarray, wb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of each vector of two blocks in tree order, and the least vector of its component.

    ``ua``, ``wa``: vectors and row counts of the first block in tree order. ``same``: the two are
    one block, and each pair counts once for both of its vectors. Else the second block's vectors
    are numbered behind the first's.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    shift = 0 if same else len(ua)
    total = len(ua) if same else len(ua) + len(ub)
    ties, links = Ties(total), np.zeros(total)
    # Additions to whole ranges, summed up at the end.
    add = np.zeros(total + 1)
    upto_a, upto_b = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])

    def whole(a0: int, a1: int, b0: int, b1: int) -> None:
        in_a, in_b = upto_a[a1] - upto_a[a0], upto_b[b1] - upto_b[b0]
        add[[a0, b0 + shift]] += [in_b, in_a]
        add[[a1, b1 + shift]] -= [in_b, in_a]
        ties.add(np.full(b1 - b0, a0), np.arange(b0, b1) + shift)
        ties.add(np.full(a1 - a0, b0 + shift), np.arange(a0, a1))

    def inside(a0: int, a1: int) -> None:
        # All pairs of a node link: each vector with all others of it.
        add[a0] += upto_a[a1] - upto_a[a0]
        add[a1] -= upto_a[a1] - upto_a[a0]
        links[a0:a1] -= wa[a0:a1]
        ties.add(np.full(a1 - a0, a0), np.arange(a0, a1))

    def children(t: CoverTree, node: int) -> np.ndarray:
        return np.arange(t.first[node], t.first[node] + t.count[node]) if t.count[node] else np.array([node])

    todo = [(0, 0)]
    while todo:
        na, nb = todo.pop()
        itself = same and na == nb
        if itself and 2 * ta.radius[na] < reach - _MARGIN:
            inside(int(ta.start[na]), int(ta.end[na]))
            continue
        if itself and not ta.count[na]:
            continue
        ca, cb = children(ta, na), children(tb, nb)
        for k in range(0, len(ca), _CHUNK):
            some = ca[k : k + _CHUNK]
            cosines = ua[ta.start[some]] @ ub[tb.start[cb]].T
            far = np.sqrt(np.maximum(0, 2 - 2 * cosines))
            radii = ta.radius[some][:, None] + tb.radius[cb][None, :]
            near = far - radii <= reach + _MARGIN
            if itself:
                # Each pair of children once, and each child with itself.
                near &= np.arange(len(cb))[None, :] >= np.arange(k, k + len(some))[:, None]
            i, j = np.nonzero(near)
            a, b = some[i], cb[j]
            alone = (ta.count[a] == 0) & (tb.count[b] == 0)
            if itself:
                todo += [(x, x) for x in a[(a == b) & ~alone].tolist()]
                apart = a != b
                i, j, a, b, alone = i[apart], j[apart], a[apart], b[apart], alone[apart]
            a0, b0 = ta.start[a], tb.start[b]
            cosine = cosines[i, j]
            for x in np.flatnonzero(alone & (np.abs(cosine - threshold) < 1e-12)).tolist():
                cosine[x] = _cosine(ua[a0[x]], ub[b0[x]])
            pair = alone & (cosine >= threshold)
            np.add.at(links, a0[pair], wb[b0[pair]])
            np.add.at(links, b0[pair] + shift, wa[a0[pair]])
            ties.add(a0[pair], b0[pair] + shift)
            sure = ~alone & (far[i, j] + radii[i, j] < reach - _MARGIN)
            for x in np.flatnonzero(sure).tolist():
                whole(int(a0[x]), int(ta.end[a[x]]), int(b0[x]), int(tb.end[b[x]]))
            rest = ~alone & ~sure
            todo += list(zip(a[rest].tolist(), b[rest].tolist()))
    return links + np.cumsum(add)[:total], ties.settle()


def _read(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _planted(table: pa.Table) -> pa.Table:
    """A block as one row: vectors, classes and weights in tree order, and the tree."""
    raw = _read(table["vector"])
    unit = _unit(raw)
    tree = CoverTree(unit)
    o = tree.order
    nodes = np.stack([tree.start, tree.end, tree.first, tree.count]).astype(np.int32)
    return pa.table({
        "part": table["part"][:1], "block": table["block"][:1], "size": pa.array([len(o)], pa.int32()),
        "centre": pa.array([unit[o[0]].tolist()], pa.list_(pa.float64())), "radius": [float(tree.radius[0])],
        "vectors": [unit[o].tobytes()], "node": [table["node"].to_numpy()[o].astype(np.int64).tobytes()],
        "rows": [table["n"].to_numpy()[o].astype(np.int64).tobytes()], "nodes": [nodes.tobytes()], "radii": [tree.radius.tobytes()],
    })


_BLOCK = "part string, block int, size int, centre array<double>, radius double, vectors binary, node binary, rows binary, nodes binary, radii binary"


def _grown(row: dict, side: str) -> tuple[CoverTree, np.ndarray, np.ndarray, np.ndarray]:
    tree = CoverTree.__new__(CoverTree)
    tree.start, tree.end, tree.first, tree.count = np.frombuffer(row[f"nodes_{side}"], np.int32).reshape(4, -1)
    tree.radius = np.frombuffer(row[f"radii_{side}"], np.float64)
    unit = np.frombuffer(row[f"vectors_{side}"], np.float64).reshape(row[f"size_{side}"], -1)
    return tree, unit, np.frombuffer(row[f"rows_{side}"], np.int64), np.frombuffer(row[f"node_{side}"], np.int64)


def classes_of(vectors: DataFrame, label: str = "label", vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Distinct vectors of a label: ``node`` (a number of its own), ``part`` (label and length), ``n`` rows, least id."""
    rows = vectors.filter(F.col(label).isNotNull() & usable(vector)).select(
        F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), F.col(id_column).alias("id")
    )
    classes = rows.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    numbered = classes.select(
        F.monotonically_increasing_id().alias("node"), "label", "vector", "n", "least", F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string")).alias("part")
    )
    # Written, so that a class keeps its number wherever it is read.
    return settled(numbered, "vector-classes")


def _in_blocks(classes: DataFrame) -> DataFrame:
    """Classes with ``block``: near vectors together where a part has several blocks."""
    counts = classes.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    wide = counts.filter(F.col("size") > BLOCK_ROWS)
    # Seeds: the classes of least hash, as many as blocks are needed and no more than SEEDS.
    lots = classes.join(wide, "part", "left_semi").select("part", "vector", F.xxhash64("node", F.lit(7)).alias("lot"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("lot"))
    drawn = lots.withColumn("nth", nth).filter(F.col("nth") <= SEEDS).join(wide, "part").filter(F.col("nth") <= F.ceil(F.col("size") / BLOCK_ROWS))
    seeds = drawn.groupBy("part", "size").agg(F.array_sort(F.collect_list(F.struct("nth", "vector"))).alias("seeds"))
    kind = "node long, part string, n long, vector array<double>, cell int"
    target = pa.schema([("node", pa.int64()), ("part", pa.string()), ("n", pa.int64()), ("vector", pa.list_(pa.float64())), ("cell", pa.int32())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            cell = np.zeros(len(parts), np.int32)
            for p in np.unique(parts):
                at = np.flatnonzero(parts == p)
                seeds = batch.column("seeds")[int(at[0])].as_py()
                if seeds:
                    fixed = _unit(np.array([s["vector"] for s in seeds], np.float64))
                    own = _unit(_read(batch.column("vector").take(pa.array(at))))
                    cell[at] = np.argmax(own @ fixed.T, axis=1)
            out = [batch.column(c) for c in ("node", "part", "n", "vector")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(cell)], schema=target)

    few = classes.join(wide, "part", "left_anti").select("node", "part", "n", "vector", F.lit(0).alias("cell"))
    many = classes.join(seeds, "part").select("node", "part", "n", "vector", "seeds").mapInArrow(assign, kind)
    celled = few.unionByName(many)
    cells = celled.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("cuts"))
    before = Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.withColumn("base", F.coalesce(F.sum("cuts").over(before), F.lit(0)))
    block = F.col("base") + F.pmod(F.xxhash64("node"), F.col("cuts"))
    return celled.join(bases, ["part", "cell"]).select("node", "part", "n", "vector", block.cast("int").alias("block"))


def planted(classes: DataFrame) -> DataFrame:
    """Blocks with their cover trees, a row each, written to the shared folder."""
    return settled(_in_blocks(classes).groupBy("part", "block").applyInArrow(_planted, _BLOCK), "cover-trees")


def met(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per pair of blocks and linked class: ``node``, ``links`` (linked rows in that pair), ``tied`` (least class of its component there)."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    roots = blocks.select("part", "block", "centre", "radius")
    one = roots.select("part", F.col("block").alias("a"), F.col("centre").alias("_c"), F.col("radius").alias("_r"))
    other = roots.select("part", F.col("block").alias("b"), F.col("centre").alias("_d"), F.col("radius").alias("_s"))
    squares = F.aggregate(F.zip_with("_c", "_d", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    # Blocks of one part: a row for each pair of blocks, not of vectors.
    pairs = one.join(other, "part").filter((F.col("a") <= F.col("b")) & (F.sqrt(squares) - F.col("_r") - F.col("_s") <= reach + 2 * _MARGIN)).select("part", "a", "b")

    def side(name: str, key: str) -> DataFrame:
        columns = [c for c in blocks.columns if c not in ("part", "block", "centre", "radius")]
        return blocks.select("part", F.col("block").alias(key), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    both = pairs.join(side("a", "a"), ["part", "a"]).join(side("b", "b"), ["part", "b"])
    schema = "node long, links long, tied long"
    target = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("tied", pa.int64())])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ta, ua, wa, na = _grown(row, "a")
                same = row["a"] == row["b"]
                tb, ub, wb, nb = (ta, ua, wa, na) if same else _grown(row, "b")
                links, top = links_within(ta, ua, wa, tb, ub, wb, threshold, same)
                node = na if same else np.concatenate([na, nb])
                linked = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[linked]), pa.array(np.rint(links[linked]).astype(np.int64)), pa.array(node[top[linked]])], schema=target
                )

    return settled(both.mapInArrow(traverse, schema), "block-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, label: str = "label", vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    prepare(vectors.sparkSession)
    classes = classes_of(vectors, label, vector, id_column)
    found = met(planted(classes), threshold)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(found.filter("node != tied").select(F.col("node").alias("u"), F.col("tied").alias("v")))
    owned = classes.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    told = owned.join(least, "component").join(links, "node", "left").select(
        F.col("label").alias("_l"), F.col("vector").alias("_v"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    rows = vectors.select(
        F.col(id_column).alias("vec_id"),
        F.when(F.col(label).isNotNull() & usable(vector), F.col(label)).alias("_label"), F.transform(vector, lambda x: x.cast("double")).alias("_vector"),
    )
    alone = rows.filter("_label IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.filter("_label IS NOT NULL").join(told, (F.col("_label") == F.col("_l")) & (F.col("_vector") == F.col("_v")))
    out = linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("component_id", F.col("component_id").cast("long")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
