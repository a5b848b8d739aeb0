"""N-gram Jaccard join (1): documents whose shingle sets are alike, by count vectors in R-trees.

A document's set holds the hashes of its distinct runs of ``words`` words. Documents with
one set are one node. A set is also a point: its hashes are dealt to ``GROUPS`` groups,
and the counts per group are the coordinates. The overlap of two sets is at most the sum
of the lesser coordinates, and of a set with the sets of an R-tree node at most that sum
with the node's upper corner.

1. Space is cut so that alike sets meet: hashes are ordered by rarity (counted over all
   documents in a table of fixed size, ties by hash), and two sets with a Jaccard
   similarity of ``alike`` share one of their rarest hashes, a quarter of each set. Sets
   that share such a hash form a cell.
2. In every cell the least set is held against the others by the bound, then the least of
   those it does not allow against the rest of them, and so on; a set left alone is
   searched for in the cell's R-tree. Pairs found are held against a finer bound, by as many
   groups as a set has hashes, and those left are compared exactly. That joins groups
   of near copies without pairing them all, and sets without any pair need no comparison.
3. Cells that still hold several components are searched as R-trees for pairs of
   different components that the bound allows, by ``GROUPS`` groups in the tree and by
   ``FINE_GROUPS`` for what it finds. Components with such a pair make a cluster; the sets in
   such pairs meet block by block in their cluster, are compared exactly there, and
   give links enough to join the components. Neither step lists the pairs.
4. Components follow from the links found. No link between different components is
   missed, so the components are those of all links.
5. Every link lies within one component, so the whole join is made there: components are
   cut into blocks, each two blocks of a component meet once, are searched as R-trees and
   compared exactly. ``joined`` gives all links between different sets with the documents
   of each set, ``link_counts`` the links per document. ``linked_by_join`` counts them where
   they are found, so that a large group of near copies gives a row per set and block, not
   one per pair.

Defined results: documents with one set are linked with each other too, repeated rows
among them; empty sets have no links; a null or empty text, or one without words, has an empty set and stands
alone; with fewer words than ``words`` the whole sequence is the one shingle; null ids
are kept and never the name of a component while it has another id; repeated rows give
one row each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriweave.functions.groups import broadcast_if_small
from veriweave.llm.common import LOWER, WHITE, Rolling, frugal, id_and_text, mix, partitions_for, settled, slices, text_bytes, word_bounds
from veriweave.llm.graph_components import components

WORDS = 5
# Similarity: 100 * overlap >= PERCENT * union.
PERCENT = 75
GROUPS = 64
# Groups of the finer bound, at least; sets of more hashes have more.
FINE_GROUPS = 512
FAN_OUT = 16
# Sets of a cell that one task searches; larger cells are searched block by block.
BLOCK_SETS = 4096
# Entries of the table of counts that orders hashes by rarity.
TABLE_BITS = 18
# Sets, and hashes in them, of a component that the whole join takes as one block.
PAIR_SETS = 512
PAIR_HASHES = 1 << 20
_PIECE = 1 << 12
_SLICE_BYTES = 1024 * 1024
_PROFILE = "doc_id long, n long, node long, point binary, piece int, counts binary"
_BLOBS = "bucket int, n int, nodes binary, tokens binary"
_CELLS = "cell long, node long, n long, many long"
_SETS = "node long, n long, counts binary, hashes binary"
# Nodes that are sent to all tasks to read the sets of those only, at most.
SENT_NODES = 500_000
_LINKS = "a long, b long, common long"
_NODE = np.dtype([("node", "<i8"), ("n", "<u4")])
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xE7037ED1A0B428DB)


def sets_of(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets, WHITE)
    h = Rolling(raw).pieces(starts, ends)
    runs = h[: max(len(h) - words + 1, 0)].copy()
    for i in range(1, words):
        runs = mix(runs * _A + h[i : i + len(runs)] + _B)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            short = h[a : a + 1].copy()
            for i in range(a + 1, b):
                short = mix(short * _A + h[i : i + 1] + _B)
            # Short sequences are told apart from runs of full length.
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    total = mix(hashes * _B).sum(dtype=np.uint64) + np.uint64(len(hashes)) if len(hashes) else np.uint64(0)
    return int(mix(np.array([total]))[0].view(np.int64))


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    """The least overlap of alike sets of n and m hashes."""
    return -((-percent * (n + m)) // (100 + percent))


def _counts(hashes: np.ndarray, groups: int) -> np.ndarray:
    """How many hashes of a set are in each group; groups are told by the last bits."""
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def _packed(counts: np.ndarray, groups: int) -> bytes:
    """Counts in as few bytes each as the greatest needs."""
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // groups}")


def fine_counts(hashes: np.ndarray) -> bytes:
    """The number of groups, the least power of two of at least ``FINE_GROUPS`` and the hashes, and the packed counts."""
    groups = max(FINE_GROUPS, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else FINE_GROUPS
    return groups.to_bytes(4, "little") + _packed(_counts(hashes, groups), groups)


def fine_bound(a: bytes, b: bytes) -> int:
    """The most hashes that two sets can share by their fine counts. Of two numbers of groups the lesser counts."""
    x, y = _fine(a), _fine(b)
    groups = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, groups).sum(0), y.reshape(-1, groups).sum(0)).sum())


def _fine(counts: bytes) -> np.ndarray:
    return _unpacked(memoryview(counts)[4:], int.from_bytes(counts[:4], "little")).astype(np.int64)


def _folded(sets: DataFrame) -> DataFrame:
    """``node`` and ``point``: counts of every set by ``FINE_GROUPS`` groups."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [_packed(_fine(c).reshape(-1, FINE_GROUPS).sum(0), FINE_GROUPS) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.binary())], names=["node", "point"])

    return sets.select("node", "counts").mapInArrow(run, "node long, point binary")


def _profile(source: DataFrame, words: int) -> DataFrame:
    """Size, digest and point of every set; and, in rows of their own, counts of hashes by table entry."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << TABLE_BITS, np.int64)
        names = [c.split()[0] for c in _PROFILE.split(", ")]
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                sets = sets_of(*text_bytes(part.column(1)), words)
                every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                counts += np.bincount((every >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(counts))
                n = len(sets)
                points = [_packed(_counts(s, GROUPS), GROUPS) for s in sets]
                columns = (part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), pa.array(points, pa.binary()))
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        pieces = counts.reshape(-1, _PIECE)
        n = len(pieces)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([p.astype("<i4").tobytes() for p in pieces], pa.binary())],
            names=names,
        )

    return source.mapInArrow(run, _PROFILE)


def _rarity(profile: DataFrame) -> np.ndarray:
    """The table of counts, summed over all tasks."""

    @frugal
    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PIECE, np.int64)
        for batch in batches:
            for counts in batch.column(1):
                total += np.frombuffer(counts.as_buffer(), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "counts"])

    table = np.zeros(1 << TABLE_BITS, np.int64)
    rows = profile.filter("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(add, "piece int, counts binary")
    for row in rows.collect():
        table[row.piece * _PIECE : (row.piece + 1) * _PIECE] = np.frombuffer(row.counts, np.int64)
    return table


def _rare_hashes(source: DataFrame, rarity: np.ndarray, n_buckets: int, words: int, percent: int) -> DataFrame:
    """The rarest hashes of every set, by bucket; equal sets of one slice are sent once."""
    shared = source.sparkSession.sparkContext.broadcast(rarity)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                known: dict[tuple[int, int], np.ndarray] = {}
                for hashes in sets_of(*text_bytes(part.column(1)), words):
                    if len(hashes):
                        known.setdefault((digest(hashes), len(hashes)), hashes)
                if not known:
                    continue
                nodes = np.array(list(known), _NODE)
                chosen = []
                for hashes in known.values():
                    keep = len(hashes) - -(-percent * len(hashes) // 100) + 1
                    order = np.lexsort((hashes, rarity[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]))
                    chosen.append(hashes[order[:keep]])
                every = np.concatenate(chosen)
                owner = np.repeat(np.arange(len(nodes)), [len(c) for c in chosen])
                bucket = (every % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                every, owner, bucket = (every[order] >> np.uint64(32)).astype("<u4"), owner[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                rows = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(every)], strict=True):
                    used, own = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), b - a, nodes[used].tobytes(), every[a:b].tobytes() + own.astype("<u4").tobytes()))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _BLOBS.split(", ")]
                )

    return source.mapInArrow(run, _BLOBS)


def _cells(blobs: DataFrame) -> DataFrame:
    """Cells with several nodes, each set of nodes once per bucket."""

    @frugal
    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tokens, owners = [], [], []
        n_nodes = 0
        for batch in batches:
            for n, listed, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                own = np.frombuffer(listed, _NODE)
                nodes.append(own)
                tokens.append(np.frombuffer(body, "<u4", n))
                owners.append(np.frombuffer(body, "<u4", n, 4 * n).astype(np.int64) + n_nodes)
                n_nodes += len(own)
        listed, at = np.unique(np.concatenate(nodes), return_inverse=True)
        pairs = np.unique(np.concatenate(tokens).astype(np.uint64) << np.uint64(32) | at[np.concatenate(owners)].astype(np.uint64))
        token, owner = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        many = np.diff(np.r_[start, len(token)])
        start, many = start[many > 1], many[many > 1]
        if not len(start):
            return
        # A digest of the nodes of each cell; cells with the same nodes count once.
        sums = np.r_[np.uint64(0), np.cumsum(mix(listed["node"].view(np.uint64)[owner] * _A + listed["n"][owner].astype(np.uint64)))]
        cell = mix(sums[start + many] - sums[start] + many.astype(np.uint64))
        cell, keep = np.unique(cell, return_index=True)
        start, many = start[keep], many[keep]
        rows = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = listed[owner[rows]]
        columns = (np.repeat(cell, many).view(np.int64), own["node"], own["n"].astype(np.int64), np.repeat(many, many))
        names = [c.split()[0] for c in _CELLS.split(", ")]
        for a in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[a : a + 100_000])) for c in columns], names=names)

    return blobs.groupBy("bucket").applyInArrow(one, _CELLS)


def _sets(source: DataFrame, words: int) -> DataFrame:
    """Size, fine counts and hashes of the given documents (node, text), by node; a row may come twice."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                sets = sets_of(*text_bytes(part.column(1)), words)
                # Where ids repeat, the text of another node may come along.
                own = [(i, s) for i, s in zip(part.column(0).to_pylist(), sets, strict=True) if digest(s) == i]
                columns = ([i for i, _ in own], [len(s) for _, s in own], [fine_counts(s) for _, s in own], [s.tobytes() for _, s in own])
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "counts", "hashes"])

    return source.mapInArrow(run, _SETS)


def _points(column: pa.Array, groups: int = GROUPS) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == groups for r in rows):
        return np.frombuffer(b"".join(rows), "<u1").reshape(-1, groups).astype(np.int32)
    return np.stack([_unpacked(r, groups).astype(np.int32) for r in rows])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the keys in tables that cut no group, with the first row of each group."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        first = starts(table)
        if len(first) > 1:
            yield table.slice(0, first[-1]), first[:-1]
            held = table.slice(first[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def _of_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sets of the given nodes. A counted few are sent to where the sets are read, so that no other set is shuffled."""
    return sets.join(broadcast_if_small(nodes, SENT_NODES), "node", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the columns of both sets, named after their side."""
    side = lambda name: sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns]).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{name}" for c in columns for name in "ab"])


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are alike, as edges: by the bound of their fine counts, then by their hashes."""

    @frugal
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i) for i in range(2, 6))
            least = needed(n.to_numpy(), m.to_numpy(), percent)
            kept = [fine_bound(a.as_py(), b.as_py()) >= k for a, b, k in zip(x, y, least.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(kept, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    @frugal
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                kept.append(int((y[at] == x).sum()) >= int(needed(len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(kept, pa.bool_())) for i in (0, 1)], names=["u", "v"])

    able = settled(_with_both(pairs, sets, "n", "counts").mapInArrow(bound, "a long, b long"), "bounded-pairs")
    return _with_both(able, _of_nodes(sets, _ends(able)), "hashes").mapInArrow(exact, "u long, v long")


class Tree:
    """A packed R-tree of points: upper corners and least sizes of nodes, level by level, leaves first."""

    def __init__(self, points: np.ndarray, n: np.ndarray) -> None:
        # Sort by size, then tile by the group in which the points of a slab differ most.
        order = np.argsort(n, kind="stable")
        slab = FAN_OUT * FAN_OUT
        tiles = []
        for a in range(0, len(order), slab):
            own = order[a : a + slab]
            widest = int(np.argmax(points[own].max(0) - points[own].min(0))) if len(own) else 0
            tiles.append(own[np.argsort(points[own, widest], kind="stable")])
        self.order = np.concatenate(tiles) if tiles else order
        corner, least = points[self.order], n[self.order]
        self.levels = [(corner, least)]
        while len(corner) > FAN_OUT:
            cuts = np.arange(0, len(corner), FAN_OUT)
            corner, least = np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((corner, least))

    def search(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Indices of points whose bound with the given one allows the overlap needed."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            at = at[at < len(corner)]
            at = at[np.minimum(corner[at], point).sum(1) >= needed(least[at], n, percent)]
            if depth:
                at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).reshape(-1)
        return self.order[at]


class Parts:
    """Rows of one block by component, and the components put together so far."""

    def __init__(self, component: np.ndarray) -> None:
        self.component, self.label = np.unique(component, return_inverse=True)

    def join(self, row: int, rows: np.ndarray) -> np.ndarray:
        """Put the components of the rows together with that of the row; one row of each that was apart from it."""
        others, at = np.unique(self.label[rows], return_index=True)
        apart = others != self.label[row]
        if apart.any():
            together = np.zeros(len(self.component), bool)
            together[others[apart]] = True
            self.label[together[self.label]] = self.label[row]
        return rows[at[apart]]

    def names(self) -> np.ndarray:
        """A component of each row's, the same for those put together."""
        return self.component[self.label]


def _dealt(cells: DataFrame, block_sets: int) -> DataFrame:
    """Add ``own``, the block of the node in a cell of more than ``block_sets`` nodes (``many``)."""
    return cells.withColumn("own", F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / block_sets)))


def _first_pairs(cells: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Pairs (a, b) that the bound allows: enough for every node that has any such pair in a cell, and few in groups of near copies.

    ``cells`` has cell, node, n and point. In a cell that is met block by block every node
    is also paired with itself, as one that may have pairs in another block.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_groups(batches, ["cell", "own"]):
            node, n, blocks = (table.column(c).to_numpy() for c in ("node", "n", "many"))
            points = _points(table.column("point"))
            group = np.zeros(len(node), np.int64)
            group[first[1:]] = 1
            centre = first[np.cumsum(group)]
            allowed = np.minimum(points, points[centre]).sum(1) >= needed(n, n[centre], percent)
            a, b = [node[centre[allowed]]], [node[allowed]]
            large = blocks > block_sets
            a.append(node[large])
            b.append(node[large])
            for start, end in zip(first, [*first[1:], len(node)], strict=True):
                left = start + np.flatnonzero(~allowed[start:end])
                if end - start < 3 or not len(left):
                    continue
                tree, alone = Tree(points[start:end], n[start:end]), []
                while len(left):
                    own, left = left[0], left[1:]
                    near = np.minimum(points[left], points[own]).sum(1) >= needed(n[left], n[own], percent)
                    a.append(np.full(near.sum(), node[own]))
                    b.append(node[left[near]])
                    left = left[~near]
                    if not near.any():
                        alone.append(own)
                for own in alone:
                    at = start + tree.search(points[own], int(n[own]), percent)
                    at = at[at != own][:1]
                    a.append(np.full(len(at), node[own]))
                    b.append(node[at])
            a, b = np.concatenate(a), np.concatenate(b)
            kept = (a != b) | np.isin(a, node[large])
            pairs = np.unique(np.stack([np.minimum(a, b)[kept], np.maximum(a, b)[kept]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

    dealt = _dealt(cells, block_sets).select("cell", "own", "many", "node", "n", "point")
    return dealt.repartition("cell", "own").sortWithinPartitions("cell", "own", "node").mapInArrow(run, "a long, b long").distinct()


def _met_between(cells: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Nodes that share a cell with one of another component that the bound allows: node, component, and ``cluster``.

    ``cells`` has cell, node, n, component and point (by ``FINE_GROUPS``). A cell of more than
    ``block_sets`` nodes is met block by block. The pairs are not listed: the components that they
    join in a block are named by one of them, the cluster, so a block gives at most a row per node.
    """
    blocks = F.ceil(F.col("many") / block_sets)
    dealt = (
        _dealt(cells, block_sets)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "component", "point")
    )

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_groups(batches, ["cell", "low", "high"]):
            node, n, component, own, low, high = (table.column(c).to_numpy() for c in ("node", "n", "component", "own", "low", "high"))
            fine = _points(table.column("point"), FINE_GROUPS)
            # Groups are told by the last bits, so the lesser number of groups is a sum over the greater.
            points = fine.reshape(len(fine), -1, GROUPS).sum(1)
            found = [np.empty((3, 0), np.int64)]
            for start, end in zip(first, [*first[1:], len(node)], strict=True):
                rows = np.arange(start, end)
                asked, kept = rows[own[rows] == low[start]], rows[own[rows] == high[start]]
                if not len(asked) or not len(kept):
                    continue
                tree, met = Tree(points[kept], n[kept]), np.zeros(len(rows), bool)
                parts = Parts(component[rows])
                for i in asked:
                    at = kept[tree.search(points[i], int(n[i]), percent)]
                    at = at[component[at] != component[i]]
                    if low[start] == high[start]:
                        at = at[node[at] > node[i]]
                    at = at[np.minimum(fine[at], fine[i]).sum(1) >= needed(n[at], int(n[i]), percent)]
                    if len(at):
                        met[i - start] = True
                        met[at - start] = True
                        parts.join(i - start, at - start)
                some = rows[met]
                found.append(np.stack([node[some], component[some], parts.names()[met]]))
            rows = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["node", "component", "cluster"])

    ordered = dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return ordered.mapInArrow(run, "node long, component long, cluster long").distinct()


def _all_pairs(placed: DataFrame, sets: DataFrame, percent: int, block_sets: int, block_hashes: int, counted: bool = False, apart: bool = False) -> DataFrame:
    """All links (a, b, common) with a < b among the nodes of each component; ``placed`` has node, n, copies and component.

    ``counted``: instead, for every node the linked documents of other nodes, by block (node, links).
    ``apart``: ``placed`` also has ``part``; only links between parts, and of those enough to join the same parts in each block.

    A component of more than ``block_sets`` nodes or ``block_hashes`` hashes is met block by block.
    Hashes join last, so that they are shuffled twice only, and only those of the nodes asked for.
    """
    sizes = placed.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / block_hashes)).alias("blocks"))
    part = F.col("part" if apart else "component").alias("part")
    dealt = placed.join(sizes.hint("merge"), "component").select("component", "blocks", "node", "copies", part, F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))
    met = (
        dealt.join(_of_nodes(sets, placed.select("node")).select("node", "hashes").hint("merge"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "copies", "part", "hashes")
    )

    def taken(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, common = np.concatenate(found, axis=1)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(common)], names=["a", "b", "common"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_found = [], 0
        for table, first in _whole_groups(batches, ["component", "low", "high"]):
            node, own, low, high, copies, part = (table.column(c).to_numpy() for c in ("node", "own", "low", "high", "copies", "part"))
            column = table.column("hashes")
            for start, end in zip(first, [*first[1:], len(node)], strict=True):
                # A set may come twice.
                rows = start + np.flatnonzero(np.r_[True, node[start + 1 : end] != node[start : end - 1]])
                if len(rows) < 2:
                    continue
                names, block, weight = node[rows], own[rows], copies[rows]
                total = np.zeros(len(rows), np.int64)
                sets = [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in rows]
                n = np.array([len(x) for x in sets])
                offsets = np.r_[0, np.cumsum(n)]
                used, flat = np.unique(np.concatenate(sets), return_inverse=True)
                groups = (used[flat] & np.uint64(GROUPS - 1)).astype(np.int64) + GROUPS * np.repeat(np.arange(len(n)), n)
                points = np.bincount(groups, minlength=GROUPS * len(n)).reshape(-1, GROUPS)
                asked, kept = np.flatnonzero(block == low[start]), np.flatnonzero(block == high[start])
                if not len(asked) or not len(kept):
                    continue
                tree, marked = Tree(points[kept], n[kept]), np.zeros(len(used), bool)
                parts = Parts(part[rows]) if apart else None
                for i in asked:
                    at = kept[tree.search(points[i], int(n[i]), percent)]
                    if apart:
                        # Those joined in this block need no more links.
                        at = at[parts.label[at] != parts.label[i]]
                    if low[start] == high[start]:
                        at = at[names[at] > names[i]]
                    if not len(at):
                        continue
                    # How many hashes of each candidate are marked as those of the set.
                    marked[flat[offsets[i] : offsets[i + 1]]] = True
                    ends = np.cumsum(n[at])
                    places = np.arange(ends[-1]) + np.repeat(offsets[at] - ends + n[at], n[at])
                    common = np.add.reduceat(marked[flat[places]], ends - n[at], dtype=np.int64)
                    marked[flat[offsets[i] : offsets[i + 1]]] = False
                    alike = common >= needed(n[at], int(n[i]), percent)
                    if apart:
                        alike &= np.isin(at, parts.join(i, at[alike]))
                    if counted:
                        total[i] += weight[at[alike]].sum()
                        total[at[alike]] += weight[i]
                        continue
                    found.append(np.stack([np.full(alike.sum(), names[i]), names[at[alike]], common[alike]]))
                    n_found += int(alike.sum())
                    if n_found >= 100_000:
                        yield taken(found)
                        n_found = 0
                if counted:
                    some = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(total[some])], names=["node", "links"])
        if found:
            yield taken(found)

    ordered = met.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "node")
    return ordered.mapInArrow(run, "node long, links long" if counted else _LINKS)


def _spanning(
    docs: DataFrame, words: int, percent: int, block_sets: int, pair_sets: int = PAIR_SETS, pair_hashes: int = PAIR_HASHES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, node), hashes of the nodes that may have links, and links enough for the components."""
    source = id_and_text(docs)
    profile = settled(_profile(source, words), "shingle-profile")
    documents = profile.filter("piece IS NULL").select("doc_id", "n", "node")
    whole = profile.filter("n > 0")
    classes = whole.groupBy("node").agg(F.min("doc_id").alias("least"))
    points = whole.groupBy("node").agg(F.max("point").alias("point")).hint("merge")
    cells = settled(_cells(_rare_hashes(source, _rarity(profile), partitions_for(docs), words, percent)).distinct(), "shingle-cells")
    pairs = settled(_first_pairs(cells.join(points, "node"), percent, block_sets), "shingle-pairs")

    # One document stands for each node that has a pair.
    active = _ends(pairs)
    ids = active.join(classes, "node").select("node", F.col("least").alias("doc_id"))
    texts = source.join(ids.hint("merge"), source["doc_id"].eqNullSafe(ids["doc_id"])).select("node", "text")
    sets = settled(_sets(texts, words), "shingle-sets")
    first = settled(_alike(pairs.filter("a != b"), sets, percent), "links")
    found = components(first)

    # Cells that hold several components are searched; the sets that may link them are met cluster by cluster.
    placed = cells.join(active.hint("merge"), "node", "left_semi").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("cell")
    left = placed.join(several, "cell").join(_folded(sets).hint("merge"), "node")
    met = settled(_met_between(left, percent, block_sets), "shingle-clusters")
    clusters = components(met.select(F.col("component").alias("u"), F.col("cluster").alias("v")))
    parts = met.select("node", F.col("component").alias("part")).distinct().join(clusters.withColumnRenamed("node", "part"), "part")
    sizes = sets.select("node", "n").distinct().withColumn("copies", F.lit(1).cast("long"))
    between = settled(parts.join(sizes.hint("merge"), "node"), "shingle-parts")
    more = _all_pairs(between, sets, percent, pair_sets, pair_hashes, apart=True)
    links = first.unionByName(settled(more.select(F.col("a").alias("u"), F.col("b").alias("v")), "links"))
    return documents, sets, links


def _named(documents: DataFrame, final: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document, by the component of its node."""
    classes = documents.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("least"))
    named = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.select("node", "n", "component").join(names, "component").select("node", "n", "component_id")
    return documents.join(of_node, ["node", "n"], "left").select(
        "doc_id", "node", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the least id that links reach) of every document, without listing all links."""
    documents, _, links = _spanning(docs, words, percent, block_sets)
    return _named(documents, components(links)).drop("node")


def _placed(documents: DataFrame, spanning: DataFrame) -> DataFrame:
    """Nodes that have links: node, component, n, copies (documents of the node); written, as several steps read it."""
    sizes = documents.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    return settled(components(spanning).join(sizes.hint("merge"), "node"), "shingle-components")


def joined(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS, pair_sets: int = PAIR_SETS, pair_hashes: int = PAIR_HASHES
) -> tuple[DataFrame, DataFrame]:
    """The whole join: ``doc_id``, ``n_shingles``, ``node`` of every document, and ``a``, ``b``, ``common`` of every two nodes with alike sets.

    Documents of one node have one set; the links between documents are those of their
    nodes and all pairs within a node that is not empty.
    """
    documents, sets, spanning = _spanning(docs, words, percent, block_sets, pair_sets, pair_hashes)
    placed = _placed(documents, spanning)
    return documents.withColumnRenamed("n", "n_shingles"), settled(_all_pairs(placed, sets, percent, pair_sets, pair_hashes), "all-links")


def linked_by_join(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS, pair_sets: int = PAIR_SETS, pair_hashes: int = PAIR_HASHES
) -> DataFrame:
    """What ``linked`` gives, and ``n_links``, the other documents each is linked with, from the whole join."""
    documents, sets, spanning = _spanning(docs, words, percent, block_sets, pair_sets, pair_hashes)
    placed = _placed(documents, spanning)
    links = _all_pairs(placed, sets, percent, pair_sets, pair_hashes, counted=True).groupBy("node").agg(F.sum("links").alias("links"))
    copies = documents.filter("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    counts = copies.join(settled(links, "link-counts"), "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = _named(documents, placed.select("node", "component"))
    n_links = F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")
    return named.join(counts, "node", "left").select("doc_id", "n_shingles", "component_id", n_links)


def link_counts(documents: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``n_links`` (other documents with an alike set) of every document, from what ``joined`` gives."""
    copies = documents.filter("n_shingles > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    both = links.select(F.col("a").alias("of"), F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("of"), F.col("a").alias("node")))
    others = both.join(copies, "node").groupBy("of").agg(F.sum("copies").alias("others")).withColumnRenamed("of", "node")
    counted = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    n_links = F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links")
    return documents.join(counted, "node", "left").select("doc_id", "n_shingles", n_links)
