"""Hard-negative mining: scores of a candidate at one anchor bound its scores at the anchors next to it.

Vectors are whole numbers, scores inner products. For anchors p and a and a candidate c, the score
at a lies within ``|a - p| * |c|`` of the score at p. A spanning tree of least total length joins
the anchors of a block; its root scores all candidates, and every other anchor starts from the
bounds of its parent, widened by that product. Only candidates whose bounds meet what is asked are
scored again, which makes their bounds exact: for positives those that can still be among the
first, for negatives those whose bounds overlap a window of scores.

Anchors and candidates are cut into blocks, and each block of anchors meets each block of
candidates (of its label, for positives) in a task of its own; a task keeps what can be among the
first of each anchor. Nothing but those few rows is shuffled again.

Defined results: rows without a label or vector, or with a null or non-finite component, take no
part. Vectors meet only vectors of their length. Every row counts, also where ids repeat; a row is
never its own positive. A null id is no anchor and comes last among ties, further ties by the
order of the rows. Scores beyond 64 bits are cut to the nearest long. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.llm.common import prepare, settled

POSITIVES, NEGATIVES = 5, 3
# Scores of negatives, in hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
ANCHORS, CANDIDATES = 512, 8192

_LONG = (-(2**63), 2**63 - 1)
_EXACT = 2**53


def spanning_tree(points: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Order, parent and length of the edge to it of every point, joined to the nearest point that is already in the tree."""
    n = len(points)
    parent, length = np.zeros(n, np.int64), np.full(n, np.inf)
    inside, order, at = np.zeros(n, bool), [], 0
    while True:
        inside[at] = True
        order.append(at)
        if len(order) == n:
            return order, parent, np.where(np.isinf(length), 0.0, length)
        away = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = ~inside & (away < length)
        parent[closer], length[closer] = at, away[closer]
        at = int(np.argmin(np.where(inside, np.inf, length)))


class Scores:
    """Exact scores of candidates at anchors, and bounds for those that were not scored."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray) -> None:
        most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (anchors, candidates)]
        # Doubles hold the sums exactly, or whole numbers of any size are used.
        self.kind = np.float64 if most[0] * most[1] * max(1, anchors.shape[1]) < _EXACT else object
        self.anchors, self.candidates = anchors.astype(self.kind), candidates.astype(self.kind)
        self.points = anchors.astype(np.float64)
        self.norms = np.sqrt((candidates.astype(np.float64) ** 2).sum(axis=1))
        self.order, self.parent, self.length = spanning_tree(self.points)
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.left = np.bincount(self.parent[self.order[1:]], minlength=len(anchors))
        self.scored = 0

    def at(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some candidates."""
        self.scored += len(rows)
        some = self.candidates if len(rows) == len(self.candidates) else self.candidates[rows]
        return some @ self.anchors[anchor]

    def visit(self, wanted):
        """For each anchor in tree order: the anchor, the candidates that ``wanted(anchor, lowest, highest)`` asks for, and their scores."""
        everyone = np.arange(len(self.candidates))
        for k, anchor in enumerate(self.order):
            if k == 0:
                exact = self.at(anchor, everyone)
                low, high = exact.astype(np.float64), exact.astype(np.float64)
                rows = np.flatnonzero(wanted(anchor, low, high))
                found = exact[rows]
            else:
                up = int(self.parent[anchor])
                before_low, before_high = self.bounds[up]
                # Rounding of the products and of long sums is well below this.
                slack = self.length[anchor] * self.norms
                slack = slack + 1e-9 * (slack + np.abs(before_low) + np.abs(before_high))
                low, high = before_low - slack, before_high + slack
                rows = np.flatnonzero(wanted(anchor, low, high))
                found = self.at(anchor, rows)
                low[rows] = high[rows] = found.astype(np.float64)
                self.left[up] -= 1
                if not self.left[up]:
                    del self.bounds[up]
            if self.left[anchor]:
                self.bounds[anchor] = (low, high)
            yield anchor, rows, found


def first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest scores, ties by id, then by row."""
    at = np.arange(len(scores))
    if len(at) > 4 * n:
        floor = np.partition(scores, len(scores) - n)[len(scores) - n] if scores.dtype != object else sorted(scores)[-n]
        at = np.flatnonzero(scores >= floor)
    if scores.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda x: (-scores[x], ids[x], rows[x]))[:n], np.int64)
    return at[np.lexsort((rows[at], ids[at], -scores[at]))[:n]]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(n, -1)


def _longs(scores) -> list[int]:
    return [min(max(int(s), _LONG[0]), _LONG[1]) for s in scores]


_ID_LAST = 2**63 - 1
_FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor long, positive long, row long, id long, score long"


def _blocks(anchors: pa.Table, candidates: pa.Table):
    """Trees of at most ANCHORS anchors with the candidates of the block: scores, the anchors' part of the table, and the columns of the candidates."""
    if not anchors.num_rows or not candidates.num_rows:
        return
    anchors = anchors.sort_by([("label", "ascending"), ("row", "ascending")])
    vectors = _matrix(candidates["q"], candidates.num_rows)
    label, row = candidates["label"].to_numpy(), candidates["row"].to_numpy()
    ids = candidates["id"].combine_chunks().fill_null(_ID_LAST).to_numpy(zero_copy_only=False)
    for k in range(0, anchors.num_rows, ANCHORS):
        some = anchors.slice(k, ANCHORS)
        yield Scores(_matrix(some["q"], some.num_rows), vectors), some, label, row, ids


def _positives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    out = {c: [] for c in _FOUND.names}
    for scores, some, label, row, ids in _blocks(anchors, candidates):
        own_row, own_label = some["row"].to_numpy(), some["label"].to_numpy()

        def wanted(anchor, low, high, own_row=own_row, own_label=own_label, label=label, row=row):
            fit = (label == own_label[anchor]) & (row != own_row[anchor])
            if fit.sum() > POSITIVES:
                # Five candidates have at least this score.
                sure = np.partition(low[fit], fit.sum() - POSITIVES)[fit.sum() - POSITIVES]
                fit &= high >= sure
            return fit

        for anchor, rows, found in scores.visit(wanted):
            best = first(found, ids[rows], row[rows], POSITIVES)
            out["anchor"] += [int(own_row[anchor])] * len(best)
            out["positive"] += [None] * len(best)
            out["row"] += row[rows[best]].tolist()
            out["id"] += ids[rows[best]].tolist()
            out["score"] += _longs(found[best])
    return pa.table(out, schema=_FOUND)


def _negatives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    out = {c: [] for c in _FOUND.names}
    for scores, some, label, row, ids in _blocks(anchors, candidates):
        own_row, own_label = some["row"].to_numpy(), some["label"].to_numpy()
        windows = [[(p["row"], -(-LOWEST * p["score"] // 100), HIGHEST * p["score"] // 100) for p in ps] for ps in some["positives"].to_pylist()]

        def wanted(anchor, low, high, own_label=own_label, label=label, windows=windows):
            overlaps = np.zeros(len(label), bool)
            for _, least, most in windows[anchor]:
                if least <= most:
                    overlaps |= (high >= float(least)) & (low <= float(most))
            return overlaps & (label != own_label[anchor])

        for anchor, rows, found in scores.visit(wanted):
            for positive, least, most in windows[anchor]:
                at = np.flatnonzero((found >= least) & (found <= most))
                at = at[first(found[at], ids[rows[at]], row[rows[at]], NEGATIVES)]
                out["anchor"] += [int(own_row[anchor])] * len(at)
                out["positive"] += [positive] * len(at)
                out["row"] += row[rows[at]].tolist()
                out["id"] += ids[rows[at]].tolist()
                out["score"] += _longs(found[at])
    return pa.table(out, schema=_FOUND)


def _met(anchors: DataFrame, rows: DataFrame, part: list[str], mine) -> DataFrame:
    """What ``mine`` finds in every block of anchors with every block of candidates of the same part."""
    most = anchors.groupBy(*part).agg(F.count(F.lit(1)).alias("n_anchors"))
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n_rows")).join(most, part)
    sizes = sizes.select(*part, F.ceil(F.col("n_anchors") / ANCHORS).cast("int").alias("n_a"), F.ceil(F.col("n_rows") / CANDIDATES).cast("int").alias("n_c"))

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # Lots of anchors of one label stay together, so that the edges of a tree are short.
    lot = F.xxhash64("label", F.pmod(F.xxhash64("row"), 2 * F.col("n_a")))
    left = anchors.join(sizes, part).withColumn("a", F.pmod(lot, F.col("n_a")).cast("int")).withColumn("c", all_of("n_c"))
    right = rows.join(sizes, part).withColumn("c", F.pmod(F.xxhash64("row"), F.col("n_c")).cast("int")).withColumn("a", all_of("n_a"))
    # Columns of their own, as both sides come from one table.
    right = right.select(*[F.col(c).alias(c) for c in ("row", "id", "label", "q", "dim", "c", "a")])
    keys = [*part, "a", "c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(mine, _FOUND_DDL)


def _ranked(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n of each key. Each task before the shuffle keeps no more of a key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= n)


def prepared(vectors: DataFrame, label: Column, anchor: Column, scale: int, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Rows that take part: ``row`` (a number of its own), ``id``, ``label``, ``q`` (whole components), ``dim``, ``anchor``; written to the shared folder."""
    v = F.col(vector)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(label.isNotNull() & F.coalesce(v.isNotNull() & plain, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("q"), F.size(v).alias("dim"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    return settled(rows, "whole-vectors")


def mined(rows: DataFrame) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores, for rows as ``prepared`` gives them."""
    columns = ["row", "id", "label", "q", "dim"]
    candidates, anchors = rows.select(*columns), rows.filter("anchor").select(*columns)
    positives = settled(_ranked(_met(anchors, candidates, ["dim", "label"], _positives), ["anchor"], POSITIVES), "positives")
    listed = positives.groupBy("anchor").agg(F.collect_list(F.struct("row", "score")).alias("positives"))
    asked = anchors.join(listed, F.col("row") == F.col("anchor")).select(*columns, "positives")
    negatives = _ranked(_met(asked, candidates, ["dim"], _negatives), ["anchor", "positive"], NEGATIVES)
    told = positives.select(F.col("anchor").alias("_a"), F.col("row").alias("_p"), F.col("id").alias("_pid"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("_n"), F.col("id").alias("anchor_id"))

    def known(c: str) -> Column:
        return F.when(F.col(c) != _ID_LAST, F.col(c))

    return (
        negatives.join(told, (F.col("anchor") == F.col("_a")) & (F.col("positive") == F.col("_p")))
        .join(named, F.col("anchor") == F.col("_n"))
        .select("anchor_id", known("_pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"))
    )


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every fiftieth id, where every seventh id has the next label."""
    prepare(vectors.sparkSession)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(prepared(vectors, label, F.col("vec_id") % 50 == 0, 256))
