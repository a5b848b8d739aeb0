"""Toxicity: a character n-gram classifier scaled by naive Bayes log-count ratios (9).

A text's features are the hashed character n-grams that occur in it, in lower case. Over
the learning rows, each feature's log-count ratio between toxic and other texts is
computed, and the features that tell the classes apart best are kept. A logistic
regression over presences scaled by those ratios is then fitted. Learning rows are a
sample of the labelled ones of at most about ``train_rows``; every text is scored whole.

Defined results: a null or empty text has no features and gets the score of the
intercept; rows with a null label are not learned from; several labels of one document
count once each; without learning rows of both classes every score is the share of toxic
rows (0.5 without any); repeated rows give one result each; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.llm.common import id_and_text, slices
from veriweave.session import staged

SIZES = (3, 4, 5, 6)
BITS = 20
# Features kept, labelled rows learned from at most (in expectation), and the rules of the fit.
FEATURES = 2048
TRAIN_ROWS = 30_000
ALPHA = 1.0
PENALTY = 1e-3
STEPS = 1000
# How often a toxic row counts in the regression, at most (and never more than the other class in all).
TOXIC_WEIGHT = 3.0
_PIECE = 1 << 12
_SLICE_BYTES = 4 * 1024 * 1024


def ngrams(text: str, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> np.ndarray:
    """Hash of every n-gram of the text between two spaces, in lower case (with repeats)."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    h = points * np.uint32(0x9E3779B1)
    for size in range(2, max(sizes) + 1):
        if len(points) < size:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[size - 1 :] * np.uint32(0x9E3779B1)
        if size in sizes:
            found.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """Kept features with their weights (ratio times coefficient), and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    sizes: tuple[int, ...]
    bits: int

    def score(self, texts: list[str]) -> np.ndarray:
        marked = np.zeros(1 << self.bits, bool)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            grams = ngrams(text, self.sizes, self.bits)
            marked[grams] = True
            out[i] = self.weights[marked[self.features]].sum() + self.intercept
            marked[grams] = False
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def _class_counts(rows: DataFrame, sizes: tuple[int, ...], bits: int) -> dict[int, np.ndarray]:
    """Learning texts of each class with each feature, and their number (last entry).

    Counts are summed in each task, then by pieces of the feature range; the driver gets
    one array per class.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, (1 << bits) + _PIECE), np.int32)
        marked = np.zeros(1 << bits, bool)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = ngrams(text, sizes, bits)
                marked[grams] = True
                at = np.flatnonzero(marked)
                totals[toxic, at] += 1
                totals[toxic, 1 << bits] += 1
                marked[at] = False
        for toxic in (0, 1):
            pieces = totals[toxic].reshape(-1, _PIECE)
            used = np.flatnonzero(pieces.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([toxic] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([pieces[p].tobytes() for p in used], pa.binary())],
                names=["toxic", "piece", "counts"],
            )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PIECE, np.int64)
        for batch in batches:
            for counts in batch.column(2):
                total += np.frombuffer(counts.as_buffer(), np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["toxic", "piece", "counts"],
        )

    schema = "toxic int, piece int, counts binary"
    out = {c: np.zeros((1 << bits) + _PIECE, np.int64) for c in (0, 1)}
    for row in rows.select("text", "toxic").mapInArrow(count, schema).groupBy("toxic", "piece").applyInArrow(add, schema).collect():
        out[row.toxic][row.piece * _PIECE : (row.piece + 1) * _PIECE] = np.frombuffer(row.counts, np.int64)
    return {c: v[: (1 << bits) + 1] for c, v in out.items()}


def _kept_features(rows: DataFrame, features: np.ndarray, sizes: tuple[int, ...], bits: int) -> DataFrame:
    """Label and present kept features (as numbers among them) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << bits, bool)
        for batch in batches:
            present = []
            for text in batch.column(0).to_pylist():
                grams = ngrams(text, sizes, bits)
                marked[grams] = True
                present.append(np.flatnonzero(marked[shared.value]).tolist())
                marked[grams] = False
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(present, pa.list_(pa.int32()))], names=["toxic", "present"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, present array<int>")


def regression(
    rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, scale: np.ndarray, penalty: float, steps: int, toxic_weight: float = TOXIC_WEIGHT
) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of an L2-penalised logistic regression on ``scale[column]`` at (row, column), by accelerated gradient steps."""
    n, m = len(labels), len(scale)
    counted = np.where(labels == 1, max(1.0, min(toxic_weight, (labels == 0).sum() / max(labels.sum(), 1))), 1.0)
    counted /= counted.mean()
    values = scale[columns]
    weight = np.zeros(m + 1)
    look, previous = weight.copy(), weight.copy()
    norms = np.bincount(rows, weights=values * values, minlength=n)
    step = 8.0 / ((np.percentile(norms, 95) + 1.0) * max(2.0, counted.max()) + 8 * penalty)
    for t in range(1, steps + 1):
        margin = np.bincount(rows, weights=values * look[columns], minlength=n) + look[m]
        error = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels
        error *= counted
        gradient = np.r_[np.bincount(columns, weights=values * error[rows], minlength=m) / n + penalty * look[:m], error.mean()]
        weight = look - step * gradient
        look = weight + (t - 1) / (t + 2) * (weight - previous)
        previous = weight
    return weight[:m], float(weight[m])


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS, features: int = FEATURES,
    sizes: tuple[int, ...] = SIZES, bits: int = BITS, penalty: float = PENALTY, steps: int = STEPS,
) -> Model:
    """Learn from the labelled documents for which ``learn`` (over doc_id) holds."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic in (0, 1) AND doc_id IS NOT NULL").filter(learn)
    )
    # About train_rows labels, by hash of the id. So many fit in every task, and texts need no shuffle to meet them.
    share = min(1.0, train_rows / max(known.count(), 1))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = staged(id_and_text(docs).join(F.broadcast(drawn), "doc_id"), "toxicity-rows")
    counts = _class_counts(rows, sizes, bits)
    n0, n1 = int(counts[0][-1]), int(counts[1][-1])
    if not n0 or not n1:
        rate = min(max(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(rate / (1 - rate))), sizes, bits)
    with0, with1 = counts[0][:-1].astype(float), counts[1][:-1].astype(float)
    share0, share1 = with0 / n0, with1 / n1
    overall = (with0 + with1) / (n0 + n1)
    spread = np.sqrt(np.maximum(overall * (1 - overall), 1e-12) * (1 / n0 + 1 / n1))
    strength = np.where(with0 + with1 >= 3, np.abs(share1 - share0) / spread, 0.0)
    kept = np.sort(np.argsort(-strength, kind="stable")[:features])
    kept = kept[strength[kept] > 0]
    ratio = np.log((with1[kept] + ALPHA) / (n1 + 2 * ALPHA)) - np.log((with0[kept] + ALPHA) / (n0 + 2 * ALPHA))
    sample = _kept_features(rows, kept, sizes, bits).collect()
    target = np.array([r.toxic for r in sample], float)
    many = np.array([len(r.present) for r in sample], np.int64)
    columns = np.concatenate([np.array(r.present, np.int64) for r in sample]) if sample else np.empty(0, np.int64)
    coefficients, intercept = regression(np.repeat(np.arange(len(sample)), many), columns, target, ratio, penalty, steps)
    return Model(kept, ratio * coefficients, intercept, sizes, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_column: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether a row's fold is kept from learning; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the learning folds and score every row: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = fit(docs, labels, ~held_out(), **options)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
