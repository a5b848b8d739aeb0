"""Language identification by segmentation-marginalised unigrams (8).

The pieces of a published vocabulary get one probability per language. The likelihood
of a word is the sum over all its segmentations into pieces, found by a forward
algorithm; a text is scored by the product over its words, whole. Probabilities are
learned by expectation maximisation over the same segmentations, from word counts of a
bounded sample of labelled texts per language (``train_docs``).

Defined results: null texts and texts without a letter are ``und`` with score 0; rows
without a language are not learned from; without any labelled text everything is
``und``; equal posteriors go to the smaller language name; repeated rows give one
result each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.llm.common import frugal, hold, id_and_text, mix, slices, with_kept
from veriweave.session import staged

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
# Labelled texts learned from, per language, at most in expectation.
TRAIN_DOCS = 2000
ROUNDS = 2
UNDECIDED = "und"
# Probability of a character that no piece covers, and the count added to every piece.
UNKNOWN = 1e-7
SMOOTHING = 0.05
_CACHE_WORDS = 200_000
_SLICE_BYTES = 2 * 1024 * 1024
_GROUP_CELLS = 1 << 20
_ROWS_TOGETHER = 50_000
# Words longer than this are scored one by one, and not learned from.
_LONG = 64
_MARK = "▁"


class Pieces:
    """The pieces of the vocabulary, found by hash."""

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
        self.longest = max(map(len, self.names))
        self.n = len(self.names)
        keys = np.empty(self.n, np.uint64)
        for size in range(1, self.longest + 1):
            own = [i for i, p in enumerate(self.names) if len(p) == size]
            if own:
                h = np.zeros(len(own), np.uint64)
                points = _points([self.names[i] for i in own], size)
                for t in range(size):
                    h = _extend(h, points[:, t])
                keys[own] = h
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.marked = np.zeros(1 << 22, bool)
        self.marked[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @classmethod
    def of(cls, path: str) -> Pieces:
        hold("language_id", cls._made.clear)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def find(self, points: np.ndarray) -> list[np.ndarray]:
        """Piece ids by length: entry s has, for each word and end, the piece of s + 1 characters that ends there.

        ``n`` stands for an unknown single character, ``n + 1`` for no piece.
        """
        words, length = points.shape
        found = []
        hashes = np.zeros((words, length), np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            hashes = _extend(hashes[:, : length - size + 1], points[:, size - 1 :])
            ids = np.full(hashes.shape, self.n if size == 1 else self.n + 1, np.int32)
            maybe = self.marked[(hashes >> np.uint64(42)).astype(np.int64)]
            asked = hashes[maybe]
            at = np.minimum(np.searchsorted(self.keys, asked), self.n - 1)
            ids[maybe] = np.where(self.keys[at] == asked, self.rank[at], ids[maybe])
            found.append(ids)
        return found


def _points(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)


def _extend(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + points.astype(np.uint64) + np.uint64(1))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Indices and texts of words of one length, in groups of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    row = 0
    while row < len(order):
        size = max(int(lengths[order[row]]), 1)
        end = int(np.searchsorted(lengths[order], size, side="right"))
        end = min(end, row + max(1, _GROUP_CELLS // (size * 16)))
        yield order[row:end], [words[i] for i in order[row:end]]
        row = end


def forward(pieces: Pieces, words: list[str], table: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations: one row per word, one column per column of ``table``.

    ``table``: probability by piece, then of an unknown character, then 0 for no piece.
    """
    out = np.zeros((len(words), table.shape[1]))
    for rows, group in _by_length([_MARK + w for w in words]):
        length = len(group[0])
        if length > _LONG:
            for row, word in zip(rows, group, strict=True):
                out[row] = _forward_long(pieces.find(_points([word], length)), table, length)
        else:
            out[rows] = _forward(pieces.find(_points(group, length)), table, len(group), length)[0]
    return out


def _forward_long(found: list[np.ndarray], table: np.ndarray, length: int) -> np.ndarray:
    """Log-likelihoods of one long word: all pieces that end at a place are taken at once."""
    sizes = len(found)
    # Sums of the last prefixes, the longest first.
    window = np.zeros((sizes, table.shape[1]))
    window[0] = 1.0
    logs = np.zeros(table.shape[1])
    for begin in range(0, length, _LONG):
        end = min(begin + _LONG, length)
        ids = np.full((end - begin, sizes), len(table) - 1, np.int32)
        for size in range(1, sizes + 1):
            first = max(begin + 1, size)
            if first <= end:
                ids[first - 1 - begin :, size - 1] = found[size - 1][0, first - size : end - size + 1]
        for place, shares in enumerate(table[ids]):
            now = (window * shares).sum(0)
            window[1:] = window[:-1]
            window[0] = now
            if place % 16 == 15:
                top = window.max(0)
                window /= top
                logs += np.log(top)
    return np.log(window[0]) + logs


def _forward(found: list[np.ndarray], table: np.ndarray, n: int, length: int, keep: bool = False):
    """Log-likelihoods, and if asked the scaled sums by end of prefix with the logs of their scales."""
    alpha = [np.ones((n, table.shape[1]))]
    logs = np.zeros((n, table.shape[1]))
    none = len(table) - 1
    kept, scales = [alpha[0]], [logs.copy()]
    for t in range(1, length + 1):
        now = np.zeros_like(logs)
        for size in range(1, min(len(found), t) + 1):
            ids = found[size - 1][:, t - size]
            if size < 3:
                now += alpha[-size] * table[ids]
                continue
            # Few words have a longer piece at any one place.
            rows = np.flatnonzero(ids != none)
            if len(rows):
                now[rows] += alpha[-size][rows] * table[ids[rows]]
        alpha.append(now)
        if t % 8 == 0:
            # All sums that are still needed are divided by the largest of them.
            top = np.maximum.reduce(alpha[-len(found) :])
            alpha = [a / top for a in alpha[-len(found) :]]
            logs = logs + np.log(top)
        if keep:
            kept.append(alpha[-1])
            scales.append(logs.copy())
    return np.log(alpha[-1]) + logs, kept, scales


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, times their weights."""
    total = np.zeros(pieces.n + 2)
    table = probability[:, None]
    for rows, group in _by_length([_MARK + w for w in words]):
        length = len(group[0])
        points = _points(group, length)
        found = pieces.find(points)
        likelihood, ahead, ahead_log = _forward(found, table, len(group), length, keep=True)
        # The same sums from the other end of the words.
        turned = [f[:, ::-1] for f in found]
        _, back, back_log = _forward(turned, table, len(group), length, keep=True)
        for size, ids in enumerate(found, 1):
            for start in range(length - size + 1):
                rest = length - start - size
                logs = ahead_log[start] + back_log[rest] - likelihood
                share = ahead[start] * back[rest] * table[ids[:, start]] * np.exp(logs)
                total += np.bincount(ids[:, start], weights=share[:, 0] * weights[rows], minlength=pieces.n + 2)
    return total


class Model:
    """Piece probabilities of each language."""

    def __init__(self, languages: list[str], table: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.table, self.prior = languages, table, prior


def _initial(n: int) -> np.ndarray:
    return np.r_[np.full(n, 1.0 / n), UNKNOWN, 0.0]


def fit(
    docs: DataFrame, learn: Column, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS,
    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
) -> Model:
    """Learn from the labelled rows for which ``learn`` holds.

    Texts are sampled by a hash of their content so that about ``train_docs`` are read per
    language; the driver gets one count per language and piece, which the vocabulary bounds.
    """
    labelled = docs.filter(learn & F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}")).select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")
    )
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    pieces = Pieces.of(vocabulary)
    if not languages:
        return Model([], np.zeros((pieces.n + 2, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, train_docs / sizes[lang]))])
    drawn = F.pmod(F.xxhash64("text", F.lit(8)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    counts = staged(
        labelled.filter(drawn)
        .select("lang", F.explode(F.split("text", r"\s+")).alias("word"))
        .filter(f"word != '' AND length(word) < {_LONG}")
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")),
        "language-words",
    )
    table = np.stack([_initial(pieces.n)] * len(languages), 1)
    for _ in range(rounds):
        found = {(r.lang, r.piece): r.n for r in _expectation(counts, languages, table, vocabulary).collect()}
        for j, lang in enumerate(languages):
            own = np.array([found.get((lang, i), 0.0) for i in range(pieces.n)]) + SMOOTHING
            table[: pieces.n, j] = own / own.sum()
    n = np.array([sizes[lang] for lang in languages], float)
    return Model(languages, table, np.log(n / n.sum()))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of some size, since words are taken in groups of one length."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS_TOGETHER:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _expectation(counts: DataFrame, languages: list[str], table: np.ndarray, vocabulary: str) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast(table)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(vocabulary)
        totals = np.zeros((len(languages), pieces.n + 2))
        for rows in _together(batches):
            langs = np.array(rows.column(0).to_pylist(), object)
            words, n = rows.column(1).to_pylist(), rows.column(2).to_numpy()
            for j, lang in enumerate(languages):
                own = np.flatnonzero(langs == lang)
                if len(own):
                    totals[j] += expected_counts(pieces, [words[i] for i in own], n[own], shared.value[:, j])
        at = np.argwhere(totals[:, : pieces.n] > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([languages[j] for j in at[:, 0]], pa.string()), pa.array(at[:, 1]), pa.array(totals[at[:, 0], at[:, 1]])],
            names=["lang", "piece", "n"],
        )

    return counts.select("lang", "word", "n").mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Scorer:
    """Scores of words under a model, kept in a table of bounded size."""

    def __init__(self, model: Model, vocabulary: str) -> None:
        self.model, self.pieces = model, Pieces.of(vocabulary)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text by language."""
        cut = [t.split() for t in texts]
        place = self.place
        new = [w for w in {w for words in cut for w in words} if w not in place]
        if len(place) + len(new) > _CACHE_WORDS:
            place.clear()
            self.scores = self.scores[:0]
            new = list({w for words in cut for w in words})
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, forward(self.pieces, new, self.model.table)])
        out = np.zeros((len(texts), self.scores.shape[1]))
        for i, words in enumerate(cut):
            if words:
                out[i] = self.scores[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(0)
        return out


def predict(
    docs: DataFrame, model: Model, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (the posterior of that language) of every whole text; no shuffle.

    Columns to ``keep`` follow (see ``id_and_text``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    decided = F.col("text").rlike(r"\p{L}") & F.lit(bool(model.languages))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model, vocabulary)
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                asked = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                texts = [t if a else "" for t, a in zip(part.column(1).to_pylist(), asked, strict=True)]
                langs, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
                if model.languages:
                    logs = scorer.texts(texts) + model.prior
                    best = logs.argmax(1)
                    posterior = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                    langs = [model.languages[b] if a else UNDECIDED for a, b in zip(asked, best, strict=True)]
                    scores = np.where(asked, posterior, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores), *part.columns[2:-1]], names=schema.names)

    source = id_and_text(docs, id_column, text_column, keep).withColumn("asked", decided)
    schema = with_kept("doc_id long, lang_pred string, score double", docs, keep)
    return source.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether a row's fold is kept from learning; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the learning folds and predict every row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    model = fit(docs, ~held_out(), **options)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
