"""Benchmark decontamination (5): a prefix-filtered set join of benchmark windows with documents.

A window is a run of ``size`` item words (a shorter item is one window). Its set is made
of shingles of ``shingle`` words, ordered by rarity over all documents. Containment of
the whole set is asked for, so the necessary prefix is the one rarest shingle: only
windows whose prefix shingle occurs in a document meet that document. Its place in the
window gives the place of the window in the document (positional bound), which must lie
within the document (length bound). What is left is compared word by word.

The index of windows is broadcast in parts of at most ``part_bytes``; a benchmark of any
size is joined part by part and the spans are merged.

Defined results: a null or empty text has no words, no spans and no items; a null or
empty item has no window; a null item id counts as the empty one; items that share an id
count once; repeated documents give one row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.llm.common import LOWER, Rolling, frugal, id_and_text, mix, slices, text_bytes, word_bounds

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
PART_BYTES = 32 * 1024 * 1024
_SLICE_BYTES = 1024 * 1024

# Bytes that belong to no word, after lower-casing.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xE7037ED1A0B428DB)
_PARTS = "shingle long, n long"
_HITS = "doc_id long, key long, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"


class Words:
    """Words of many texts: hash of each, first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw = LOWER[raw]
        self.starts, self.ends, self.first = word_bounds(self.raw, offsets, BREAKS)
        self.hashes = Rolling(self.raw).pieces(self.starts, self.ends)

    def shingles(self, words: int) -> np.ndarray:
        """Hash of every run of ``words`` words; runs that cross texts are met with no window of one."""
        h = self.hashes
        if len(h) < words:
            return np.empty(0, np.uint64)
        out = h[: len(h) - words + 1].copy()
        for i in range(1, words):
            out = mix(out * _A + h[i : len(h) - words + 1 + i] + _B)
        return out

    def joined(self, start: int, end: int) -> bytes:
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.starts[start:end], self.ends[start:end], strict=True))


def windows_of(items: DataFrame, size: int = WINDOW_WORDS, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``item_id`` and ``words`` (joined by spaces) of every distinct window of every item."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words = Words(*text_bytes(batch.column(1)))
            rows = set()
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                for start in range(a, max(b - size, a) + 1) if b > a else ():
                    rows.add((ids[i], words.joined(start, min(start + size, b)).decode()))
            columns = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["item_id", "words"])

    source = items.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    return source.mapInArrow(run, "item_id string, words string")


class Index:
    """Windows by prefix shingle."""

    def __init__(self, windows: list[tuple[str, list[str]]], shingle: int) -> None:
        self.shingle = shingle
        self.texts = [w.encode() for w, _ in windows]
        self.items = [i for _, i in windows]
        offsets = np.cumsum([0, *(len(t) for t in self.texts)])
        self.words = Words(np.frombuffer(b"".join(self.texts), np.uint8), offsets)
        self.length = np.diff(self.words.first)
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sets(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shingle length in use: the windows with it, their first shingle and how many they have."""
        for k in range(1, self.shingle + 1):
            chosen = np.flatnonzero((self.length == k) if k < self.shingle else (self.length >= k))
            if len(chosen):
                yield k, chosen, self.words.first[:-1][chosen], self.length[chosen] - k + 1

    def all_shingles(self) -> dict[int, np.ndarray]:
        """Every distinct shingle of a window, by shingle length."""
        found = {}
        for k, _, first, many in self.sets():
            at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found[k] = np.unique(self.words.shingles(k)[at])
        return found

    def order(self, counts: dict[int, int]) -> None:
        """Index every window under its rarest shingle (ties: the smaller hash)."""
        for k, chosen, first, many in self.sets():
            hashes = self.words.shingles(k)
            keys, rows, places = [], [], []
            for w, a, m in zip(chosen, first, many, strict=True):
                own = hashes[a : a + m]
                place = min(range(m), key=lambda i: (counts.get(int(own[i].view(np.int64)), 0), int(own[i])))
                keys.append(own[place])
                rows.append(w)
                places.append(place)
            by = np.argsort(np.array(keys, np.uint64), kind="stable")
            self.prefix[k] = (np.array(keys, np.uint64)[by], np.array(rows)[by], np.array(places)[by])


def _filter(keys: np.ndarray) -> np.ndarray:
    """A table over the top bits of the keys that lets most other hashes be skipped."""
    marked = np.zeros(1 << 20, bool)
    marked[(keys >> np.uint64(44)).astype(np.int64)] = True
    return marked


def _places(hashes: np.ndarray, keys: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose hash is among the sorted keys, and the range of equal keys of each."""
    at = np.flatnonzero(marked[(hashes >> np.uint64(44)).astype(np.int64)])
    low = np.searchsorted(keys, hashes[at], side="left")
    high = np.searchsorted(keys, hashes[at], side="right")
    hit = high > low
    return at[hit], low[hit], high[hit]


def shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """Occurrences over all documents of the wanted shingles (``shingle``, ``n``), summed in tasks before the shuffle."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        totals = {k: np.zeros(len(keys), np.int64) for k, keys in wanted.items()}
        marked = {k: _filter(keys) for k, keys in wanted.items()}
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                words = Words(*text_bytes(part.column(1)))
                for k, keys in wanted.items():
                    _, low, _ = _places(words.shingles(k), keys, marked[k])
                    totals[k] += np.bincount(low, minlength=len(keys))
        for k, keys in wanted.items():
            seen = totals[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(totals[k][seen])], names=["shingle", "n"])

    return docs.mapInArrow(run, _PARTS).groupBy("shingle").agg(F.sum("n").alias("n"))


def _find(words: Words, index: Index, marked: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: first word in the texts, and window."""
    starts, found = [], []
    for k, (keys, rows, places) in index.prefix.items():
        at, low, high = _places(words.shingles(k), keys, marked[k])
        many = high - low
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window = rows[entry]
        start = np.repeat(at, many) - places[entry]
        length = index.length[window]
        end_of_text = words.first[np.searchsorted(words.first, np.repeat(at, many), side="right")]
        start_of_text = words.first[np.searchsorted(words.first, np.repeat(at, many), side="right") - 1]
        fits = (start >= start_of_text) & (start + length <= end_of_text)
        start, window, length = start[fits], window[fits], length[fits]
        # Word by word, from both ends of the window.
        same = np.ones(len(start), bool)
        first = index.words.first[window]
        for i in range(int(length.max(initial=0))):
            left = np.flatnonzero(same & (length > i))
            same[left] = words.hashes[start[left] + i] == index.words.hashes[first[left] + i]
        for s, w, n in zip(start[same].tolist(), window[same].tolist(), length[same].tolist(), strict=True):
            if words.joined(s, s + n) == index.texts[w]:
                starts.append(s)
                found.append(w)
    return np.array(starts, np.int64), np.array(found, np.int64)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """The union of spans as sorted, disjoint spans."""
    out: list[dict[str, int]] = []
    for i in np.argsort(starts, kind="stable"):
        if out and starts[i] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], int(ends[i]))
        else:
            out.append({"start": int(starts[i]), "end": int(ends[i])})
    return out


def _hits(docs: DataFrame, shared, keep: Sequence[str]) -> DataFrame:
    """Spans of hit words and items of each document, for one part of the index."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        marked = {k: _filter(entry[0]) for k, entry in index.prefix.items()}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                words = Words(*text_bytes(part.column(1)))
                start, window = _find(words, index, marked)
                row = np.searchsorted(words.first, start, side="right") - 1
                spans: list[list] = [[]] * part.num_rows
                items: list[list] = [[]] * part.num_rows
                for r in np.unique(row):
                    own = row == r
                    begin = start[own] - words.first[r]
                    spans[r] = _merged(begin, begin + index.length[window[own]])
                    items[r] = sorted({i for w in np.unique(window[own]) for i in index.items[w]})
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(part.num_columns - 1), pa.array(np.diff(words.first)), pa.array(spans, kind),
                        pa.array(items, pa.list_(pa.string())), *part.columns[2:-1],
                    ],
                    names=schema.names,
                )

    schema = T.StructType([*T.StructType.fromDDL(_HITS), *[docs.schema[f"_kept{i}"] for i in range(len(keep))]])
    return docs.mapInArrow(run, schema)


def _merge_parts(hits: DataFrame) -> DataFrame:
    """One row per document from the rows of all parts of the index."""

    @frugal
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["spans"] = [
                _merged(np.array([s["start"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64)) for spans in frame["spans"]
            ]
            yield frame

    return (
        hits.groupBy("doc_id", "key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
        .mapInPandas(run, _HITS)
    )


def contaminated_spans(
    docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, part_bytes: int = PART_BYTES, keep: Sequence[str] = ()
) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` of hit words (start, end) and sorted ``item_ids`` of every document.

    Columns to ``keep`` follow (see ``id_and_text``).
    """
    spark = docs.sparkSession
    # The key tells documents of one id apart when parts of the index are put together.
    source = id_and_text(docs, keep=keep).withColumn("key", F.xxhash64("text"))
    texts = source.select("doc_id", "text", "key")
    windows = (
        windows_of(items, size).groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumn("bytes", F.length("words") * 12 + F.length(F.array_join("items", ",")) + 200)
    )
    n_parts = int((windows.agg(F.sum("bytes")).first()[0] or 0) // part_bytes) + 1
    parts = []
    for part in range(n_parts):
        own = windows.filter(F.pmod(F.xxhash64("words"), F.lit(n_parts)) == part).orderBy("words").select("words", "items")
        index = Index([(r.words, list(r.items)) for r in own.collect()], shingle)
        counts = shingle_counts(texts, index.all_shingles())
        index.order({r.shingle: r.n for r in counts.collect()})
        shared = spark.sparkContext.broadcast(index)
        parts.append(_hits(source, shared, keep) if n_parts == 1 else _hits(texts, shared, ()))
    if n_parts == 1:
        return parts[0].drop("key")
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    keys = source.drop("text")
    merged = _merge_parts(hits)
    same = keys.doc_id.eqNullSafe(merged.doc_id) & (keys.key == merged.key)
    return keys.join(merged, same).select(keys.doc_id, "n_words", "spans", "item_ids", *[f"_kept{i}" for i in range(len(keep))])


def judged(docs: DataFrame, items: DataFrame, one_in: int = 20, **options) -> DataFrame:
    """The spans as counts and a digest; contaminated when at least one word in ``one_in`` is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return contaminated_spans(docs, items, **options).withColumn("n_hit", n_hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *[f"_kept{i}" for i in range(len(options.get("keep", ())))],
    )
