"""Token-ID / binary output (4): ids of whole documents in files, in ascending document order.

Documents are range-partitioned by id; each range is written as one shard of frames, and
a frame holds whole documents as blocks of ``range_coder``. The container is Parquet
(one row per frame, payload as binary), so that any file system Spark writes to will do,
and a lost task is written again by Spark's commit protocol. Frames are read back and
decoded independently of each other.

Defined results: a null or empty text has no ids of its own, only the end id; documents
of one id stand in the order of their texts, a null id first; extra columns are ignored;
an empty table gives an empty file and no rows.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veriweave.llm import range_coder
from veriweave.llm.byte_bpe import byte_characters
from veriweave.llm.common import id_and_text, partitions_for, slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
# Ids after which a frame is closed; a longer document makes a longer frame.
FRAME_IDS = 1 << 22
# Entries of the table of encoded words that a worker keeps; it is emptied when full.
CACHE_ENTRIES = 1_000_000
SHARDS_PER_GROUP = 1000
_SLICE_BYTES = 4 * 1024 * 1024
_FRAMES = "shard int, frame int, first long, doc_ids array<long>, counts array<int>, n_ids long, payload binary"
_DOCUMENTS = "shard int, doc_id long, first long, n_tokens long, ids_crc32 long"


# A word of printable ASCII, and the pre-tokens of one in lower case: the pattern of the tokenizer file for these characters.
_PLAIN = re.compile(rb"[!-~]+")
_PRE_TOKENS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Encoder(dict):
    """Ids of texts by a tokenizer file that lower-cases and lets no token cross ASCII white space; one per worker process.

    Texts are cut there, and each distinct piece is encoded once: this is the table of
    pieces. The normaliser leaves pieces of printable ASCII alone, so these are cut into
    pre-tokens, which stand in the table too and go to the tokenizer's model directly;
    so do lower-case letters in normal form. Any other piece takes the whole way.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [str(t).lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_characters()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __missing__(self, word: bytes) -> bytes:
        cut = _PRE_TOKENS.findall(word) if _PLAIN.fullmatch(word) else ()
        if len(cut) > 1:
            coded = b"".join(map(self.__getitem__, cut))
        else:
            ids = [t.id for t in self.tokenize(word.decode())] if cut else self._ids(word)
            coded = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = coded
        return coded

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode()
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self.tokenize("".join(map(self.letters.__getitem__, word)))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as 32-bit integers."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        lower = text.lower()
        # The file's added tokens are found before all else, and only in their own case.
        if any(t in lower for t in self.added):
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, lower.split()))


class _Frame:
    """Documents gathered for one frame."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.pieces: list[bytes] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.pieces.append(ids)
        self.counts.append(len(ids) // 4)
        self.size += len(ids) // 4

    def row(self, shard: int, frame: int, first: int) -> pa.RecordBatch:
        payload = range_coder.encode(np.frombuffer(b"".join(self.pieces), np.uint32))
        values = (shard, frame, first, self.ids, self.counts, self.size, payload)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary())
        names = [f.split()[0] for f in _FRAMES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def frames(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """The frames of all documents: shards follow the ascending ranges of ids."""
    source = id_and_text(docs).withColumn("text", F.col("text").cast("binary"))
    ordered = source.repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        shard = TaskContext.get().partitionId()
        frame, number, first = _Frame(), 0, 0
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    frame.add(doc_id, encoder.encode(text) + end)
                    if frame.size >= frame_ids:
                        yield frame.row(shard, number, first)
                        frame, number, first = _Frame(), number + 1, first + frame.size
        if frame.ids:
            yield frame.row(shard, number, first)

    return ordered.mapInArrow(run, _FRAMES)


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the ids of all documents to a new folder."""
    frames(docs, **options).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, counts, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ends = np.cumsum([0, *counts]).astype(np.int32)
                ids = range_coder.decode(payload)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], names=["doc_id", "ids"])

    return spark.read.parquet(path).select("doc_ids", "counts", "payload").mapInArrow(run, "doc_id long, ids array<long>")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, doc_ids, counts, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                raw = memoryview(range_coder.decode(payload).astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts + first),
                        pa.array(counts, pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    documents = files.select("shard", "first", "doc_ids", "counts", "payload").mapInArrow(run, _DOCUMENTS)
    # Ids before each shard: running totals within groups of shards, then over the few groups.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("shard") / SHARDS_PER_GROUP))
    ahead = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = shards.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("groups_before"))
    within = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        shards.withColumn("shards_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(groups, "group")
        .select("shard", (F.col("groups_before") + F.col("shards_before")).alias("base"))
    )
    return documents.join(bases, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
