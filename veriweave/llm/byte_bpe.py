"""Byte-level BPE encoding and decoding (7).

A sentencepiece BPE model is serialised directly from a published rank file: every
token is a piece of byte-mapped characters whose score is its negative rank, and the
normaliser is the identity. Pre-tokens are encoded by that model, ids are decoded by
the inverse mapping. Nothing is trained.

Defined results: a null text is the empty one; an empty text has no ids and decodes to
no bytes; a null id stays null; repeated rows give one result row each; columns besides
id and text are ignored; an empty table gives an empty table with the same schema.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriweave.llm.common import frugal, hold, id_and_text, list_array, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Entries of the table of finished pieces that a worker keeps; it is emptied when full.
CACHE_ENTRIES = 250_000
_SLICE_BYTES = 2 * 1024 * 1024


def byte_characters() -> list[str]:
    """A printable character for each byte value: printable bytes stand for themselves, others move past 255."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as file:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must be 0 to n - 1")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, 32-bit float or varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece follows the last rank."""
    letters = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal)
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, unknown))
    absent = (1 << 64) - 1  # -1
    trainer = _field(3, bpe) + _field(40, len(tokens)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one rank file; one per worker process. What only encoding needs is made when it is asked for."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str) -> None:
        self.tokens = read_ranks(path)
        self.source = pattern
        self.letters = byte_characters()
        self.done: dict[str, bytes] = {}
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        hold("byte_bpe", cls._made.clear)
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))

    @cached_property
    def pattern(self) -> regex.Pattern:
        return regex.compile(self.source)

    def _encode_pieces(self, pieces: list[str]) -> None:
        """Fill the table for pieces of text that no pre-token crosses."""
        cut = [self.pattern.findall(p) for p in pieces]
        new = list({t for tokens in cut for t in tokens})
        raw = [t.encode() for t in new]
        ids: dict[str, list[int]] = {}
        ask, mapped = [], []
        translate = self.letters.__getitem__
        for token, data in zip(new, raw, strict=True):
            rank = self.ranks.get(data)
            if rank is None:
                ask.append(token)
                mapped.append("".join(map(translate, data)))
            else:
                ids[token] = [rank]
        if ask:
            ids.update(zip(ask, self.model.encode(mapped, num_threads=1), strict=True))
        for piece, tokens in zip(pieces, cut, strict=True):
            self.done[piece] = np.fromiter(chain.from_iterable(ids[t] for t in tokens), np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers.

        A space before a character that is not white space always starts a pre-token,
        so texts are cut there and the pieces looked up or encoded.
        """
        cut = [_pieces(t) for t in texts]
        done = self.done
        missing = {p for pieces in cut for p in pieces if p not in done}
        if missing:
            if len(done) + len(missing) > CACHE_ENTRIES:
                done.clear()
                missing = {p for pieces in cut for p in pieces}
            self._encode_pieces(list(missing))
        return [b"".join(map(done.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_WIDE = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


def _pieces(text: str) -> list[str]:
    if not text:
        return []
    pieces = _CUT.split(text) if _WIDE.search(text) else text.removesuffix(" ").split(" ")
    trailing = " " if text[-1] == " " and not _WIDE.search(text) else ""
    return [p for p in (pieces[0], *(" " + p for p in pieces[1:]), trailing) if p]


def encode(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text; row by row, no shuffle."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                coded = codec.encode(part.column(1).to_pylist())
                counts = np.array([len(c) // 4 for c in coded], np.int64)
                ids = list_array(np.frombuffer(b"".join(coded), np.int32), counts, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id``, ``ids`` and their ``decoded`` bytes; a null list of ids decodes to no bytes."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary, pattern)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            decoded = [codec.decode(flat[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def coded(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``decode(encode(docs))`` in one Python worker a task instead of two, each with its tables."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES):
                ids = [np.frombuffer(c, np.int32) for c in codec.encode(part.column(1).to_pylist())]
                lists = list_array(np.concatenate(ids), np.array([len(i) for i in ids], np.int64), pa.int32())
                decoded = pa.array(map(codec.decode, ids), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids and decoded bytes of every document as counts and digests."""
    return coded(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
