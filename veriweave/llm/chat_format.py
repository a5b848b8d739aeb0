"""Chat formatting as prefix trees (2).

Conversations that begin with the same turns share those turns: they are sorted by
their turns, and each emits only the turns that the one before it does not have. A pack
is a run of sorted conversations, written depth first: every segment (one formatted
turn) comes with its position id, which counts from the start of its conversation, the
intervals of the pack that hold its ancestors, and its range under the loss mask. Units
are characters. A tree larger than ``pack_chars`` or ``pack_leaves`` continues in further
packs, which repeat the shared turns once each, so that a first turn that begins a third
of all conversations is spread over many tasks.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. A ``<`` before any number of
backslashes and a ``|`` gets one more backslash, so no control string is left inside a
text, and taking one away gives the text back. In a role, backslashes and line feeds are
written as ``\\\\`` and ``\\n`` first.

Defined results: null roles and texts are empty; turns of one number are ordered by role
and text, a null number first; rows without a conversation id are one conversation;
repeated rows are repeated turns; extra columns are ignored; an empty table gives no packs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_CHARS = 1 << 18
PACK_LEAVES = 1 << 12
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)")


def escape(text: str) -> str:
    """The text without control strings."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape_role(role), unescape(rest.removesuffix("\n").removesuffix(END))))
    return turns


Interval = tuple[int, int]


@dataclass
class _Pack:
    """A run of conversations, written depth first."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    segments: list[dict] = field(default_factory=list)
    leaves: list[dict] = field(default_factory=list)
    path: list[tuple[tuple[str, str], int]] = field(default_factory=list)

    def add(self, conversation: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            text, begin, end = format_turn(*turn)
            parent = self.path[-1][1] if self.path else -1
            position, seen = 0, []
            if parent >= 0:
                above = self.segments[parent]
                position = above["position"] + above["length"]
                seen = [*above["intervals"]]
                # Ancestors that follow each other in the pack make one interval.
                first, last = above["start"], above["start"] + above["length"]
                if seen and seen[-1]["end"] == first:
                    seen[-1] = {"start": seen[-1]["start"], "end": last}
                else:
                    seen.append({"start": first, "end": last})
            masked = (self.size + begin, self.size + end) if turn[0] == LOSS_ROLE else (self.size, self.size)
            self.segments.append({
                "start": self.size, "length": len(text), "position": position, "parent": parent, "intervals": seen,
                "loss_start": masked[0], "loss_end": masked[1],
            })
            self.path.append((turn, len(self.segments) - 1))
            self.pieces.append(text)
            self.size += len(text)
        self.leaves.append({"conv_id": conversation, "segment": self.path[-1][1] if self.path else -1})


_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SEGMENT = pa.struct([
    ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()),
    ("intervals", pa.list_(_INTERVAL)), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
])
_LEAF = pa.struct([("conv_id", pa.int64()), ("segment", pa.int32())])
_PACK_SCHEMA = (
    "text string, segments array<struct<start:long,length:long,position:long,parent:int,intervals:array<struct<start:long,end:long>>,"
    "loss_start:long,loss_end:long>>, leaves array<struct<conv_id:long,segment:int>>"
)
_READ_SCHEMA = "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"


def _written(pack: _Pack) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(["".join(pack.pieces)]), pa.array([pack.segments], pa.list_(_SEGMENT)), pa.array([pack.leaves], pa.list_(_LEAF))],
        names=["text", "segments", "leaves"],
    )


def packs(turns: DataFrame, pack_chars: int = PACK_CHARS, pack_leaves: int = PACK_LEAVES) -> DataFrame:
    """One row per pack: ``text``, ``segments`` (depth first) and ``leaves`` (the last segment of each conversation).

    ``turns`` has conv_id, turn, role and text. Conversations are sorted over the cluster by
    the hashes of their turns, and by id where all turns are equal.
    """
    whole = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
            ).alias("row"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .withColumn("path", F.transform("rows", lambda r: F.xxhash64(r["role"], r["text"])))
    )
    ordered = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            for conversation, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [(r["role"], r["text"]) for r in rows]
                if pack.leaves and (pack.size + sum(len(t) for _, t in own) > pack_chars or len(pack.leaves) >= pack_leaves):
                    yield _written(pack)
                    pack = _Pack()
                pack.add(conversation, own)
        if pack.leaves:
            yield _written(pack)

    return ordered.select("conv_id", "rows").mapInArrow(run, _PACK_SCHEMA)


def read_back(packed: DataFrame) -> DataFrame:
    """Each conversation as the packs have it: its ``turns``, the text under its loss mask and its length.

    A conversation is what its last segment attends to, followed by that segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, segments, leaves = (batch.column(i)[row].as_py() for i in range(3))
                out: list[tuple] = []
                for leaf in leaves:
                    at = leaf["segment"]
                    last = segments[at]
                    formatted = "".join(text[i["start"] : i["end"]] for i in last["intervals"]) + text[last["start"] : last["start"] + last["length"]]
                    if len(formatted) != last["position"] + last["length"]:
                        raise ValueError("the position ids of a pack do not fit its intervals")
                    masked = []
                    while at >= 0:
                        masked.append(unescape(text[segments[at]["loss_start"] : segments[at]["loss_end"]]))
                        at = segments[at]["parent"]
                    turns = [{"role": r, "text": t} for r, t in parse(formatted)]
                    out.append((leaf["conv_id"], turns, "".join(reversed(masked)), len(formatted)))
                kinds = (pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string(), pa.int64())
                for a in range(0, len(out), 256):
                    columns = [pa.array(c, k) for c, k in zip(zip(*out[a : a + 256], strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turns", "loss_text", "formatted_chars"])

    return packed.select("text", "segments", "leaves").mapInArrow(run, _READ_SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """What the packs hold, as counts and digests per conversation."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(packed).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
