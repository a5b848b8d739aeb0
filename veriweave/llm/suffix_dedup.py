"""Suffix-array dedup (10): remove every byte of a string of ``size`` bytes that also starts earlier.

Blockwise suffix sorting with a cover sample. A sample of positions is ranked first, and
ties between suffixes are resolved by the ranks of sampled suffixes ahead of them. The
sample must have a position at the same distance ahead of any two equal strings. A
residue cover gives that by position and samples an eighth of all positions for strings
of this size; the cover used here is defined by content, which gives the same guarantee
with one position in 35: of every string of ``size`` bytes, the sampled position is that
of its least hashed k-gram.

1. Positions that share their sampled position form a run. Each run goes to the bucket of
   its k-gram, with a hash of its bytes. In a bucket, all but the first of equal runs are
   removed; what is left are the first runs of different contexts of one k-gram.
2. Only those are sorted, one bucket at a time. Their sampled suffixes and the bytes
   before them, read backwards, are sorted with their common prefix lengths; two strings
   are equal exactly if both ranks agree to the depth their distance asks for. The bytes
   themselves are compared, in full.
3. Removed spans of a document are put together and cut out.

Memory is bounded by a bucket (see ``partitions_for``) and by the slices of text a worker
takes; long texts are taken in pieces.

Defined results: a null or empty text has no bytes; order is by doc_id, a null id first,
then by a hash of the text where ids repeat, and of rows that are equal in both all but
one count as later copies; strings do not cross documents; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.llm.common import Rolling, frugal, id_and_text, partitions_for, settled, slices, text_bytes

SIZE = 100
GRAM = 32
_SLICE_BYTES = 1 << 20
_PLACE = np.uint64((1 << 26) - 1)
_LEAST_LONG = -(1 << 63)
# A run: k-gram hash within its bucket, hash of its bytes, document in the blob's list,
# first position, number of positions, distance from the first to the sampled one.
_RUN = (("gram", "<u4"), ("hash", "<u8"), ("doc", "<u4"), ("first", "<u4"), ("many", "u1"), ("ahead", "u1"))
_BLOBS = "bucket int, n int, docs binary, runs binary, spans binary"
_FOUND = "gram long, key long, text_key long, runs binary, spans binary"
_SPANS = "key long, text_key long, spans binary"
_CONTEXTS = "bucket int, gram long, key long, text_key long, first int, many int, ahead int, context binary"
_DOC = np.dtype([("key", "<i8"), ("text_key", "<i8")])
_SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
_DETAIL = np.dtype([("first", "<u4"), ("many", "u1"), ("ahead", "u1")])


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def runs_of(raw: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of string starts that share their sampled position: row, first start, number, distance ahead, hashes."""
    empty = {c: np.empty(0, np.int64) for c in ("row", "first", "many", "ahead")} | {c: np.empty(0, np.uint64) for c in ("gram", "hash")}
    if len(raw) < size:
        return empty
    rolling = Rolling(raw)
    grams = rolling.windows(gram)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    sampled = (_sliding_least(keys, size - gram + 1) & _PLACE).astype(np.int64)
    lengths = np.diff(offsets)
    has = lengths >= size
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, offsets[:-1][has], 1)
    np.add.at(edge, offsets[1:][has] - size + 1, -1)
    valid = np.cumsum(edge[: len(sampled)]) > 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (sampled[1:] != sampled[:-1])
    starts = offsets[:-1][has]
    begin[starts] = True
    first = np.flatnonzero(begin)
    if not len(first):
        return empty
    row = np.searchsorted(offsets, first, side="right") - 1
    last_start = offsets[row + 1] - size
    after = np.r_[first[1:], len(raw)]
    many = np.minimum(after, last_start + 1) - first
    at = sampled[first]
    ahead = at - first
    content = rolling.pieces(first, first + many - 1 + size)
    return {"row": row, "first": first - offsets[row], "many": many, "ahead": ahead, "gram": grams[at], "hash": content ^ (ahead.astype(np.uint64) << np.uint64(57))}


def _pieces(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, offsets, document keys, text keys and the first position, for slices of the batch; long texts come in pieces."""
    for part in slices(batch, _SLICE_BYTES):
        raw, offsets = text_bytes(part.column(2))
        keys, text_keys = part.column(0).to_numpy(), part.column(1).to_numpy()
        if part.num_rows > 1 or len(raw) <= 2 * _SLICE_BYTES:
            yield raw, offsets, keys, text_keys, 0
            continue
        for at in range(0, max(len(raw) - size + 1, 1), _SLICE_BYTES):
            piece = raw[at : at + _SLICE_BYTES + size - 1]
            yield piece, np.array([0, len(piece)]), keys, text_keys, at


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of spans as sorted, disjoint, not adjacent spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.r_[True, start[1:] > end[:-1]] if len(start) else np.empty(0, bool)
    out = np.empty(int(new.sum()), _SPAN)
    out["start"] = start[new]
    out["end"] = end[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]] if len(start) else end
    return out


def _by_document(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Merged spans of each document."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(doc)], strict=True):
        yield int(doc[a]), _merged(start[a:b], end[a:b])


def _spans_batch(docs: np.ndarray, found: Iterator[tuple[int, np.ndarray]]) -> dict[str, list]:
    out: dict[str, list] = {"key": [], "text_key": [], "spans": []}
    for doc, spans in found:
        out["key"].append(int(docs["key"][doc]))
        out["text_key"].append(int(docs["text_key"][doc]))
        out["spans"].append(spans.tobytes())
    return out


def _bucket_runs(source: DataFrame, n_buckets: int, size: int, gram: int) -> DataFrame:
    """Runs by bucket. Equal runs of one slice are settled in place: only the first is sent, the others become spans."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, offsets, keys, text_keys, shift in _pieces(batch, size):
                found = runs_of(raw, offsets, size, gram)
                n = len(found["first"])
                if not n:
                    continue
                docs = np.empty(len(keys), _DOC)
                docs["key"], docs["text_key"] = keys, text_keys
                # Rows equal in id and text are one document here.
                _, rank = np.unique(docs, return_inverse=True)
                first = found["first"] + shift
                order = np.lexsort((first, rank[found["row"]], found["hash"], found["gram"]))
                g, h, d, f = found["gram"][order], found["hash"][order], rank[found["row"]][order], first[order]
                distinct = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (f[1:] != f[:-1])]
                order, g, h = order[distinct], g[distinct], h[distinct]
                leads = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
                later, order = order[~leads], order[leads]
                # High bits choose the bucket, low bits tell k-grams apart in it.
                bucket = ((found["gram"][order] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
                by_bucket = np.argsort(bucket, kind="stable")
                order, bucket = order[by_bucket], bucket[by_bucket]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                columns = {
                    "gram": found["gram"].astype(np.uint32), "hash": found["hash"], "doc": found["row"], "first": first, "many": found["many"], "ahead": found["ahead"],
                }
                rows: list[tuple] = []
                for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
                    own = order[a:b]
                    used, doc = np.unique(found["row"][own], return_inverse=True)
                    body = b"".join((doc if c == "doc" else columns[c][own]).astype(kind).tobytes() for c, kind in _RUN)
                    rows.append((int(bucket[a]), len(own), docs[used].tobytes(), body, None))
                start = first[later]
                end = start + found["many"][later] - 1 + size
                for doc, spans in _by_document(found["row"][later], start, end):
                    rows.append((int(docs["text_key"][doc] % n_buckets), 0, docs[doc : doc + 1].tobytes(), None, spans.tobytes()))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "n", "docs", "runs", "spans"]
                )

    return source.mapInArrow(run, _BLOBS)


def _settle_runs(bucketed: DataFrame, size: int) -> DataFrame:
    """In each bucket: spans of runs that are not the first of their kind, and the first runs of k-grams with several kinds."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(values: dict[str, list]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            n = len(values["key"])
            full = {"gram": [None] * n, "runs": [None] * n, "spans": [None] * n} | values
            names = ("gram", "key", "text_key", "runs", "spans")
            return pa.RecordBatch.from_arrays([pa.array(full[c], k) for c, k in zip(names, kinds, strict=True)], names=list(names))

        parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in _RUN}
        docs: list[np.ndarray] = []
        n_docs = 0
        bucket = 0
        for batch in batches:
            for b, n, blob, runs, spans in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                bucket = b
                own = np.frombuffer(blob, _DOC)
                if n == 0:
                    yield rows({"key": [int(own["key"][0])], "text_key": [int(own["text_key"][0])], "spans": [spans]})
                    continue
                at = 0
                for column, kind in _RUN:
                    width = np.dtype(kind).itemsize
                    values = np.frombuffer(runs, kind, n, at)
                    parts[column].append(values + np.uint32(n_docs) if column == "doc" else values)
                    at += n * width
                docs.append(own)
                n_docs += len(own)
        if not docs:
            return
        # One list of documents, in their order.
        listed, doc_of = np.unique(np.concatenate(docs), return_inverse=True)
        runs = {c: np.concatenate(v) for c, v in parts.items()}
        parts.clear()
        doc = doc_of[runs["doc"]]
        order = np.lexsort((runs["first"], doc, runs["hash"], runs["gram"]))
        g, h, d, f = runs["gram"][order], runs["hash"][order], doc[order], runs["first"][order]
        distinct = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (f[1:] != f[:-1])]
        order, g, h = order[distinct], g[distinct], h[distinct]
        new_gram = np.r_[True, g[1:] != g[:-1]]
        leads = new_gram.copy()
        leads[1:] |= h[1:] != h[:-1]
        later = order[~leads]
        start = runs["first"][later].astype(np.int64)
        spans = _spans_batch(listed, _by_document(doc[later], start, start + runs["many"][later] - 1 + size))
        if spans["key"]:
            yield rows(spans)
        # Kinds of each k-gram; a k-gram with one kind is settled.
        group = np.cumsum(new_gram) - 1
        kinds = np.bincount(group[leads])
        open_runs = order[leads & (kinds[group] > 1)]
        if len(open_runs):
            by = np.lexsort((runs["gram"][open_runs], doc[open_runs]))
            open_runs = open_runs[by]
            cuts = np.flatnonzero(np.r_[True, np.diff(doc[open_runs]) != 0])
            out: dict[str, list] = {"gram": [], "key": [], "text_key": [], "runs": []}
            for a, b in zip(cuts, np.r_[cuts[1:], len(open_runs)], strict=True):
                own = open_runs[a:b]
                detail = np.empty(b - a, [("gram", "<u4"), *_DETAIL.descr])
                for c in ("gram", "first", "many", "ahead"):
                    detail[c] = runs[c][own]
                out["gram"].append(bucket)
                out["key"].append(int(listed["key"][doc[own[0]]]))
                out["text_key"].append(int(listed["text_key"][doc[own[0]]]))
                out["runs"].append(detail.tobytes())
            yield rows(out)

    @frugal
    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from settle(batches)

    return bucketed.groupBy("bucket").applyInArrow(one, _FOUND)


def _contexts(source: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """The bytes of the runs that are still open."""
    asked = found.filter("runs IS NOT NULL").select("key", "text_key", F.struct(F.col("gram").alias("bucket"), "runs").alias("asked"))
    per_doc = asked.groupBy("key", "text_key").agg(F.collect_list("asked").alias("asked"))
    detail = np.dtype([("gram", "<u4"), *_DETAIL.descr])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 * _SLICE_BYTES):
                raw, offsets = text_bytes(part.column(2))
                pieces: list[np.ndarray] = []
                buckets: list[np.ndarray] = []
                rows: list[np.ndarray] = []
                for i, asked in enumerate(part.column(3).to_pylist()):
                    for entry in asked:
                        own = np.frombuffer(entry["runs"], detail)
                        pieces.append(own)
                        buckets.append(np.full(len(own), entry["bucket"], np.int32))
                        rows.append(np.full(len(own), i, np.int64))
                own, row = np.concatenate(pieces), np.concatenate(rows)
                begin = offsets[row] + own["first"]
                text = raw.tobytes()
                contexts = [text[a:b] for a, b in zip(begin.tolist(), (begin + own["many"].astype(np.int64) - 1 + size).tolist(), strict=True)]
                # Runs of one k-gram meet again, in as many groups as there were buckets.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(buckets)), pa.array(own["gram"].astype(np.int64)), pa.array(part.column(0).to_numpy()[row]),
                        pa.array(part.column(1).to_numpy()[row]), pa.array(own["first"].astype(np.int32)), pa.array(own["many"].astype(np.int32)),
                        pa.array(own["ahead"].astype(np.int32)), pa.array(contexts, pa.binary()),
                    ],
                    names=[c.split()[0] for c in _CONTEXTS.split(", ")],
                )

    return source.join(per_doc, ["key", "text_key"]).select("key", "text_key", "text", "asked").mapInArrow(run, _CONTEXTS)


def sorted_with_lcp(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-width strings (rows of bytes) by group and content, and the common prefix of each with the one before it.

    A string of another group shares -1 bytes.
    """
    n, width = strings.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    rows = wide[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.where(group[order][1:] == group[order][:-1], np.minimum(common, width), -1)
    return order, np.r_[-1, common]


def repeated_strings(group: np.ndarray, contexts: list[bytes], first: np.ndarray, many: np.ndarray, ahead: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs in document order, by distance ahead: the runs whose string at that distance also starts earlier, and its start."""
    n = len(contexts)
    most_ahead = int(ahead.max())
    lengths = np.fromiter(map(len, contexts), np.int64, n)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(lengths) - lengths
    # Sampled suffixes, and what stands before them read backwards, padded with zeros.
    right = np.zeros((n, size), np.uint8)
    left = np.zeros((n, max(most_ahead, 1)), np.uint8)
    row = np.repeat(np.arange(n), lengths)
    place = np.arange(len(flat)) - begin[row] - ahead[row]
    behind = place < 0
    right[row[~behind], place[~behind]] = flat[~behind]
    left[row[behind], -1 - place[behind]] = flat[behind]
    right_order, right_common = sorted_with_lcp(group, right)
    left_order, left_common = sorted_with_lcp(group, left)
    last = ahead - many + 1
    for distance in range(most_ahead + 1):
        own = np.flatnonzero((ahead >= distance) & (last <= distance))
        if len(own) < 2:
            continue
        rank = np.empty(n, np.int64)
        rank[right_order] = np.cumsum(right_common < size - distance)
        back = np.empty(n, np.int64)
        back[left_order] = np.cumsum(left_common < distance)
        key = rank[own] * np.int64(n + 1) + back[own]
        _, leads, kind = np.unique(key, return_index=True, return_inverse=True)
        again = own[leads[kind] != np.arange(len(own))]
        if len(again):
            yield again, first[again] + ahead[again] - distance


def _settle_contexts(contexts: DataFrame, size: int) -> DataFrame:
    """Spans of strings that also start earlier, one bucket of sampled suffixes at a time."""

    @frugal
    def one(key: tuple, table: pa.Table) -> pa.Table:
        docs = np.empty(table.num_rows, _DOC)
        docs["key"], docs["text_key"] = table.column("key").to_numpy(), table.column("text_key").to_numpy()
        first, many, ahead = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "many", "ahead"))
        order = np.lexsort((first, first + ahead, docs["text_key"], docs["key"]))
        distinct = np.r_[True, (docs[order][1:] != docs[order][:-1]) | (first[order][1:] != first[order][:-1])]
        order = order[distinct]
        bodies = table.column("context").to_pylist()
        docs, first, many, ahead = docs[order], first[order], many[order], ahead[order]
        found = list(repeated_strings(table.column("gram").to_numpy()[order], [bodies[i] for i in order], first, many, ahead, size))
        out: dict[str, list] = {"key": [], "text_key": [], "spans": []}
        if found:
            listed, doc = np.unique(docs, return_inverse=True)
            rows, starts = np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])
            out = _spans_batch(listed, _by_document(doc[rows], starts, starts + size))
        return pa.table([pa.array(out["key"], pa.int64()), pa.array(out["text_key"], pa.int64()), pa.array(out["spans"], pa.binary())], names=["key", "text_key", "spans"])

    return contexts.groupBy("bucket").applyInArrow(one, _SPANS)


def _cut(docs: DataFrame, spans: DataFrame, size: int, keep: Sequence[str], decode: bool) -> DataFrame:
    """Every document with its removed spans and the bytes that are left."""
    per_doc = spans.groupBy("key", "text_key").agg(F.collect_list("spans").alias("found"))
    # Rows equal in id and text: all but one are later copies.
    copies = Window.partitionBy("key", "text_key").orderBy(F.lit(0))
    numbered = docs.withColumn("copy", F.row_number().over(copies))
    columns = [f"_kept{i}" for i in range(len(keep))]
    schema = T.StructType([
        *T.StructType.fromDDL(f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept {'string' if decode else 'binary'}"), *[docs.schema[c] for c in columns]
    ])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, 4 * _SLICE_BYTES):
                sizes, removed, kept = [], [], []
                for text, copy, found in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    data = text.encode()
                    if copy > 1:
                        spans = [(0, len(data))] if len(data) >= size else []
                    else:
                        every = np.concatenate([np.frombuffer(x, _SPAN) for x in found]) if found else np.empty(0, _SPAN)
                        spans = _merged(every["start"], every["end"]).tolist()
                    at, pieces = 0, []
                    for a, b in spans:
                        pieces.append(data[at:a])
                        at = b
                    pieces.append(data[at:])
                    sizes.append(len(data))
                    removed.append([{"start": a, "end": b} for a, b in spans])
                    left = b"".join(pieces)
                    kept.append(left.decode(errors="ignore") if decode else left)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string() if decode else pa.binary()), *part.columns[4:]], names=schema.names
                )

    joined = numbered.join(per_doc, ["key", "text_key"], "left").select("doc_id", "text", "copy", "found", *columns)
    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, keep: Sequence[str] = (), decode: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, removed ``spans`` (maximal, in bytes) and ``kept`` bytes of every document.

    Columns to ``keep`` follow (see ``id_and_text``). With ``decode`` what is left comes as
    text, without characters that were cut in two.
    """
    source = (
        id_and_text(docs, keep=keep)
        .withColumn("key", F.coalesce(F.col("doc_id"), F.lit(_LEAST_LONG)))
        .withColumn("text_key", F.xxhash64("text"))
    )
    keyed = source.select("key", "text_key", "text")
    runs = _bucket_runs(keyed, partitions_for(docs), size, gram)
    found = settled(_settle_runs(runs, size), "suffix-runs")
    detailed = settled(_settle_contexts(_contexts(keyed, found, size), size), "suffix-spans")
    spans = found.filter("spans IS NOT NULL").select("key", "text_key", "spans").unionByName(detailed)
    return _cut(source, spans, size, keep, decode)


def digests(docs: DataFrame, **options) -> DataFrame:
    """What was removed and what is left, as counts and a digest."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs, **options).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
