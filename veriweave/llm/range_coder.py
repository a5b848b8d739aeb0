"""A context-mixing range coder for token ids, over many blocks in step.

Blocks are coded independently: each begins with empty contexts and ends with its own
checksum. Rows of numpy arrays stand for blocks, so one step codes the next id of every
block of a batch.

The model of a block mixes three predictions of the next id. Order 2 and order 1 each
name one id per context, with a confidence that moves with every hit and miss. The
weights of the mixture are the shares of hits, by the pair of confidences and whether
both name one id; they are counted over all blocks and stand in the head. What remains
of the weight goes to order 0, frequencies of classes of ids of like size. The mixture
codes an id as one event (predicted by order 2, by order 1, by neither), in the last
case followed by its class and its place in the class. Events, classes and places are
three streams of a block, so that the work on each is small: only the events need the
contexts. All arithmetic is on integers (or exact in floats), so that decoding repeats
it exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 1024
LANES = 4096
# Blocks of which streams are put together at once, so that these arrays stay small.
_TOGETHER = 256
# Ids must be below this, so that the place of an id in its class takes no more than 16 bits.
MOST_IDS = 1 << 19
_SLOTS = 512
_HEAD = struct.Struct("<4sBxHI")
_MAGIC = b"CMR3"
_ENTRY = np.dtype([("ids", "<u4"), ("escaped", "<u4"), ("events", "<u4"), ("classes", "<u4"), ("places", "<u4"), ("crc", "<u4")])
_STREAMS = ("events", "classes", "places")
# Shares of a symbol are out of 4096; a width below 65536 takes in one more 16-bit word.
_BITS = np.uint32(12)
_TOTAL = 1 << 12
_SHORT = np.uint32(1 << 16)
_FULL = np.uint32(0xFFFFFFFF)
_16 = np.uint32(16)
# Bits of the low end that stay, by how far it is shifted.
_KEPT = np.r_[np.full(16, (1 << 64) - 1, np.uint64), np.uint64(0xFFFF)]
_TRUST_BITS, _TRUST_MASK = np.uint32(3), np.uint32(7)
_SLOT_SHIFT = np.uint32(32 - (_SLOTS.bit_length() - 1))
# Pairs of confidences, twice: predictions differ, or are the same.
_STATES = 128
# Change of an entry's confidence after a miss, then after a hit, by confidence so far.
_MOVED = np.array([1, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int64).astype(np.uint32)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every id; least id and free bits of every class: ids below 8 alone, then four classes per bit length."""
    ids = np.arange(MOST_IDS)
    length = np.frexp(ids.astype(np.float64))[1].astype(np.int64)
    free = np.maximum(length - 3, 0)
    of_id = np.where(length < 4, ids, 8 + (length - 4) * 4 + ((ids >> free) & 3))
    least = np.searchsorted(of_id, np.arange(of_id[-1] + 1))
    return of_id.astype(np.uint8), least.astype(np.uint32), free[least].astype(np.uint32)


_CLASS, _LEAST, _FREE = _classes()
_N_CLASSES = len(_LEAST)


def _shares(counts: np.ndarray, least: np.ndarray | int) -> np.ndarray:
    """Counts of symbols (by row) as shares out of ``_TOTAL``, at least ``least``."""
    totals = np.maximum(counts.sum(1, keepdims=True), 1)
    out = np.maximum(counts * _TOTAL // totals, least)
    row = np.arange(len(out))
    out[row, out.argmax(1)] += _TOTAL - out.sum(1)
    return out


class _Contexts:
    """What order 1 and order 2 name in some blocks in step. Arrays of both orders stand behind each other: order 1, then order 2."""

    def __init__(self, lanes: int) -> None:
        self.lanes = lanes
        self.base = np.arange(2 * lanes, dtype=np.int64) * _SLOTS
        # By context: the id named, and in the low bits its confidence.
        self.named = np.zeros(2 * lanes * _SLOTS, np.uint32)
        self.keys = np.zeros(2 * lanes, np.uint32)
        self.fresh = np.zeros(2 * lanes, np.uint32)
        self.last = np.zeros(lanes, np.uint32)
        self.second = np.zeros(lanes, np.uint32)

    def look(self) -> np.ndarray:
        """The state that tells the weights; sets ``guess`` and what ``learn`` needs."""
        lanes, keys = self.lanes, self.keys
        np.multiply(self.last, np.uint32(0x9E3779B1), out=keys[:lanes])
        np.multiply(keys[:lanes] ^ (self.second * np.uint32(0x85EBCA6B)), np.uint32(0xC2B2AE35), out=keys[lanes:])
        self.at = (keys >> _SLOT_SHIFT) + self.base
        self.entry = self.named.take(self.at)
        self.guess = self.entry >> _TRUST_BITS
        self.sure = self.entry & _TRUST_MASK
        same = self.guess[:lanes] == self.guess[lanes:]
        return self.sure[lanes:] + self.sure[:lanes] * np.uint32(8) + same * np.uint32(64)

    def learn(self, ids: np.ndarray) -> np.ndarray:
        """Take in the ids; whether order 1, then order 2 had named them."""
        lanes, fresh = self.lanes, self.fresh
        np.left_shift(ids, _TRUST_BITS, out=fresh[:lanes])
        fresh[:lanes] |= np.uint32(1)
        fresh[lanes:] = fresh[:lanes]
        hit = (self.entry ^ fresh) < np.uint32(8)
        history = self.sure + hit * np.uint32(8)
        # A named id that was hardly trusted is replaced when it misses.
        self.named[self.at] = np.where(history < np.uint32(2), fresh, self.entry + _MOVED.take(history))
        self.second, self.last = self.last, ids
        return hit


def _code(symbols: np.ndarray, start: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit words of each block (one row per block) and how many each has; ``symbols``: one row per step."""
    steps, lanes = symbols.shape
    # One look-up for both.
    table = (start << _16 | share).astype(np.uint32)
    row = np.arange(lanes, dtype=np.int64)
    # A first word that takes carries, at most one word per symbol, two closing words.
    out = np.zeros((steps + 4) * lanes, np.uint32)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    place = row + lanes
    for now in symbols:
        unit = width >> _BITS
        found = table.take(now)
        low += unit * (found >> _16)
        width = unit * (found & np.uint32(0xFFFF))
        # Above its 16 bits the word has the carry, if there was one.
        out[place] = low >> np.uint64(16)
        shift = (width < _SHORT) * _16
        # A word that was written goes; otherwise all 33 bits stay.
        low &= _KEPT.take(shift)
        low <<= shift
        width <<= shift
        place += shift * np.int64(lanes) >> 4
    out[place] = low >> np.uint64(16)
    out[place + lanes] = low & np.uint64(0xFFFF)
    words = out.reshape(-1, lanes)
    used = (place - row) // lanes + 2
    for i in range(int(used.max(initial=1)) - 1, 0, -1):
        over = words[i] >> _16
        if over.any():
            words[i - 1] += over
            words[i] &= np.uint32(0xFFFF)
    return words[1:].T.astype("<u2"), used - 1


class _Reader:
    """The state of decoding some blocks in step."""

    def __init__(self, stream: np.ndarray, used: np.ndarray) -> None:
        self.lanes = len(used)
        words = np.zeros((self.lanes, int(used.max(initial=0)) + 2), np.uint32)
        words[:, :-2][np.arange(words.shape[1] - 2) < used[:, None]] = stream
        self.flat = np.ascontiguousarray(words.T).reshape(-1)
        row = np.arange(self.lanes, dtype=np.int64)
        self.code = self.flat[row] << _16 | self.flat[row + self.lanes]
        self.width = np.full(self.lanes, _FULL)
        self.place = row + 2 * self.lanes

    def take(self, start: np.ndarray, width: np.ndarray) -> None:
        """Go on behind a symbol."""
        short = width < _SHORT
        shift = short * _16
        self.code = ((self.code - start) << shift) | self.flat.take(self.place, mode="clip") * short
        self.width = width << shift
        self.place = self.place + short * np.int64(self.lanes)


def _place_bits(classes: np.ndarray, escaped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Free bits of each escaped id, where they begin in the stream of places, and the words of each block in it."""
    free = _FREE.take(classes)
    ends = np.cumsum(free, dtype=np.int64)
    block_ends = np.r_[0, ends][np.cumsum(escaped)]
    bits = np.diff(block_ends, prepend=0)
    words = -(-bits // 16)
    # Each block begins a word.
    begin = (np.cumsum(words) - words) * 16 - (block_ends - bits)
    return free, ends - free + np.repeat(begin, escaped), words


def _encode_places(places: np.ndarray, classes: np.ndarray, escaped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places as 16-bit words, and the words of each block."""
    free, at, words = _place_bits(classes, escaped)
    shifted = places << (np.uint32(32) - free - (at & 15).astype(np.uint32))
    first = at >> 4
    n = int(words.sum()) + 2
    # No bit is set twice, so sums are the bits put together.
    out = np.bincount(first, shifted >> _16, n)
    out += np.bincount(first + 1, shifted & np.uint32(0xFFFF), n)
    return out[:-2].astype("<u2"), words


def _decode_classes(stream: np.ndarray, used: np.ndarray, escaped: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Classes of all escaped ids, block by block."""
    reader = _Reader(stream, used)
    named = np.repeat(np.arange(_N_CLASSES, dtype=np.uint8), shares)
    start, share = (np.cumsum(shares) - shares).astype(np.uint32), shares.astype(np.uint32)
    most = int(escaped.max(initial=0))
    out = np.zeros((most, reader.lanes), np.uint8)
    for t in range(most):
        unit = reader.width >> _BITS
        # Exact: both are below 2 ** 32, so no quotient is rounded up to the next integer.
        now = named.take((reader.code / unit).astype(np.int64), mode="clip")
        out[t] = now
        reader.take(unit * start.take(now), unit * share.take(now))
    return out.T[np.arange(most) < escaped[:, None]]


def _decode_escaped(classes: np.ndarray, stream: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """Ids of the classes, with the places of the stream."""
    free, at, _ = _place_bits(classes, escaped)
    words = np.r_[stream, np.zeros(2, stream.dtype)].astype(np.uint32)
    first = at >> 4
    pair = words.take(first, mode="clip") << _16 | words.take(first + 1, mode="clip")
    places = (pair >> (np.uint32(32) - free - (at & 15).astype(np.uint32))) & ((np.uint32(1) << free) - np.uint32(1))
    return _LEAST.take(classes) + places


def _decode_ids(stream: np.ndarray, used: np.ndarray, others: np.ndarray, escaped: np.ndarray, shares: np.ndarray, steps: int) -> np.ndarray:
    """The ids of some blocks, one row per step; ``others``: what neither order predicted, block by block."""
    reader = _Reader(stream, used)
    lanes = reader.lanes
    contexts = _Contexts(lanes)
    others = np.r_[others, np.uint32(0)]
    next_other = np.cumsum(escaped) - escaped
    to2, to1 = shares[:, 0].astype(np.uint32), (shares[:, 0] + shares[:, 1]).astype(np.uint32)
    out = np.zeros((steps, lanes), np.uint32)
    for t in range(steps):
        state = contexts.look()
        unit = reader.width >> _BITS
        end2, end1 = unit * to2.take(state), unit * to1.take(state)
        missed = reader.code >= end2
        neither = reader.code >= end1
        start = np.where(neither, end1, end2 * missed)
        end = np.where(missed, np.where(neither, unit << _BITS, end1), end2)
        reader.take(start, end - start)
        now = np.where(missed, np.where(neither, others.take(next_other, mode="clip"), contexts.guess[:lanes]), contexts.guess[lanes:])
        next_other = next_other + neither
        contexts.learn(now)
        out[t] = now
    return out


def _batches(n_blocks: int, lanes: int) -> list[tuple[int, int]]:
    """Blocks in batches of about ``lanes``, all of like size."""
    many = max(round(n_blocks / lanes), 1)
    cuts = [n_blocks * i // many for i in range(many + 1)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _events(ids: np.ndarray) -> np.ndarray:
    """Of each id (one row per step) the state of the contexts, and in the low bits whether order 2 and order 1 had named it."""
    steps, lanes = ids.shape
    contexts = _Contexts(lanes)
    out = np.empty((steps, lanes), np.uint16)
    for t in range(steps):
        state = contexts.look()
        hit = contexts.learn(ids[t])
        out[t] = state * np.uint32(4) + hit[lanes:] * np.uint32(2) + hit[:lanes]
    return out


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> bytes:
    """The ids (below ``MOST_IDS``) as a sequence of independent, checksummed blocks."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if int(ids.max(initial=0)) >= MOST_IDS:
        raise ValueError(f"ids must be below {MOST_IDS}")
    n_blocks = -(-len(ids) // block_ids)
    entries = np.zeros(n_blocks, _ENTRY)
    entries["ids"] = np.minimum(len(ids) - np.arange(n_blocks) * block_ids, block_ids)
    entries["crc"] = [zlib.crc32(ids[i * block_ids : (i + 1) * block_ids]) for i in range(n_blocks)]
    seen = np.zeros(_STATES * 4, np.int64)
    classes_seen = np.zeros(_N_CLASSES, np.int64)
    found = []
    streams: dict[str, list[bytes]] = {s: [] for s in _STREAMS}
    for first, end in _batches(n_blocks, lanes):
        own = ids[first * block_ids : end * block_ids]
        steps = min(block_ids, len(own))
        padded = np.zeros((end - first) * steps, np.uint32)
        padded[: len(own)] = own
        by_block = padded.reshape(-1, steps)
        events = _events(np.ascontiguousarray(by_block.T))
        grid = np.full((end - first, steps), _N_CLASSES, np.uint8)
        for a in range(0, end - first, _TOGETHER):
            part = slice(a, a + _TOGETHER)
            own_events = np.ascontiguousarray(events[:, part].T)
            seen += np.bincount(own_events.reshape(-1), minlength=len(seen))
            neither = (own_events & np.uint16(3)) == 0
            escaped = neither.sum(1)
            others = by_block[part][neither]
            classes = _CLASS.take(others)
            classes_seen += np.bincount(classes, minlength=_N_CLASSES)
            grid[part][np.arange(steps) < escaped[:, None]] = classes
            entries["escaped"][first:end][part] = escaped
            words, entries["places"][first:end][part] = _encode_places(others - _LEAST.take(classes), classes, escaped)
            streams["places"].append(words.tobytes())
        found.append((events, grid))
    seen = seen.reshape(_STATES, 4)
    event_shares = _shares(np.stack([seen[:, 2] + seen[:, 3], seen[:, 1], seen[:, 0]], 1), 1)
    class_shares = _shares(classes_seen[None], classes_seen[None] > 0)[0]
    # Start and share by state and hits; a symbol for all that pads a stream.
    start2, share2 = np.zeros(_STATES, np.int64), event_shares[:, 0]
    share1, rest = event_shares[:, 1], event_shares[:, 2]
    event_start = np.stack([share2 + share1, share2, start2, start2], 1).reshape(-1).astype(np.uint32)
    event_share = np.stack([rest, share1, share2, share2], 1).reshape(-1).astype(np.uint32)
    class_start = np.r_[np.cumsum(class_shares) - class_shares, 0].astype(np.uint32)
    class_share = np.r_[class_shares, _TOTAL].astype(np.uint32)

    def add(stream: str, first: int, end: int, words: np.ndarray, used: np.ndarray) -> None:
        entries[stream][first:end] = used
        streams[stream].append(words[np.arange(words.shape[1]) < used[:, None]].tobytes())

    for (first, end), (events, grid) in zip(_batches(n_blocks, lanes), found, strict=True):
        add("events", first, end, *_code(events, event_start, event_share))
        most = int(entries["escaped"][first:end].max())
        add("classes", first, end, *_code(np.ascontiguousarray(grid[:, :most].T), class_start, class_share))
    shares = np.r_[event_shares[:, :2].reshape(-1), class_shares].astype("<u2").tobytes()
    return b"".join([_HEAD.pack(_MAGIC, 1, block_ids, n_blocks), shares, entries.tobytes(), *(x for s in _STREAMS for x in streams[s])])


def decode(payload: bytes, lanes: int = LANES) -> np.ndarray:
    """The ids of all blocks, in order; a block that does not fit its checksum is an error."""
    magic, version, block_ids, n_blocks = _HEAD.unpack_from(payload)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a file of this format")
    shares = np.frombuffer(payload, "<u2", 2 * _STATES + _N_CLASSES, _HEAD.size).astype(np.int64)
    event_shares, class_shares = shares[: 2 * _STATES].reshape(_STATES, 2), shares[2 * _STATES :]
    at = _HEAD.size + 2 * len(shares)
    entries = np.frombuffer(payload, _ENTRY, n_blocks, at)
    at += entries.nbytes
    words, cuts = {}, {}
    for s in _STREAMS:
        cuts[s] = np.r_[0, np.cumsum(entries[s], dtype=np.int64)]
        words[s] = np.frombuffer(payload, "<u2", int(cuts[s][-1]), at)
        at += words[s].nbytes
    out = np.zeros(int(entries["ids"].sum()), np.uint32)
    done = 0
    for first, end in _batches(n_blocks, lanes):
        own = entries[first:end]
        stream = {s: words[s][cuts[s][first] : cuts[s][end]] for s in _STREAMS}
        used = {s: own[s].astype(np.int64) for s in _STREAMS}
        escaped = own["escaped"].astype(np.int64)
        classes = _decode_classes(stream["classes"], used["classes"], escaped, class_shares)
        others = np.empty(len(classes), np.uint32)
        before, before_word = np.r_[0, np.cumsum(escaped)], cuts["places"][first : end + 1] - cuts["places"][first]
        for a in range(0, end - first, _TOGETHER):
            b = min(a + _TOGETHER, end - first)
            part = slice(before[a], before[b])
            others[part] = _decode_escaped(classes[part], stream["places"][before_word[a] : before_word[b]], escaped[a:b])
        steps = int(own["ids"].max())
        decoded = np.ascontiguousarray(_decode_ids(stream["events"], used["events"], others, escaped, event_shares, steps).T, dtype="<u4")
        for i, entry in enumerate(own):
            block = decoded[i, : entry["ids"]]
            if zlib.crc32(block) != entry["crc"]:
                raise ValueError(f"block {first + i} does not fit its checksum")
            out[done : done + len(block)] = block
            done += len(block)
    return out
