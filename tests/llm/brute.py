"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import tiktoken

from veriweave.llm.byte_bpe import VOCABULARY, read_ranks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text: str | None, k: int = 5) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)} if words else set()


def jaccard_components(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """n_shingles and component_id by id (ids are unique)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def without_repeats(rows: list[tuple[int, str | None]], size: int = 100) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, left) of rows in the order given."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - size + 1):
            piece = data[p : p + size]
            if piece in seen:
                hit[p : p + size] = b"\1" * size
            seen.add(piece)
        spans = sum(1 for j, x in enumerate(hit) if x and (j == 0 or not hit[j - 1]))
        out.append((i, len(data), sum(hit), spans, bytes(x for x, h in zip(data, hit, strict=True) if not h)))
    return out


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows: list[tuple], items: list[tuple], size: int = 13) -> list[tuple]:
    """(id, n_words, n_hit, n_items, digest, contaminated) of rows in the order given."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = item_words(text)
        for i in range(max(len(words) - size, 0) + 1):
            if words:
                windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        words = item_words(text)
        hit, ids = set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                found = windows.get(tuple(words[p : p + n]))
                if found:
                    hit |= set(range(p, p + n))
                    ids |= found
        out.append((i, len(words), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def byte_bpe(text: str | None) -> list[int]:
    ranks = {t: i for i, t in enumerate(read_ranks(VOCABULARY))}
    if "coder" not in _MADE:
        _MADE["coder"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _MADE["coder"].encode_ordinary(text or "")


_MADE: dict = {}
