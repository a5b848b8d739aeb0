"""Conversation repair, embedding near-dedup and hard negatives against brute force, on odd rows too."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from veriweave.llm import conversation_repair as repair
from veriweave.llm import embedding_dedup as dedup
from veriweave.llm import hard_negatives as hard
from veriweave.llm import oracles

TURNS = "conv_id long, turn long, role string, text string, run long, audit string"
VECTORS = "vec_id long, embedding array<float>, label int, node long, score double"


def every_repair(rows, inserts=3):
    """Least cost and audit by trying every sequence of edits with few insertions between the rows."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(inserts), repeat=len(rows) + 1):
            state, cost, audit, ok = 0, 0, "", True
            for k in range(len(rows) + 1):
                for _ in range(gaps[k]):
                    state, cost, audit = (3 if state == 2 else 2), cost + 5, audit + "I"
                if k == len(rows):
                    break
                initial, fault = rows[k]
                edit = edits[k]
                audit += edit
                if edit == "D":
                    cost += 2
                    continue
                after = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)
                if edit == "R":
                    after = 3 if state == 2 else 2
                if fault in "bd" or after is None:
                    ok = False
                    break
                cost += (edit == "R") + 5 * (fault == "t")
                state = after
            if ok and state in (0, 3) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_least_edits_against_every_sequence():
    draw = random.Random(5)
    for _ in range(150):
        rows = [(draw.choice("suax"), draw.choice("....bdt")) for _ in range(draw.randint(0, 4))]
        assert repair.cheapest(rows) == every_repair(rows), rows


def test_runs_put_together_are_the_whole():
    draw = random.Random(6)
    for _ in range(60):
        rows = [(draw.choice("ssuuaax"), draw.choice("....bdt")) for _ in range(draw.randint(0, 14))]
        best = None
        for states in itertools.product(range(repair.STATES), repeat=3):
            cost, audit, entry = 0, "", 0
            for part, leave in zip((rows[:4], rows[4:9], rows[9:]), states):
                found = repair.cheapest(part, entry, (leave,), trailing=False)
                if found is None:
                    break
                cost, audit, entry = cost + found[0], audit + found[1], leave
            else:
                behind = repair.finish(entry)
                best = min(x for x in (best, (cost + 5 * len(behind), audit + behind)) if x is not None)
        assert best == repair.cheapest(rows), rows


def odd_turns():
    draw = random.Random(7)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, None if draw.random() < 0.1 else turn * draw.choice((1, 1, 2)), draw.choice(("user", "assistant", "system", "tool", "", None)),
                         draw.choice(("Yes.", "Yes.", "no", " \t", "", None, "Well? \n", "ünï.", "end…")), 0, "x"))
    # One long conversation, with repeated rows in one turn and a very long text.
    rows += [(99, i // 2, ("user", "assistant", "user")[i % 3], ("Go.", f"On {i}.", "cut")[i % 3], 0, "x") for i in range(120)]
    rows += [(99, 7, "user", "Same.", 0, "x")] * 9 + [(99, 60, "assistant", "Long. " * 30000, 0, "x")]
    # Conversations of which nothing is left.
    return rows


@pytest.mark.parametrize("run_rows", [5, 256])
def test_repair_of_odd_turns_equals_sql(spark, run_rows):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "run", "audit"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("given", conversations)
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    cursor = con.execute(oracles.CONVERSATION_REPAIR)
    columns = [c[0] for c in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = sorted(str(tuple(r)) for r in repair.repaired(turns, run_rows=run_rows).select(*columns).collect())
    assert got == want


def test_repaired_turns_alternate_and_hash(spark):
    turns, gone = repair.damaged(spark.createDataFrame(odd_turns(), TURNS))
    pieces = repair.pieces(repair.runs(turns, gone, run_rows=20)).cache()
    by_conv = {}
    for r in sorted(repair.repaired_turns(pieces).collect(), key=lambda r: (r["run"], r["place"])):
        by_conv.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    digests = {r["conv_id"]: r for r in repair.digests(pieces).collect()}
    assert len(digests) == 14
    for conv, digest in digests.items():
        said = by_conv.get(conv, [])
        initials = "".join(role[:1] for role, _ in said)
        assert initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2) and initials != "s"
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest() == digest["repaired_sha256"]


def test_empty_tables(spark):
    assert repair.repaired(spark.createDataFrame([], TURNS)).collect() == []
    assert dedup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def odd_vectors(n=260, dim=6, seed=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i and rng.random() < 0.6:
            # Near or equal copies of an earlier vector, also at another length.
            base = rows[rng.integers(0, i)][1]
            if base is not None and len(base) == dim and all(x is not None and math.isfinite(x) for x in base):
                v = np.array(base) * rng.choice([1.0, 3.0]) + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3, 0.6])
        rows.append([i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)), 0, 0.5])
    rows[10][1], rows[11][1], rows[12][1], rows[13][1] = None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2)
    rows[14][1], rows[15][1], rows[16][2], rows[17][1] = [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), None, [1.0, 2.0]
    rows[18][1], rows[19][1] = [1.0, 2.0], [-0.0] + [1.0] * (dim - 1)
    rows[20][1], rows[20][2], rows[19][2] = [0.0] + [1.0] * (dim - 1), 1, 1
    return [tuple(r) for r in rows] + [tuple(rows[30])] + [(300, *rows[31][1:])]


def plain_links(rows, threshold):
    def direction(r):
        v = r[1]
        return v if r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) else None

    vs = [direction(r) for r in rows]
    near = [set() for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = vs[i], vs[j]
        if a and b and rows[i][2] == rows[j][2] and len(a) == len(b):
            x, y = np.array(a, float), np.array(b, float)
            if float(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out)


@pytest.mark.parametrize("block_rows", [11, 4096])
def test_links_against_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block_rows)
    rows = odd_vectors()
    got = dedup.near_duplicates(spark.createDataFrame(rows, VECTORS))
    assert sorted(tuple(r) for r in got.collect()) == plain_links(rows, 0.93)


def test_traversal_counts_whole_nodes():
    # A dense group of near copies, accepted by bounds, beside single vectors.
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    near = base + rng.normal(size=(150, 16)) * 0.05
    unit = dedup._unit(np.concatenate([near, rng.normal(size=(100, 16)), base + rng.normal(size=(60, 16)) * 0.4]))
    weights = rng.integers(1, 4, len(unit))
    tree = dedup.CoverTree(unit)
    u, w = unit[tree.order], weights[tree.order]
    links, top = dedup.links_within(tree, u, w, tree, u, w, 0.93, True)
    alike = (u @ u.T >= 0.93) & ~np.eye(len(u), dtype=bool)
    assert np.array_equal(links, alike @ w)
    for i, j in zip(*np.nonzero(alike)):
        assert top[i] == top[j]
    half = len(unit) // 2
    ta, tb = dedup.CoverTree(unit[:half]), dedup.CoverTree(unit[half:])
    ua, ub = unit[:half][ta.order], unit[half:][tb.order]
    links, top = dedup.links_within(ta, ua, weights[:half][ta.order], tb, ub, weights[half:][tb.order], 0.93, False)
    across = ua @ ub.T >= 0.93
    assert np.array_equal(links, np.concatenate([across @ weights[half:][tb.order], across.T @ weights[:half][ta.order]]))
    for i, j in zip(*np.nonzero(across)):
        assert top[i] == top[half + j]


def test_cover_tree_nests_and_covers():
    unit = dedup._unit(np.random.default_rng(10).normal(size=(300, 5)))
    tree = dedup.CoverTree(unit)
    u = unit[tree.order]
    assert sorted(tree.order) == list(range(300))
    for a, b, r, first, count in zip(tree.start, tree.end, tree.radius, tree.first, tree.count):
        assert np.sqrt(np.maximum(0, 2 - 2 * (u[a:b] @ u[a]))).max() <= r + 1e-7
        kids = range(first, first + count)
        assert not count or (tree.start[first] == a and [tree.end[k] for k in kids] == [*[tree.start[k] for k in kids][1:], b])
        centres = u[[tree.start[k] for k in kids]]
        assert all(tree.radius[k] <= r / 2 + 1e-7 for k in kids)
        apart = 2 - 2 * (centres @ centres.T) + 9 * np.eye(len(centres))
        assert not count or np.sqrt(np.maximum(0, apart)).min() > r / 2 - 1e-7


def plain_negatives(rows):
    def plain(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    some = [(r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], [math.floor(256 * x) for x in r[1]]) for r in rows if r[2] is not None and plain(r[1])]
    out = []
    for a, anchor in enumerate(some):
        if anchor[0] % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(anchor[2], r[2])), r[0], b, r[1]) for b, r in enumerate(some) if b != a and len(r[2]) == len(anchor[2])]
        for p in sorted(s for s in scores if s[3] == anchor[1])[:5]:
            inside = sorted(s for s in scores if s[3] != anchor[1] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0])
            out += [(anchor[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(inside[:3])]
    return sorted(out)


@pytest.mark.parametrize("anchors,candidates,scale", [(512, 8192, 1.0), (2, 30, 1.0), (512, 100, 1e5)])
def test_negatives_against_all_scores(spark, monkeypatch, anchors, candidates, scale):
    monkeypatch.setattr(hard, "ANCHORS", anchors)
    monkeypatch.setattr(hard, "CANDIDATES", candidates)
    rows = [(r[0], None if r[1] is None else [x if x is None else float(np.float32(x * scale)) for x in r[1]], *r[2:]) for r in odd_vectors()]
    # Ids that repeat are rows of their own; copies of an anchor tie.
    rows += [(50, *rows[60][1:]), (310, *rows[50][1:])]
    got = hard.hard_negatives(spark.createDataFrame(rows, VECTORS))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_bounds_spare_scores():
    # Anchors that lie close together: most candidates are settled by the bounds of the first.
    rng = np.random.default_rng(11)
    anchors = np.rint(rng.normal(size=8) * 256 + rng.normal(size=(20, 8)) * 3).astype(np.int64)
    candidates = np.rint(rng.normal(size=(500, 8)) * 256).astype(np.int64)
    scores = hard.Scores(anchors, candidates)
    exact = anchors @ candidates.T
    floor = np.sort(exact, axis=1)[:, -5].astype(float)
    for anchor, rows, found in scores.visit(lambda a, low, high: high >= floor[a]):
        assert set(np.flatnonzero(exact[anchor] >= floor[anchor])) <= set(rows.tolist())
        assert np.array_equal(found, exact[anchor][rows])
    assert scores.scored < 0.3 * exact.size
