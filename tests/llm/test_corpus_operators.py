"""Operators over whole corpora: near copies, repeated strings, contamination, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_text_operators import table
from veriweave.llm import decontamination, graph_components, ngram_join, suffix_dedup
from veriweave.llm.common import Rolling, prepare, word_bounds


@pytest.fixture(scope="module", autouse=True)
def _prepared(spark):
    prepare(spark)


def near_copies(seed, n_groups=12, most=14):
    """Texts of groups of copies with words changed, at all degrees of likeness."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 5)))
    texts = []
    for _ in range(n_groups):
        base = [word() for _ in range(pick.choice([1, 3, 5, 12, 60, 200]))]
        for _ in range(pick.randint(1, most)):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(base) // 25))):
                copy[pick.randrange(len(copy))] = word()
            texts.append(pick.choice([" ", "  ", "\n"]).join(copy))
    pick.shuffle(texts)
    return texts


@pytest.mark.parametrize("block_sets", [3, 4096])
def test_ngram_join_equals_all_pairs(spark, block_sets):
    rows = list(enumerate(near_copies(1) + [None, "", " \t\n", "one", "ONE", "one two", "x " * 3000, "x " * 3100], -5))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(table(spark, rows), block_sets=block_sets).collect()}
    assert got == brute.jaccard_components(rows)


def test_ngram_join_of_a_chain_and_a_common_passage(spark):
    # Each text is like the next only; and unlike texts share a long passage.
    chain = [" ".join(f"c{i}" for i in range(a * 5, a * 5 + 60)) for a in range(12)]
    passage = " ".join(f"p{i}" for i in range(30))
    shared = [f"{passage} " + " ".join(f"s{a}x{i}" for i in range(9 + a)) for a in range(25)]
    rows = list(enumerate(chain + shared))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(table(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)


@pytest.mark.parametrize("pair_sets, pair_hashes", [(3, 1 << 20), (512, 400), (512, 1 << 20)])
def test_ngram_join_finds_every_link(spark, pair_sets, pair_hashes):
    base = [f"v{i}" for i in range(80)]
    variants = [" ".join([*base[:i], f"z{i}", *base[i + 1 :]]) for i in range(0, 80, 2)]
    chain = [" ".join(f"c{i}" for i in range(a * 5, a * 5 + 60)) for a in range(12)]
    texts = near_copies(3, 6, 8) + variants + variants[:5] + chain + [None, "", "one", "ONE"]
    sets = [brute.shingles(t) for t in texts]
    alike = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and x and 100 * len(x & y) >= 75 * len(x | y)}
    documents, links = ngram_join.joined(table(spark, list(enumerate(texts))), block_sets=7, pair_sets=pair_sets, pair_hashes=pair_hashes)
    members = {}
    for r in documents.filter("n_shingles > 0").collect():
        members.setdefault(r.node, []).append(r.doc_id)
    found = {(i, j) for own in members.values() for i in own for j in own if i != j}
    listed = links.collect()
    for r in listed:
        found |= {(i, j) for a, b in ((r.a, r.b), (r.b, r.a)) for i in members[a] for j in members[b]}
        assert r.common == len(sets[members[r.a][0]] & sets[members[r.b][0]])
    assert found == alike and len(listed) == len({(r.a, r.b) for r in listed}) and all(r.a < r.b for r in listed)
    counts = {r.doc_id: r.n_links for r in ngram_join.link_counts(documents, links).collect()}
    assert counts == {i: sum(1 for a, _ in alike if a == i) for i in range(len(texts))}


def test_components_of_the_whole_join(spark):
    rows = list(enumerate([*near_copies(5), None, ""]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_by_join(table(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)
    # Blocks of a few sets: links are counted where they are found, whichever blocks meet.
    documents, links = ngram_join.joined(table(spark, rows))
    want = {r.doc_id: r.n_links for r in ngram_join.link_counts(documents, links).collect()}
    assert {r.doc_id: r.n_links for r in ngram_join.linked_by_join(table(spark, rows), pair_sets=3).collect()} == want
    documents, links = ngram_join.joined(table(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, None)]))
    assert sorted((r.n_shingles, r.n_links) for r in ngram_join.link_counts(documents, links).collect()) == [(0, 0), (0, 0), (1, 2), (1, 2), (1, 2)]
    assert ngram_join.link_counts(*ngram_join.joined(table(spark, []))).count() == 0


@pytest.mark.parametrize("block_sets, pair_sets", [(4096, 512), (9, 7)])
def test_ngram_join_lists_no_pairs_of_nearly_alike_sets(spark, monkeypatch, block_sets, pair_sets):
    # One hash short of alike, each two of them: nothing links, and the bound allows all pairs.
    core = [f"k{i}" for i in range(304)]
    texts = [" ".join([*core, *(f"t{a}x{i}" for i in range(51))]) for a in range(60)]
    # Some have a near copy, so that components of two meet those of one.
    texts += [" ".join([*core, *(f"t{a}x{i}" for i in range(54))]) for a in range(0, 24, 2)]
    made = {}

    def settled(df, name):
        out = kept(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    kept = ngram_join.settled
    monkeypatch.setattr(ngram_join, "settled", settled)
    rows = list(enumerate(texts))
    documents, _, links = ngram_join._spanning(table(spark, rows), ngram_join.WORDS, ngram_join.PERCENT, block_sets, pair_sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join._named(documents, graph_components.components(links)).collect()}
    assert got == brute.jaccard_components(rows)
    assert len({c for _, c in got.values()}) == 60
    if block_sets > len(texts):
        # A few rows a text; its pairs are 2,556.
        assert all(n < 6 * len(texts) for name, n in made.items() if name not in ("shingle-cells", "shingle-profile")), made


def test_ngram_join_odd_rows(spark):
    same = "a b c d e f g"
    rows = [(7, same), (7, same), (None, same), (None, "q w e r t y"), (3, "z"), (9, None)]
    got = sorted(map(tuple, ngram_join.linked(table(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 3, 7), (7, 3, 7), (None, 3, 7), (None, 2, None), (3, 1, 3), (9, 0, 9)], key=str)
    assert ngram_join.linked(table(spark, [])).count() == 0


def test_tree_finds_all_that_the_bound_allows():
    pick = np.random.default_rng(5)
    points = pick.integers(0, 12, (700, ngram_join.GROUPS))
    points[350:] = np.maximum(points[:350] + pick.integers(-1, 2, (350, ngram_join.GROUPS)), 0)
    n = points.sum(1)
    tree = ngram_join.Tree(points, n)
    for i in range(0, 700, 50):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) >= ngram_join.needed(n, int(n[i]), 75))
        assert sorted(tree.search(points[i], int(n[i]), 75)) == want.tolist()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph_components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert graph_components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def repeated_texts(seed):
    pick = random.Random(seed)
    base = ["".join(pick.choice("abé") for _ in range(pick.randint(0, 400))) for _ in range(12)]
    rows = []
    for i in range(50):
        parts = []
        for _ in range(pick.randint(0, 4)):
            b = pick.choice(base)
            a = pick.randint(0, len(b))
            parts.append(b[a : a + pick.randint(0, 300)])
            if pick.random() < 0.3:
                parts.append(pick.choice("xyz") * pick.randint(1, 250))
        rows.append((i * 3 - 20, "".join(parts)))
    return [*rows, (1000, None), (1001, base[0] * 3), (1002, "ab" * 400), (1003, "c" * 100), (1004, "c" * 99)]


def digests(rows):
    return sorted((i, n, r, s, brute.sha(left)) for i, n, r, s, left in brute.without_repeats(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_all_positions(spark, seed):
    rows = repeated_texts(seed)
    assert sorted(map(tuple, suffix_dedup.digests(table(spark, rows)).collect())) == digests(rows)


def test_suffix_dedup_in_pieces(spark):
    # Texts that a worker takes in several pieces.
    pick = random.Random(9)
    common = "".join(pick.choice("abcdefgh ") for _ in range(5000))
    long = "".join(pick.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, common), (2, long[:1_048_000] + common + long[1_048_000:])]
    assert sorted(map(tuple, suffix_dedup.digests(table(spark, rows)).collect())) == digests(rows)


def test_suffix_dedup_odd_rows(spark):
    text, other = "abcdefghij" * 15 + "k", "z" * 150
    got = sorted(map(tuple, suffix_dedup.digests(table(spark, [(1, text), (1, text), (1, text), (None, other), (2, other)])).collect()), key=str)
    first, = digests([(1, text)])
    ahead, again = digests([(0, other)])[0], (2, 150, 150, 1, brute.sha(b""))
    assert got == sorted([first, (1, 151, 151, 1, brute.sha(b"")), (1, 151, 151, 1, brute.sha(b"")), (None, *ahead[1:]), again], key=str)
    assert suffix_dedup.digests(table(spark, [])).count() == 0


def test_sorted_contexts_have_right_common_prefixes():
    pick = np.random.default_rng(2)
    strings = pick.integers(0, 2, (200, 21)).astype(np.uint8)
    group = pick.integers(0, 3, 200)
    order, common = suffix_dedup.sorted_with_lcp(group, strings)
    rows = [(int(group[i]), strings[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for (g, a), (h, b), c in zip(rows[:-1], rows[1:], common[1:], strict=True):
        assert c == (-1 if g != h else next((i for i in range(21) if a[i] != b[i]), 21))


ITEMS = [(3, "Alpha beta-gamma, delta! " * 5), (1, "short ITEM é9"), (1, "short item É9 x"), (2, None), (4, "... !"), (None, "no id here"), (10, "one")]


@pytest.mark.parametrize("part_bytes", [3000, 1 << 25])
def test_decontamination_equals_all_windows(spark, part_bytes):
    pick = random.Random(4)
    words = "alpha beta gamma delta short item é9 É9 x y no id here".split() + ["one"]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 60))) for _ in range(60)]
    texts += ["alpha beta gamma delta " * 4, "z " * 300 + "alpha beta gamma delta " * 4, None, "", "..", "short item é9" * 1, "oneone", "ONE"]
    rows = list(enumerate(texts))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("key", F.lit(1))
    got = sorted(map(tuple, decontamination.judged(table(spark, [*rows, rows[0]]), items, part_bytes=part_bytes).collect()))
    assert got == sorted(brute.contamination([*rows, rows[0]], ITEMS))
    assert decontamination.judged(table(spark, []), items).count() == 0
    assert decontamination.judged(table(spark, rows), items.limit(0), part_bytes=part_bytes).filter("n_hit > 0 OR contaminated").count() == 0


def test_words_do_not_cross_texts():
    raw = np.frombuffer(b"ab cdef  gh", np.uint8)
    breaks = np.zeros(256, bool)
    breaks[32] = True
    starts, ends, first = word_bounds(raw, np.array([0, 0, 4, 4, 6, 11, 11]), breaks)
    assert [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"c", b"de", b"f", b"gh"]
    assert first.tolist() == [0, 0, 2, 2, 3, 5, 5]
    pieces = Rolling(np.frombuffer(b"abcabc", np.uint8))
    assert pieces.windows(3)[0] == pieces.windows(3)[3] == pieces.pieces(np.array([0]), np.array([3]))[0]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    pick = random.Random(7)
    texts = near_copies(11, 8, 5) + [t for _, t in repeated_texts(3)[:20]]
    items = [(1, " ".join(pick.choice(["red", "blue", "green", "grey"]) for _ in range(20)))]
    texts += [f"start {items[0][1]} end", "z y x w v " * 200 + items[0][1], "123 ... 456", None, "", "Ü"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    groups = brute.jaccard_components(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    left = [(i, data.decode(errors="ignore")) for i, _, _, _, data in brute.without_repeats(left)]
    judged = {r[0]: r[5] for r in brute.contamination(left, items)}
    want = []
    for i, t in left:
        if not judged[i]:
            ids = brute.byte_bpe(t)
            want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t)))
    assert got == sorted(want)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_stages_keep_the_columns_of_documents(spark, tmp_path):
    df = table(spark, [(1, "some words of a text " * 9), (2, None), (None, "other words of a text " * 9), (1, "some words of a text " * 9)])
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        assert out.count() >= 1
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_fine_counts_bound_the_overlap():
    pick = np.random.default_rng(4)
    sets = [np.unique(pick.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) for n in (1, 5, 63, 64, 65, 700, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) // 2], pick.integers(0, 1 << 63, len(s), dtype=np.uint64)])) for s in sets]
    # Many hashes of one group need more than a byte.
    sets.append(np.arange(400, dtype=np.uint64) * np.uint64(1 << 20))
    packed = [ngram_join.fine_counts(s) for s in sets]
    for a, x in zip(sets, packed):
        for b, y in zip(sets, packed):
            common = len(np.intersect1d(a, b))
            assert common <= ngram_join.fine_bound(x, y) <= min(len(a), len(b))
    far = ngram_join.fine_bound(packed[6], ngram_join.fine_counts(np.unique(pick.integers(0, 1 << 63, 5000, dtype=np.uint64))))
    assert far < ngram_join.needed(5000, 5000, 75)
