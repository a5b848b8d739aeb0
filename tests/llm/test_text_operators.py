"""Operators on single texts: byte-level BPE, HTML, language, toxicity, fingerprints, token files, chat."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from veriweave.llm import byte_bpe, chat_format, common, fingerprints, html_text, language_id, range_coder, token_files, toxicity
from veriweave.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASHING = ("key", "text_key", "bucket", "n", "node", "words", "ids", "score", "signature", "_range", "copy", "spans")


@pytest.fixture(scope="module", autouse=True)
def _prepared(spark):
    prepare(spark)


def table(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [
    (5, None), (1, ""), (2, " "), (3, "a"), (4, "the the the"), (6, "é漢🙂 \x1c\x85 x"), (7, "word " * 20_000), (8, "x" * 50_000),
    (9, "the the the"), (9, "the the the"), (None, "no id"), (11, "<|endoftext|> I'm 12 years,  old\n\n  ok "),
]


def random_texts(n, alphabet, longest, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, longest))) for _ in range(n)]


def by_id(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def test_byte_bpe_equals_the_library_and_decodes(spark):
    rows = ODD + list(enumerate(random_texts(300, " \n\ta'sB1²é漢..🙂\x85\x1c", 40, 1), 100))
    got = by_id(byte_bpe.digests(table(spark, rows)))
    want = []
    for i, t in rows:
        ids = brute.byte_bpe(t)
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or "")))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert byte_bpe.digests(table(spark, [])).count() == 0


def test_byte_bpe_digests_need_one_worker_a_task(spark):
    docs = table(spark, ODD)
    plan = byte_bpe.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(map(str, byte_bpe.coded(docs).collect())) == sorted(map(str, both))


def test_frugal_work_begins_without_tables_of_other_operators(monkeypatch):
    kept = []
    monkeypatch.setattr(common, "_HELD", {"byte_bpe": lambda: kept.append("byte_bpe"), "rolling": lambda: kept.append("rolling")})
    monkeypatch.setattr(common, "give_back", lambda: kept.append("back"))

    def rows(n):
        yield from range(n)

    assert list(common.frugal(rows)(3)) == [0, 1, 2]
    assert kept == ["byte_bpe", "back"] and list(common._HELD) == ["rolling"]
    assert common.frugal(len)("ab") == 2


def test_byte_bpe_model_has_all_pieces():
    codec = byte_bpe.Codec.of(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    assert codec.model.get_piece_size() == len(codec.tokens) + 1
    assert codec.model.unk_id() == len(codec.tokens)


@pytest.mark.parametrize("size", [0, 1, 5, 1024, 1025, 3000])
@pytest.mark.parametrize("largest", [2, 300, 49_408, 70_000])
def test_range_coder_round_trip(size, largest):
    ids = np.random.default_rng(size).integers(0, largest, size).astype(np.uint32)
    ids[size // 2 :] = ids[: size - size // 2]
    payload = range_coder.encode(ids)
    assert (range_coder.decode(payload) == ids).all()


def test_range_coder_shrinks_repeats_and_finds_damage():
    ids = np.tile(np.arange(50, dtype=np.uint32) * 900, 100)
    payload = range_coder.encode(ids)
    assert len(payload) < ids.nbytes / 8
    damaged = bytearray(payload)
    damaged[-20] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode(bytes(damaged))
    with pytest.raises(ValueError):
        range_coder.encode(np.array([1 << 30]))


@pytest.mark.parametrize("largest", [3, 49_408, 1 << 19])
def test_range_coder_takes_blocks_in_batches_of_like_size(largest):
    ids = np.random.default_rng(1).zipf(1.3, 16 * 41 - 5).clip(0, largest - 1).astype(np.uint32)
    payload = range_coder.encode(ids, block_ids=16, lanes=40)
    assert (range_coder.decode(payload, lanes=40) == ids).all()
    assert (range_coder.decode(payload, lanes=7) == ids).all()
    # One block more than a batch makes no batch of its own.
    assert range_coder._batches(41, 40) == [(0, 41)]


def test_token_files_encode_plain_words_by_their_pre_tokens():
    encoder = token_files.Encoder(token_files.VOCABULARY)
    whole = encoder.tokenizer
    texts = ["79.36.208.206 (944) 555-6250 don't rock'n'roll 'stuff' ''s A1b2;", "x_y~z \\^` '' 's 't're THE-END."]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    # Only other words need the whole way.
    encoder.tokenizer = None
    assert [np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() for t in texts] == want
    encoder.tokenizer = whole
    odd = ["<|endoftext|>a <|ENDOFTEXT|> x<|startoftext|> B", "<|EndOfText|>", "a\x1cb \x7f e\u0301 \u00c9T\u00c9 \u0130x n\u00b2 \u01c5 \x00", "\u00a0x\u2003y 12\u0663"]
    assert [np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() for t in odd] == [whole.encode(t, add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("frame_ids", [1, 500, 1 << 21])
def test_token_files(spark, tmp_path, frame_ids):
    rows = ODD + list(enumerate(random_texts(40, "abcde Fé1.,\x01\n", 60, 2), 100))
    path = str(tmp_path / "ids")
    token_files.write(table(spark, rows), path, frame_ids=frame_ids)
    model = Tokenizer.from_file(token_files.VOCABULARY)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files.read_summary(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    assert sum(len(r.ids) for r in token_files.read_ids(spark, path).collect()) == start


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(table(spark, []), path)
    assert token_files.read_summary(spark, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and you can not say no to all of them.</div>
<div class="ad">Buy the best of all things in the world, it is cheap and it is good for you and for us.</div>
<article><h1>A title &amp; more</h1><p>Short.</p><p>The first part of the text is long enough to be told by the words that it has in it.</p>
<p><b>An open element<br>goes on with the words of the text, and there is no end tag for it in the whole of the page.
<p>%%% ### 123 *** %%% ### 123 *** %%% ### 123 *** %%% ### 123 *** %%% ### 123 *** %%% ### 123 ***</p>
<form>Your name <input><button>Send the form to us</button></form><p>End.</p>
<div class="comments"><p>This is the best of all the pages that I have read, and I have read a lot of them.</p></div></article>
<aside>See also the other page of the site, which is as good as this one and has more of it.</aside>
<footer>&copy; us and all of the people who work with us on it, in the year of the page.</footer></body></html>"""
MAIN = [
    "A title & more", "Short.", "The first part of the text is long enough to be told by the words that it has in it.",
    "An open element goes on with the words of the text, and there is no end tag for it in the whole of the page.",
    "%%% ### 123 *** %%% ### 123 *** %%% ### 123 *** %%% ### 123 *** %%% ### 123 *** %%% ### 123 ***", "End.",
]


def test_html_main_text(spark):
    long = ("The text of a page without an article is told by the words in it. " * 3).strip()
    plain = f"<div><p>{long}</p><p>Yes.</p><p>{long}</p><p>No.</p></div><ul><li><a>One</a></li><li><a>Two</a></li></ul>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", plain), (5, "u", PAGE[: PAGE.index("End.")]), (5, "u", "<p>x"), (6, "u", "no markup")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_blocks", F.lit(1))
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extract(df).collect())
    # "No." stands as near to main text as to a list of links, outside an article.
    want = [("1", "u", MAIN), ("2", "None", []), ("3", "u", []), ("None", "u", [long, "Yes.", long]), ("5", "u", MAIN[:-1]), ("5", "u", []), ("6", "u", [])]
    texts = [(i, u, "\n\n".join(blocks)) for i, u, blocks in want]
    assert got == sorted((i, u, t, len(t)) for i, u, t in texts)
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_open_blocks_take_their_neighbours_label():
    assert html_text._settled([True, None, None, False, None], [False] * 5) == [True, True, False, False, False]
    assert html_text._settled([True, None, False], [False] * 3) == [True, False, False]
    assert html_text._settled([True, None, False], [True] * 3) == [True, True, False]
    assert html_text._settled([None, None], [True, False]) == [True, False]


def test_language_forward_sums_all_segmentations():
    pieces = language_id.Pieces.of(language_id.VOCABULARY)
    table = language_id._initial(pieces.n)[:, None] * np.linspace(1, 2, pieces.n + 2)[:, None]
    place = {p: i for i, p in enumerate(pieces.names)}
    for word in ["thing", "a", "", "漢字", "unbelievable" * 9]:
        marked = "▁" + word
        sums = [1.0]
        for t in range(1, len(marked) + 1):
            total = 0.0
            for n in range(1, min(pieces.longest, t) + 1):
                piece = marked[t - n : t]
                share = table[place[piece], 0] if piece in place else table[pieces.n, 0] if n == 1 else 0.0
                total += sums[t - n] * share
            sums.append(total)
        want = np.log(sums[-1]) if sums[-1] > 1e-300 else None
        got = language_id.forward(pieces, [word], table)[0, 0]
        assert np.isfinite(got) and (want is None or abs(got - want) < 1e-8)


def test_language_expected_pieces_cover_the_word():
    pieces = language_id.Pieces.of(language_id.VOCABULARY)
    counts = language_id.expected_counts(pieces, ["thing"], np.array([2.0]), language_id._initial(pieces.n))
    lengths = np.array([len(p) for p in pieces.names] + [1, 0])
    assert abs((counts * lengths).sum() - 2 * len("▁thing")) < 1e-9


def test_language_held_out(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(sf.withColumn("score", F.lit("x"))).join(sf.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 300 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    odd = table(spark, [*ODD, (20, "12 ... 34"), (21, None)]).withColumn("lang", F.when(F.col("doc_id") > 6, F.lit("fr")))
    got = {(r[0], r[2]): r for r in map(tuple, language_id.identify(odd).collect())}
    assert {k[0] for k in got if k[1] == "und"} >= {5, 1, 2, 20, 21}
    assert all(r[3] == 0 for k, r in got.items() if k[1] == "und")
    assert language_id.identify(odd).count() == len(ODD) + 2
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.judged(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_odd_rows(spark):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (9, 0, 0), (9, 0, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judged(docs, labels).count() == len(ODD)
    one = toxicity.judged(docs, labels.filter("toxic = 0")).collect()
    assert len(one) == len(ODD) and {r.predicted for r in one} == {0}
    assert {r.score for r in toxicity.judged(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.judged(docs.limit(0), labels).count() == 0


def test_fingerprints_of_edited_texts(spark):
    rows = [(i, t) for i, t in ODD if i not in (9,)] + list(enumerate(random_texts(60, "ab cd é ", 300, 3), 100))
    got = {r.doc_id: r for r in fingerprints.compared(table(spark, rows), range_rows=10).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == brute.sha(text[: len(text) - half] + after[:half])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_fingerprints_tell_order(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    rows = [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(words)), (4, " ".join(words[:390])), (5, "a b " * 50), (6, "a b " * 60)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, rows)).collect()}
    near = lambda a, b: sum(x == y for x, y in zip(got[a].signature, got[b].signature, strict=True)) / 32
    assert got[1].signature == got[3].signature
    assert near(1, 4) > 0.7 and 0.2 < near(1, 2) < 0.8
    # Uses of a k-mer count one by one.
    assert got[5].signature != got[6].signature
    assert fingerprints.compared(table(spark, [])).count() == 0
    alone = fingerprints.compared(table(spark, [(1, "abcdef")])).first()
    assert alone.edited_sha256 == brute.sha("abcabc") and alone.near_next == 1.0


def test_fingerprints_of_short_texts_tell_order(spark):
    pick = random.Random(8)
    texts = [[f"w{pick.randrange(10**6)}" for _ in range(n)] for n in range(20, 101, 4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(i + 1000, " ".join(w[len(w) // 2 :] + w[: len(w) // 2])) for i, w in enumerate(texts)]
    got = {r.doc_id: r.signature for r in fingerprints.fingerprints(table(spark, rows)).collect()}
    assert all(h is not None for s in got.values() for h in s)
    # Of two k-mers in random places, about half the pairs stand the other way round after a swap of halves.
    near = [sum(x == y for x, y in zip(got[i], got[i + 1000], strict=True)) / 32 for i in range(len(texts))]
    assert 0.25 < sum(near) / len(near) < 0.55
    # Every tuple draws its own pair.
    assert all(len(set(s)) > 16 for s in got.values())


def test_fingerprints_take_the_two_least(spark):
    texts = ["a b c d e f g h a b c a b c", "a b c", "a", "x x x x x x x"]
    got = {r.doc_id: r.signature for r in fingerprints.fingerprints(table(spark, list(enumerate(texts)))).collect()}
    assert len(set(got[0])) > 8 and None not in got[1] and None not in got[2]
    assert fingerprints.fingerprints(table(spark, [(1, None)])).first().signature == [None] * 32


def test_fingerprints_equal_all_hashes(spark):
    # What a tuple looks at holds its two least hashes, on short, long and uniform texts.
    texts = ["a b c d e f g h a b c a b c", "x " * 700, "a", "", *random_texts(3, "abc d e", 900, 6)]
    rows = table(spark, list(enumerate(texts)))
    few = fingerprints.with_signature(rows.select("doc_id", "text"), "text", "signature")
    got = {r.doc_id: r.signature for r in few.collect()}
    for i, text in enumerate(texts):
        words = text.split()
        grams = [tuple(words[a : a + 3]) for a in range(max(len(words) - 2, min(len(words), 1)))]
        uses = [grams[:a].count(g) for a, g in enumerate(grams)]
        own = spark.createDataFrame([(a, *[(*g, None, None)[j] for j in range(3)], u) for a, (g, u) in enumerate(zip(grams, uses, strict=True))], "place long, x string, y string, z string, use int")
        element = F.shiftrightunsigned(F.xxhash64(F.shiftright(F.xxhash64("x", "y", "z"), 25), "use"), 26)
        hashes = own.select("place", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("t"), element.alias("e")).select("place", "t", F.xxhash64("e", "t").alias("h"))
        by = {}
        for r in hashes.collect():
            by.setdefault(r.t, []).append((r.h, r.place))
        want = [[h for h, _ in sorted(sorted(by[t])[:2], key=lambda x: x[1])] if by else [] for t in range(32)]
        pairs = [w[:2] if len(w) > 1 else [*w, None] for w in want]
        plain = spark.createDataFrame([(t, *p) for t, p in enumerate(pairs) if p and p[0] is not None], "t int, a long, b long")
        signed = {r.t: r.h for r in plain.select("t", F.xxhash64("a", "b").alias("h")).collect()}
        assert got[i] == [signed.get(t) for t in range(32)]


def test_fingerprints_look_at_few_elements_and_compute_them_once(spark):
    plan = fingerprints.with_signature(table(spark, [(1, "a b")]).select("doc_id", "text"), "text", "signature")._jdf.queryExecution().optimizedPlan().toString()
    # The tuples read finished elements and a finished bound: neither is worked out again inside their lambda.
    tuples = max(plan.split("\n"), key=lambda line: line.count("lambda") if "AS signature" in line else -1)
    assert "sort_array" not in tuples and "shiftright" not in tuples and tuples.count("CASE WHEN (size(") <= 2


TURNS = [
    (1, 0, "system", "Be <|im_end|> kind\n"), (1, 1, "user", "a"), (1, 2, "assistant", "b <\\| c"), (2, 1, "user", "a"), (2, 0, "system", "Be <|im_end|> kind\n"),
    (2, 2, "assistant", ""), (2, 3, "assistant", "<|im_start|>assistant ok"), (3, 0, "us\ner\\n", None), (4, None, None, None), (None, 0, "user", "x"),
    (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "assistant", "long " * 5000), (7, 0, "system", "Be <|im_end|> kind\n"),
]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("path", F.lit(1))


@pytest.mark.parametrize("size", [1, 60, 1 << 18])
def test_chat_round_trip(spark, size):
    rows = TURNS + [(c, t, "user" if t % 2 == 0 else "assistant", f"{c % 3}:{t}" * (t + 1)) for c in range(20, 60) for t in range(c % 5 + 1)]
    packed = chat_format.packs(conversations(spark, rows), pack_chars=size, pack_leaves=7)
    got = {r.conv_id: r for r in chat_format.digests(packed).collect()}
    of: dict = {}
    for c, t, role, text in rows:
        of.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(of)
    for c, turns in of.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        spoken = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == brute.sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(spoken), brute.sha(spoken))
        assert got[c].formatted_chars == sum(len(chat_format.format_turn(r, t)[0]) for r, t in turns)


def test_chat_shares_turns_and_hides_other_branches(spark):
    packed = chat_format.packs(conversations(spark, TURNS)).collect()
    texts = "".join(p.text for p in packed)
    assert texts.count(chat_format.format_turn("system", "Be <|im_end|> kind\n")[0]) <= len(packed)
    for p in packed:
        for s in p.segments:
            assert s.position == sum(i.end - i.start for i in s.intervals)
            assert all(i.end <= s.start for i in s.intervals)
    assert chat_format.digests(chat_format.packs(conversations(spark, TURNS).limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "<<||", "a<|im_start|>b"])
def test_chat_escape_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text + "\n\\n")) == text + "\n\\n"
