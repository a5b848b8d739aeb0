"""HTML extraction by two-pass block rules (6).

A page is cut into blocks at block-level tags. The first pass decides each block alone:
by the elements it stands in, its link density, its length and its density of stop
words. Blocks too short for that, and blocks of the article without stop words, stay
open. The second pass gives them the label of the nearest decided neighbours: that of
both where they agree, the nearer one's where they differ.

Defined results: a null or empty page gives an empty text; markup that is never closed
ends with the page; equal distances to differing neighbours count as main text inside an
article and as boilerplate outside; a page without any decided block keeps its article's
blocks; null ids and urls stay null; repeated rows give one row each; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriweave.llm.common import slices

# Rules: share of characters in links above which a block is a list of links, length
# under which a block is too short to decide, shares of stop words.
MOST_LINKS = 0.4
SHORT = 70
STOP_SHARE = 0.12
_SLICE_BYTES = 4 * 1024 * 1024

# Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so
    some than that the their them then there these they this to up was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me mes ne nous ou par pas plus pour qu que qui sa
    se ses son sont sur un une vous
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im in ist mit nach
    nicht noch nur oder sich sie sind so über um und uns von vor war wie wird wir zu zum zur
    al como con del el ella en entre era es esta este fue ha hay la las lo los más muy no nos o para pero por que se si sin su sus también te
    un una y ya""".split()
)
# Elements that never hold main text, elements that cut blocks, and names of parts of a page.
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas audio video select option textarea button".split())
OUTSIDE = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert
    menu nav navbar navigation sidebar side widget widgets footer header masthead comment comments reply replies respond disqus share sharing
    social related recommended recommendations newsletter subscribe subscription signup login form search breadcrumb breadcrumbs pagination pager
    toolbar modal popup overlay""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


class _Block:
    __slots__ = ("pieces", "linked", "outside", "main")

    def __init__(self, outside: bool, main: bool) -> None:
        self.pieces: list[str] = []
        self.linked = 0
        self.outside, self.main = outside, main


def _named_part(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether the attributes tell a part of the page that is no main text."""
    for name, value in attributes:
        if name in ("class", "id") and value:
            if any(x in PARTS for x in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())):
                return True
        elif name == "role" and value and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Blocks(HTMLParser):
    """Cuts a page into blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[_Block] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, no text, outside, main
        self.links = 0
        self.cut = True

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.links += 1
        if tag in BLOCKS:
            self.cut = True
        if tag in VOID:
            if tag == "br" and self.blocks and not self.cut:
                self.blocks[-1].pieces.append(" ")
            return
        if tag in BLOCKS or tag in SKIPPED:
            _, skipped, outside, main = self.open[-1] if self.open else ("", False, False, False)
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):
                # Such elements need no end tag: a new one ends the last of its kind.
                if self.open and self.open[-1][0] == tag:
                    self.open.pop()
                    _, skipped, outside, main = self.open[-1] if self.open else ("", False, False, False)
            whole = tag in ("html", "body")
            part = not whole and (tag in OUTSIDE or (tag == "header" and not main) or (tag not in MAIN or not self._plain_main(attributes)) and _named_part(attributes))
            self.open.append((tag, skipped or tag in SKIPPED, outside or part, main or tag in MAIN))

    @staticmethod
    def _plain_main(attributes: list[tuple[str, str | None]]) -> bool:
        """An article or main element is what it says, unless it is named a comment."""
        return not any(n in ("class", "id") and v and re.search(r"comment|repl(y|ies)|related|promo|sponsor|advert", v, re.I) for n, v in attributes)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self.cut = True
            self.links = 0
        if (tag in BLOCKS or tag in SKIPPED) and any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        _, skipped, outside, main = self.open[-1] if self.open else ("", False, False, False)
        if skipped:
            return
        if self.cut:
            if not data.strip():
                return
            self.blocks.append(_Block(outside, main))
            self.cut = False
        self.blocks[-1].pieces.append(data)
        if self.links:
            self.blocks[-1].linked += len(data.strip())


def _first_label(text: str, block: _Block) -> bool | None:
    """True: main text; False: boilerplate; None: not decided alone."""
    if block.outside:
        return False
    if block.linked > MOST_LINKS * len(text):
        return False
    if len(text) < SHORT:
        return None
    words = _WORD.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if share >= STOP_SHARE:
        return True
    return None if block.main else False


def _settled(labels: list[bool | None], main: list[bool]) -> list[bool]:
    """Open labels from the nearest decided neighbours, on the same side of an article's border where there are any."""
    n = len(labels)
    out = [bool(x) for x in labels]
    if None not in labels:
        return out
    # Decided blocks ahead and behind, found once for articles and once for the rest of the page.
    for inside in (True, False):
        rows = [i for i in range(n) if main[i] == inside]
        decided = [k for k, i in enumerate(rows) if labels[i] is not None]
        left = -1
        for k, i in enumerate(rows):
            if labels[i] is not None:
                left += 1
                continue
            before = decided[left] if left >= 0 else None
            after = decided[left + 1] if left + 1 < len(decided) else None
            if before is None and after is None:
                out[i] = inside
            elif before is None or after is None:
                out[i] = bool(labels[rows[after if before is None else before]])
            else:
                a, b = bool(labels[rows[before]]), bool(labels[rows[after]])
                out[i] = a if a == b or k - before < after - k else b if after - k < k - before else inside
    return out


def main_blocks(html: str) -> tuple[list[str], int]:
    """Texts of the main blocks in page order, and the number of all blocks."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    texts = [" ".join("".join(b.pieces).split()) for b in parser.blocks]
    kept = [(t, b) for t, b in zip(texts, parser.blocks, strict=True) if t]
    labels = [_first_label(t, b) for t, b in kept]
    final = _settled(labels, [b.main and not b.outside for _, b in kept])
    return [t for (t, _), good in zip(kept, final, strict=True) if good], len(kept)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, and the numbers of blocks found and kept; row by row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _SLICE_BYTES, "html"):
                found = [main_blocks(h) for h in part.column(2).to_pylist()]
                texts = ["\n\n".join(blocks) for blocks, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                        pa.array([n for _, n in found], pa.int32()), pa.array([len(b) for b, _ in found], pa.int32()),
                    ],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    source = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(html_column), F.lit("")).alias("html"),
    )
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int")
