"""Main text of web pages: the contiguous region whose words and tags have the largest total score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import bounded, map_texts, ship_package

# A page is cut into comments, elements whose content is no markup, tags, and the text between them.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.I | re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
NEVER_CONTENT = frozenset(
    "head title nav footer aside form button select option menu dialog object canvas audio video map fieldset".split()
)
PAGE_ONLY = frozenset(["header"])  # content where it stands inside the article
NEVER_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs comment "
    "comments disqus replies respond social share sharing related recommended newsletter subscribe subscription signup "
    "login footer masthead pagination pager skip complementary contentinfo search".split()
)
# A class of several parts is boilerplate if each part is one of the names above, one of these, or a number.
LAYOUT = frozenset(
    "site page main primary secondary top bottom left right post entry article articles posts blog wp mobile desktop global "
    "area bar block box button buttons container form icons inner item items link links list panel section slot unit "
    "wrap wrapper header google dfp".split()
)
ARTICLE = frozenset(["article", "main"])
PAGE = frozenset(["html", "body"])
WRAPPERS = frozenset(["form", "fieldset"])  # some pages stand in one whole

# Scores: of a word and of a tag that no labelled page has, and how far a learned one may go.
WORD, TAG, MOST = 1.0, -0.5, 4.0

def boilerplate_name(name: str) -> bool:
    """Whether a whole class, id or role says boilerplate: ``site-footer`` does, ``has-sidebar`` and ``related-work`` don't."""
    if name in NEVER_NAMED:
        return True
    parts = [p for p in re.split(r"[-_]+", name) if p and not p.isdigit()]
    return any(p in NEVER_NAMED for p in parts) and all(p in NEVER_NAMED or p in LAYOUT for p in parts)


class Element:
    """An element of a page: its name and feature, what it stands in, and whether it is boilerplate or in an article."""

    __slots__ = ("name", "feature", "parent", "marked", "named", "barred", "wraps", "form", "junk", "inside", "words", "first", "last")

    def __init__(self, name: str, feature: str, parent: Element | None, classes: list[str], first: int):
        self.name, self.feature, self.parent = name, feature, parent
        self.marked = name in ARTICLE or any("articlebody" in re.split(r"[-_]+", x) for x in classes)
        self.named = any(boilerplate_name(x) for x in classes)
        self.barred = self.wraps = self.form = self.junk = self.inside = False
        self.words = 0
        self.first = self.last = first  # its first event, and the one after its last


class Event(NamedTuple):
    kind: str  # "tag" or "text"
    feature: str
    element: Element
    data: str  # name or text
    words: int  # of a text


def settle(elements: list[Element]) -> None:
    """Tell boilerplate from the rest. Elements come after those that they stand in.

    What holds the content is no boilerplate because of its name or because it is a form. Content is a ``main`` or one of
    the page's long articles; where none is marked, more than half of the words outside menus and the like.
    """
    for e in reversed(elements[1:]):
        e.parent.last = max(e.parent.last, e.last)
        if e.name in WRAPPERS or e.name not in NEVER_CONTENT:
            e.parent.words += e.words
    for e in elements[1:]:
        e.barred = e.parent.barred or e.name in NEVER_CONTENT and e.name not in WRAPPERS and e.name != "head"
    marks = [e for e in elements if e.marked and e.words and not e.barred and (e.name == "main" or not e.named)]
    longest = max((e.words for e in marks), default=0)
    for e in marks:
        up = e if e.name == "main" or 2 * e.words >= longest else None
        while up is not None and not up.wraps:
            up.wraps = True
            up = up.parent
    for e in elements[1:]:
        up = e.parent
        wraps = e.wraps if marks else 2 * e.words > elements[0].words
        form = e.name in WRAPPERS
        e.form = form or up.form
        e.junk = up.junk or e.name in PAGE_ONLY and not up.inside or e.form and e.name == "label"
        e.junk = e.junk or e.name in NEVER_CONTENT and not (form and wraps) or e.named and not wraps and e.name not in ARTICLE
        if e.name in PAGE and up.name in {"", "html", "head"}:
            e.junk = False
        e.inside = up.inside or e.marked


def read_page(html: str) -> tuple[list[Event], list[Element]]:
    """Walk a page once, keeping the open elements: its tags and texts in order, and its elements."""
    elements = [Element("", "", None, [], 0)]
    stack = elements[:]
    seen: list[Event] = []

    def add(kind: str, feature: str, element: Element, data: str) -> None:
        seen.append(Event(kind, feature, element, data, len(data.split()) if kind == "text" else 0))
        element.last = len(seen)
        element.words += seen[-1].words

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            add("text", stack[-1].feature, stack[-1], html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                element = stack[depth]
                del stack[depth:]
                add("tag", "/" + element.feature, element, name)
            else:
                add("tag", "/" + name, stack[-1], name)
            continue
        named = [x for got in NAMES.findall(m[4] or m[7] or "") for x in (got[0] or got[1] or got[2]).lower().split()]
        feature = ".".join([name, *named[:2]])
        if name not in INLINE:  # a block ends an open paragraph and what stands open in it
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name not in INLINE), 0)
            if depth and stack[depth].name == "p":
                del stack[depth:]
            elif name == "p":
                del stack[depth + 1 :]
        element = Element(name, feature, stack[-1], named, len(seen))
        elements.append(element)
        add("tag", feature, element, name)
        if name not in VOID:
            stack.append(element)
    if at < len(html):
        add("text", stack[-1].feature, stack[-1], html[at:])
    settle(elements)
    return seen, elements


def count_features(pages: list[str | None]) -> Counter:
    """For pages that mark their article: how often each tag, and each word by its element, is inside and outside.

    Boilerplate counts on neither side: what its list items and links hold says nothing of those of an article.
    """
    out: Counter = Counter()
    for html in pages:
        if not html or not re.search(r"<(article|main)\b|articlebody", html, re.I):
            continue
        for kind, feature, element, _, words in read_page(html)[0]:
            n = words if kind == "text" else 1
            if n and not element.junk:
                out[kind, feature, element.inside] += n
    return out


def learn_weights(
    pages: DataFrame, html_col: str = "html", max_pages: int = 20_000, max_features: int = 20_000
) -> dict[tuple[str, str], float]:
    """Scores of tags, and of words by the element they stand in, from pages that mark their article themselves.

    Words score the logarithm of how much likelier they are inside; tags always score below zero, the more so the rarer
    they are inside. About ``max_pages`` pages chosen by a hash of the page are read, and the ``max_features`` commonest
    features are kept, which bounds the model; all others have the default scores.
    """
    ship_package(pages.sparkSession)
    html = pages.select(F.col(html_col).cast("string").alias("html"))
    n = html.count()
    share = 1.0 if n <= max_pages else max_pages / n
    some = html.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch, "html"):
                counts = count_features(piece.column("html").to_pylist())
                rows = [(k, f, i, c) for (k, f, i), c in counts.items()]
                if rows:
                    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64()]
                    arrays = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["kind", "feature", "inside", "n"])

    counted = some.mapInArrow(run, "kind string, feature string, inside boolean, n long")
    total = (
        counted.groupBy("kind", "feature")
        .agg(
            F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
            F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside"),
        )
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "kind", "feature")
        .limit(max_features)
    )
    counts: Counter = Counter()
    for r in total.collect():
        counts[r["kind"], r["feature"], True] = r["inside"]
        counts[r["kind"], r["feature"], False] = r["outside"]
    return weights_of(counts)


def weights_of(counts: Counter) -> dict[tuple[str, str], float]:
    weights = {}
    for kind, feature in {(k, f) for k, f, _ in counts}:
        inside, outside = counts[kind, feature, True], counts[kind, feature, False]
        if kind == "text":
            weights[kind, feature] = max(-MOST, min(MOST, log((inside + 3.0) / (outside + 1.0))))
        else:
            weights[kind, feature] = -0.05 - MOST * (outside + 0.5) / (inside + outside + 1.0)
    return weights


def widened(start: int, end: int, elements: list[Element]) -> tuple[int, int]:
    """The whole of the smallest marked article that holds the region; if none does, of those that it cuts."""
    marked = [(e.first, e.last) for e in elements if e.marked and not e.junk]
    around = [(first, last) for first, last in marked if first <= start and end <= last]
    if around:
        return min(around, key=lambda span: span[1] - span[0])
    cut = [(first, last) for first, last in marked if first < end and start < last]
    return min([start, *(first for first, _ in cut)]), max([end, *(last for _, last in cut)])


def main_text(html: str | None, weights: dict[tuple[str, str], float]) -> str:
    """Blocks of the best region, joined by empty lines.

    One linear scan keeps the best sum that ends at each event. A boilerplate element counts as one tag whatever it
    holds, so that an advert or a list of links inside an article doesn't split it, and its texts are never returned. A
    region in an article that the page marks is widened to the whole article.
    """
    if not html:
        return ""
    seen, elements = read_page(html)
    best = total = 0.0
    start, found = 0, (0, 0)
    skipped = False
    for i, (kind, feature, element, _, words) in enumerate(seen):
        if element.junk:
            total += 0.0 if skipped else TAG
        elif kind == "tag":
            total += weights.get((kind, feature), TAG)
        elif words:
            total += words * weights.get((kind, feature), WORD)
        skipped = element.junk
        if total <= 0.0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    if best > 0.0:
        found = widened(*found, elements)
    blocks, held = [], []

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    for kind, _, element, data, _ in seen[found[0] : found[1]]:
        if kind == "text":
            if not element.junk:
                held.append(data)
        elif data == "br":
            held.append(" ")
        elif data not in INLINE:
            close()
    close()
    return "\n\n".join(blocks)


def extract_text(
    pages: DataFrame, html_col: str = "html", max_pages: int = 20_000, weights: dict[tuple[str, str], float] | None = None
) -> DataFrame:
    """Add ``text`` and ``n_chars`` to the pages and drop their markup.

    Weights are learned from the pages themselves unless given; they are bounded by ``learn_weights`` and sent to the
    tasks. Each page is handled where it is read. Null or empty markup gives an empty text; nulls elsewhere stay;
    repeated rows give repeated results; an empty table gives no rows; a page of any length is read whole. Other columns
    are kept; columns that were named ``text`` or ``n_chars`` before are replaced.
    """
    learned = learn_weights(pages, html_col, max_pages) if weights is None else weights
    sent = pages.sparkSession.sparkContext.broadcast(learned)
    kept = pages.drop(*{"text", "n_chars"} - {html_col}).withColumn(html_col, F.col(html_col).cast("string"))

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        model = sent.value

        def work(batch: list[str | None]) -> dict[str, list]:
            texts = [main_text(html, model) for html in batch]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_texts(kept, html_col, "text string, n_chars long", make)
