"""Main text of web pages by minimum-cut labelling.

A page is read into elements and blocks of text in page order. Elements are marked as boilerplate, comment
list or content by their tag, names and role. A mark is strong if the name says nothing else ("site-footer"),
weak if it does ("no-footer", "comment-free"), and weak marks fade with the distance below the element. An
element that holds most of the page's prose is a wrapper and loses its mark, unless there is an article
beside it. A logistic model over the marks above a block, its links, length and tag, fitted to the table
below, gives each block its costs of being content and of being boilerplate: the capacities of its edges
to the two terminals. Blocks that are neighbours in the page or children of one element are joined by
smoothness edges. The minimum cut is the cheapest labelling.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements by what they do to the text, and the names by which pages mark boilerplate.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody tfoot thead tr ul caption title noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose text browsers don't show. One that is never closed holds nothing; a drawing ends where a block begins.
UNSEEN = frozenset("template svg object canvas audio video annotation annotation-xml".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr"}, "thead": {"tr"}, "tfoot": {"tr"},
}
BOILER_TAGS = frozenset("nav aside footer form menu dialog search fieldset select button option input label noscript".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login social share sharing related recommended widget pagination pager "
    "toolbar copyright legal disclaimer skip search hidden toc announcement".split()
)
BOILER_STARTS = ("cookie", "advert", "adslot", "adbox", "adunit", "sidebar", "navbar", "breadcrumb", "newsletter", "sponsor", "promo", "paywall", "footer")
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus discussion commentlist".split())
#: Words that leave the meaning of a name beside them as it is.
PLAIN_NAMES = frozenset(
    "site page main top bottom left right upper lower inner outer wrap wrapper container box block bar area section list item items "
    "content contents text body head title link links button buttons form group panel module modules global primary secondary mobile "
    "desktop col column row inline holder zone slot unit icon icons logo post posts article articles story stories news thread count "
    "author meta more my the and of js id class ui c l m s x d h w".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

BOILER, NAMED, COMMENT, CONTENT = 0, 1, 2, 3
#: Ends of sentences.
STOPS = ".!?:;\"”»…"
#: Strength of a mark by a name that says something else too, and what is left of it one element further down.
WEAK, FADES = 0.5, 0.8
#: An element with this share of a page's prose may be a wrapper; the prose beside a boilerplate element that is none is
#: at least this share of its own, beside a comment list that one.
MOST, BESIDE, BESIDE_COMMENTS = 0.5, 0.25, 0.1
#: Characters of prose that a wrapper has at least.
WRAPPED = 200

#: Smoothness between neighbours in the page, and between consecutive children of one element.
NEAR, SIBLING = 0.15, 0.6

# Fixed values of the training table. Columns: strength of the mark as a boilerplate element, as an element so
# named, inside an article or main element (1) or not, strength of the mark as a comment list, share of linked text, characters, heading, paragraph,
# ends like a sentence, content.
TABLE = """
0 0 1 0 0.0 420 0 1 1 1
0 0 1 0 0.0 60 1 0 0 1
0 0 1 0 0.0 12 0 1 1 1
0 0 1 0 0.1 230 0 1 1 1
0 0 1 0 0.0 35 0 0 0 1
0 0 1 0 0.4 150 0 1 1 1
0 0 1 0 0.0 900 0 1 1 1
0 0 1 0 0.0 3 0 1 1 1
0 0 1 0 0.0 25 1 0 1 1
0 0 1 0 0.9 60 0 1 0 1
0 0 0 0 0.0 500 0 1 1 1
0 0 0 0 0.0 300 0 1 1 1
0 0 0 0 0.0 180 0 1 1 1
0 0 0 0 0.1 640 0 1 1 1
0 0 0 0 0.0 45 1 0 0 1
0 0 0 0 0.0 70 0 1 1 1
0 0 0 0 0.2 250 0 0 1 1
0 0 0 0 0.0 800 0 0 1 1
0 0 0 0 1.0 10 0 0 0 0
0 0 0 0 1.0 25 0 0 0 0
0 0 0 0 0.8 40 0 0 0 0
0 0 0 0 0.0 14 0 0 0 0
0 0 0 0 0.9 80 0 1 0 0
0 0 0 0 0.0 30 0 0 0 0
1 0 0 0 1.0 8 0 0 0 0
1 0 0 0 0.0 60 0 0 1 0
1 0 0 0 0.2 200 0 1 1 0
1 0 0 0 0.0 90 1 0 0 0
1 0 0 0 0.0 420 0 1 1 0
1 0 1 0 0.0 120 0 1 1 0
1 0 1 0 1.0 20 0 0 0 0
1 0 1 0 0.0 30 1 0 0 0
1 0 1 0 0.0 300 0 1 1 0
1 1 0 0 0.5 30 0 0 0 0
0 1 0 0 0.0 60 0 0 1 0
0 1 0 0 0.0 200 0 1 1 0
0 1 0 0 0.3 350 0 1 1 0
0 1 0 0 1.0 15 0 0 0 0
0 1 0 0 0.0 20 1 0 0 0
0 1 1 0 0.0 80 0 1 1 0
0 1 1 0 0.0 250 0 1 1 0
0 1 1 0 0.7 30 0 0 0 0
0 1 1 0 0.0 18 1 0 0 0
0 0 0 1 0.0 150 0 1 1 0
0 0 0 1 0.1 40 0 1 1 0
0 0 0 1 0.0 500 0 1 1 0
0 0 1 1 0.0 300 0 1 1 0
0 0 1 1 0.5 15 0 0 0 0
0 0 1 1 0.0 20 1 0 0 0
1 0 0 1 0.0 60 0 0 0 0
0 0.5 0 0 0.0 300 0 1 1 1
0 0.5 0 0 0.0 120 0 1 1 1
0 0.5 0 0 0.1 500 0 1 1 1
0 0.5 0 0 0.0 40 1 0 0 1
0 0.5 0 0 1.0 12 0 0 0 0
0 0.5 0 0 0.0 20 0 0 0 0
0 0.5 1 0 0.0 60 0 1 1 1
0 0.5 1 0 0.0 250 0 1 1 1
0 0.5 1 0 0.0 30 1 0 0 1
0 0.5 1 0 0.9 20 0 0 0 0
0 0.4 1 0 0.2 200 0 1 1 1
0 0.4 0 0 0.2 400 0 1 1 1
0 0.3 0 0 0.0 180 0 1 1 1
0 0.3 1 0 0.0 20 0 1 1 1
0 0 1 0.5 0.0 200 0 1 1 1
0 0 1 0.5 0.0 40 1 0 0 1
0 0 1 0.5 0.0 60 0 1 1 1
0 0 0 0.5 0.0 300 0 1 1 1
0 0 0 0.5 0.0 120 0 1 1 1
0 0 0 0.5 1.0 15 0 0 0 0
0 0 0 0.4 0.0 250 0 1 1 1
0 0 1 0 0.0 90 0 0 1 1
0 0 1 0 0.0 20 0 0 0 1
0 0 1 0 0.3 45 0 0 0 1
0 0 0 0 0.0 60 0 1 1 1
0 0 0 0 0.0 130 0 0 1 1
0 0 0 0 0.0 25 0 1 0 0
0 1 0 0 0.0 600 0 1 1 0
0 1 1 0 0.0 600 0 1 1 0
1 1 0 0 0.0 300 0 1 1 0
0 1 0 1 0.0 200 0 1 1 0
"""


def _vector(boiler: float, named: float, content: float, comment: float, linked: float, chars: float, heading: int, para: int, stop: int) -> list[float]:
    return [boiler, named, content, comment, linked, linked * content, math.log1p(min(chars, 10_000)) / 5, heading, para, stop, 1.0]


@lru_cache(maxsize=1)
def weights(l2: float = 0.05, steps: int = 40) -> tuple[float, ...]:
    """The logistic model fitted to TABLE by Newton's method."""
    rows = [[float(v) for v in line.split()] for line in TABLE.strip().split("\n")]
    x = np.array([_vector(*r[:-1]) for r in rows])
    y = np.array([r[-1] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
    return tuple(float(v) for v in w)


Element = tuple[int, str, tuple[float, float, float, float]]
Block = tuple[str, int, int, str, float]


def _strength(value: str, names: frozenset[str], starts: tuple[str, ...] = ()) -> float:
    """How strongly the names in a class or id attribute mark an element as one of ``names``."""
    most = 0.0
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        hit = [w in names or bool(starts) and w.startswith(starts) for w in words]
        if any(hit):
            most = max(most, 1.0 if all(h or w in PLAIN_NAMES for h, w in zip(hit, words, strict=True)) else WEAK)
    return most


def marks(tag: str, attributes: str, in_content: bool) -> tuple[float, float, float, float]:
    """The marks of an element by itself: boilerplate element, so named, comment list, content."""
    boiler = named = comment = 0.0
    content = 1.0 if tag in ("article", "main") else 0.0
    if tag in BOILER_TAGS or tag == "header" and not in_content:
        boiler = 1.0
    if attributes and tag not in ("html", "body", "main", "a", "b", "i", "em", "strong"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                comment = max(comment, _strength(value, COMMENT_NAMES))
                if tag != "article":  # an article may be about anything
                    inside = {"header", "search", "related"} if tag == "header" else {"header"}
                    named = max(named, _strength(value, BOILER_NAMES - inside if in_content else BOILER_NAMES, BOILER_STARTS))
            elif name == "role":
                boiler = max(boiler, float(value.lower() in BOILER_ROLES))
                content = max(content, float(value.lower() in ("main", "article")))
            elif name == "style" and re.search(r"display\s*:\s*none", value) or name == "aria-hidden" and value.lower() == "true":
                named = 1.0
    return boiler, named, comment, content


def read(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks with text in page order, (text, parent element, own element, tag, share of linked text), and
    the elements, (parent, tag, marks), numbered in page order from 1. Scripts, styles and comments are no
    text. Elements are closed as browsers do where tags are missing."""
    out: list[Block] = []
    elements: list[Element] = [(0, "", (0.0, 0.0, 0.0, 0.0))]
    # Open elements: tag, number, whether text in it is seen, whether it is in content.
    stack: list[tuple[str, int, bool, bool]] = [("", 0, True, False)]
    open_: dict[str, int] = {}
    # The element that holds the current block: the nearest open one that makes blocks.
    parts: list[str] = []
    linked = 0
    at = 0
    holder = stack[0]
    above = 0
    closed: dict[str, int] = {}  # where the last end tag of an unseen element is

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                # Paragraphs are children of the element around them; loose text is one of its own.
                inner = holder[0] in ("p", "li", "pre", "blockquote", "tr", "dd", "dt", "figcaption", "summary") or holder[0][:1] == "h" and holder[0][1:].isdigit()
                out.append((text, above if inner else holder[1], stack[-1][1], holder[0], min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def settle() -> None:
        nonlocal holder, above
        k = len(stack) - 1
        while k and stack[k][0] not in BLOCKS:
            k -= 1
        holder, above = stack[k], stack[max(0, k - 1)][1]

    def shut(k: int) -> None:
        for name, *_ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    def unclosed(tag: str) -> bool:
        if tag not in closed:
            ends = [m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.I)]
            closed[tag] = ends[-1] if ends else -1
        return closed[tag] < at

    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and stack[-1][2]:
            text = html.unescape(page[at:end])
            parts.append(text)
            if open_.get("a"):
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] or m[4]
        attributes = m[3] or m[6] or ""
        if closing:
            if tag in BLOCKS:
                flush()
            if not open_.get(tag):
                if tag in ("br", "p"):
                    parts.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    shut(k)
                    break
                if stack[k][0] in BLOCKS and tag not in BLOCKS and tag not in UNSEEN:
                    break  # an inline end tag closes nothing beyond its block
            if tag in BLOCKS or tag in UNSEEN:
                settle()
            elif tag in ("td", "th"):
                parts.append(" ")
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        if tag in UNSEEN and (attributes.rstrip().endswith("/") or unclosed(tag)):
            continue
        if tag in BLOCKS or tag in CLOSES:
            if tag in BLOCKS:
                flush()
                if open_.get("svg"):
                    shut(next(k for k, s in enumerate(stack) if s[0] == "svg"))
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    shut(k)
                    break
                if stack[k][0] in BLOCKS and stack[k][0] not in ("p",):
                    break
        if tag in ("td", "th"):
            parts.append(" ")
        own = marks(tag, attributes, stack[-1][3])
        elements.append((stack[-1][1], tag, own))
        stack.append((tag, len(elements) - 1, stack[-1][2] and tag not in UNSEEN, stack[-1][3] or own[CONTENT] > 0))
        open_[tag] = open_.get(tag, 0) + 1
        if tag in BLOCKS:
            settle()
    flush()
    return out, elements


def _prose(block: Block) -> int:
    """Characters of a block that reads like running text, else 0."""
    n = len(block[0])
    return n if block[4] < 0.5 and (n >= 80 or n >= 30 and block[0][-1] in STOPS) else 0


def wrappers(found: list[Block], elements: list[Element]) -> set[int]:
    """The marked elements that hold most of the page's prose, with no article beside them to be the main text."""
    prose = np.array([_prose(b) for b in found], dtype=np.int64)
    own = np.array([b[2] for b in found], dtype=np.int64)
    total = int(prose.sum())
    if total < WRAPPED:
        return set()
    n = len(elements)
    below, last = np.zeros(n, dtype=np.int64), np.arange(n)
    np.add.at(below, own, prose)
    strong = np.zeros(n, dtype=np.int64)
    holds, content = [False] * n, [False] * n
    for e in range(1, n):
        parent, tag, m = elements[e]
        strong[e] = strong[parent] + (max(m[:CONTENT]) == 1.0)
        content[e] = content[parent] or m[CONTENT] > 0
    for e in range(n - 1, 0, -1):
        parent, tag, m = elements[e]
        below[parent] += below[e]
        last[parent] = max(last[parent], last[e])
        holds[parent] = holds[parent] or (holds[e] or m[CONTENT] > 0 or tag == "h1") and not any(m[:CONTENT])
    live = strong[own] if len(own) else own
    in_content = np.array([content[e] for e in own], dtype=bool)
    out: set[int] = set()
    for e in range(1, n):
        m = elements[e][2]
        mark = max(m[:CONTENT])
        if not mark or below[e] < max(WRAPPED, MOST * total):
            continue
        inside = (own >= e) & (own <= last[e])
        beside = prose * ~inside * (live == 0)
        if m[COMMENT] == 1.0:
            wraps = beside.sum() < BESIDE_COMMENTS * below[e]
        else:
            wraps = holds[e] or beside.sum() < (BESIDE if mark == 1.0 else 1.0) * below[e]
        if wraps and (holds[e] and m[COMMENT] < 1.0 or not (beside * in_content).any()):
            out.add(e)
            if mark == 1.0:
                live = live - inside
        elif mark == 1.0:
            break  # whatever it holds is under its mark
    return out


def signs(found: list[Block], elements: list[Element]) -> list[tuple[float, float, float, float]]:
    """(boilerplate, named, content, comment) for each block, from the marks of the elements around it."""
    voided = wrappers(found, elements)
    # For each element: boilerplate, strongly and weakly named, strong and weak comment list, content.
    around: list[tuple[float, float, float, float, float, float]] = [(0.0,) * 6]
    for e in range(1, len(elements)):
        parent, _, (boiler, named, comment, content) = elements[e]
        b, n1, n2, c1, c2, t = around[parent]
        if e in voided:
            boiler = named = comment = 0.0
        around.append((
            max(b, boiler), max(n1, float(named == 1.0)), max(n2 * FADES, named), max(c1, float(comment == 1.0)), max(c2 * FADES, comment), max(t, content)
        ))
    out = []
    for block in found:
        b, n1, n2, c1, c2, t = around[block[2]]
        out.append((b, max(n1, n2), t, max(c1, c2)))
    return out


def margins(found: list[Block], elements: list[Element]) -> list[float]:
    """Log odds of being content."""
    w = weights()
    out = []
    for (text, _, _, tag, linked), (boiler, named, content, comment) in zip(found, signs(found, elements), strict=True):
        v = _vector(
            boiler, named, content, comment, linked, len(text),
            tag[:1] == "h" and tag[1:].isdigit(), tag in ("p", "pre", "blockquote"), text[-1] in STOPS,
        )
        out.append(sum(a * b for a, b in zip(w, v, strict=True)))
    return out


def edges(found: list[Block]) -> list[dict[int, float]]:
    """Smoothness capacities between blocks."""
    near: list[dict[int, float]] = [{} for _ in found]
    last: dict[int, int] = {}
    for i, (_, parent, *_) in enumerate(found):
        for j, weight in ((i - 1, NEAR), (last.get(parent, -1), SIBLING)):
            if j >= 0:
                near[i][j] = near[j][i] = near[i].get(j, 0.0) + weight
        last[parent] = i
    return near


def min_cut(odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """The labelling with the least sum of terminal and smoothness capacities cut: true is content.

    A block whose terminal outweighs all its edges takes that label in some minimum cut; it is fixed
    and its edges become terminal capacities of its neighbours. Maximum flow by shortest augmenting
    paths settles what is left. Of several minimum cuts the one with the least content is taken there.
    """
    odds = list(odds)
    near = [dict(x) for x in near]
    label: list[bool | None] = [None] * len(odds)
    todo = deque(range(len(odds)))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, weight in near[i].items():
                del near[j][i]
                odds[j] += weight if label[i] else -weight
                todo.append(j)
            near[i] = {}
    left = [i for i, x in enumerate(label) if x is None]
    while True:
        reached = {i: i for i in left if odds[i] > 1e-12}
        queue = deque(reached)
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for j, room in near[i].items():
                if room > 1e-12 and j not in reached:
                    reached[j] = i
                    if odds[j] < -1e-12:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            break
        path = [end]
        while reached[path[-1]] != path[-1]:
            path.append(reached[path[-1]])
        path.reverse()
        flow = min(odds[path[0]], -odds[end], *(near[a][b] for a, b in zip(path, path[1:], strict=False)))
        odds[path[0]] -= flow
        odds[end] += flow
        for a, b in zip(path, path[1:], strict=False):
            near[a][b] -= flow
            near[b][a] += flow
    for i in left:
        label[i] = i in reached
    return [bool(x) for x in label]


def main_text(page: str) -> str:
    found, elements = read(page)
    keep = min_cut(margins(found, elements), edges(found))
    return "\n\n".join(block[0] for block, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``: the content blocks of the whole html,
    joined by two line feeds. Null and empty html give an empty text. Null identifiers and repeated
    rows are kept; other columns are ignored; an empty table gives an empty result."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")
