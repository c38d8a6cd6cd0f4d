"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lines in a window; least part of the largest window at which a further stretch of text still belongs to the
#: page's main text where the page does not name its article.
WINDOW, PART = 3, 0.15

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|canvas|audio|video|math|title)\b(?:[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)"""
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"[ \t-\r]+")

_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HOLDERS = frozenset(
    "article aside body button details dialog div fieldset figure footer form head header main menu nav ol search section select table "
    "textarea ul span p li a label".split()
)
_OUT = frozenset("aside button dialog footer form head menu nav search select textarea label".split())
_MARKS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner banners sponsor sponsored promo promotion outbrain taboola nav navbar navigation "
    "menu menus breadcrumb breadcrumbs pagination pager footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser comment comments "
    "disqus respond reply replies widget toolbar masthead topbar copyright disclaimer skip search complementary contentinfo".split()
)


class _Element:
    __slots__ = ("begin", "end", "holds", "name", "out", "parent")

    def __init__(self, name: str, out: bool, begin: int, parent: int) -> None:
        self.name, self.out, self.begin, self.end, self.parent = name, out, begin, -1, parent
        self.holds = False


def _marked(more: str) -> bool:
    """Do class, id or role say that this is not the article?"""
    for m in _NAMES.finditer(more):
        value = m[1] or m[2] or m[3] or ""
        names = [*_WORD.findall(value), *re.sub("[-_]", "", value).split()]
        if any(n.lower() in _MARKS for n in names):
            return True
    return False


def _parse(html: str) -> tuple[list[str], np.ndarray, list[_Element], set[int]]:
    """Lines, how many characters of each are outside links, the elements over them, and which lines are headings."""
    lines: list[str] = []
    outside: list[int] = []
    headings: set[int] = set()
    elements: list[_Element] = []
    stack: list[int] = []
    held: list[str] = []
    free, in_link, heading = 0, 0, False

    def close() -> None:
        nonlocal held, free
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip(" ")
            if text:
                if heading:
                    headings.add(len(lines))
                lines.append(text)
                outside.append(min(free, len(text)))
            held, free = [], 0

    def add(text: str) -> None:
        nonlocal free
        if text:
            held.append(text)
            if not in_link:
                free += len(text.strip())

    at = 0
    for m in _TAG.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in _BREAKS:
            close()
        elif name == "br":
            held.append(" ")
        if m["end"]:
            if name == "a":
                in_link = 0
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False
            if name in _HOLDERS:
                for i in range(len(stack) - 1, -1, -1):
                    if elements[stack[i]].name == name:
                        for j in stack[i:]:
                            elements[j].end = len(lines)
                        del stack[i:]
                        break
        else:
            if name == "a":
                in_link = 1
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = True
            if name in _HOLDERS and not m["more"].endswith("/"):
                marked = _marked(m["more"]) if m["more"] else False
                if name in ("span", "p", "li", "a", "label") and not marked and name != "label":
                    continue
                if name in ("p", "li"):  # closed by the next of its kind
                    for i in range(len(stack) - 1, -1, -1):
                        if elements[stack[i]].name == name:
                            elements[stack[i]].end = len(lines)
                            del stack[i]
                        break
                if name not in _BREAKS and marked:
                    close()
                out = name in _OUT or (marked and name not in ("body", "article", "main"))
                elements.append(_Element(name, out, len(lines), stack[-1] if stack else -1))
                stack.append(len(elements) - 1)
                if name in ("article", "main"):
                    for j in stack[:-1]:
                        elements[j].holds = True
    add(html[at:])
    close()
    for j in stack:
        elements[j].end = len(lines)
    return lines, np.array(outside, np.int64), elements, headings


def _stretches(weight: np.ndarray) -> list[tuple[int, int, int]]:
    """(first line, past the last, largest window) of each stretch between a surge and the next dive.

    A window's sum is of WINDOW lines.  Text surges where the sum leaves nothing, and dives where it falls to nothing.
    """
    out, begin = [], None
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW - 1 :] if len(weight) else weight
    for i in range(len(weight)):
        if begin is None and weight[i]:
            begin = i
        if begin is not None and (i + 1 == len(weight) or not weight[i + 1 : i + 1 + WINDOW].any()):
            last = begin + int(np.flatnonzero(weight[begin : i + 1])[-1]) + 1
            out.append((begin, last, int(sums[begin:last].max())))
            begin = None
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, one a line; empty if there is none.

    Markup is stripped and every block-level element makes lines.  Menus, headers, footers, sidebars, notices, adverts,
    forms and comments go where elements or their names say so, unless they hold the article; a class or id does not remove what holds
    most of the text outside links of the article around it, or of a page without one.

    Then line blocks decide: text is kept from where the text of WINDOW lines surges to where it dives.  If the page's ``article``
    elements, else its ``main``, hold most of the text outside links, they are the weight: their lines count in full, links
    included, and others for nothing.  Else lines count without links, in the element that holds most of the text, and a stretch
    far below the page's largest is left out.
    """
    if not html:
        return ""
    lines, outside, elements, headings = _parse(html)
    if not lines:
        return ""
    keep = np.ones(len(lines), bool)
    within = np.zeros(len(lines), bool)
    for e in elements:
        if e.name in ("article", "main"):
            within[e.begin : e.end] = True
    for e in elements:
        if e.name == "header" and not e.holds:
            inner = within[e.begin : e.end].any()
            for i in range(e.begin, e.end):
                keep[i] &= inner and i in headings
        elif e.out and e.name in _OUT and not e.holds:
            keep[e.begin : e.end] = False
    held = lambda a, b: int(np.where(keep[a:b], outside[a:b], 0).sum())
    for e in elements:  # outer before inner
        if e.out and e.name not in _OUT and e.name != "header" and not e.holds:
            a, b = _around(e, elements, len(lines))
            named = within.any() and not within[e.begin : e.end].any()
            if named or 2 * held(e.begin, e.end) <= held(a, b):
                keep[e.begin : e.end] = False
    begin, end = 0, len(lines)
    weight = np.where(keep, outside, 0)
    whole = held(begin, end)
    for kind in ("article", "main"):
        chosen = np.zeros(len(lines), bool)
        for e in elements:
            if e.name == kind and held(e.begin, e.end):
                chosen[e.begin : e.end] = True
        if 2 * int(weight[chosen].sum()) > whole:
            weight = np.where(keep & chosen, [len(x) for x in lines], 0)
            return _chosen(lines, weight, np.flatnonzero(keep & chosen), 0.0)
    for e in elements:  # outer before inner
        if begin <= e.begin and e.end <= end and held(e.begin, e.end) >= 0.7 * whole > 0:
            begin, end, whole = e.begin, e.end, held(e.begin, e.end)
    return _chosen(lines, weight, begin + np.flatnonzero(keep[begin:end]), PART)


def _around(e: _Element, elements: list[_Element], n: int) -> tuple[int, int]:
    """The lines of the article around an element, else of the page."""
    at = e.parent
    while at >= 0:
        if elements[at].name in ("article", "main"):
            return elements[at].begin, elements[at].end
        at = elements[at].parent
    return 0, n


def _chosen(lines: list[str], weight: np.ndarray, at: np.ndarray, part: float) -> str:
    """The lines ``at`` in stretches whose largest window is ``part`` of the largest one or more."""
    found = _stretches(weight[at])
    least = part * max((top for *_, top in found), default=0)
    return "\n".join(lines[at[i]] for a, b, top in found if top >= least for i in range(a, b))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; null html counts as empty, and a page without an article has empty text.

    Pages are independent: repeated rows give equal rows, an empty table an empty result.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType for f in pages.schema.fields}
    schema = T.StructType(
        [T.StructField("page_id", kinds["page_id"]), T.StructField("url", kinds["url"]), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
