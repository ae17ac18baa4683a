"""Main text of web pages by line-block distribution.

Markup is stripped and every block element begins a line. Each line has a weight: its text without links, lowered where
tags, classes, ids or roles say menu, header, footer, side bar, notice, advert, form or comment. The weights of a sliding
window of lines are summed; where the sum rises to LEVEL the text surges, where it falls below it dives, and what lies
between is the text. That is done twice: the element that holds the first regions (an article, if there is one) raises the
weight of its lines, so that short ones at its edges stay, and lowers that of all others; the second regions are the result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, and the sum of weights at which the text surges and below which it dives.
SPAN, LEVEL = 3, 40
#: What a line inside the element that holds the text gains, the share of a line's weight outside of it, the share where a
#: mark says that it is no text, and the share of the heaviest region that another must weigh.
GAIN, OUTSIDE, MARKED, REGION = 40, 0.1, 0.02, 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key ends an open element of these kinds (end tags that may be left out).
_BLOCK_IN_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SKIP = frozenset("head nav footer aside form button menu dialog audio video canvas".split())
_MAIN = frozenset(("article", "main"))
#: Words of a class, id or role that mark what is not the article, and words that say nothing beside them.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar side aside footer foot header masthead topbar notice notices "
    "cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus "
    "respond reply replies breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer search complementary contentinfo form".split()
)
_PLAIN = frozenset(
    "area bar block body bottom box button buttons card col column container content group icons inner item items left link links list main middle module page panel post posts primary "
    "right row secondary section site slot stories text thread title top unit wrap wrapper".split()
)
_NOT_MARKS = ("has-", "with-", "no-", "is-", "has_", "with_", "no_")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def _marked(name: str, attr: str, in_main: bool) -> bool:
    """Whether an element's kind, class, id or role marks it as no text; a word of several parts only if each of them is
    a mark or plain, so that `side-effects` is none."""
    if name in _SKIP or name == "header" and not in_main:
        return True
    if not attr or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTR.findall(attr):
        key = key.lower()
        if key in ("class", "id", "role"):
            for word in "".join(values).lower().split():
                if word in _MARKS:
                    return True
                parts = set(re.split(r"[-_:]+", word))
                if name != "article" and not word.startswith(_NOT_MARKS) and parts & _MARKS and parts <= _MARKS | _PLAIN:
                    return True
        elif key == "aria-hidden" and "".join(values).lower() == "true":
            return True
    return name != "article" and bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _QUOTED.sub("", attr), re.I))


class Page:
    """lines: (text, length without links, element) of each block in page order. Elements are numbered in the order in
    which they begin; 0 is the page. parent, last: an element's parent and the last element inside it; main: the innermost
    article or main element round it, 0 if none; marked: whether it or one round it is marked. Time and memory are linear."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, int]] = []
        self.parent, self.last, self.main, self.marked = [0], [0], [0], [False]
        names: list[str] = [""]
        stack: list[int] = [0]
        open_: Counter[str] = Counter()
        said: list[str] = []
        linked = at = 0
        in_link = False
        lower = html.lower()
        closing: dict[str, int] = {}

        def line() -> None:
            nonlocal linked
            text = " ".join("".join(said).split())
            if text:
                self.lines.append((text, max(0, len(text) - linked), stack[-1]))
            said.clear()
            linked = 0

        def hear(raw: str) -> None:
            nonlocal linked
            if raw:
                text = entities.unescape(raw)
                said.append(text)
                if in_link:
                    linked += len(text.strip())

        def close(name: str) -> None:
            """Ends elements up to the innermost of this name, which is open."""
            while True:
                n = stack.pop()
                self.last[n] = len(self.parent) - 1
                open_[names[n]] -= 1
                if names[n] == name:
                    return

        for m in _TOKEN.finditer(html):
            hear(html[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                if m["raw"]:
                    said.append(" ")
                continue
            ends, attr = bool(m["end"] or m["end2"]), m["attr"] or m["attr2"] or ""
            if name == "br":
                said.append(" ")
            if ends:
                if name == "a":
                    in_link = False
                if name not in _INLINE or open_[name]:
                    line()
                if open_[name]:
                    close(name)
                continue
            inline = name in _INLINE
            mark = _marked(name, attr, bool(self.main[stack[-1]]))
            if mark:  # one that is never closed marks nothing
                if name not in closing:
                    closing[name] = lower.rfind(f"</{name}")
                mark = closing[name] >= at
            if name == "a":
                in_link = True
            if not inline or mark:
                line()
            if name in _VOID or inline and (not mark or attr.endswith("/")):
                continue
            if name in _BLOCK_IN_P and open_["p"]:
                close("p")
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and names[stack[-1]] == name:
                close(name)
            number, top = len(self.parent), stack[-1]
            self.parent.append(top)
            self.last.append(number)
            self.main.append(number if name in _MAIN and not mark else self.main[top])
            self.marked.append(mark or self.marked[top])
            names.append(name)
            open_[name] += 1
            stack.append(number)
        hear(html[at:])
        line()
        for n in stack:
            self.last[n] = len(self.parent) - 1


def regions(weight: list[float], level: float) -> list[tuple[int, int]]:
    """(surge, dive) of each run of windows of SPAN lines whose weights sum to level: first and last line of it, of which
    either bears its part of a window."""
    sums = [sum(weight[i : i + SPAN]) for i in range(len(weight))]
    out, i = [], 0
    while i < len(sums):
        if sums[i] < level:
            i += 1
            continue
        surge = i
        while i < len(sums) and sums[i] >= level:
            i += 1
        dive = min(i - 1 + SPAN - 1, len(weight) - 1)
        while surge < dive and weight[surge] * SPAN < level:
            surge += 1
        while dive > surge and weight[dive] * SPAN < level:
            dive -= 1
        if out and surge <= out[-1][1]:
            surge = out.pop()[0]
        out.append((surge, dive))
    return out


def _heavy(weight: list[float]) -> list[tuple[int, int]]:
    """The regions that weigh a share of the heaviest; of a page without so much text, those of its own greatest sum."""
    peak = max((sum(weight[i : i + SPAN]) for i in range(len(weight))), default=0)
    found = [(sum(weight[a : b + 1]), a, b) for a, b in regions(weight, min(LEVEL, peak))] if peak > 0 else []
    most = max((w for w, _, _ in found), default=0)
    return [(a, b) for w, a, b in found if w >= REGION * most]


def main_text(html: str | None) -> str:
    """Blocks of the article, white space made single, joined by two line feeds; '' if there are none."""
    page = Page(html or "")
    lines, marked = page.lines, page.marked
    if all(marked[n] for _, _, n in lines):  # all there is
        marked = [False] * len(marked)
    size = [n for _, n, _ in lines]
    if not any(n for n, (_, _, e) in zip(size, lines, strict=True) if not marked[e]):  # links only: they are all there is
        size = [len(text) for text, _, _ in lines]
    weight = [n * (MARKED if marked[e] else 1) for n, (_, _, e) in zip(size, lines, strict=True)]
    found = _heavy(weight)
    if not found:
        return ""
    # the element that holds the regions: the article of the heaviest lines, or else what is round all of them
    held: Counter[int] = Counter()
    for a, b in found:
        for i in range(a, b + 1):
            held[page.main[lines[i][2]]] += weight[i]
    holder = max((m for m in held if m), key=lambda m: (held[m], -m), default=0)
    if not holder:
        inside = [page.parent[lines[i][2]] for a, b in found for i in range(a, b + 1) if not marked[lines[i][2]]] or [0]
        low, high, holder = min(inside), max(inside), min(inside)
        while holder and not (holder <= low and high <= page.last[holder]):
            holder = page.parent[holder]
    final = []
    for w, (_, _, e) in zip(weight, lines, strict=True):
        within = holder <= e <= page.last[holder]
        final.append((w + (0 if marked[e] else GAIN)) if within else w * OUTSIDE)
    least = min(GAIN, max(final))
    return "\n\n".join(lines[i][0] for a, b in _heavy(final) for i in range(a, b + 1) if final[i] >= least)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html, any more columns).

    text holds the blocks of the article (see main_text), n_chars its code points. Null, empty and text-free html gives
    an empty text; markup that is cut off or not closed hides nothing but itself; plain text without tags is one block.
    A page takes time and memory in proportion to its length, however deep its elements nest. Rows that repeat give equal
    rows, nulls in page_id and url stay, and no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.record_batch({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
