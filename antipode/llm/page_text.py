"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's parser streams over a page and cuts it into block lines. Each line has its
text, the number of tags around it and how much of it is link text. Page furniture named by its
element, role, class or id is left out, unless it holds an <article> or <main> or most of the page's plain text. The
text-to-tag ratio of the lines is smoothed with a Gaussian and split at a threshold into content and rest; a region runs
from its first to its last content line, so short lines inside an article stay, and reaches over lines of half the
threshold at both ends. All <article> and <main> elements with a line of plain text are kept whole; they bound the text
unless most of the page's plain text lies outside of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.llm.common import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of the page.
HIDDEN = frozenset("script style template title svg select option textarea".split())
DROPPED = frozenset(
    "head noscript iframe object canvas audio video map nav header footer aside "
    "menu form button label fieldset dialog".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html "
    "legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar".split())
#: Words of class and id names that mark furniture, whole words after cutting at marks, digits and capitals.
FURNITURE = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus feedback footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notices paywall popup promo promoted promotion related reply replies respond search share sharing sidebar "
    "signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget".split())
#: A name with one of these tells how a page is laid out (has-sidebar, no-comments).
STATES = frozenset("closed disabled enabled has is layout no not off on open supports with without".split())
#: The header or footer of one of these belongs to the text (content-header).
SUBJECTS = frozenset("article body chapter content entry main post section story text title".split())
CLOSED_BY = {"p": BLOCKS, "head": frozenset(["body"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option"])}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
SIGMA = 1.0


def _names_furniture(name: str) -> bool:
    """Whether one class or id name marks furniture."""
    words = {w.lower() for w in _NAME.findall(name)}
    marks = words & FURNITURE
    if not marks or words & STATES:
        return False
    return not (marks <= {"header", "footer"} and words & SUBJECTS)


class _Lines(HTMLParser):
    """Streaming events to block lines: [text, tags, link characters, scope, innermost furniture]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, innermost furniture (-1: hidden), scope
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parts: list[str] = []
        self.outer, self.holds = [0], [False]  # of furniture: the one around it, whether it holds an article
        self.tags = self.links = self.in_link = self.scopes = 0

    def _break(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, around, scope = self.stack[-1] if self.stack else ("", 0, 0)
            self.lines.append((text, self.tags, self.links, scope, around))
            self.tags = 0
        self.parts, self.links = [], 0

    def _furniture(self, tag: str, attrs: list) -> bool:
        if tag in DROPPED:
            return not (tag == "header" and any(t in ("article", "main") for t, _, _ in self.stack))
        if tag in ("body", "html", "article", "main"):
            return False
        for name, value in attrs:
            if name == "aria-hidden" and value == "true":
                return True
            if name == "role" and (value or "").strip().lower() in ROLES:
                return True
            if name in ("class", "id") and any(map(_names_furniture, (value or "").split())):
                return True
        return False

    def kept(self) -> list[tuple[str, int, int, int]]:
        """The lines outside of furniture. Furniture with an article or most of the plain text is none."""
        weight, holds = [0] * len(self.outer), list(self.holds)
        for text, _, links, _, around in self.lines:
            weight[around] += max(0, len(text) - links)
        for k in range(len(weight) - 1, 0, -1):  # inner ones have larger numbers
            weight[self.outer[k]] += weight[k]
            holds[self.outer[k]] |= holds[k]
        gone = [False] * len(weight)
        for k in range(1, len(weight)):
            gone[k] = gone[self.outer[k]] or not (holds[k] or 2 * weight[k] > weight[0])
        out, more = [], 0
        for text, tags, links, scope, around in self.lines:
            if gone[around]:
                more += tags
            else:
                out.append((text, tags + more, links, scope))
                more = 0
        return out

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        while self.stack and tag in CLOSED_BY.get(self.stack[-1][0], ()):
            self._pop()
        if tag in BLOCKS and tag not in ("html", "body"):
            # an unclosed <p> ends at the next block, with the inline elements open in it
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name == "p":
                    while len(self.stack) > i:
                        self._pop()
                    break
                if name in BLOCKS:
                    break
        around, scope = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, 0)
        if tag in BLOCKS:
            self._break()
        elif tag in ("br", "wbr"):
            if tag == "br" and around >= 0:
                self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ("article", "main") and around >= 0:
            self.holds[around] = True
            if not scope:
                self.scopes += 1
                scope = self.scopes
        if around >= 0:
            if tag in HIDDEN or any(name == "hidden" for name, _ in attrs):
                self._break()
                around = -1
            elif self._furniture(tag, attrs):
                self._break()
                self.outer.append(around)
                self.holds.append(False)
                around = len(self.outer) - 1
        self.stack.append((tag, around, scope))
        self.in_link += tag == "a"

    def _pop(self) -> None:
        tag, around, _ = self.stack[-1]
        if tag in BLOCKS or around != (self.stack[-2][1] if len(self.stack) > 1 else 0):
            self._break()
        self.stack.pop()
        self.in_link -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID or not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1] < 0:
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data)


def page_lines(html: str) -> list[tuple[str, int, int, int]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._break()
    return parser.kept()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, weights renormalised at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty if there is none."""
    lines = page_lines(html or "")
    if not lines:
        return ""
    length = np.array([len(x[0]) for x in lines], float)
    plain = length - np.array([min(x[2], len(x[0])) for x in lines], float)
    level = smoothed(plain / np.maximum(1, np.array([x[1] for x in lines], float)))
    # two clusters of lines, cut at the spread of the smoothed ratios
    cut = min(float(level.std()), float(level.mean()))
    text = plain > 0.5 * length
    if not text.any():
        return ""
    content = (level >= cut) & text
    if not content.any():
        content = text
    scopes = np.array([x[3] for x in lines])
    # whole articles, each that holds plain text
    keep = np.isin(scopes, np.unique(scopes[text & (scopes > 0)]))
    if 2 * plain[keep].sum() <= plain.sum() or not (content & keep).any():
        first, last = np.flatnonzero(content)[[0, -1]]
        while first > 0 and text[first - 1] and level[first - 1] >= 0.5 * cut:
            first -= 1
        while last < len(lines) - 1 and text[last + 1] and level[last + 1] >= 0.5 * cut:
            last += 1
        # link blocks go in runs, as lists of links; one alone between lines of text is part of it
        beside = np.concatenate([[False], text, [False]])
        inside = np.arange(len(lines))
        keep |= (inside >= first) & (inside <= last) & (text | (beside[:-2] & beside[2:]))
    return "\n\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  keep: list[str] | None = None) -> DataFrame:
    """(id, ``keep`` columns, text, n_chars) per page. A null or empty page has an empty text."""
    keep = keep or []
    fields = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [id_col, *keep])

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            texts = [main_text(h) for h in cols["_html"].to_pylist()]
            yield {id_col: cols[id_col], **{c: cols[c] for c in keep}, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages.select(id_col, *keep, F.col(html_col).alias("_html")),
                    schema + ", text string, n_chars long", work)
