"""Main text of web pages from the line-block distribution.

Markup is stripped to one line per block, and with it the elements that are not the article by their kind
or by their class or id.  A line weighs its text without that of links; where a page names its article, lines inside weigh
more and lines outside less.  Weights are summed over a sliding window of lines.  The text lies between a surge, where
the sum leaves the threshold, and the dive after which it stays below, from the first surge to the last dive; what is
short or linked between them belongs to it.

Pages are read in one pass, in time proportional to their length however they are broken.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Weight that a window needs, and its share of the greatest one that is enough.
THRESHOLD, SHARE = 50, 0.5
#: Weight of a character inside the article that a page names, and outside of it.
INSIDE, OUTSIDE = 8.0, 0.125

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption legend".split())
RAW = frozenset("script style textarea title noframes noembed iframe xmp".split())
DROPPED = frozenset("head nav footer aside form menu button select noscript template svg math object audio video canvas dialog input datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr copyright "
    "footer header masthead menu menus nav navbar navigation newsletter notice notices notification alert paywall popup modal overlay promo promotion promoted recommended "
    "related replies reply responses share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar topbar widget login signup search "
    "complementary contentinfo".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*").match
_SPECIAL = re.compile("[>\"']").search
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+").split
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])").sub


class Token(NamedTuple):
    """A tag, or a text if ``name`` is empty."""
    name: str
    closing: bool
    body: str


class _Finder:
    """``str.find`` in a page that remembers from where on a mark is absent, so that no stretch is searched in vain twice."""

    def __init__(self, page: str) -> None:
        self.page, self.absent, self.quotes = page, {}, True

    def __call__(self, mark: str, start: int) -> int:
        none_from = self.absent.get(mark, len(self.page))
        if start >= none_from:
            return -1
        place = self.page.find(mark, start, min(none_from + len(mark) - 1, len(self.page)))
        if place < 0:
            self.absent[mark] = start
        return place


def _tag_end(page: str, start: int, find: _Finder) -> int:
    """Place of the ``>`` that ends a tag whose attributes start at ``start``, outside quotes; -1 if there is none.

    Where quotes leave a tag without an end they count no longer, for it and all that follow.
    """
    at = start
    while find.quotes:
        special = _SPECIAL(page, at)
        if special is not None and special[0] == ">":
            return special.start()
        close = find(special[0], special.end()) if special is not None else -1
        if close < 0:
            find.quotes = False
        at = close + 1
    return find(">", start)


def tokens(page: str) -> list[Token]:
    """Texts and tags in order; comments, declarations and the content of raw elements are left out."""
    out, shown, at, find = [], 0, 0, _Finder(page)
    while (at := page.find("<", at)) >= 0:
        closing = page.startswith("/", at + 1)
        name, end = _NAME(page, at + 1 + closing), -1
        if page.startswith("<!--", at):
            end = find("-->", at + 4)
            end = end + 2 if end >= 0 else len(page) - 1
        elif page.startswith("<![CDATA[", at):
            end = find("]]>", at + 9)
            end = end + 2 if end >= 0 else find(">", at + 9)
        elif name:
            end = _tag_end(page, name.end(), find)
        elif closing or page[at + 1:at + 2] in ("!", "?"):
            end = find(">", at + 2 + closing)
        if end < 0:
            at += 1
            if find(">", at) < 0:  # no tag can end any more, but a comment may begin
                at = page.find("<!--", at)
                if at < 0:
                    break
            continue
        if at > shown:
            out.append(Token("", False, page[shown:at]))
        at = shown = end + 1
        if name:
            token = Token(name[0].lower(), closing, page[name.end():end])
            out.append(token)
            if token.name in RAW and not closing:
                close = re.compile(rf"</{re.escape(token.name)}\s*>", re.I).search(page, at)
                at = shown = close.end() if close else len(page)
                out.append(Token(token.name, True, ""))
    if shown < len(page):
        out.append(Token("", False, page[shown:]))
    return out


def marked(token: Token) -> bool:
    """Whether attributes say that an element is no part of the article."""
    if "=" not in token.body and "hidden" not in token.body:
        return False
    for name, value in _ATTRIBUTE.findall(token.body):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id", "role") and MARKS.intersection(_SPLIT(_CAMEL("-", value).lower())):
            return True
    return False


def element_ends(all_tokens: list[Token]) -> list[int | None]:
    """For every opening tag the place after its element, None if nothing closes it; a paragraph ends before the next block."""
    ends: list[int | None] = [None] * len(all_tokens)
    opened: dict[str, list[int]] = {}
    paragraphs: list[int] = []
    for i, token in enumerate(all_tokens):
        if token.name in BLOCKS:
            for k in paragraphs:
                ends[k] = i + 1 if token.name == "p" and token.closing else i
            paragraphs = []
        if token.name == "p":
            paragraphs += [] if token.closing else [i]
        elif token.name:
            stack = opened.setdefault(token.name, [])
            if not token.closing:
                stack.append(i)
            elif stack:
                ends[stack.pop()] = i + 1
    return ends


class Line(NamedTuple):
    text: str
    linked: int
    dropped: bool
    inside: bool


def lines_of(page: str) -> list[Line]:
    """One line per block with text: the text, how much of it is links, whether it is dropped, whether it is in the article."""
    all_tokens = tokens(page)
    named = [i for i, t in enumerate(all_tokens) if t.name in ("article", "main") and not t.closing and not marked(t)]
    ends = element_ends(all_tokens)
    drop_until, article_until, link_depth, lines, parts, linked = 0, 0, 0, [], [], 0
    dropped = inside = False

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, linked, dropped, inside))
        parts, linked = [], 0

    for i, token in enumerate(all_tokens):
        if not token.name:
            text = html.unescape(token.body) if "&" in token.body else token.body
            parts.append(text)
            linked += len(text.strip()) if link_depth else 0
            continue
        now_dropped, now_inside = i < drop_until, i < article_until
        if not token.closing and not now_dropped and token.name not in VOID:
            by_kind = token.name in DROPPED or token.name == "header" and not now_inside
            if by_kind or token.name not in ("html", "body") and marked(token):
                end, after = ends[i], bisect_right(named, i)
                if end is not None and not (after < len(named) and named[after] < end):
                    drop_until, now_dropped = end, True
        if token.name in ("article", "main") and not token.closing and not now_dropped and not now_inside:
            article_until, now_inside = ends[i] or len(all_tokens), True
        if token.name in BLOCKS or now_dropped != dropped or now_inside != inside:
            flush()
            if token.name in BLOCKS:
                link_depth = 0
        elif token.name == "br":
            parts.append(" ")
        dropped, inside = now_dropped, now_inside
        if token.name == "a":
            link_depth = 0 if token.closing else 1
    flush()
    return lines


def between_surge_and_dive(weights: list[float], threshold: float, widest: bool) -> tuple[int, int]:
    """First and past-the-last line of the text: the stretch with most text, or from the first to the last stretch if ``widest``."""
    sums = [sum(weights[i:i + WINDOW]) for i in range(len(weights))]
    stretches, i = [], 0
    while i < len(sums):
        if sums[i] > threshold:
            surge = i
            while i < len(sums) and sums[i] > threshold:
                i += 1
            dive = min(i + WINDOW - 1, len(weights))
            kept = [k for k in range(surge, dive) if weights[k] > 0]
            if kept:
                stretches.append((kept[0], kept[-1] + 1))
        else:
            i += 1
    if not stretches:
        return 0, 0
    if widest:
        return stretches[0][0], stretches[-1][1]
    return max(stretches, key=lambda s: sum(weights[s[0]:s[1]]))


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by an empty line; empty if there is none."""
    lines = [line for line in lines_of(page) if not line.dropped] if page else []
    named = any(line.inside for line in lines)
    weights = [INSIDE * len(line.text) if line.inside else (OUTSIDE if named else 1.0) * max(0, len(line.text) - line.linked) for line in lines]
    greatest = max((sum(weights[i:i + WINDOW]) for i in range(len(weights))), default=0)
    start, end = between_surge_and_dive(weights, min(THRESHOLD, SHARE * greatest), True)
    return "\n\n".join([line.text for line in lines[start:end]])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages`` (page_id, url, html).

    A null or empty html has the empty text; other columns are ignored; null and repeated ids pass
    through; rows are independent, so there is no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.html_text import main_text

        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
