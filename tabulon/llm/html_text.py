"""Main text of web pages by line-block distribution: where text surges and where it dives."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Lines of a sliding window, and the characters that make a surge (half of the page's largest window, if that is less).
WIDTH, SURGE = 3, 86
# Share of a line's characters inside links from which it counts as a menu entry.
LINKED = 0.75

# Elements of HTML by their role here.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul""".split())
SPACES = frozenset("br td th img input wbr".split()) - {"wbr"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "title"}
SKIPPED = frozenset("nav footer aside form button select option dialog menu head label fieldset audio video canvas".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SKIPPED_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promos promotion banner sidebar sidenav menu nav navbar navigation
    breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social
    related recommended recommendations comment comments commentlist disqus respond reply replies pagination pager widget widgets toolbar skip hidden""".split())
ARTICLE = frozenset(("article", "main"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b).{0,200}\Z", re.I | re.S)
# The same inside an article, where a line may also speak of copyright: a year follows.
DATED_RIGHTS = re.compile(r"\s*(?:(?:©|\(c\)|copyright\b)[\s,:]*)+(?:19|20)[0-9]{2}\b.{0,200}\Z", re.I | re.S)


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    skipped: bool  # inside a menu, footer, advert or the like
    article: int  # number of the outermost article, 0 outside


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in ATTRIBUTE.finditer(raw)}


def _skips(tag: str, raw: str, in_article: bool) -> bool:
    if tag in SKIPPED or tag == "header" and not in_article:
        return True
    if not raw.strip():
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if a.get("role", "").lower() in SKIPPED_ROLES:
        return True
    names = {x.lower() for x in NAME_PART.findall(a.get("class", "") + " " + a.get("id", ""))}
    return bool(names & SKIPPED_NAMES) or bool("header" in names and not in_article)


def page_lines(page: str) -> list[Line]:
    """The page without markup, one line per block that has text."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag; whether inside something skipped, in which article, inside a link
    where: dict[str, list[int]] = {}  # places in the stack by tag
    endless: set[str] = set()  # raw elements of which no end follows
    parts: list[str] = []
    linked = at = articles = 0

    def here() -> tuple[bool, int, bool]:
        return stack[-1][1:] if stack else (False, 0, False)

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        parts.append(text)
        if here()[2]:
            linked += len("".join(text.split()))

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, linked, *here()[:2]))
        parts.clear()
        linked = 0

    def close(tag: str, within: frozenset[str] = frozenset()) -> None:
        if not where.get(tag) or any(where.get(w) and where[w][-1] > where[tag][-1] for w in within):
            return
        for name, *_ in reversed(stack[(k := where[tag][-1]):]):
            where[name].pop()
        del stack[k:]

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>"))
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        elif tag in SPACES:
            parts.append(" ")
        if m[1]:
            close(tag)
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in CLOSES_P:
            close("p", frozenset(("table", "td", "th", "button")))
        if tag == "li":
            close("li", frozenset(("ul", "ol", "menu")))
        elif tag in ("dd", "dt"):
            close("dd", frozenset(("dl",)))
            close("dt", frozenset(("dl",)))
        elif tag == "tr":
            close("tr", frozenset(("table",)))
        elif tag == "body":
            close("head")
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            skipped, article, link = here()
            skipped = skipped or _skips(tag, m[3], bool(article))
            if tag in ARTICLE and not article:
                articles += 1
                article = articles
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, skipped, article, link or tag == "a"))
    flush()
    return lines


def surging(size: np.ndarray) -> np.ndarray:
    """Which lines lie between a surge and the dive that follows, for the weights of consecutive lines.

    The weights of WIDTH lines are added up along the page. Text begins where the sum surges, with the lines of text right
    before, and ends where it dives to nothing.
    """
    kept = np.zeros(len(size), bool)
    if not size.any():
        return kept
    sums = np.convolve(size, np.ones(WIDTH, np.int64))[WIDTH - 1:]  # of each line and those that follow
    surge = min(SURGE, sums.max() / 2)
    on = False
    for k in range(len(size)):
        if not on and sums[k] >= surge:
            on, back = True, k
            while back and size[back - 1] and not kept[back - 1]:  # a heading or short lines right before the surge
                back -= 1
            kept[back:k] = True
        elif sums[k] == 0:  # dive: no text here or in the lines that follow
            on = False
        kept[k] |= on
    return kept & (size > 0)


def main_text(page: str) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty if there is none."""
    lines = page_lines(page)
    size = np.array([0 if x.skipped or (DATED_RIGHTS if x.article else RIGHTS).match(x.text) else len(x.text) for x in lines], np.int64)
    article = np.array([x.article for x in lines], np.int64)
    if size[article > 0].sum() * 4 >= max(1, size.sum()):
        # Articles: what has no weight in them doesn't end the text, and one doesn't go on in the next.
        own = np.flatnonzero((article > 0) & (size > 0))
        place = np.arange(len(own)) + WIDTH * np.cumsum(np.diff(article[own], prepend=article[own[0]]) != 0)
        weight = np.zeros(place[-1] + 1, np.int64)
        weight[place] = size[own]
        kept = np.zeros(len(lines), bool)
        kept[own] = surging(weight)[place]
    else:
        linked = [x.linked >= LINKED * len(x.text.replace(" ", "")) for x in lines]
        kept = surging(np.where(linked, 0, size) if lines else size)
    return "\n\n".join(x.text for x, stays in zip(lines, kept) if stays)


def extract_text(pages: DataFrame, html_column: str = "html", kept: list[Column] | None = None) -> DataFrame:
    """`_kept` (a struct of the `kept` columns, by default all) and `text`, the main text of each page.

    Markup goes, a block becomes a line, character references are decoded, white space is one space. Lines of menus,
    headers, footers, sidebars, notices, adverts, forms and comments have no weight. The weights of WIDTH lines are added up
    along the page: text begins where the sum surges (or with the lines of text right before) and ends where it dives to
    nothing, and what lies between is kept. If articles hold a quarter of the weight, the page is their lines with weight,
    one article apart from the next; else lines of links have no weight either. Time is linear in the page, however its
    tags are nested or left open.
    Null and empty pages have empty text. Each row is on its own; repeated rows and nulls elsewhere stay as they are.
    """
    packed = pages.select(F.struct(*(kept or [F.col(f"`{c}`") for c in pages.columns])).alias("_kept"), F.col(html_column).alias("_html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                text = [main_text(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["_kept", "text"])

    return packed.mapInArrow(rows, T.StructType([packed.schema["_kept"], T.StructField("text", T.StringType())]))
