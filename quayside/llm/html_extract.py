"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element is a line of text. Each line counts with its length; lines of menus, headers,
footers, sidebars, adverts, notices, forms and comments (told by element or by class, id and role), and lines outside
articles that are links for the most part, count nothing. The lengths are summed over sliding windows of lines. Where the sums
surge from nothing a stretch of text begins, where they dive to nothing it ends; this is done for every page, and a stretch that crosses the
border of a marked article (``article``, ``main`` or the role) is cut there. The stretch with the most text is the main one,
where text of a marked article weighs ``IN_ARTICLE`` times. The text is the main stretch and all stretches in keeping with it: their
fullest window holds ``IN_KEEPING`` of the usual window of the main one, or, if both are in a marked article, that part of it divided by
``IN_ARTICLE``. If the main one is in a marked article, all stretches of that article are text, and stretches outside articles are not.
Inside an article a line goes by the name of its element only if that is an advert, notice, form or the like as a whole: each
part of the name says so or says nothing (``ad-box``), while ``price-alert`` is text.

A marked article inside an element named as boilerplate, a form or a header is read, but weighs as other text; one inside a menu,
``aside``, footer or hidden element is not.

Defined cases: a null page has the empty text, as have pages without text; repeated rows are treated alike; pages of any length
are read whole; unclosed and stray tags are taken as browsers do, roughly; an empty table gives an empty result; extra
columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
#: Elements of HTML by what they do to the text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav aside footer menu dialog button fieldset head".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph, and elements whose end tag closes what is open inside.
CLOSES_P = BLOCK - {"body", "html", "head"}
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Names of areas of a page; only as a whole class, id or role, since with-sidebar or entry-header name no such area.
_HEAD = re.compile(r"(?:(?:site|global|main|top)[_-])?(?:header|masthead|banner)", re.I)
_AREA = re.compile(
    r"(?:(?:site|global|main|primary|secondary|left|right|top|bottom|footer|header)[_-])?"
    r"(?:breadcrumbs?|footer|menu|nav|navbar|navigation|pagination|pager|related|search|sidebar|tags?|toolbar|topbar|widget|complementary|contentinfo)"
    r"(?:[_-](?:left|right|top|bottom|links?|menu|posts?|stories|articles|list|items?|box|form|area|\d+))*",
    re.I,
)
#: Names of what is not the text wherever it stands; also as parts of a class, id or role.
_BOILERPLATE = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adbox|comments?|respond|disqus|consent|cookie\w*|gdpr|"
    r"modal|newsletter|notice|notification|popup|privacy|promo\w*|"
    r"share|sharing|signup|skip|social|sponsor\w*|subscribe|subscription|alert)(?:$|[_-])",
    re.I,
)
#: The same words, and those that say nothing beside them; in an article a name must consist of such parts.
_WORD = re.compile(_BOILERPLATE.pattern[len("(?:^|[_-])") : -len("(?:$|[_-])")], re.I)
_BESIDE = re.compile(r"(?:box|container|wrapper?|inner|outer|section|area|list|banner|bar|block|form|buttons?|links?|thread|reply|policy|content|item|slot|unit|\d+)", re.I)
#: What a class says about the state of an element is not its name.
_STATE = re.compile(r"(?:with|without|has|have|no|is|show|hide)[_-]", re.I)
_ARTICLE = re.compile(r"\brole\s*=\s*[\"']?(?:main|article)\b", re.I)
_ARTICLE_ROLE = re.compile(r"\brole\s*=\s*[\"']?article\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: How much more text of a marked article weighs, and which part of the main stretch's usual window others must reach.
IN_ARTICLE, IN_KEEPING = 10, 0.25
#: How firmly an element is no text: a heading in an article is text below NAMED_HEAD, an article below both that and NAMED, nothing below FIRM.
NAMED_HEAD, NAMED, FIRM = 1, 2, 3


@dataclass
class Line:
    text: str
    weight: int  # characters that count
    article: int  # number of the marked article it is in, 0 for none


def _firmness(name: str, attributes: str, inside: bool) -> int:
    """0 for an element that may hold text, else how firmly it does not; ``inside``: in an article."""
    if name in ASIDE or (attributes and _HIDDEN.search(attributes)):
        return FIRM
    if name == "form" or (name == "header" and not inside):
        return NAMED
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    names = [x for value in _NAMES.findall(attributes) for x in value.strip("\"'").split() if not _STATE.match(x)]
    if any(_AREA.fullmatch(x) or (_wholly(x) if inside else _BOILERPLATE.search(x)) for x in names):
        return NAMED
    return NAMED_HEAD if any(_HEAD.fullmatch(x) for x in names) else 0


def _wholly(name: str) -> bool:
    parts = re.split("[_-]+", name.strip("_-"))
    return any(map(_WORD.fullmatch, parts)) and all(_WORD.fullmatch(x) or _BESIDE.fullmatch(x) for x in parts)


def lines(page: str) -> list[Line]:
    """The blocks of a page as lines, in page order."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0  # characters in links
    # element, and for all down to it: firmness, in an article, number of the marked one (less than 0 for main areas), open links
    stack: list[tuple[str, int, bool, int, int]] = []
    root = ("", 0, False, 0, 0)
    n_marked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, firm, inside, marked, _ = stack[-1] if stack else root
            counts = not firm and (inside or 2 * linked <= len(text))
            out.append(Line(text, len(text) if counts else 0, marked))
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        raw = page[at : m.start()]
        at = m.end()
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            linked += len(text.strip()) if stack and stack[-1][4] else 0
        name = m[3]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCK
        if block:
            flush()
        elif name == "br":  # white space of its block
            parts.append(" ")
        if m[2]:  # end tag: closes down to its own element, but nothing beyond an article or table around it
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
                if block is False and stack[depth][0] in BLOCK:
                    break
            continue
        if name in VOID or m[4].rstrip().endswith("/"):
            continue
        if name in CLOSES_P and stack:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCK:
                    break
        if name in ("li", "td", "tr", "th", "dd", "dt", "option") and stack and stack[-1][0] == name:
            stack.pop()
        _, firm, inside, marked, links = stack[-1] if stack else root
        own = _firmness(name, m[4], inside)
        if name in ("article", "main") or _ARTICLE.search(m[4]):
            whole = name == "article" or _ARTICLE_ROLE.search(m[4]) is not None
            if firm == 0 and (marked == 0 or (whole and marked < 0)):  # an article in a main area is an article of its own
                n_marked += 1
                marked = n_marked if whole else -n_marked
            firm = firm if firm == FIRM else own if own == FIRM else 0
            inside = True
        elif name in HEADINGS and inside and firm == NAMED_HEAD:
            firm = own
        else:
            firm = max(firm, own)
        stack.append((name, firm, inside, marked, links + (name == "a")))
    parts.append(html.unescape(page[at:]))
    flush()
    return out


def stretches(weights: np.ndarray, window: int = 3) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between each surge and the dive behind it. The sum at line i is over the lines i .. i + window - 1."""
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(window, dtype=np.int64))[window - 1 :]
    here = np.concatenate([[0], sums > 0, [0]]).astype(np.int8)
    surges, dives = np.flatnonzero(np.diff(here) == 1), np.flatnonzero(np.diff(here) == -1)
    out = []
    for a, b in zip(surges, dives):
        full = np.flatnonzero(weights[a : min(b + window - 1, len(weights))])
        out.append((int(a + full[0]), int(a + full[-1]) + 1))
    return out


def main_text(page: str | None, window: int = 3) -> str:
    found = lines(page or "")
    weights = np.array([x.weight for x in found], dtype=np.int64)
    places = []
    for first, last in stretches(weights, window):
        full = [i for i in range(first, last) if found[i].weight]
        cuts = [j for i, j in zip(full, full[1:]) if found[i].article != found[j].article]
        places += [(a, b) for a, b in zip([first, *cuts], [*cuts, last])]
    if not places:
        return ""

    def sums(p: tuple[int, int]) -> np.ndarray:
        return np.convolve(weights[p[0] : p[1]], np.ones(min(window, p[1] - p[0]), dtype=np.int64), "valid")

    main = max(places, key=lambda p: (int(weights[p[0] : p[1]].sum()) * (IN_ARTICLE if found[p[0]].article else 1), -p[0]))
    marked = found[main[0]].article
    least = IN_KEEPING * float(np.median(sums(main))) / (IN_ARTICLE if marked else 1)

    def stays(p: tuple[int, int]) -> bool:
        if p == main or (marked and found[p[0]].article == marked):
            return True
        return bool((found[p[0]].article or not marked) and sums(p).max() >= least)

    kept = [p for p in places if stays(p)]
    return "\n".join(x.text for first, last in kept for x in found[first:last] if x.weight)


def extract(pages: DataFrame, window: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, window) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
