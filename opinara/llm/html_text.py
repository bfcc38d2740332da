"""Main text of web pages by the line-block distribution.

Markup is stripped so that every block element is a line. Page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts, styles) leaves ``WINDOW`` lines without
text. The block at a line is the weight of the lines in a window that starts there. A surge is a line
with text whose block reaches the threshold while the one before lay in a dip; a dive is where the
block falls to nothing. Lines between a surge and the dive that follows are the main text.

A line weighs its text length, nothing if it is hardly more than links. Where a page marks an article,
each character in it weighs ``INSIDE``, so that one is a surge, and one outside weighs ``OUTSIDE``. The
threshold is ``SURGE``, or half of the page's heaviest block where that is less: a short page keeps
its text. Once blocks have surged in a container, its other lines need one character, so a short
paragraph after an advert stays.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
a line feed. Null, empty and text-free pages, and those of links only, give an empty text. Pages cut
off in a tag or comment keep what comes before it. Repeated rows and null ids are extracted one by
one; of very long pages the whole is read, one page at a time, in some ten times its size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opinara.llm import textvec as tv

WINDOW = 3
SURGE = 86
INSIDE, OUTSIDE = SURGE, 0.25  # weight of a character in and outside a marked article
LINKS = 0.8  # share of a line's text in links from which it weighs nothing

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z]+")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th img".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Their content is no markup: only the own end tag counts there.
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}
EMBEDDED = frozenset("noscript template svg object canvas math".split())
FURNITURE = frozenset(
    "head nav header footer aside form menu dialog button select textarea fieldset".split()
)
# Blocks of running text: their container is the element around them.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption".split())
CONTENT = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar "
    "header footer masthead colophon contentinfo sidebar aside complementary widget related "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social comment comments disqus respond replies".split()
)
# Parts that may stand beside such a word in one name, as in "site-footer" and "related-posts".
PLACES = frozenset(
    "site page main top bottom left right global primary secondary bar box wrap wrapper container "
    "area inner outer link links list items thread posts articles stories button buttons".split()
)
HEAD_ONLY = frozenset("title base basefont bgsound link meta style script noscript template noframes object".split())
# Open elements that a start tag ends, and those that keep it from ending any further out.
ENDED_BY_BLOCK = frozenset(BLOCKS - {"body", "caption", "html", "legend", "li", "option", "optgroup"}
                           - {"dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr"})
CELLS = ("td", "th")
ROWS = ("tr", *CELLS)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (CELLS, ("tr", "table")),
    "th": (CELLS, ("tr", "table")),
    "tr": (ROWS, ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", *ROWS), ("table",))),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    **dict.fromkeys(ENDED_BY_BLOCK, (("p",), ("button", "caption", "object", "table", *CELLS))),
}
FENCES = ("caption", "object", "table", "template", *CELLS)
TABLE_PARTS = frozenset("caption table tbody tfoot thead tr td th html body".split())


def is_named_furniture(attributes: str) -> bool:
    """Whether a name in class, id or role is one of page furniture, alone or with its place."""
    for value in NAMED.findall(attributes):
        for name in value.lower().strip("\"'").split():
            parts = NAME_PART.findall(name)
            if any(p in FURNITURE_NAMES for p in parts) and all(
                p in FURNITURE_NAMES or p in PLACES for p in parts
            ):
                return True
    return False


def is_furniture(tag: str, attributes: str) -> bool:
    """Whether an element is page furniture by its name or by its class, id or role."""
    if tag in FURNITURE or tag in EMBEDDED:
        return True
    if tag in CONTENT or not attributes:
        return False
    return is_named_furniture(attributes)


def raw_end(page: str, tag: str, at: int) -> int:
    """Where the content of a raw element that starts at ``at`` and its end tag end."""
    m = RAW_END[tag].search(page, at)
    return m.end() if m else len(page)


def opens(tag: str, attributes: str) -> bool:
    return tag not in VOID and not SELF_CLOSED.search(attributes)


@dataclass
class Tag:
    """A tag or comment (no name); raw elements are one tag with their content and no name."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""
    # Of a start tag: the first tag after the element, and whether that is past its own end tag.
    after: int = 0
    closed: bool = False
    title: bool = False  # holds h1 or main
    article: bool = False  # holds an article that is not named as furniture
    furniture: bool = False
    container: int = -1  # the tag whose text the element's own lines belong to


@dataclass
class Line:
    """A stripped line; ``linked`` of its characters lie in links. Gaps hold no text."""

    text: str = ""
    linked: int = 0
    inside: bool = False
    container: int = -1


def tags(page: str) -> list[Tag]:
    """Tags and comments of a page, none from the content of raw elements."""
    out, at = [], 0
    while m := TAG.search(page, at):
        at = m.end()
        name, attributes = (m.group(2) or "").lower(), m.group(3) or ""
        if name in RAW:
            if not m.group(1) and opens(name, attributes):
                at = raw_end(page, name, at)
            name = ""
        out.append(Tag(m.start(), at, name, bool(m.group(1)), attributes))
    return out


def nest(found: list[Tag]) -> None:
    """Set where the elements end: at their end tag, or where a parent or a sibling ends them."""
    stack: list[Tag] = []
    places: dict[str, list[int]] = {}  # of a name, places in the stack

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def end(place: int, after: int) -> None:
        while len(stack) > place:
            x = stack.pop()
            places[x.name].pop()
            x.after = after
            if stack:
                stack[-1].title |= x.title or x.name in ("h1", "main")
                stack[-1].article |= x.article or (
                    x.name == "article" and not is_named_furniture(x.attributes)
                )

    for i, t in enumerate(found):
        if not t.name:
            continue
        if not t.closing:
            if places.get("head") and t.name not in HEAD_ONLY and last(("head",)) >= last(EMBEDDED):
                end(last(("head",)), i)
            names, fences = ENDS.get(t.name, ((), ()))
            place = last(names) if names else -1
            if place >= 0 and place > last(fences):
                end(place, i)
            if opens(t.name, t.attributes):
                t.container = i
                if t.name not in BLOCKS or t.name in RUNNING:
                    t.container = stack[-1].container if stack else -1
                t.furniture = is_furniture(t.name, t.attributes)
                places.setdefault(t.name, []).append(len(stack))
                stack.append(t)
        elif places.get(t.name):
            place = places[t.name][-1]
            inner = t.name not in TABLE_PARTS and place < last(FENCES)
            inline = t.name not in BLOCKS and not stack[place].furniture
            if inner or inline and place < last(BLOCKS):
                continue
            stack[place].closed = True
            end(place + 1, i)
            end(place, i + 1)
    end(0, len(found))


def lines(page: str) -> tuple[list[Line], bool]:
    """Stripped lines of a page outside furniture; whether it marks an article.

    Furniture that holds an h1 or main is no furniture, nor is what holds an article if no article
    stands outside furniture (teasers and comments are often marked as articles).
    """
    out: list[Line] = []
    text: list[str] = []
    found = tags(page)
    nest(found)
    i, alone = 0, True
    while i < len(found):
        t = found[i]
        if t.name == "article" and not t.closing and not is_named_furniture(t.attributes):
            alone = False
            break
        i = t.after if t.furniture and not t.title else i + 1
    at = i = article = linked = link = 0
    marked = False
    around: list[Tag] = []  # open blocks

    def take(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if i < link:
            linked += len("".join(html.unescape(piece).split()))

    def flush() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append(Line(line, linked, article > 0, around[-1].container if around else -1))
        linked = 0

    def gap() -> None:
        out.extend(Line() for _ in range(WINDOW))

    while i < len(found):
        t = found[i]
        take(page[at : t.start])
        at, i = t.end, i + 1
        if t.name == "a" and not t.closing:
            link = t.after + (not t.closed)
        if t.furniture and not t.title and not (t.article and alone):
            if t.name in BLOCKS or t.name in FURNITURE:
                flush()
                gap()
            i = t.after
            if t.closed:
                at = found[i - 1].end
            else:
                at = found[i].start if i < len(found) else len(page)
        elif t.name in BLOCKS:
            flush()
            while around and around[-1].after <= i:
                around.pop()
            if not t.closing and t.after > i:
                around.append(t)
            if t.name in ("article", "main"):
                marked = True
                article = max(0, article + (-1 if t.closing else 1))
                gap()
        elif t.name in SPACED:
            text.append(" ")
    take(page[at:])
    flush()
    return out, marked


def weights(found: list[Line], marked: bool) -> np.ndarray:
    """How much each line counts for the main text."""
    size = np.array([len(x.text) for x in found], float)
    if marked:
        return size * np.array([INSIDE if x.inside else OUTSIDE for x in found], float)
    letters = np.array([len(x.text) - x.text.count(" ") for x in found])
    linked = np.array([x.linked for x in found])
    return np.where(linked >= LINKS * np.maximum(letters, 1), 0.0, size)


def chosen(block: np.ndarray, text: np.ndarray, surge: np.ndarray) -> np.ndarray:
    """The lines with text between each surge and the dive that follows it."""
    kept, on = np.zeros(len(block), bool), False
    for i in range(len(block)):
        if not on and text[i] and block[i] >= surge[i]:
            on = True
        elif on and block[i] == 0 and not text[i]:
            on = False
        kept[i] = on and text[i]
    return kept


def main_text(page: str | None) -> str:
    """Lines between the surge and dive points of the line-block distribution."""
    if not page:
        return ""
    found, marked = lines(page)
    weight = weights(found, marked)
    if not weight.sum():
        return ""
    total = np.concatenate([[0.0], np.cumsum(weight)])
    begin = np.arange(len(weight))
    block = total[np.minimum(begin + WINDOW, len(weight))] - total[begin]
    text = np.array([bool(x.text) for x in found])
    # Lines of links alone start nothing.
    surge = np.where(weight > 0, min(SURGE, block.max() / 2), np.inf)
    kept = chosen(block, text, surge)
    held = {x.container for x, k in zip(found, kept, strict=True) if k}
    known = np.array([x.container in held for x in found])
    kept = chosen(block, text, np.where(known & (weight > 0), 0, surge))
    return "\n".join(x.text for x, k in zip(found, kept, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "html", 1 << 20):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    part.column(1).cast(pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
