"""Main text of web pages by line-block distribution (operator 4).

The markup is stripped into lines, one for each block element.  Regions that
never hold article text (navigation, headers and footers of the page, sidebars,
forms, scripts, adverts, notices, comments of readers) leave lines of no length.
The lengths of the other lines, without linked text, are summed over sliding
windows; the text surges where a sum rises over a threshold, which a page of short
lines lowers, and dives where a sum falls to nothing.  What lies between is kept,
with the unlinked lines that adjoin a surge and the linked ones inside.

Tags and names are evidence for the windows and no way around them.  Where the page
marks its article or main part, lines outside of it have no length, any length
surges, and a few linked lines beside a surge stay.  A mark that leaves most of the
text outside, such as a teaser's, is no evidence.  A class, id or role marks a
region as something else only if all parts of a name say so (ad-slot, but not
notice-of-motion), and not where such regions would take most of the page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as c

WINDOW = 3
SURGE = 80
#: A marked part is taken for the article unless so many times its unlinked text lies outside.
MARK = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
#: Elements whose content is no markup.
RAW = frozenset(("script", "style", "textarea", "noscript", "template", "iframe", "xmp", "svg", "math"))
#: Elements that never hold article text; title stands in the head.
OUTSIDE = frozenset(("head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video")) | RAW
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Parts of names in class, id or role that mark a region as no article text, and neutral parts beside them.
MARKERS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent notice alert
    popup modal newsletter subscribe subscription comment comments disqus reply replies respond sidebar widget widgets nav navbar navigation menu
    breadcrumb breadcrumbs footer masthead share sharing social related complementary contentinfo search pagination pager login signup""".split()
)
NEUTRAL = frozenset("box block wrapper wrap container content area section list bar slot unit item items inner outer left right top bottom main site page side header links link form thread primary secondary global".split())
WHOLE = frozenset(("site-header", "page-header", "side-bar", "sign-up", "log-in"))
_PARTS_OF = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
#: Names are no evidence where they leave less than one part in so many of the page.
NAMES = 5


def named_other(value: str) -> bool:
    """Whether some name among the words of an attribute says in all its parts that this is no article text."""
    for name in value.strip("\"'").split():
        parts = [x for x in _PARTS_OF.split(name) if x and not x.isdigit()]
        low = [x.lower() for x in parts]
        if name.lower() in WHOLE or any(x in MARKERS for x in low) and all(x in MARKERS or x in NEUTRAL for x in low):
            return True
    return False


#: Names of article elements that hold something else; whole names, as an article may be called has-sidebar.
_NO_ARTICLE = re.compile(r"comments?(?:-\d+)?|repl(?:y|ies)|ads?|advert\w*|sponsor\w*|promo\w*|related|teaser", re.I)


def lines_of(html: str, names: bool = True) -> tuple[list[tuple[str, int, bool]], int]:
    """(text, linked characters, inside a marked main part) of each block, in page order, and how much was left out for its name."""
    left_out = 0
    out: list[tuple[str, int, bool]] = []
    buf: list[str] = []
    linked = link_depth = main_depth = 0
    open_: list[str] = []

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((text, linked, main_depth > 0))
        linked = 0

    def hear(text: str) -> None:
        nonlocal linked
        if text:
            buf.append(text)
            if link_depth:
                linked += len("".join(unescape(text).split()))

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            hear(html[at:])
            break
        if m.start() > at:
            hear(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            elif name in BLOCKS:
                flush()
                _end(open_, name)
                if name in ("article", "main"):
                    main_depth = max(0, main_depth - 1)
            continue
        attrs = m[3]
        if name in VOID:
            if name == "br":
                buf.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCKS:
            _start(open_, name)
        drop = name in OUTSIDE or name == "header" and not main_depth
        if name == "article" and attrs and any(_NO_ARTICLE.fullmatch(y) for x in _NAMES.findall(attrs) for y in x.strip("\"'").split()):
            drop = True
        by_name = not drop and names and attrs and name not in ("body", "html", "article", "main") and any(map(named_other, _NAMES.findall(attrs)))
        if drop or by_name:
            if name in BLOCKS or name in OUTSIDE:
                flush()
            to = _after(html, at, name, attrs, open_)
            left_out += (to - at) * by_name
            at = to
            continue
        if name == "a":
            link_depth += 1
        elif name in BLOCKS:
            flush()
            open_.append(name)
            if name in ("article", "main"):
                main_depth += 1
    flush()
    return out, left_out


_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I | re.S) for name in RAW}
_CELLS, _PARTS = frozenset(("td", "th")), frozenset(("tr", "tbody", "thead", "tfoot"))
#: Elements that need no end tag, with the start tags that end them.
_ENDED_BY = {"p": BLOCKS, "head": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")), "tr": _PARTS, "td": _CELLS | _PARTS, "th": _CELLS | _PARTS}
_TRACKED = BLOCKS | OUTSIDE | {"option"}


def _start(open_: list[str], name: str) -> None:
    """Take off the elements that a start tag ends."""
    while open_ and name in _ENDED_BY.get(open_[-1], ()):
        open_.pop()


def _end(open_: list[str], name: str) -> bool:
    """Take off the innermost element of that name and what it holds."""
    if name not in open_:
        return False
    while open_.pop() != name:
        pass
    return True


def _after(html: str, at: int, name: str, attrs: str, around: list[str]) -> int:
    """Place where an element opened before at ends, by its end tag or without one.

    One that is never closed ends where an element around it does, or before an
    article or main part inside of it.
    """
    if attrs.endswith("/"):
        return at
    if name in RAW:
        m = _ENDS[name].search(html, at)
        return m.end() if m else len(html)
    open_, main = [name], None
    while m := _TOKEN.search(html, at):
        at = m.end()
        other = (m[2] or "").lower()
        if other != name and other not in _TRACKED or other in VOID:
            continue
        if m[1]:
            if _end(open_, other):
                if not open_:
                    return at
            elif other in around:
                return m.start() if main is None else main
            continue
        _start(open_, other)
        if not open_:
            return m.start()
        if other in RAW:
            at = _after(html, at, other, m[3], [])
            continue
        if other in ("article", "main") and main is None:
            main = m.start()
        open_.append(other)
    return len(html) if main is None else main


def _body(free: list[int], window: int, surge: int, beside: list[bool] | None = None) -> list[int]:
    """Numbers of the lines between surges and dives.

    A stretch runs from one line with unlinked text to another and holds no window
    without such text; linked lines inside of it stay.  It is kept whole if the sum
    of some window in it rises over the threshold, or over half of the page's
    largest sum where that is less.  Lines in beside that have no length stay if
    fewer of them than a window adjoin a stretch that is kept.
    """
    stretches: list[list[int]] = []  # [first, last] line
    for i in (i for i, n in enumerate(free) if n):
        if stretches and i - stretches[-1][1] <= window and not (beside and not all(beside[stretches[-1][1] : i + 1])):
            stretches[-1][1] = i
        else:
            stretches.append([i, i])
    tops = [max(sum(free[i : min(i + window, last + 1)]) for i in range(first, last + 1)) for first, last in stretches]
    least = min(surge, max(tops, default=0) // 2)
    kept: set[int] = set()
    for (first, last), top in zip(stretches, tops):
        if top > least:
            kept.update(range(first, last + 1))
            for way, at in ((-1, first), (1, last)) if beside else ():
                run, i = [], at + way
                while 0 <= i < len(free) and beside[i] and not free[i]:
                    run.append(i)
                    i += way
                if len(run) < window:
                    kept.update(run)
    return sorted(kept)


def main_lines(html: str | None, window: int = WINDOW, surge: int = SURGE) -> tuple[list[str], bool]:
    """The article's blocks, and whether a mark of the page was taken as evidence."""
    lines, left_out = lines_of(html or "")
    if left_out > NAMES * (sum(len(t) for t, *_ in lines) + 1):
        every, _ = lines_of(html or "", names=False)
        if sum(len(t) for t, *_ in every) > NAMES * sum(len(t) for t, *_ in lines):
            lines = every
    free = [max(0, len(t.replace(" ", "")) - n) for t, n, _ in lines]
    within = sum(n for n, (*_, inside) in zip(free, lines) if inside)
    marked = any(inside for *_, inside in lines) and MARK * within >= sum(free) - within
    if marked:
        inside = [x for *_, x in lines]
        kept = _body([n if x else 0 for n, x in zip(free, inside)], window, 0, inside)
        if not kept:  # all of the marked part is linked
            kept = [i for i, x in enumerate(inside) if x] if sum(inside) < window else []
    else:
        kept = _body(free, window, surge)
    return [lines[i][0] for i in kept], marked


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks joined by line feeds; empty for null, empty or textless pages."""
    return "\n".join(main_lines(html, window, surge)[0])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, in one pass without a shuffle; other columns are ignored.

    A null or empty html gives an empty text; repeated rows give repeated rows, and
    nothing depends on the order of rows; an empty table gives an empty result.  A
    page is worked on whole, in memory of a few times its size.
    """
    c.ship(pages.sparkSession)

    def run(batches):
        for b in c.slices(batches, "html"):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(c.table(spark, sf_dir, "pages"))
