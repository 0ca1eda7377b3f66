"""Main text of web pages by the distribution of text over lines.

Markup is stripped, with all elements that are no running text, and every block
element starts a line. The text lengths of a few following lines are summed over
a sliding window. Sums above a threshold are surges. The main text is all that
lies between the first and the last surge, lists of links among it, and reaches
out on both sides to where the sums dive to nothing.

Link text does not count for the length of a line, but that of a heading or
paragraph that is a link as a whole is no dive, unless `WINDOW` of its kind stand
together like a menu. If a page marks its article or main part, all lines of that
part are kept. Each page is handled alone, in Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm import common

WINDOW = 3
# Without a marked article, a window with this many characters without links is a surge.
SURGE_CHARS = 40

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote opens a value after an equals sign only, as in HTML. Nothing is read twice: no part gives back
    # what it has matched, and a tag whose value is never closed ends at the first angle bracket.
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?", re.S)
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br img picture".split()
)
# Elements that hold no running text of the article.
_ASIDE = frozenset(
    "head nav footer aside button select option optgroup datalist dialog menu noscript template svg canvas "
    "object applet audio video map".split()
)
# Controls are left out within forms only; other text of a form counts, as a form may hold the whole page.
_CONTROLS = frozenset("label legend output meter progress".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
# Classes and ids, alone or put together, of an element that is not part of the article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
    "comment comments disqus replies respond sidebar nav navbar navigation menu topbar breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended recommendations pagination pager login search toolbar masthead copyright paywall "
    "skip widget".split()
)
# What may stand before or after such a name. Other compounds say something else: category-promotion, content-sidebar-wrap.
_PLACES = frozenset("site page main primary secondary left right top bottom".split())
_PARTS = frozenset("area bar box list links buttons posts".split())
_REPLIES = frozenset("comment comments disqus replies respond".split())
_HEADERS = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _names(attributes: dict[str, str]) -> set[str]:
    """Words of the classes and ids that are made of names alone."""
    found: set[str] = set()
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split():
        parts = [part for part in re.split(r"[-_:]+", name) if part]
        if len(parts) > 1 and parts[0] in _PLACES:
            parts = parts[1:]
        if len(parts) > 1 and parts[-1] in _PARTS | _PLACES:
            parts = parts[:-1]
        if all(part in _NAMES or part in _HEADERS for part in parts):
            found.update(parts)
    return found


def _is_aside(tag: str, attributes: dict[str, str], in_article: bool, in_form: bool) -> bool:
    """Whether an element is left out by what it is, not by its name."""
    if tag in ("html", "body", "main"):
        return False
    if tag in _ASIDE or (tag == "header" and not in_article) or (in_form and tag in _CONTROLS):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return attributes.get("role", "").lower() in _ROLES


class Lines:
    """Lines of a page: text, length without links, whether inside the article, kind of block."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool, str]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.kind = ""

    def add(self, text: str, in_link: bool) -> None:
        self.parts.append(text)
        if in_link:
            self.linked += len(_SPACE.sub(" ", html.unescape(text)).strip())

    def end(self, in_article: bool) -> None:
        if self.parts:
            # Runs are decoded together: a reference may stand between two tags only as a whole.
            text = _SPACE.sub(" ", "".join(html.unescape(p) for p in self.parts)).strip()
            if text:
                self.rows.append((text, max(0, len(text) - self.linked), in_article, self.kind))
            self.parts, self.linked = [], 0


def lines_of(page: str) -> list[tuple[str, int, bool, str]]:
    """The lines that are left when markup and what is no running text are stripped.

    A name does not decide for an element that holds most of the page's text
    without links. Comments may hold more than the article they belong to.
    """
    rows, named, total = _parsed(page, frozenset())
    marked = any(in_article for _, _, in_article, _ in rows)
    spared = {at for at, (held, replies) in named.items() if 2 * held > total and not (replies and marked)}
    return _parsed(page, spared)[0] if spared else rows


def _parsed(page: str, spared: set[int] | frozenset[int]) -> tuple[list[tuple], dict[int, tuple[int, bool]], int]:
    """Lines; characters without links of each named element by its position, and whether it holds replies; all such characters.

    Elements at the positions `spared` are not left out for their names.
    """
    lines, open_, at = Lines(), [], 0
    opened: Counter[str] = Counter()  # open elements by name
    # Depths of the outermost elements that are left out, for whatever reason and not by name.
    aside: int | None = None
    hard: int | None = None
    counted: list[str] = []  # for each open element its name if it counts below, else nothing
    inside = {"article": 0, "main": 0, "a": 0, "form": 0}
    named: dict[int, tuple[int, bool]] = {}
    begun: dict[int, tuple[int, bool, int]] = {}  # by depth: position, replies, characters before
    total = position = 0

    def close() -> str:
        nonlocal aside, hard
        name, counts = open_.pop(), counted.pop()
        opened[name] -= 1
        depth = len(open_)
        if counts:
            inside[counts] -= 1
        if depth in begun:
            start, replies, before = begun.pop(depth)
            named[start] = total - before, replies
        if aside is not None and depth <= aside:
            aside = None
        if hard is not None and depth <= hard:
            hard = None
        return name

    while True:
        tag = _TAG.search(page, position)
        text = page[at : tag.start() if tag else len(page)]
        if text and aside is None:
            lines.add(text, inside["a"] > 0)
        if text and hard is None and not inside["a"]:
            total += len(_SPACE.sub(" ", text).strip())
        if tag is None:
            break
        position = at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        in_article = inside["article"] + inside["main"] > 0
        if name not in _INLINE and aside is None:
            lines.end(in_article)
            lines.kind = "" if tag["end"] else "heading" if name in _HEADINGS else name
        elif name == "br" and aside is None:
            lines.add(" ", False)
        if tag["end"]:
            if opened[name]:
                while close() != name:
                    pass
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I | re.S).search(page, position)
            position = at = end.end() if end else len(page)
            continue
        if name in _VOID or tag["attrs"].rstrip().endswith("/") and name not in ("p", "div"):
            continue
        if name in ("p", "li", "a") and open_ and open_[-1] == name and aside != len(open_) - 1:
            close()  # closed by the next of its kind
        if name == "main":
            aside = hard = None
        if hard is None:
            attributes = _attributes(tag["attrs"])
            if _is_aside(name, attributes, in_article, inside["form"] > 0):
                hard = len(open_)
                aside = hard if aside is None else aside
            elif name not in ("html", "body", "main") and not (name == "article" and not in_article and aside is None):
                names = _names(attributes)
                if names & _NAMES or (names & _HEADERS and not in_article):
                    begun[len(open_)] = tag.start(), bool(names & _REPLIES), total
                    if aside is None and tag.start() not in spared:
                        aside = len(open_)
        counts = name in inside and (hard is None if name in ("a", "form") else aside is None)
        open_.append(name)
        opened[name] += 1
        counted.append(name if counts else "")
        if counts:
            inside[name] += 1
    lines.end(inside["article"] + inside["main"] > 0)
    while open_:
        close()
    return lines.rows, named, total


def lengths_with_links(rows: list[tuple[str, int, bool, str]]) -> list[int]:
    """Lengths of lines, with the links of headings and paragraphs that are no menu."""
    lengths, at = [size for _, size, _, _ in rows], 0
    while at < len(rows):
        kind, end = rows[at][3], at + 1
        if not rows[at][1] and kind in ("heading", "p"):
            while end < len(rows) and not rows[end][1] and rows[end][3] == kind:
                end += 1
            if end - at < WINDOW:
                lengths[at:end] = [len(row[0]) for row in rows[at:end]]
        at = end
    return lengths


def between_surge_and_dive(lengths: list[int], least: float, plain: list[int] | None = None) -> tuple[int, int]:
    """First line and the one after the last of the region around all surges.

    Surges are those of `plain`, the lengths without any links, if given.
    """
    if not lengths or not any(lengths):
        return 0, 0
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    surges = [sum(plain[i : i + WINDOW]) for i in range(len(plain))] if plain and any(plain) else sums
    threshold = min(least, max(surges))
    found = [i for i, size in enumerate(surges) if size >= threshold]
    first, last = found[0], found[-1]
    while first > 0 and sums[first - 1]:
        first -= 1
    while last + 1 < len(sums) and sums[last + 1]:
        last += 1
    last = min(last + WINDOW, len(lengths)) - 1
    while not lengths[first]:
        first += 1
    while not lengths[last]:
        last -= 1
    return first, last + 1


def main_text(page: str | None) -> str:
    """Blocks of the main text, one a line; empty if there is none."""
    lines = lines_of(page or "")
    used = [line for line in lines if line[2]]
    if not used:
        first, after = between_surge_and_dive(lengths_with_links(lines), SURGE_CHARS, [line[1] for line in lines])
        used = lines[first:after]
    return "\n".join(line[0] for line in used)


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` without the column of markup and with the main text as `text_col`.

    A null page is empty and gives an empty text, as does one without text. Each
    row is handled alone, so repeated rows give equal texts; other columns are
    kept, and one that is called `text_col` is replaced. An empty table gives no
    rows.
    """
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            texts = pa.array([main_text(page.as_py()) for page in get(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[get(c) for c in kept], texts], names=[*kept, text_col])

    return common.map_in_arrow(pages.select(*kept, html_col), run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text` and its code points."""
    return extracted(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
