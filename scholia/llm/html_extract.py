"""Main text of web pages by scoring the element tree.

A page becomes a tree of elements and a list of blocks (text between block-level tags).  Each block
outside of scripts, menus, notices and the like gets points for its length and its commas, less its
share of linked text, and passes them to the elements around it, half as many with each step up.
The element with most points, less its share of linked text, is the container.  An ``article`` or
``main`` element around it takes its place if the container holds half of its text.  Siblings of the container that
score a fifth of it, or that are paragraphs or headings of their own with few links, are kept too.  All blocks in
what is kept are the text, but for lists and divisions of links.

Tags are matched through the places at which each of them is open, and points are summed up from the
leaves, so time is linear in the page's length whatever its nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import ranges
from .scratch import quoted, small_batches
from .worker import batches_of

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that are never part of an article.
OUTSIDE = frozenset(
    "head nav footer aside form script style noscript template svg math canvas iframe object embed button select option textarea input dialog menu audio video map title xmp noembed noframes".split()
)
#: Words of a class or id that mark what is not part of an article.
OUTSIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements adsense adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist
    respond reply replies consent cookie cookies gdpr disqus footer masthead menu menus modal nav navbar navigation newsletter notice notices
    notification alert outbrain overlay pager pagination popup promo promotion promoted related recommended recommendations share sharing shares sidebar
    sidebars sidenav social sponsor sponsored sponsors subscribe subscription subscriptions taboola tags teaser toolbar topbar widget widgets""".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: A class word after one of these tells about something else than the element's own content.
NEGATIONS = frozenset("has with no without is".split())
KEPT_ALONE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article section main div table ul ol dl td th blockquote aside nav header footer form li".split())
HOLDERS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 li".split())
#: Elements that are a menu if nine tenths of their text are links.
MENUS = frozenset("div section ul ol dl table".split())
HREF = re.compile(r"\bhref\b", re.I)


class Element:
    __slots__ = ("article", "linked", "outside", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Element | None, outside: bool):
        self.tag, self.parent, self.points, self.size, self.linked = tag, parent, 0.0, 0, 0
        self.outside = outside or parent is not None and parent.outside
        self.article = tag in HOLDERS or parent is not None and parent.article


class Open:
    """The open elements, and at which depths each tag is open."""

    def __init__(self):
        self.every = [Element("html", None, False)]
        self.made = [self.every[0]]
        self.blocks = [0]  # depths of those that aren't inline
        self.scopes = [0]  # of those that end the search for an open element to close
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str, outside: bool) -> None:
        depth = len(self.every)
        self.every.append(Element(tag, self.every[-1], outside))
        self.made.append(self.every[-1])
        self.at.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self.blocks.append(depth)
        if tag in SCOPES:
            self.scopes.append(depth)

    def depth(self, tag: str) -> int:
        """Depth of the innermost open element of this tag; 0 if none is open."""
        return (self.at.get(tag) or [0])[-1]

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all in it."""
        while len(self.every) > depth:
            self.at[self.every.pop().tag].pop()
        for kept in (self.blocks, self.scopes):
            while kept[-1] >= depth:
                kept.pop()

    def cut_in_scope(self, tags: Iterable[str]) -> None:
        """Close the innermost open element of these tags, unless a scope lies in between."""
        depth = max(map(self.depth, tags))
        if depth and depth >= self.scopes[-1]:
            self.cut(depth)


def _marked_outside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether tag, class, id or role tell that an element is not part of an article."""
    if tag in OUTSIDE or tag == "header" and not in_article:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower() or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role":
            if value in OUTSIDE_ROLES:
                return True
        elif name in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[^a-z]+", word)
                if any(p in OUTSIDE_WORDS and not (k and parts[k - 1] in NEGATIONS) for k, p in enumerate(parts)):
                    return True
                if not in_article and "header" in parts:
                    return True
    return False


def blocks_of(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """The page's elements, parents first, and its blocks in order: innermost block element, text, and characters in links."""
    tree = Open()
    link = 0  # depth at which a link opened, and one more; 0 outside of links
    found: list[tuple[Element, str, int]] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                found.append((tree.every[tree.blocks[-1]], whole, min(linked, len(whole))))
            text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if tree.every[-1].outside:
            return
        piece = unescape(piece) if "&" in piece else piece
        text.append(piece)
        if link:
            linked += len(piece.strip())

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        closing = m[1] or m[4]
        attributes = m[3] or m[6] or ""
        if tag == "a":
            link = 0 if closing or not HREF.search(attributes) else len(tree.every)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if closing:
            depth = tree.depth(tag)
            if not depth or tag in INLINE and depth < tree.blocks[-1]:
                continue
            if tag not in INLINE:
                flush()
            tree.cut(depth)
            link = link if link <= len(tree.every) else 0  # a link ends with the element it began in
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        outside = _marked_outside(tag, attributes, tree.every[-1].article)
        if tag in INLINE:
            if outside or tree.depth(tag) > tree.blocks[-1]:
                tree.push(tag, outside)  # so that its end tag is known as its own
            continue
        flush()
        if tag in CLOSES:
            tree.cut_in_scope(CLOSES[tag])
        tree.cut_in_scope(("p",))
        link = link if link <= len(tree.every) else 0
        if tag not in ("html", "body"):
            tree.push(tag, outside)
    flush()
    return tree.made, found


def main_text(html: str | None) -> str:
    """The main text of one page; '' if there is none."""
    elements, blocks = blocks_of(html or "")
    blocks = [b for b in blocks if not b[0].outside]
    if not blocks:
        return ""
    for element, text, linked in blocks:
        points = (1 + len(text) / 100 + text.count(",")) * (1 - linked / len(text))
        if element.tag in HEADINGS:
            points /= 4
        element.size += len(text)
        element.linked += linked
        to = element if element.tag not in KEPT_ALONE or element.parent is None else element.parent
        to.points += points
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.points += e.points / 2
            e.parent.size += e.size
            e.parent.linked += e.linked
    best = max((e for e in elements if e.size), key=lambda e: e.points * (1 - e.linked / e.size))
    e, holder = best, None
    while e is not None:
        if (e.tag == "article" or e.tag == "main" and (holder is None or holder.tag == "main")) and 2 * best.size >= e.size:
            holder = e
        e = e.parent
    best = holder or best
    kept = {id(best)}
    if best.parent is not None:
        for e in elements:
            if e.parent is best.parent and e is not best and e.size and e.linked < 0.33 * e.size:
                strong = e.points >= best.points / 5
                if strong and e.tag == best.tag or best.tag not in HOLDERS and (strong or e.tag in KEPT_ALONE):
                    kept.add(id(e))
    inside = set()
    for e in elements:  # parents come first
        if id(e) in kept or e.parent is not None and id(e.parent) in inside and not (e.tag in MENUS and 10 * e.linked >= 9 * e.size > 0):
            inside.add(id(e))
    loose = best.parent if best.tag not in HOLDERS else None  # text beside the container
    return "\n".join(text for element, text, _ in blocks if id(element) in inside or element is loose)


def extract(pages: DataFrame, id_cols: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """``id_cols`` (default: all but the html) and text string, n_chars long for each row.

    Null and empty html, and pages without text outside of menus and the like, give ''.  Rows that
    repeat give a row each.  Columns named text or n_chars are replaced.  An empty table stays empty.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in (id_cols if id_cols is not None else pages.columns) if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to in ranges(whole.column(len(kept)), rows=256):
                batch = whole.slice(at, to - at)
                texts = [main_text(x.as_py()) for x in batch.column(len(kept))]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*kept, "text", "n_chars"])

    schema = pages.select(*map(quoted, kept)).schema.add("text", "string").add("n_chars", "long")
    chosen = pages.select(*map(quoted, kept), F.col(quoted(html_col)).cast("string"))
    return chosen.toDF(*[f"c{k}" for k in range(len(chosen.columns))]).mapInArrow(batches_of("main_text", run), schema)
