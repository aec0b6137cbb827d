"""Main text of web pages by scoring the element tree.

Every paragraph earns points for its length and its commas and passes them to
its ancestors: all to the parent, a quarter to the next, half as many to each one
further up; an element's points are discounted by the share of its text that stands
in links. Points and lengths are passed once, from children to parents, so the work
grows with the page and not with the depth of its tree. The best element is the container of
the article; it grows to the article or main element round it, and siblings
that score like it are kept as well. Elements that are furniture by their kind,
role or name are left out throughout: menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles and readers' comments.

A page that is null, empty or without text gives an empty text. Markup may be
broken: what is not closed ends where its surroundings do.

Defined results: repeated rows each have their own result; an empty table gives no rows.
Pages of any length and depth are read whole. Other columns are not read and may have any
name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_bytes

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
FURNITURE = frozenset("nav footer aside form button select menu dialog fieldset datalist".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
FURNITURE_NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond disqus replies "
    "pagination pager skip paywall".split()
)
CLOSED_BY_BLOCK = "p"
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl body article main section div".split())
HOLDERS = frozenset("article main".split())
KEPT_WHOLE = frozenset("html body article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "named", "own", "links", "points", "passed", "inline", "block", "open")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, named: bool):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        self.children: list[Node | str] = []
        self.own, self.links, self.points = 0, 0, 0.0
        #: Points for those above its parent; the length and commas of its text if it stands in a line.
        self.passed, self.inline = 0.0, (0, 0)
        in_line = tag in INLINE and parent is not None
        self.block = parent.block if in_line else self
        #: Of a block, how many elements inside it that stand in a line are open, by kind.
        self.open: dict[str, int] | None = None if in_line else {}


def _furniture(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is furniture by its kind, role or state, and whether it is by its name."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True, False
    if not attributes or tag in KEPT_WHOLE:
        return False, False
    kind = named = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name == "role":
            kind |= value.strip().lower() in FURNITURE_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            kind = True
        elif name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _NAME.findall(word)]
                named |= bool(FURNITURE_NAMES.intersection(parts)) and not {"no", "has", "with", "without"}.intersection(parts)
    return kind, named


def parse(page: str) -> Node:
    """The element tree. Text in raw elements is left out; character references are decoded."""
    root = Node("html", None, False, False)
    at, here, end, holders = 0, root, len(page), 0
    blocks: dict[str, int] = {}  # open elements that do not stand in a line

    def climb(to: Node) -> Node:
        nonlocal holders
        node = here
        while node is not to:
            holders -= node.tag in HOLDERS
            (node.block.open if node.tag in INLINE else blocks)[node.tag] -= 1  # it was counted when it was opened
            node = node.parent
        return node

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            here.children.append(html.unescape(page[at : m.start() if m else end]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if (here.block.open if tag in INLINE else blocks).get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = climb(node.parent)
            continue
        if tag in ("html", "body") and here is root:
            continue
        closes = CLOSED_BY.get(tag)
        if tag not in INLINE and (blocks.get(CLOSED_BY_BLOCK) or closes is not None and any(blocks.get(c) for c in closes)):
            node, found = here, None
            while node is not None and (closes is not None or node.tag in INLINE or node.tag == CLOSED_BY_BLOCK):
                if node.tag == CLOSED_BY_BLOCK or closes is not None and node.tag in closes:
                    found = node
                if node.tag in SCOPES:
                    break
                node = node.parent
            if found is not None:
                here = climb(found.parent)
        kind, named = _furniture(tag, m[3], holders > 0)
        node = Node(tag, here, kind, named)
        here.children.append(node)
        if tag in RAW:
            node.dropped = True
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at) if not m[3].endswith("/") else None
            if close:
                at = close.end()
            elif not m[3].endswith("/"):
                at = end
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
            holders += tag in HOLDERS
            opened = node.block.open if tag in INLINE else blocks
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _score(root: Node, by_name: bool) -> list[Node]:
    """Give all kept elements their text lengths and points; returns them."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        order.append(node)
        node.own = node.links = 0
        node.points = node.passed = 0.0
        node.inline = (0, 0)
        for child in node.children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                node.own += size
                node.links += size if in_link or node.tag == "a" else 0
            elif not child.dropped and not (by_name and child.named):
                stack.append((child, in_link or node.tag == "a"))
    for node in reversed(order):  # children before parents
        parts = [(len(" ".join(c.split())), c.count(",")) if isinstance(c, str) else c.inline for c in node.children if isinstance(c, str) or c.tag in INLINE]
        parts = [p for p in parts if p[0]]
        length, commas = sum(p[0] for p in parts) + len(parts) - 1, sum(p[1] for p in parts)
        earned = 0.0
        if parts and node.tag in INLINE:
            node.inline = (length, commas)
        elif parts:
            earned = 1 + commas + min(length / 100, 3)
        node.points += earned
        if (up := node.parent) is not None:
            up.own += node.own
            up.links += node.links
            up.points += earned + node.passed
            up.passed += earned / 4 + node.passed / 2
    return order


def _value(node: Node) -> float:
    return node.points * (1 - node.links / node.own) if node.own else 0.0


def _blocks(node: Node, by_name: bool) -> Iterator[str]:
    """Texts between block borders, in page order."""
    parts: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None or isinstance(item, Node) and item.tag not in INLINE:
            if text := " ".join("".join(parts).split()):
                yield text
            parts = []
        if isinstance(item, str):
            parts.append(item)
        elif item is not None and not item.dropped and not (by_name and item.named):
            if item.tag == "br":
                parts.append(" ")
            if item.tag not in INLINE:
                stack.append(None)
            stack.extend(reversed(item.children))
    if text := " ".join("".join(parts).split()):
        yield text


def extract(page: str | None) -> str:
    """The main text: blocks joined by an empty line."""
    root = parse(page or "")
    for by_name in (True, False):
        nodes = _score(root, by_name)
        if root.own:
            break
    else:
        return ""
    blocks = [n for n in nodes if n.tag not in INLINE]
    best = max(blocks, key=_value)
    up = best
    while up is not None:
        if up.tag in HOLDERS:
            best = up
        up = up.parent
    if best.tag not in HOLDERS and best.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre") and best.parent is not None:
        best = best.parent
    kept = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * _value(best))
        kept = [c for c in best.parent.children if isinstance(c, Node) and not c.dropped and not (by_name and c.named) and (c is best or _value(c) >= least or c.tag == "p" and c.own > 80 and c.links < c.own / 4)]
    return "\n\n".join(text for node in kept for text in _blocks(node, by_name))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    arrow_bytes(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
