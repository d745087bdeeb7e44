"""Main text of web pages by composite text density.

Each page becomes a small tree, in time linear in its length. Elements that the result must not
hold (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, by tag, role
or the names in their class and id) are pruned. For every other node

    density = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

with C characters, LC of them in links, T tags, LT of them links, and LCb, Cb the body's; in a
page without links it is C / T. A node's density sum adds its children's densities. The node
with the largest sum is the centre of the article, and the least density on its path to the
body is the threshold: from the body down, through nodes at or above the threshold, each gives
the subtree of largest density sum below it. The smallest subtree that holds all of these is the
article's core. Short blocks of an article are thin by their nature (a title, an introduction, a
last line), so thinness alone drops nothing: in the core only lists of links and lines on copyright
go, and beside it what is links for the most part as well. Tags such as ``article`` have no part
in the choice.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")  # up to the end of a tag; a > in quotes doesn't end it
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_LEGAL = re.compile(r"\s*(?:©|\(c\) ?\d{4}|copyright (?:©|\(c\)|\d{4})|all rights reserved)", re.I)  # how a line on copyright begins
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# Elements of HTML by how they behave, and the names that sites give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript xmp iframe noembed noframes svg canvas object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside button datalist dialog fieldset footer form head header input label menu nav search select".split()) | RAW
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion promoted banner breadcrumb breadcrumbs
    comment comments commentlist disqus reply replies consent cookie cookies gdpr notice notices alert footer header masthead topbar
    login signin signup register menu menus nav navbar navigation navi newsletter subscribe subscription modal overlay popup pagination pager
    related recommended recommendations recirc search share sharing social sidebar sidebars sidenav skip toolbar widget widgets teaser teasers""".split()
)
# Words that only say where or what kind of box a named element is.
NEUTRAL_NAMES = frozenset(
    """area article bar big block blog body bottom box button buttons card col column container content desktop element entry fixed float global grid group holder icon icons inline inner
    item items layout left line link links list lower main mobile module my outer page panel part post primary privacy reader readers region right row secondary section site slot small sticky strip
    tab tabs text top unit upper user users view wide wrap wrapper zone""".split()
)
_CLOSES_P = BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_BARRIER = frozenset("article aside blockquote body div footer form header main nav section table td th".split())


class _Node:
    __slots__ = ("chars", "children", "closed", "density", "drop", "holds_title", "legal", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None) -> None:
        self.tag, self.parent, self.children, self.drop, self.closed = tag, parent, [], 0, False
        self.holds_title = tag in ("h1", "article", "main")
        self.legal = False
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        if parent:
            parent.children.append(self)


def _dropped_name(name: str) -> bool:
    """Whether a class or id is one of DROPPED_NAMES, or is put together of these and neutral words, as in site-footer; share-price-table is not."""
    if name.lower() in DROPPED_NAMES:
        return True
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    named = [w in DROPPED_NAMES for w in words]
    return any(named) and all(n or w in NEUTRAL_NAMES or len(w) == 1 or w.isdigit() for n, w in zip(named, words, strict=True))


def _dropped(tag: str, attributes: str) -> int:
    """2 for elements that never hold an article, 1 for those whose names say so."""
    if tag in DROPPED:
        return 2
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return 2
    if found.get("role", "").lower() in DROPPED_ROLES:
        return 2
    return int(any(_dropped_name(n) for k in ("class", "id") if k in found for n in found[k].split()))


class _Open:
    """The open elements, with the places of each tag among them, so that no end tag makes a search."""

    def __init__(self, root: _Node) -> None:
        self.stack, self.at, self.barriers = [root], {}, [-1]

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags; -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, node: _Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BARRIER:
            self.barriers.append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close the elements from ``place`` on."""
        while len(self.stack) > place or self.stack[-1].closed:
            node = self.stack.pop()
            if not node.closed:
                self.at[node.tag].pop()
            if node.tag in _BARRIER:
                self.barriers.pop()

    def close_p(self) -> None:
        place = self.last("p")
        if place > self.barriers[-1]:
            self.cut(place)

    def close(self, tag: str, add) -> None:
        place = self.last((tag,))
        if place < 0 or (tag == "p" or tag not in BLOCK) and place < self.barriers[-1]:
            return
        node = self.stack[place]
        if tag in BLOCK:
            add((node, None))
            if tag != "body":
                self.cut(place)
        else:  # blocks that were opened inside it stay open
            node.closed = True
            self.at[tag].pop()
            self.cut(len(self.stack))


def _parse(page: str) -> tuple[_Node, list[tuple[_Node, str | None]]]:
    """The tree, and the page's pieces of text in order; None marks a block's edge.

    What follows a comment or tag that doesn't end is not shown.
    """
    root = _Node("html", None)
    open_, pieces, at, text, size, quotes = _Open(root), [], 0, 0, len(page), True
    stack, add = open_.stack, pieces.append
    while at < size:
        at = page.find("<", at)
        if at < 0:
            break
        mark = page[at + 1 : at + 2]
        m = _NAME.match(page, at)
        if not m and (not mark or mark not in "!?/"):
            at += 1
            continue
        if at > text:
            add((stack[-1], page[text:at]))
        if not m:
            comment = page.startswith("<!--", at)
            end = page.find("-->", at + 2) if comment else page.find(">", at)
            at = text = size if end < 0 else end + (3 if comment else 1)
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if not rest:  # a quote or the tag doesn't end; quotes count no more from here
            quotes = False
            end = page.find(">", m.end())
            at = text = size if end < 0 else end + 1
            attributes = page[m.end() : at - 1]
        else:
            at = text = rest.end()
            attributes = page[m.end() : at - 1]
        tag = m[1].lower()
        if mark == "/":
            open_.close(tag, add)
            continue
        if tag == "html" or tag == "body" and open_.last(("body",)) > 0:
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = _raw_end(tag).search(page, at)
                at = text = (page.find(">", end.start()) + 1 or size) if end else size
            continue
        if tag == "br":
            add((stack[-1], " "))
        if tag in VOID:
            if tag == "hr":
                add((stack[-1], None))
            continue
        if tag == "body":
            open_.cut(1)
        elif tag in _CLOSES_P:
            open_.close_p()
        if tag in _CLOSES:
            own, limit = _CLOSES[tag]
            place = open_.last(own)
            if place > open_.last(limit):
                open_.cut(place)
        node = _Node(tag, stack[-1])
        node.drop = _dropped(tag, attributes)
        if tag in BLOCK:
            add((node, None))
        open_.push(node)
    if text < size:
        add((stack[-1], page[text:]))
    return root, pieces


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)


def _pruned(root: _Node) -> tuple[list[_Node], set[_Node]]:
    """The nodes that are kept, parents first, and those that are not."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        if node.holds_title and node.parent:
            node.parent.holds_title = True
    nodes, gone, inside = [], set(), set()
    for node in order:
        if node.parent in inside or node.parent and node.parent.tag in ("article", "main"):
            inside.add(node)
        own_header = node.tag in ("header", "label") and node in inside  # an article's own
        named = node.drop == 1 and node.tag not in ("html", "body", "main") and not node.holds_title
        if node.parent in gone or node.drop == 2 and not own_header or named:
            gone.add(node)
        else:
            nodes.append(node)
    return nodes, gone


def main_text(page: str) -> str:
    """The article's blocks, in page order, one to a line."""
    root, pieces = _parse(page)
    nodes, gone = _pruned(root)
    texts = [(node, html.unescape(text) if text and "&" in text else text) for node, text in pieces if node not in gone or text is None]
    for node, text in texts:
        if text and node not in gone:
            node.chars += len(text) - text.count(" ") - text.count("\n")
            node.legal = node.legal or _LEGAL.match(text) is not None
    linked = set()
    for node in nodes:  # parents first
        if node.tag == "a" or node.parent in linked:
            linked.add(node)
            node.link_chars = node.chars
        node.link_tags += node.tag == "a"
    for node in reversed(nodes):
        above = node.parent
        if above:
            above.chars += node.chars
            above.link_chars += node.link_chars
            above.tags += node.tags + 1
            above.link_tags += node.link_tags
            above.legal = above.legal or node.legal
    for node in nodes:
        node.density = _density(node, root)
    for node in reversed(nodes):
        node.sum = sum(c.density for c in node.children if c not in gone)
    return _blocks(texts, _held(root, nodes, gone, _selected(root, nodes, gone)))


def _path(node: _Node) -> Iterator[_Node]:
    while node:
        yield node
        node = node.parent


def _density(node: _Node, root: _Node) -> float:
    c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
    if not c:
        return 0.0
    if not root.link_chars:
        return c / t
    base = math.log(c / max(1, c - lc) * lc + root.link_chars / root.chars * c + math.e)
    inner = c / max(1, lc) * t / lt
    return c / t * math.log(max(inner, 1.0)) / max(math.log(base), 1e-6)


def _selected(root: _Node, nodes: list[_Node], gone: set[_Node]) -> set[_Node]:
    """The subtrees that hold the text; the whole tree if no element has text. Of equal sums the larger, then the first, node is the centre."""
    best = max(nodes, key=lambda n: (n.sum, n.chars))
    if not best.sum:
        return {root}
    least = min(n.density for n in _path(best))
    inner = {}
    for node in reversed(nodes):
        below = max((inner[c] for c in node.children if c not in gone), key=lambda n: n.sum, default=node)
        inner[node] = below if below.sum > node.sum else node
    kept, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.density >= least:
            kept.add(inner[node] if inner[node].sum else node)
            todo.extend(c for c in node.children if c not in gone)
    return kept


def _core(root: _Node, nodes: list[_Node], marked: set[_Node]) -> list[_Node]:
    """The way from the root to the smallest subtree that holds all marked nodes."""
    below = dict.fromkeys(nodes, 0)
    for node in reversed(nodes):
        below[node] += node in marked
        if node.parent:
            below[node.parent] += below[node]
    way = [root]
    while way[-1] not in marked:
        inner = next((c for c in way[-1].children if below.get(c) == below[root]), None)
        if not inner:
            break
        way.append(inner)
    return way


def _only_links(node: _Node, least: int) -> bool:
    """Whether an element has ``least`` links or more, and more of its characters in links than outside."""
    return node.link_tags >= least and 2 * node.link_chars > node.chars


def _held(root: _Node, nodes: list[_Node], gone: set[_Node], marked: set[_Node]) -> set[_Node]:
    """The nodes whose own text is the article's."""
    way = _core(root, nodes, marked)
    core, above = way[-1], set(way[:-1])
    bare = set()  # of the nodes above the core, those whose own lines are links for the most part
    for node in above:
        own = [c for c in node.children if c not in gone and c not in above and c is not core]
        inline = [c for c in own if c.tag not in BLOCK]
        chars = node.chars - sum(c.chars for c in node.children if c not in gone) + sum(c.chars for c in inline)
        if 2 * sum(c.link_chars for c in inline) > chars:
            bare.add(node)
    held, inside, out = set(), set(), set()
    for node in nodes:  # parents first
        parent = node.parent
        if node is core or parent in inside:
            inside.add(node)
            menu = node not in marked and node.tag in BLOCK - {"p"} and _only_links(node, 3)
            dropped = parent in out or node is not core and (menu or node.tag in ("div", "section") and node.chars < 200 and node.legal)
        elif node in above:
            dropped = False
        elif parent in above and node.tag not in BLOCK:
            dropped = parent in bare
        else:
            dropped = parent in out or node.tag in BLOCK and (_only_links(node, 1) or node.chars < 200 and node.legal)
        if dropped:
            out.add(node)
        elif node not in bare:
            held.add(node)
    return held


def _blocks(texts: list[tuple[_Node, str | None]], kept: set[_Node]) -> str:
    blocks, held = [], []
    for node, text in [*texts, (None, None)]:
        if text is None:
            if block := " ".join("".join(held).split()):
                blocks.append(block)
            held = []
        elif node in kept:
            held.append(text)
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html).

    Null and empty pages, and pages without an article, have an empty text. Pages with equal
    content give equal texts, each its own row; of equally dense elements the larger, then the
    first, is the centre. A page of any length is parsed whole, in linear time. Other columns
    are ignored, and an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")
