"""Main text of web pages by composite text density.

A page becomes a tree of elements; only what is never shown as text (FIRM) is left out at once. Every element has the
characters and tags below it, and how many of either are in links. Its composite density is its characters for each tag,
multiplied by a logarithm that falls as the share of link characters and link tags grows beside the page's own, so that
menus score near zero. An element's density sum is the sum of its children's densities. The threshold is the least density
on the path from the body to the element of greatest density sum; of the elements that reach the threshold, the one of
greatest sum is the main subtree. No name of a class, id, role or part of a page has a say in that.

Then, and only then, parts that are not the article are taken out: elements whose tag (PARTS), role, class or id says so.
A main subtree that lies in such a part gives way to the next by density sum. Names don't count against elements that hold
the page's text: if they would take more than half of what stands outside links, elements with a fifth of it or more stay
(a short one only if it has blocks or nothing stands beside it), and what is inside them is judged in turn. A header below
the page's own level that has a heading is the article's. Of each ancestor's other blocks, those with half the main
subtree's characters for each tag or more and few links are taken too, headings before it, and what stands between but
blocks of links, so that an article in several parts is whole whatever its length. Blocks are the runs of text between block
elements; line breaks of the source don't matter, and white space inside a block becomes one space. Formulas, hidden
elements and drawings are text like any other: only what was named above is dropped.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

# The elements of HTML by how they are parsed and shown.
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
# Of these, never text, however much they hold; and parts that are not the article.
FIRM = set("script style textarea title noscript iframe xmp noembed noframes head template select option datalist".split())
PARTS = set("nav header footer aside form button input label fieldset dialog menu".split())
LINES = 250  # characters: an advertisement or a footer in one block has fewer
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation svg text tspan button label object canvas picture audio video".split())
# Elements that an opening tag ends, and the elements that end is not looked for beyond.
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Words of classes and ids, alone or parted by dashes, underscores or spaces, that name menus, notices, adverts and comments.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|popup|modal|newsletter|subscribe|subscription|paywall"
    r"|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|masthead|footer|sidebar|widget|widgets|recommendations"
    r"|comment|comments|commentlist|disqus|replies|respond|login|signup|searchbox|toolbar|tagcloud|outbrain|taboola)(?:$|[\s_-])"
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""", re.I)
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "parent", "chars", "tags", "link_chars", "link_tags", "density", "sum", "named", "dropped")

    def __init__(self, tag: str, parent: "Node | None", named: bool = False):
        self.tag, self.parent, self.kids, self.named, self.dropped = tag, parent, [], named, tag in FIRM
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _named(tag: str, attributes: str) -> bool:
    """Whether a tag or its class, id or role names a part that isn't the article."""
    if tag in PARTS:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for m in NAMES.finditer(attributes):
        value = (m[2] or "").strip("\"'").lower()
        if value in ROLES if m[1].lower() == "role" else BOILERPLATE.search(value):
            return True
    return False


def parse(page: str) -> Node:
    """The page as a tree. Strings among the kids are text. Tags left open are closed where HTML closes them."""
    root = Node("html", None)
    now, at, end = root, 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            now.kids.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            now.kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                now.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:  # a closing tag ends the nearest open element of its name, if there is one
            node = now
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None and tag != "body":
                now = node.parent
            elif tag == "p":
                now.kids.append(Node("p", now))
            continue
        if tag in ("html", "body"):
            if tag == "body" and not any(isinstance(k, Node) and k.tag == "body" for k in root.kids):
                body = Node("body", root)
                root.kids.append(body)
                now = body
            continue
        if tag in CLOSES_P:
            node = now
            while node.parent is not None and node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if tag in ENDED_BY:
            node, stop = now, SCOPE[tag]
            while node.parent is not None and node.tag not in stop:
                if node.tag in ENDED_BY[tag]:
                    now = node.parent
                    break
                node = node.parent
        node = Node(tag, now, _named(tag, m[3]))
        now.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            inner = page[at : close.start() if close else end]
            if not node.dropped:
                node.kids.append(inner)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            now = node
    return root


def _drop_named(root: Node) -> None:
    """Drops elements that are named as other parts, but those that hold the page's text, as wrappers and elements left open."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        stack += [(k, linked) for k in node.kids if isinstance(k, Node) and k.tag not in FIRM]
    free: dict[Node, int] = {}
    headed: set[Node] = set()
    for node, linked in reversed(order):
        own = 0 if linked else sum(len(WHITE.sub(" ", k).strip()) for k in node.kids if isinstance(k, str))
        free[node] = own + sum(free.get(k, 0) for k in node.kids if isinstance(k, Node))
        if node.tag in HEADINGS or any(k in headed for k in node.kids):
            headed.add(node)
    for node, _ in order:
        outer = node.parent is None or node.parent.tag in ("html", "body")
        node.dropped = node.named and not (node.tag == "header" and node in headed and not outer)
    whole = free[root]
    top, stack = [], [root]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, Node) and k in free:
                (top if k.dropped else stack).append(k)
    lost = sum(free[k] for k in top)
    while lost * 2 > whole:
        large = [k for k in top if free[k] * 5 >= whole and (free[k] >= LINES or lost == whole or any(isinstance(x, Node) and x.tag not in INLINE and x.tag not in VOID for x in k.kids))]
        if not large:
            return
        top = [k for k in top if k not in large]
        lost -= sum(free[k] for k in large)
        stack = large
        while stack:
            node = stack.pop()
            node.dropped = False
            for k in node.kids:
                if isinstance(k, Node) and k in free:
                    if k.dropped:
                        top.append(k)
                        lost += free[k]
                    else:
                        stack.append(k)


def _measure(root: Node) -> list[Node]:
    """Characters, tags and links of every element that can be main text, children before parents."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append((node, linked))
        here = linked or node.tag == "a"
        stack += [(k, here) for k in node.kids if isinstance(k, Node) and not k.dropped]
    for node, _ in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node, linked in reversed(order):
        own = sum(len(WHITE.sub(" ", k).strip()) for k in node.kids if isinstance(k, str))
        node.chars += own
        if linked or node.tag == "a":
            node.link_chars += own
        if node.parent is not None:
            p, inline = node.parent, node.tag in INLINE and node.tag != "a" or node.tag in VOID
            p.chars += node.chars
            p.tags += node.tags + (not inline)
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags + (node.tag == "a")
    return [n for n, _ in reversed(order)]


def _densities(nodes: list[Node], body: Node) -> None:
    """Composite densities, and the sums of children's densities."""
    whole = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if not n.chars:
            continue
        free, tags = max(n.chars - n.link_chars, 1), max(n.tags, 1)
        plain = n.chars / tags
        base = math.log(n.chars / free * n.link_chars + whole * n.chars + math.e)
        ratio = n.chars / max(n.link_chars, 1) * tags / max(n.link_tags, 1)
        n.density = plain * max(0.0, math.log(max(ratio, 1.0)) / max(math.log(base), 0.25)) if n.link_chars < n.chars else 0.0
    for n in nodes:
        n.sum = sum(k.density for k in n.kids if isinstance(k, Node) and not k.dropped)


def _container(node: Node) -> bool:
    return node.tag not in INLINE and node.tag not in VOID and node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre")


def _units(node: Node) -> list[tuple[list, int, int, int]]:
    """The blocks that are a node's kids, text and inline elements in a row as one: kids, characters, those in links, and tags."""
    out: list[list] = []
    before = False
    for k in node.kids:
        inline = isinstance(k, str) or k.tag in INLINE or k.tag in VOID
        if not (inline and before):
            out.append([])
        out[-1].append(k)
        before = inline
    units = []
    for kids in out:
        nodes = [k for k in kids if isinstance(k, Node) and not k.dropped]
        chars = sum(n.chars for n in nodes) + sum(len(WHITE.sub(" ", k).strip()) for k in kids if isinstance(k, str))
        units.append((kids, chars, sum(n.link_chars for n in nodes), max(1, sum(n.tags for n in nodes))))
    return units


def _inside_dropped(node: Node) -> bool:
    while node is not None and not node.dropped:
        node = node.parent
    return node is not None


def main_node(root: Node, names: bool = True) -> Node:
    """The main subtree, after what isn't the article in it and around it is marked as dropped. names: whether names may say so."""
    body = next((k for k in root.kids if isinstance(k, Node) and k.tag == "body"), root)
    nodes = _measure(root)
    _densities(nodes, body)
    inside = [n for n in nodes if n is not root and _container(n) and n.chars]
    if not inside:
        return body
    path, n = [], max(inside, key=lambda n: n.sum)
    while n is not None:
        path.append(n)
        n = n.parent
    threshold = min((p.density for p in path if p.chars), default=0.0)
    ranked = sorted((n for n in inside if n.density >= threshold), key=lambda n: -n.sum) or [path[0]]
    if names:
        _drop_named(root)
        _measure(root)
    best = next((n for n in ranked if not _inside_dropped(n) and n.chars), body)
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent
    # an ancestor that holds dense text beside what was chosen is the whole article, less what stands around that text
    child, chars, tags = best, best.chars, max(best.tags, 1)
    for up in [p for p in path[path.index(best) + 1 :] if p is not root or body is root]:
        units = _units(up)
        at = next(i for i, (kids, *_) in enumerate(units) if any(k is child for k in kids))
        found = [at]
        for i, (kids, c, links, t) in enumerate(units):
            heading = i < at and isinstance(kids[0], Node) and kids[0].tag in HEADINGS
            if i != at and links * 3 < c and (heading or c * tags * 2 >= chars * t):
                found.append(i)
        out = [k for i, (kids, c, links, _) in enumerate(units) if i != at and (not min(found) <= i <= max(found) or links * 3 >= c > 0) for k in kids]
        for k in out:
            if isinstance(k, Node):
                k.dropped = True
        gone = set(map(id, out))
        up.kids = [k for k in up.kids if isinstance(k, Node) or id(k) not in gone]
        if len(found) > 1:
            best = up
        child = up
    return best


def blocks(node: Node) -> list[str]:
    """Texts between block boundaries, white space in each made one space."""
    out, run = [], []

    def end() -> None:
        text = WHITE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.dropped:
            if x.tag not in INLINE:
                end()
        elif x.tag in ("br", "hr"):
            end() if x.tag == "hr" else run.append("\n")
        else:
            block = x.tag not in INLINE and x.tag not in VOID
            if block:
                end()
                stack.append(None)
            stack += reversed(x.kids)
    end()
    return out


def main_text(page: str, names: bool = True) -> str:
    if not page:
        return ""
    return "\n".join(blocks(main_node(parse(page), names)))


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text (blocks of the main text joined by \\n, empty if none), n_chars (its code points).

    Null and empty pages have empty text. Repeated rows stay rows. Extra columns are ignored; an empty table gives no rows.
    """
    ship(pages.sparkSession)

    def of(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x or "") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(of, "page_id long, url string, text string, n_chars long")
