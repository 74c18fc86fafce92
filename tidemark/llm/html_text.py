"""Operator 8: main text of web pages by composite text density.

Each page is parsed into a tree (one pass of a tag scanner, with HTML's rules for raw text, void elements and implied
end tags). Navigation, site headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are cut by element, role and class (by class only what does not hold the article, see settle); on what is left every node gets its link-adjusted characters per tag

    density = C/T * log(C/LC * T/LT) / log(ln(C/(C-LC)*LC + LCb/Cb*C + e))

with C characters, T tags, LC linked characters, LT link tags of the subtree and LCb, Cb those of the body (zero
divisors count as 1). A node's sum is that of its children's densities. The node with the largest sum is the core;
the article (or main) element around it, else its highest ancestor below the body that is at least as dense as the
body-path threshold and not mostly links, is the result.

Text: character references decoded, white space inside a block as one space, blocks joined by a line feed; a table
row is a block, a line break is white space. Null or empty html gives an empty text; broken markup never fails;
repeated rows are answered once each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr caption hr address details summary header footer nav aside form fieldset center hgroup dialog search".split())
CUT = frozenset("head nav footer aside form button dialog menu fieldset label search input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations share "
    "sharing social footer masthead comment comments commentlist disqus reply replies respond popup modal overlay login search pagination pager skip copyright".split()
)
#: Those that stand for a block of its own, hardly ever for a wrapper of the page.
OWN_BLOCK = frozenset("cookie cookies consent gdpr comment comments commentlist disqus reply replies respond popup modal overlay".split())
_CLOSES_P = BLOCK - {"html", "body"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}}
_BARRIER = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote b i em strong span a u small font br code q cite tbody".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "kids", "main", "cut", "doubt", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.kids, self.main, self.cut, self.doubt = tag, parent, [], [], False, False, 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _marked(node: Node, attributes: str, inside: bool) -> None:
    """Sets cut and main by the element and its attributes, and doubt (1, or 2 for a block of its own) by words in class
    or id; inside: an article or main element is open."""
    tag = node.tag
    node.cut = tag in CUT or tag == "header" and not inside
    node.main = tag in ("article", "main")
    if not attributes or tag in ("html", "body"):
        return
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), entities.unescape(a or b or c)
        if name == "role":
            node.cut |= value.lower() in ROLES
            node.main |= value.lower() in ("main", "article")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.cut = True
        elif name == "itemprop":
            node.main |= value.lower() == "articlebody"
            node.cut |= value.lower() == "comment"
        elif name in ("class", "id") and tag not in ("main",):
            words = {x.lower() for x in _WORD.findall(value)}
            if words & MARKS or "header" in words and not inside and tag != "article":
                node.doubt = max(node.doubt, 2 if words & OWN_BLOCK else 1)


def parse(page: str) -> Node:
    """The tree of a page; text and children of a node in order in its parts."""
    root = Node("html", None)
    body = Node("body", root)
    root.parts.append(body)
    root.kids.append(body)
    stack, at, size = [root, body], 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            stack[-1].parts.append(page[at:end])
        if m is None:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "table", "div", "section", "main") and tag not in BLOCK and tag not in ("td", "th"):
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = close.end() if close else size if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 1, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _CLOSES_P or stack[k].tag in ("td", "th"):
                    break
        if tag == "head":
            continue
        if tag in _SIBLINGS:
            for k in range(len(stack) - 1, 1, -1):
                if stack[k].tag in _BARRIER[tag]:
                    break
                if stack[k].tag in _SIBLINGS[tag]:
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        node = Node(tag, stack[-1])
        _marked(node, m[3], any(x.main for x in stack))
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _ordered(root: Node) -> list[Node]:
    """Uncut nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in node.kids if not x.cut]
    return out


def weigh(root: Node) -> list[Node]:
    """Sets counts, density and sum of all uncut nodes."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        kids = [x for x in node.kids if not x.cut]
        node.chars = sum(len(x.strip()) for x in node.parts if x.__class__ is str) + sum(x.chars for x in kids)
        node.tags = sum(x.tags + 1 for x in kids)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in kids)
        node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in kids)
    body = nodes[1] if len(nodes) > 1 else nodes[0]
    ratio = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9) / max(math.log(base + 1e-9), 1e-3) if base > 1 + 1e-6 else c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9) / 1e-3
    for node in nodes:
        node.sum = sum(x.density for x in node.kids if not x.cut)
    return nodes


def densest(nodes: list[Node]) -> Node:
    """The node with the largest sum of densities."""
    return max(nodes, key=lambda x: x.sum) if any(x.sum for x in nodes) else max(nodes, key=lambda x: x.density)


def _weight(node: Node) -> int:
    """Characters, those in links as a tenth; in tenths."""
    return 10 * node.chars - 9 * node.link_chars


def settle(root: Node) -> list[Node]:
    """Cuts the nodes in doubt, except those around the article, and weighs what is left.

    A node is kept if it holds most of the text, the largest article or main, or the densest subtree and more text than
    stands outside all nodes in doubt; a block of its own only if hardly any text stands there. Inside a kept node the
    next ones in doubt are judged in the same way, so a wrapper stays and the sidebar in it goes."""
    nodes = weigh(root)
    if not any(x.doubt for x in nodes):
        return nodes
    around, inner = {}, {None: []}
    for x in nodes:  # the nearest node in doubt: itself or an ancestor
        up = around.get(x.parent)
        if x.doubt:
            inner[up].append(x)
            inner[x] = []
        around[x] = x if x.doubt else up

    def holding(node: Node | None) -> set:
        out, x = set(), around.get(node)
        while x is not None:
            out.add(x)
            x = around.get(x.parent)
        return out

    with_text = [x for x in nodes[1:] if x.chars]
    core = holding(densest(with_text) if with_text else None)
    main = holding(max((x for x in with_text if x.main), key=_weight, default=None))
    total = _weight(nodes[1])
    clean = total - sum(_weight(x) for x in inner[None])
    ahead, kept = inner[None], set()
    while True:
        ahead = sorted((x for x in ahead if x in core or x in main or 2 * _weight(x) > total), key=lambda x: x.doubt)
        found = next((x for x in ahead if (x.doubt < 2 or 10 * clean < total) and (x in main or 2 * _weight(x) > total or _weight(x) > clean)), None)
        if found is None:
            break
        kept.add(found)
        ahead = [x for x in ahead if x is not found] + inner[found]
        clean += _weight(found) - sum(_weight(x) for x in inner[found])
    for x in nodes:
        x.cut |= x.doubt > 0 and x not in kept
    return weigh(root)


def main_node(root: Node) -> Node | None:
    """The element that holds the article, or None."""
    nodes = settle(root)
    body = nodes[1]
    with_text = [x for x in nodes[1:] if x.chars]
    if not with_text:
        return None
    core = densest(with_text)
    path = [core]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    if body.main is False:
        for tag in (("article",), ("main",)):
            for node in path:
                if node.main and (node.tag in tag or tag == ("main",)):
                    return node
        inside = [x for x in with_text if x.tag == "article" and 2 * x.chars > body.chars]
        if inside:
            return inside[0]
    threshold = min(x.density for x in path)
    while core.parent is not None and core is not body and (core.tag in _LEAF or core.parent is not body and core.parent.density >= threshold and 2 * core.parent.link_chars < core.parent.chars):
        core = core.parent
    return core


def block_text(node: Node) -> str:
    """The text of a subtree without its cut parts: one line per block."""
    lines, pieces = [], []

    def flush() -> None:
        line = " ".join(entities.unescape("".join(pieces)).split())
        if line:
            lines.append(line)
        pieces.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.__class__ is str:
            pieces.append(x)
        elif not x.cut or x is node:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            elif x.tag in ("br", "td", "th"):
                pieces.append(" ")
            todo += reversed(x.parts)
    flush()
    return "\n".join(lines)


def extract(page: str | None) -> str:
    """The main text of a page; empty if none."""
    if not page:
        return ""
    node = main_node(parse(page))
    return block_text(node) if node is not None else ""


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars (code points). Narrow: no shuffle."""

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
