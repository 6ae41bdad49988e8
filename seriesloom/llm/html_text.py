"""Main text of web pages by composite text density.

Elements that never belong to an article by tag or role (scripts, forms, menus, page headers and footers, asides) or that are hidden
are cut off the DOM tree first. Every node then has its characters per
tag, adjusted for the share of link text, and the sum of its children's densities. Elements whose class or id has a word
of ``NOT_ARTICLE`` (sidebars, notices, adverts, reader comments) take part in this; they are cut off afterwards, unless the node of the largest sum lies
in them (of the largest in an ``article`` or ``main`` element, where there is one), and the rest is weighed anew. The node of the largest sum is
the article; the least density on its path to the body is the threshold above which other subtrees add their
own node of the largest sum. Where the article lies in an ``article`` or ``main`` element, that element is taken whole.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import batches_of, slim

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset("head title script style noscript template svg math iframe object canvas form button input select textarea nav header footer aside dialog menu audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: an opening tag ends the open elements of these kinds first, up to the nearest of the second kinds
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "thead": ({"tr", "td", "th", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "dd", "dt", "li"} | {"li", "dd", "dt"}
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments reply replies disqus "
    "popup modal overlay widget login search pagination pager copyright legal disclaimer toolbar skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_TAG = re.compile(r"<!--|<([/!?]?)([a-zA-Z][^\s/>]*)?((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked", "listed")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.marked = self.listed = False


def not_article(tag: str, attributes: str) -> str:
    """"cut" for what never belongs to an article, "listed" for what words of class and id speak against, else empty."""
    if tag in CUT:
        return "cut"
    if not attributes or attributes.isspace():
        return ""
    found = ""
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            if any(w.lower() in NOT_ARTICLE for w in _NAMES.findall(value)):
                found = "listed"
        elif name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "cut"
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return "cut"
    return found


def parse(page: str) -> Node:
    """The DOM tree without what is no part of an article. Text is kept as strings among the children."""
    root = Node("html", None)
    now, at, end, cut = root, 0, len(page), 0  # cut: open elements inside one that is left out, itself included
    cut_stack: list[str] = []
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not cut_stack:
            now.children.append(page[at:lt])
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        match = _TAG.match(page, lt)
        slash, tag, attributes = match.groups()
        if not tag:
            if slash:  # a declaration, or an end tag without a name
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                if not cut_stack:
                    now.children.append("<")
                at = lt + 1
            continue
        at = match.end()
        if not page[lt:at].endswith(">"):  # the page ends inside a tag, or a new tag begins in it
            if at == end:
                break
        if slash in ("!", "?"):
            continue
        tag = tag.lower()
        if slash:
            if cut_stack:
                if tag in cut_stack:
                    while cut_stack.pop() != tag:
                        pass
                elif tag in ("body", "html"):
                    cut_stack.clear()
                continue
            node = now
            while node is not root and node.tag != tag:
                if node.tag in BLOCK and tag not in BLOCK:  # an inline end tag does not close a block
                    node = root
                    break
                node = node.parent
            if node is not root:
                now = node.parent
            continue
        closed = attributes.endswith("/")
        if cut_stack:
            # an element that was left open ends where a part of the page begins that it can't hold
            if tag in ("article", "main", "body") and cut_stack[0] not in ("aside", "nav", "div", "section", "form", "noscript", "template"):
                cut_stack.clear()
            else:
                if tag in RAW:
                    at = _after(page, at, tag)
                elif tag not in VOID and not closed and tag not in ("p", "li", "option", "dt", "dd", "td", "th", "tr"):
                    cut_stack.append(tag)
                continue
        if tag in ("html", "body"):
            if tag == "body" and not any(isinstance(c, Node) and c.tag == "body" for c in root.children):
                now = _open(root, "body")
            continue
        if tag in CLOSES_P:
            now = _close(now, {"p"}, {"td", "th", "button", "article", "section", "div"})
        if tag in ENDS:
            now = _close(now, *ENDS[tag])
        against = not_article(tag, attributes)
        if against == "cut" or against and (tag in RAW or tag in VOID or closed):
            if tag in RAW:
                at = _after(page, at, tag)
            elif tag not in VOID and not closed:
                cut_stack.append(tag)
            if tag in BLOCK:
                now.children.append(Node("br", now))
            continue
        if tag in RAW:
            at = _after(page, at, tag)
        elif tag in VOID or closed:
            now.children.append(Node(tag, now))
        else:
            now = _open(now, tag)
            now.listed = against == "listed"
    return root


def _open(parent: Node, tag: str) -> Node:
    node = Node(tag, parent)
    parent.children.append(node)
    return node


def _close(now: Node, kinds: set[str], within: set[str]) -> Node:
    """The element that stays open once the open ones of ``kinds`` are ended."""
    node, stay = now, now
    while node.parent is not None and node.tag not in within:
        if node.tag in kinds:
            stay = node.parent
        node = node.parent
    return stay


def _after(page: str, at: int, tag: str) -> int:
    """Where the raw text of an element ends."""
    close = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
    if not close:
        return len(page)
    end = page.find(">", close.end())
    return len(page) if end < 0 else end + 1


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def weigh(body: Node) -> list[Node]:
    """Fill in counts, densities and sums below ``body``."""
    nodes = nodes_of(body)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child) - child.count(" ") - child.count("\n")
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        tags, link_chars, link_tags, rest = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags), max(1, node.chars - node.link_chars)
        if node.chars:
            base = math.log(node.chars / rest * node.link_chars + share * node.chars + math.e)
            adjusted = node.chars / link_chars * tags / link_tags
            node.density = node.chars / tags * max(0.0, math.log(adjusted) / math.log(base) if base > 1 else math.log(adjusted + 1))
        children = [c for c in node.children if isinstance(c, Node)]
        node.total = sum(c.density for c in children) if children else node.density
    return nodes


def without_listed(body: Node, nodes: list[Node]) -> list[Node]:
    """The weighed nodes once listed elements are cut off in which the article does not lie."""
    if not any(n.listed for n in nodes):
        return nodes
    within: dict[int, bool] = {}
    for node in nodes:  # parents first
        within[id(node)] = node is not body and (node.tag in ("article", "main") or within[id(node.parent)])
    article = max([n for n in nodes if within[id(n)] and n.chars] or nodes, key=lambda n: n.total)
    while article is not body:
        article.listed = False
        article = article.parent
    for node in nodes:
        if any(isinstance(c, Node) and c.listed for c in node.children):
            rest = (Node("br", node) if isinstance(c, Node) and c.listed and c.tag in BLOCK else c for c in node.children)
            node.children = [c for c in rest if isinstance(c, str) or not c.listed]
    return weigh(body)


def mark(body: Node) -> None:
    """Mark the nodes that are content."""
    nodes = without_listed(body, weigh(body))
    best = max(nodes, key=lambda n: n.total)
    if best.chars == 0:
        return
    path, node = [], best
    while node is not body:
        path.append(node)
        node = node.parent
    threshold = min([n.density for n in path] + [body.density])
    for node in path:
        if node.tag in ("article", "main"):
            best = node
    best.marked = True
    whole = best.tag in ("article", "main")
    # other subtrees above the threshold; beside a marked article only further articles
    largest: dict[int, Node] = {}
    for node in reversed(nodes):
        own = node
        for child in node.children:
            if isinstance(child, Node) and largest[id(child)].total > own.total:
                own = largest[id(child)]
        largest[id(node)] = own
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density < threshold or node.chars == 0 or node.marked:
            continue
        if whole:
            node.marked |= node.tag == "article" and not _inside(best, node)
        else:
            largest[id(node)].marked = True
        stack.extend(c for c in node.children if isinstance(c, Node))


def _inside(node: Node, other: Node) -> bool:
    while node is not None:
        if node is other:
            return True
        node = node.parent
    return False


def main_text(page: str | None) -> str:
    """The text of a page's article: character references decoded, blocks and their words parted by one space."""
    if not page:
        return ""
    root = parse(page)
    body = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)
    mark(body)
    pieces: list[str] = []
    stack: list[tuple[object, bool]] = [(body, False)]
    while stack:
        node, on = stack.pop()
        if isinstance(node, str):
            if on:
                pieces.append(node)
            continue
        if node is None:
            pieces.append(" ")
            continue
        on = on or node.marked
        parted = node.tag in BLOCK or node.tag == "br"
        if parted:
            pieces.append(" ")
            stack.append((None, on))
        stack.extend((c, on) for c in reversed(node.children))
    return " ".join(html.unescape("".join(pieces)).split())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row.

    A null or empty page, and one without an article, gives an empty text. Repeated rows give repeated results, ids and urls
    may be null, an empty table gives no rows.
    """
    own = slim(pages, page_id=page_id, url=url, html=page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "html"):
            text = pa.array([main_text(p) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text})

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
