"""The running text of web pages: a tree of each page in Arrow batches, navigation dropped by the density of text and links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 12_000
EMPTY = "extract_error: empty content"
#: Elements without end tags; those whose content is never text; those that begin a block; names of parts that are not the page's own text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math head nav header footer aside form button select iframe object table figure".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset h1 h2 h3 h4 h5 h6 hr html li main ol p pre section ul".split())
SIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|promo\w*|sponsor\w*|banner|cookies?|consent|menu|navbar|nav|sidebar|breadcrumbs?|share|social|related|comments?|newsletter|popup|footer|header)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("children", "dropped", "tag")

    def __init__(self, tag: str, dropped: bool = False):
        self.tag, self.dropped, self.children = tag, dropped, []


class Tree(HTMLParser):
    """Elements and texts of a page; end tags that are missing or in excess do no harm."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.open[-1].tag == "p":  # a block ends an open paragraph
            self.open.pop()
        if tag == "li" and any(n.tag == "li" for n in self.open):
            self.end("li", {"ul", "ol"})
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        node = Node(tag, tag in SKIPPED or bool(SIDE.search(named)) or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag))

    def handle_endtag(self, tag):
        self.end(tag, set())

    def end(self, tag, within):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in within:
                return
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def blocks(root: Node) -> list[tuple[str, int]]:
    """Text of each block in order and how many of its characters are in links, without a recursion."""
    out, text, linked = [], [], 0

    def flush():
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, linked))
        text, linked = [], 0

    stack: list[tuple] = [(root, False)]
    while stack:
        node, in_link = stack.pop()
        if isinstance(node, str):
            text.append(node)
            linked += len(" ".join(node.split())) if in_link else 0
        elif node is None:
            flush()
        elif not node.dropped:
            if node.tag in BLOCK:
                flush()
                stack.append((None, False))
            if node.tag == "br":
                text.append(" ")
            stack += [(child, in_link or node.tag == "a") for child in reversed(node.children)]
    flush()
    return out


def weight(root: Node) -> int:
    """Characters of running text below a node: those of blocks that are long and not mostly links."""
    return sum(len(t) - linked for t, linked in blocks(root) if len(t) >= 25 and linked * 2 < len(t))


def main_part(root: Node) -> Node:
    """The article or main element if it has most of the text, else the deepest element that has nearly all of it."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Node) and not node.dropped:
            if node.tag in ("article", "main"):
                found.append(node)
            stack += node.children
    whole = weight(root)
    named = max(found, key=weight, default=None)
    if named is not None and whole and weight(named) >= 0.5 * whole:
        return named
    while True:  # down as long as one child keeps the text
        inner = [c for c in root.children if isinstance(c, Node) and not c.dropped and c.tag in BLOCK and c.tag not in ("p", "li")]
        best = max(inner, key=weight, default=None)
        if best is None or not whole or weight(best) < 0.9 * whole:
            return root
        root = best


def running_text(html: str) -> str:
    """A page's own text, a block a line; blocks that are mostly links are left out."""
    part = main_part(Tree(html).root)
    return "\n".join(t for t, linked in blocks(part) if linked * 2 < len(t) or len(t) == 0)


def extracted(html: Column, most: int = MOST) -> Column:
    """``struct<text, error>``: the running text, cut at ``most`` characters as sources are, or why there is none; null for null."""
    kind = pa.struct([("text", pa.string()), ("error", pa.string())])

    def row(page: str | None) -> dict | None:
        if page is None:
            return None
        try:
            text = running_text(page)
        except (ValueError, AssertionError) as e:
            return {"text": None, "error": f"extract_error: {e}"}
        return {"text": text[:most], "error": None} if text else {"text": None, "error": EMPTY}

    return F.arrow_udf(lambda pages: pa.array([row(p) for p in pages.to_pylist()], kind), "text string, error string")(html)
