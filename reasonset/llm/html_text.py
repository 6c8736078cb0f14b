"""Main text of web pages by composite text density.

A page becomes a tree without what is never text (scripts, styles, forms) and without parts that say by tag, role or
class that they are menus, headers, footers, sidebars, notices, adverts or comments. Every node then gets the density

    C / T * log(C / LC * T / LT, base = ln(C / (C - LC) * LC + LCb / Cb * C + e))

of its characters C, tags T, link characters LC and link tags LT (those of the body with b; none of them below 1). A node's sum is that of
its children's densities. The node of the largest sum leads; the smallest density on its way to the body, that of the body aside, is
the threshold: every subtree that is as dense is text, whole, and nothing else is (all of the body where the body itself leads).

Tags and marks are evidence beside the densities. Where the leading node stands in an article (or main), a subtree outside all of them
has to reach the threshold by the sum of its children as well, as a single dense line does not. A broad mark such as ``social`` or
``related`` inside an article only takes a block away that also has a third of its characters in links, or form fields.

Blocks are separated by block-level tags and line breaks; white space inside is one space; blocks are joined by one space.

Defined results: a null, empty or textless page has an empty text; tags that are never closed end with their parent; a tag cut off at the
end is dropped, text before it stays; rows are independent, so repeated rows and ties in ids need no rule; of equal sums the
first node in page order is taken. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?=[a-zA-Z/])[^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# The groups of HTML elements and the names by which pages mark what is not their text.
RAW = frozenset("script style noscript template textarea iframe noframes title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = RAW | frozenset("head nav footer aside form button select option svg canvas object audio video map dialog menu datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("br td th tr tbody thead tfoot caption html body summary figcaption".split())
SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPES = frozenset("html body table ul ol dl div section article main td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert sidebar sidebars"
    " comment comments disqus respond nav navbar navigation menu breadcrumb breadcrumbs footer popup modal overlay newsletter subscribe signup share sharing social related"
    " recommended widget toolbar pagination pager".split()
)
BROAD_MARKS = frozenset("social related alert notice notification promo promotion banner widget share sharing recommended respond overlay popup".split())
FIELDS = frozenset("form button select input option datalist".split())
HEADER_MARKS = frozenset("header masthead topbar".split())
ROOTS = frozenset("html body article main".split())


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no part of the text, and whether it is only suspected of that."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True, False
    if not attributes or tag in ROOTS:
        return False, False
    suspected = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = {w.lower() for w in _CLASS_WORD.findall(value)}
            marks = words & MARKS | (set() if in_article else words & HEADER_MARKS)
            if marks - (BROAD_MARKS if in_article else set()):
                return True, False
            suspected = suspected or bool(marks)
            continue
        value = value.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return False, suspected


class Tree:
    """Nodes in page order with counts over their subtrees; pieces of text in page order."""

    def __init__(self, page: str):
        self.tags, self.parent, self.first, self.last = ["body"], [-1], [0], [0]
        self.chars, self.links = [0], [0]  # of the subtree
        self.pieces: list[str] = []
        self.in_article = [False]
        self._suspected: list[int] = []
        self._fields: set[int] = set()  # nodes with form fields in them
        self._open = [0]
        self._names = ["body"]
        self._in_links = 0
        self._build(page)
        while self._open:
            self._pop()
        for i in range(len(self.tags) - 1, 0, -1):
            self.chars[self.parent[i]] += self.chars[i]
            self.links[self.parent[i]] += self.links[i]
            if i in self._fields:
                self._fields.add(self.parent[i])
        self.gone = [False] * len(self.tags)
        for node in self._suspected:
            if not self.gone[node] and (node in self._fields or 3 * self.links[node] >= max(1, self.chars[node])):
                self._remove(node)

    def _remove(self, node: int) -> None:
        """Takes a subtree away; its nodes follow each other in page order."""
        chars, links, at = self.chars[node], self.links[node], self.parent[node]
        while at >= 0:
            self.chars[at] -= chars
            self.links[at] -= links
            at = self.parent[at]
        inside = node
        while inside < len(self.tags) and (inside == node or self.gone[self.parent[inside]]):
            self.gone[inside], self.chars[inside], self.links[inside] = True, 0, 0
            inside += 1
        self.pieces[self.first[node] : self.last[node]] = ["\n"] * (self.last[node] - self.first[node])

    def _pop(self) -> None:
        node = self._open.pop()
        self._in_links -= self._names.pop() == "a"
        self.last[node] = len(self.pieces)

    def _text(self, text: str) -> None:
        if not text:
            return
        if "&" in text:
            text = html.unescape(text)
        n = len("".join(text.split()))
        self.pieces.append(text)
        self.chars[self._open[-1]] += n
        self.links[self._open[-1]] += n if self._in_links else 0

    def _close_to(self, names: tuple[str, ...], scopes: frozenset[str]) -> None:
        """Closes the innermost open element of the given names, with all inside it, unless a scope lies between."""
        for k in range(len(self._names) - 1, 0, -1):
            if self._names[k] in names:
                while len(self._names) > k:
                    self._pop()
                return
            if self._names[k] in scopes:
                return

    def _build(self, page: str) -> None:
        at, skip, depth = 0, None, 0
        while True:
            found = _TOKEN.search(page, at)
            if not found:
                if skip is None:
                    self._text(page[at:])
                return
            if skip is None and found.start() > at:
                self._text(page[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag, closing, attributes = found[2].lower(), bool(found[1]), found[3] or ""
            if tag in RAW and not closing and not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, at)
                at = end.start() if end else len(page)
                close = page.find(">", at)
                at = close + 1 if end and close >= 0 else len(page)
                continue
            if skip is not None:  # inside a part that is left out: only its own end counts
                if tag == skip and tag not in VOID and not attributes.endswith("/"):
                    depth += -1 if closing else 1
                if not depth or (closing and tag in ("body", "html", "article", "main") and tag in self._names):
                    skip = None
                    if closing and tag in ("article", "main"):
                        self._close_to((tag,), frozenset())
                continue
            if closing:
                if tag in BLOCK:
                    self.pieces.append("\n")
                if tag not in ("html", "body"):
                    self._close_to((tag,), SCOPES - {tag} if tag not in ("article", "main", "section", "div") else frozenset())
                continue
            if tag in BLOCK:
                self.pieces.append("\n")
            if tag in ENDS_P:
                self._close_to(("p",), SCOPES)
            if tag in SAME:
                self._close_to(SAME[tag], frozenset(("ul", "ol", "dl", "table")))
            if tag in ("html", "body"):
                continue
            in_article = "article" in self._names or "main" in self._names
            skipped, suspected = _left_out(tag, attributes, in_article)
            if tag in FIELDS:
                self._fields.add(self._open[-1])
            if skipped:
                if tag not in VOID and not attributes.endswith("/"):
                    skip, depth = tag, 1
                continue
            node = len(self.tags)
            self.tags.append(tag)
            self.parent.append(self._open[-1])
            self.first.append(len(self.pieces))
            self.last.append(len(self.pieces))
            self.chars.append(0)
            self.links.append(0)
            self.in_article.append(in_article or tag in ("article", "main"))
            if suspected:
                self._suspected.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                self._open.append(node)
                self._names.append(tag)
                self._in_links += tag == "a"

    def text(self, node: int) -> str:
        return " ".join("".join(self.pieces[self.first[node] : self.last[node]]).split())


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """The composite density of every node, and the sum over its children."""
    n = len(tree.tags)
    tags, link_tags = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not tree.gone[i]:
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tree.tags[i] == "a")
    ratio = tree.links[0] / max(1, tree.chars[0])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c = tree.chars[i]
        if c:
            t, lc, lt = max(1, tags[i]), max(1, tree.links[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - tree.links[i]) * tree.links[i] + ratio * c + math.e)
            density[i] = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t * math.log(max(1.0, c / lc * t / lt))
        if i:
            sums[tree.parent[i]] += density[i]
    return density, sums


def chosen_nodes(tree: Tree) -> list[int]:
    """The nodes whose whole text is main text, in page order; some may lie inside others."""
    density, sums = densities(tree)
    n = len(tree.tags)
    best = max(range(n), key=lambda i: (sums[i], density[i], -i))
    if best == 0:
        return [0]
    threshold, at = density[best], tree.parent[best]
    while at > 0:
        threshold, at = min(threshold, density[at]), tree.parent[at]
    known = tree.in_article[best]
    chosen = {i for i in range(1, n) if density[i] >= threshold > 0 and (not known or tree.in_article[i] or sums[i] >= threshold)}
    return sorted(chosen | {best}, key=lambda i: (tree.first[i], -tree.last[i]))


def main_text(page: str) -> str:
    tree = Tree(page)
    if not tree.chars[0]:
        return ""
    out, until = [], -1
    for i in chosen_nodes(tree):
        if tree.last[i] > until:
            out.append(tree.text(i) if tree.first[i] >= until else "")
            until = max(until, tree.last[i])
    return " ".join(x for x in out if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html"):
        texts = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, columns: tuple[str, str, str] = ("page_id", "url", "html")) -> DataFrame:
    """``page_id``, ``url`` and main ``text`` per page."""
    page_id, url, page = columns
    only = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return only.mapInArrow(_extract, "page_id long, url string, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
