"""Operator 10: main text of web pages by tree scoring.

A page becomes a tree; every paragraph of some length passes points - one, one for each comma, up to three for length - to its
parent, half of them to its grandparent, and a falling share to ancestors above.  A container's points, with a
bonus or malus for its tag and its class and id, are discounted by its link density.  The best container is kept, with
those of its siblings that score well or read like prose.  Scripts, styles, comments, controls of forms and
navigation never count.

The parser is one compiled regular expression over the page and a stack; end tags that HTML lets authors leave
out (p, li, td, ...) are implied, unknown or unmatched ones ignored.  Time is linear in the page, however deep or broken its markup.
LEAST_PARAGRAPH, LEVELS and SIBLING are parameters of the scoring; the names in _GOOD and _BAD are those that public
readability scorers look for.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import lean, light_batches, table

#: Characters that a paragraph must have to pass points.
LEAST_PARAGRAPH = 25
#: Ancestors that get points.
LEVELS = 5
#: Share of the best score that a sibling must reach.
SIBLING = 0.2

#: Quantifiers that don't give back keep the scan linear on broken markup.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: Elements whose inside is no text of the page: up to their end tag or, where there is none, the end of the page for the first two, else nothing but the tag.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template textarea iframe svg math select button".split()}
_UNENDED = frozenset(("script", "style"))
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"\bads?\b|advert|banner|combx|comment|contact|foot|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|tags|widget|\bnav|menu|breadcrumb|cookie|popup", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav footer aside head".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PARAGRAPH = frozenset("p pre td blockquote li".split())
_TAG_SCORE = {"div": 5, "article": 8, "main": 8, "section": 4, "pre": 3, "td": 3, "blockquote": 3}
_TAG_SCORE |= dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th header".split(), -5)
#: Open elements that a start tag closes, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSES |= {tag: ({"p"}, {"td", "th", "table", "button", "object"}) for tag in _BLOCK - {"br", "li", "dt", "dd", "tr", "td", "th", "html", "body", "tbody", "thead", "tfoot"}}


class Node:
    __slots__ = ("tag", "names", "parent", "children", "score", "chars", "link_chars", "commas", "skipped")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node | str] = []
        self.score, self.chars, self.link_chars, self.commas = None, 0, 0, 0
        self.skipped = tag in _SKIP or bool(names and tag not in ("html", "body", "article", "main") and _BAD.search(names) and not _GOOD.search(names))


class _Open:
    """The open elements, innermost last, and where those of each tag are among them."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def innermost(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.at[self.stack.pop().tag].pop()


def parse(page: str) -> Node:
    """The tree of a page, without what never holds main text."""
    root = Node("#root", "", None)
    open_, at, end, unended = _Open(root), 0, page.rfind(">") + 1, set()  # behind the last > there is only text
    while m := _TOKEN.search(page, at, end):
        if m.start() > at:
            open_.stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.lower()
        if m.group("end"):
            if depth := open_.innermost((tag,)):
                open_.close(depth)
            continue
        attrs = m.group("attrs")
        if tag in _RAW:
            if attrs.endswith("/") and tag not in _UNENDED or tag in unended:
                continue
            ending = _RAW[tag].search(page, at)
            if ending:
                at = ending.end()
            elif tag in _UNENDED:
                return root
            else:
                unended.add(tag)
            continue
        if tag in _CLOSES:
            closed, scope = _CLOSES[tag]
            while (depth := open_.innermost(closed)) > open_.innermost(scope):
                open_.close(depth)
        names = " ".join(x[0] or x[1] or x[2] for x in _NAMES.findall(attrs)) if "=" in attrs else ""
        node = Node(tag, names, open_.stack[-1])
        node.parent.children.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            open_.push(node)
    if at < len(page):
        open_.stack[-1].children.append(page[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Nodes in document order, with counts of their characters, commas and linked characters; strings become plain text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skipped:
            continue
        order.append(node)
        for i, x in enumerate(node.children):
            if isinstance(x, str):
                x = node.children[i] = html.unescape(x) if "&" in x else x
                node.chars += len("".join(x.split()))
                node.commas += x.count(",")
        todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    for node in reversed(order):
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.commas += node.commas
            node.parent.link_chars += node.link_chars
    return order


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _weight(node: Node) -> float:
    score = float(_TAG_SCORE.get(node.tag, 0))
    if node.names:
        score += 25 * bool(_GOOD.search(node.names)) - 25 * bool(_BAD.search(node.names))
    return score


def _lines(nodes: list[Node]) -> str:
    """Text of nodes, a line for each block."""
    out: list[str] = []
    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            out.append("\n")
        elif isinstance(x, str):
            out.append(x.replace("\n", " "))
        elif not x.skipped:
            block = x.tag in _BLOCK
            todo += [None] * block + list(reversed(x.children)) + [None] * block
    return "\n".join(line for line in (" ".join(x.split()) for x in "".join(out).split("\n")) if line)


def extract(page: str | None) -> tuple[str | None, str | None, float]:
    """(title, main text, score of the best container) of a page; (None, None, 0) for null."""
    if page is None:
        return None, None, 0.0
    title = _TITLE.search(page)
    title = " ".join(html.unescape(title.group(1)).split()) if title else None
    root = parse(page)
    order = _measure(root)
    candidates: dict[int, Node] = {}
    for node in order:
        if node.tag not in _PARAGRAPH or node.chars < LEAST_PARAGRAPH or any(isinstance(x, Node) and x.tag in _PARAGRAPH for x in node.children):
            continue
        points = 1 + node.commas + min(node.chars // 100, 3)
        up, level = node.parent, 0
        while up is not None and level < LEVELS:
            if up.tag != "#root":
                if up.score is None:
                    up.score = _weight(up)
                    candidates[id(up)] = up
                up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    best = None
    for node in order:
        if id(node) in candidates:
            node.score *= 1 - _density(node)
            if best is None or node.score > best.score:
                best = node
    if best is None:
        return title, _lines([root]), 0.0
    least = max(10.0, best.score * SIBLING)
    kept = []
    for x in best.parent.children:
        if isinstance(x, str) or x.skipped:
            continue
        bonus = best.score * SIBLING if x.names and x.names == best.names else 0.0
        prose = x.tag == "p" and (x.chars > 80 and _density(x) < 0.25 or 0 < x.chars <= 80 and x.link_chars == 0 and _lines([x])[-1:] in ".!?")
        if x is best or x.score is not None and x.score + bonus >= least or prose:
            kept.append(x)
    return title, _lines(kept), round(best.score, 6)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row (page_id, title, text, n_chars, score) for each row of pages (page_id, html).

    A null page has a null title and text; one without markup or without any paragraph that passes points gives all
    its visible text, with score 0; of equally good containers the first in the page is taken.  Pages without a title have null.
    Repeated rows give repeated rows; other columns are ignored.
    """
    light_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            got = [extract(x.as_py()) for x in batch.column(1)]
            texts = pa.array([x[1] for x in got], pa.string())
            n = pa.array([None if x[1] is None else len(x[1]) for x in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), texts, n, pa.array([x[2] for x in got], pa.float64())], ["page_id", "title", "text", "n_chars", "score"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(lean(run), "page_id long, title string, text string, n_chars long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
