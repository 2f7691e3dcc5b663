"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Paths that carry the article hold
long texts with punctuation; paths of menus hold many short ones without. For each
path of a page the mean text length and the mean number of punctuation marks of its
nodes are taken, both are smoothed over neighbouring nodes and multiplied, and the
nodes of paths over a threshold of the page are content. The lowest block that holds
all of them is the article, and all its text belongs to it, short headings too.

Elements whose tag or class says that they are no article (menus, adverts, forms,
comments) are left out before, since reader comments have the ratios of an article. A
class that only begins or ends with such a word is a weaker sign: its element stays
inside an article, and wherever it holds most of the page's long punctuated text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlab.llm.words import chunks

# Fixed values of the markup language.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: An opening tag closes these elements if they are still open within the same block.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
SCOPES = frozenset("ul ol dl table article section div main aside nav header footer form blockquote body html".split())

LEFT_OUT_TAGS = RAW | frozenset("head nav aside footer form button select template svg canvas object dialog menu".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Readers' words, however long, are never the article's.
READERS = frozenset("comment comments disqus replies reply respond".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_MARKS = re.compile(r"[.,;:!?。，；：！？、…]")
_PARTS = re.compile(r"[a-z]+")
#: A text node this long with punctuation speaks for the element that holds it.
LONG_TEXT = 80


class _Node:
    __slots__ = ("tag", "parent", "out", "doubtful", "path")

    def __init__(self, tag, parent, out, doubtful):
        self.tag, self.parent, self.out = tag, parent, out
        #: The outermost element around this one that only its class's wording speaks against.
        self.doubtful = parent.doubtful if parent and parent.doubtful else self if doubtful else None
        self.path = f"{parent.path}/{tag}" if parent else tag


def _left_out(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """(left out, doubtful) of an element by its own tag, role and class."""
    if tag in LEFT_OUT_TAGS or (tag == "header" and not inside_article):
        return True, False
    if tag in ("html", "body", "article", "main"):
        return False, False
    doubtful = False
    for name, value in _NAMES.findall(attributes):
        tokens = value.strip("\"'").lower().split()
        if name.lower() == "role":
            if LEFT_OUT_ROLES & set(tokens):
                return True, False
            continue
        ends = {parts[at] for parts in map(_PARTS.findall, tokens) if parts for at in (0, -1)}
        if LEFT_OUT_NAMES & set(tokens) or READERS & ends:
            return True, False
        doubtful |= bool(LEFT_OUT_NAMES & ends)
    return False, doubtful and not inside_article


def text_nodes(page: str) -> list[tuple[_Node, int, str]]:
    """(element, block number, text) of each text node outside left-out elements, in page order."""
    root = _Node("", None, False, False)
    stack, block, out, at = [root], 0, [], 0

    def text(raw: str) -> None:
        if raw and not stack[-1].out:
            out.append((stack[-1], block, html.unescape(raw)))

    def close(to: int) -> None:
        nonlocal block
        for node in stack[to:]:
            block += node.tag not in INLINE
        del stack[to:]

    n = len(page)
    while at < n:
        opened = page.find("<", at)
        if opened < 0:
            text(page[at:])
            break
        text(page[at:opened])
        if page.startswith("<!--", opened):
            end = page.find("-->", opened + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), opened):
            end = page.find(">", opened)
            at = n if end < 0 else end + 1
            continue
        found = _TAG.match(page, opened)
        if not found:
            text("<")
            at = opened + 1
            continue
        closing, tag, attributes, at = found[1], found[2].lower(), found[3], found.end()
        for quote in "\"'":
            # A ">" within quotes does not end the tag.
            if attributes.count(quote) % 2:
                shut = page.find(quote, at)
                end = page.find(">", shut) if shut >= 0 else -1
                if end >= 0:
                    attributes, at = page[found.start(3) : end], end + 1
                break
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag in SCOPES:
                    break
            else:
                block += tag not in INLINE
            continue
        if tag not in INLINE:
            block += 1
        if tag in VOID:
            continue
        if tag not in INLINE or tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES.get(tag, ()) or stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES and tag != "body":
                    break
        parent = stack[-1]
        inside = any(s.tag in ("article", "main") for s in stack) if attributes or tag == "header" else False
        left_out, doubtful = _left_out(tag, attributes, inside)
        node = _Node(tag, parent, parent.out or left_out, doubtful)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not node.out:
                text(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if not attributes.endswith("/") or tag in SCOPES:
            stack.append(node)
    return _trusted(out)


def _trusted(nodes: list[tuple[_Node, int, str]]) -> list[tuple[_Node, int, str]]:
    """Without doubtful elements, but for those with more than half of the page's long punctuated text."""
    if not any(node.doubtful for node, _, _ in nodes):
        return nodes
    held: dict[_Node | None, int] = {}
    for node, _, text in nodes:
        if len(text.strip()) >= LONG_TEXT and _MARKS.search(text):
            held[node.doubtful] = held.get(node.doubtful, 0) + len(text)
    total = sum(held.values())
    return [row for row in nodes if row[0].doubtful is None or 2 * held.get(row[0].doubtful, 0) > total]


def _smoothed(values: np.ndarray) -> np.ndarray:
    """A narrow Gaussian over neighbouring nodes."""
    near = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    return np.convolve(np.pad(values, 2, mode="edge"), near / near.sum(), "valid")


def content_block(nodes: list[tuple[_Node, int, str]], share: float = 0.5) -> _Node | None:
    """The block that holds the page's content nodes."""
    nodes = [(node, text) for node, _, text in nodes if text.strip()]
    if not nodes:
        return None
    paths: dict[str, list[int]] = {}
    sizes = np.array([len(t.strip()) for _, t in nodes], float)
    marks = np.array([len(_MARKS.findall(t)) for _, t in nodes], float)
    for i, (node, _) in enumerate(nodes):
        paths.setdefault(node.path, []).append(i)
    length, points = np.empty(len(nodes)), np.empty(len(nodes))
    for own in paths.values():
        length[own], points[own] = sizes[own].mean(), marks[own].mean()
    fused = _smoothed(length) * (0.1 + _smoothed(points))
    content = [i for own in paths.values() if fused[own].mean() >= share * fused.mean() for i in own]
    inside = [i for i in content if any(n.tag == "article" for n in _above(nodes[i][0]))]
    if 2 * sizes[inside].sum() >= sizes[content].sum():
        content = inside
    # The deepest block above every content node; an article around it holds its title too.
    held: dict[_Node, int] = {}
    for i in content:
        for node in _above(nodes[i][0]):
            held[node] = held.get(node, 0) + 1
    around = [n for n in _above(nodes[content[0]][0]) if held[n] == len(content) and (n.tag in SCOPES or n.parent is None)]
    return next((n for n in around if n.tag == "article"), around[0])


def _above(node: _Node) -> list[_Node]:
    """The element and all around it, from the inside out."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def main_text(page: str | None) -> str:
    """Blocks of the page's article, one a line."""
    nodes = text_nodes(page or "")
    holder = content_block(nodes)
    blocks: dict[int, list[str]] = {}
    inside: dict[_Node, bool] = {}
    for node, block, text in nodes:
        if node not in inside:
            up = node
            while up is not None and up is not holder:
                up = up.parent
            inside[node] = up is not None
        if holder is not None and inside[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, html_column: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each page: the key columns, ``text`` and ``n_chars`` (code points).

    The whole page is read. A null or empty page, or one without an article, has an
    empty text. Repeated rows give equal rows; columns that are no key are ignored.
    """
    rows = pages.select(F.struct(*keys).alias("own"), F.col(html_column).alias("html"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            texts = [main_text(page) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("own"), pa.array(texts, pa.string())], ["own", "text"])

    fields = rows.schema["own"].dataType.fields
    own = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    out = rows.mapInArrow(task, f"own struct<{own}>, text string")
    return out.select(*(F.col("own")[f.name].alias(f.name) for f in fields), "text", F.char_length("text").cast("long").alias("n_chars"))
