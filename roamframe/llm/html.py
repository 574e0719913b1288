"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks at block-level tags; a block's tag path leads from the root to the element that holds it. By
path, text length and punctuation are aggregated over its blocks; both ratios (per block) are smoothed over the
blocks in page order and fused as a product. Blocks in menus, headers, footers, sidebars, notices, adverts, forms and comments of readers are known by
tag, role or a whole name of class or id, and have paths of their own, whose ratio counts by a twentieth, or by a fiftieth where the tag says so: what
names mean is weighed, not cut out beforehand, and a class or id around over half of the page's text, by ratio, means nothing. Paths whose ratio reaches a share of the page's spread are content
paths, and these alone decide where the content is: the content element is the smallest one that holds most of the text on content paths, if need be with
the title that stands over it. The text, in order, is the blocks on content paths anywhere, all other blocks of the content element that no such name
holds, and the headings over any of them.

Null and empty pages have an empty text, as have pages without text. Broken and cut-off markup is read as far as it goes: an unfinished tag at
the end is dropped. Whole pages are read. Repeated rows stay rows; further columns are kept, but for one named like the result, which it replaces.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z|([^<]+|<)",
    re.DOTALL,
)
#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = frozenset("html body article main section div table td th ul ol dl blockquote nav aside header footer form".split())
NO_CONTENT = frozenset("head nav header footer aside button menu datalist".split())
#: These say as much as a name does: some pages have all their content in a form.
MAY_WRAP = frozenset("form dialog fieldset".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer"
    " cookie cookies consent notice notices alert popup modal overlay comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe signup login search pager pagination skip copyright".split()
)
#: An inline element marked with one of these is no part of its sentence.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo".split())
#: Their names of class and id mean nothing.
WHOLE = frozenset("html body main article".split())
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OPENED = re.compile(r"<([a-zA-Z][^\s/>]*)")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: A path is content from this share of the standard deviation of smoothed ratios on.
SHARE = 0.5
#: The content element holds at least this share of the text on content paths.
MOST = 0.7
#: What the ratio of a block counts: in no such element, in one known by name, in one known by tag.
PRIOR = (1.0, 0.05, 0.02)
#: Elements that are parts of a text: the content element is the next one around them.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd ul ol dl td th tr thead tbody table figure figcaption center font span".split())


def _marked(attributes: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a whole name of class or id is a mark (parts between hyphens are none), or the role is."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        names = next((v for v in values if v), "").lower().split()
        if any(x in (_ROLES if name.lower() == "role" and marks is MARKS else marks) for x in names):
            return True
    return False


class _Node:
    __slots__ = ("tag", "parent", "depth", "marked", "path")

    def __init__(self, tag: str, parent: _Node | None, marked: int):
        self.tag, self.parent, self.marked = tag, parent, marked
        self.depth = parent.depth + 1 if parent else 0
        self.path = f"{parent.path}/{tag}" if parent else tag


def blocks(html: str) -> list[tuple[_Node, str]]:
    """(element, text) of each block with text, in page order; inline elements and references are resolved."""
    root = _Node("", None, 0)
    at, held, found = root, [], []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                found.append((at, text))

    position = 0
    lower = None
    while match := _TOKEN.match(html, position):
        position = match.end()
        if (text := match[7]) is not None:
            held.append(text)
            continue
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            if tag in INLINE:
                continue
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                flush()
                at = node.parent
            elif tag not in VOID:
                flush()
            continue
        attributes = match[3] if match[2] else match[6]
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                if lower is None:
                    lower = html.lower()
                end = lower.find(f"</{tag}", position)
                close = html.find(">", end) if end >= 0 else -1
                position = close + 1 if close >= 0 else len(html)
            if tag not in INLINE:
                held.append(" ")
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                held.append(" ")
            elif tag not in VOID and _marked(attributes, ADVERTS) and not attributes.rstrip().endswith("/"):
                # An advert in a line of text is left out with what it holds, if that is no block.
                close = re.compile(rf"</?{tag}\b[^>]*>", re.IGNORECASE)
                depth = 1
                here = position
                while depth and (m := close.search(html, here)):
                    depth += -1 if m[0][1] == "/" else 1
                    here = m.end()
                if not depth and all(x.lower() in INLINE for x in _OPENED.findall(html[position:here])):
                    position = here
            continue
        flush()
        if tag in VOID:
            continue
        # Open paragraphs end where a block begins; list items and cells end where the next does.
        ends = CLOSES.get(tag, set())
        node = at
        while node is not root:
            if node.tag == "p" or node.tag in ends:
                at = node.parent
            if node.tag in SCOPE and node.tag not in ends:
                break
            node = node.parent
        at = _Node(tag, at, 2 if tag in NO_CONTENT else int(tag in MAY_WRAP or (tag not in WHOLE and _marked(attributes))))
        if attributes.rstrip().endswith("/") and tag not in SCOPE and tag != "p":
            at = at.parent
    flush()
    return found


def _smoothed(x: list[float]) -> list[float]:
    """Weighted with a Gaussian over two neighbours on each side, as far as there are any."""
    weights = [math.exp(-(k * k) / 2) for k in range(-2, 3)]
    out = []
    for i in range(len(x)):
        near = [(weights[k + 2], x[i + k]) for k in range(-2, 3) if 0 <= i + k < len(x)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


#: A block's tag path, and whether it is in an element known as no content by name (1) or tag (2).
Path = tuple[str, int]


def ratios(found: list[tuple[_Node, str]], paths: list[Path]) -> dict[Path, float]:
    """By path the mean of its blocks' smoothed and fused ratios of text length and punctuation, weighed by PRIOR."""
    length: dict[Path, int] = defaultdict(int)
    marks: dict[Path, int] = defaultdict(int)
    count: dict[Path, int] = defaultdict(int)
    for p, (_, text) in zip(paths, found, strict=True):
        length[p] += len(text)
        marks[p] += len(_PUNCTUATION.findall(text))
        count[p] += 1
    by_length = _smoothed([length[p] / count[p] for p in paths])
    by_marks = _smoothed([marks[p] / count[p] for p in paths])
    sums: dict[Path, float] = defaultdict(float)
    for p, a, b in zip(paths, by_length, by_marks, strict=True):
        sums[p] += a * (1 + b) * PRIOR[p[1]]
    return {p: sums[p] / count[p] for p in sums}


def content_paths(found: list[tuple[_Node, str]], paths: list[Path]) -> set[Path]:
    """The paths whose ratio reaches SHARE of the standard deviation over all blocks, and the best one."""
    ratio = ratios(found, paths)
    of = [ratio[p] for p in paths]
    mean = sum(of) / len(of)
    spread = math.sqrt(sum((x - mean) ** 2 for x in of) / len(of))
    return {p for p, x in ratio.items() if x >= SHARE * spread} | {max(ratio, key=lambda p: ratio[p])}


def _weights(found: list[tuple[_Node, str]], paths: list[Path], content: set[Path]) -> dict[_Node, int]:
    """By element the length of its text on content paths."""
    weight: dict[_Node, int] = defaultdict(int)
    for (node, text), p in zip(found, paths, strict=True):
        if p in content:
            while node is not None:
                weight[node] += len(text)
                node = node.parent
    return weight


def _paths(found: list[tuple[_Node, str]]) -> list[Path]:
    """The path of each block. An element that holds over half of the page's text, by ratios without regard to names, is content whatever its class or id."""
    weight = None

    def named(node: _Node | None) -> int:
        nonlocal weight
        found_ = 0
        while node is not None and found_ < 2:
            if node.marked == 2:
                found_ = 2
            elif node.marked and not found_:
                if weight is None:
                    plain = [(n.path, 0) for n, _ in found]
                    weight = _weights(found, plain, content_paths(found, plain))
                found_ = int(2 * weight[node] <= max(weight.values()))
            node = node.parent
        return found_

    return [(node.path, named(node)) for node, _ in found]


def _titled(content: _Node, found: list[tuple[_Node, str]]) -> _Node:
    """content, or if no title is in it, the smallest element around it, short of the body, that holds one."""
    over: set[_Node] = set()
    for node, _ in found:
        if node.tag in ("h1", "h2"):
            while node is not None:
                over.add(node)
                node = node.parent
    node = content
    while node is not None and node.parent is not None and node.tag not in ("html", "body"):
        if node in over:
            return node
        node = node.parent
    return content


def main_text(html: str) -> str:
    """The text of a page's content, a line per block."""
    found = blocks(html)
    if not found:
        return ""
    paths = _paths(found)
    content = content_paths(found, paths)
    weight = _weights(found, paths, content)
    element = max([n for n, w in weight.items() if w >= MOST * max(weight.values())], key=lambda n: n.depth)
    while element.tag in PARTS and element.parent is not None:
        element = element.parent
    element = _titled(element, found)
    kept = []
    for (node, _), p in zip(found, paths, strict=True):
        while node is not None and node is not element:
            node = node.parent
        kept.append(p in content or (node is element and not p[1]))
    # A heading goes with the block that it stands over.
    for k in range(len(found) - 2, -1, -1):
        kept[k] = kept[k] or (found[k][0].tag in HEADINGS and not paths[k][1] and kept[k + 1])
    return "\n".join(text for (_, text), x in zip(found, kept, strict=True) if x)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each in a column; all other columns are kept."""

    @F.pandas_udf("string")
    def of(html):
        return html.map(main_text)

    return pages.withColumn(out, of(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
