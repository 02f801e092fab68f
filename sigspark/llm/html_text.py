"""Main text of HTML pages by tag-path ratios.

Text length, punctuation and link text are aggregated per root-to-leaf tag path of a page. The
ratios are fused, smoothed over neighbouring blocks of the same or a sibling path, and paths whose score reaches a part of the page's mean (weighted
by text) are content. The content's nodes select: on a page with article or main elements those of them that hold content
come out whole; on other pages the deepest element that holds nearly all content, from the first to the last of it.
Elements that never hold an article's text (menus, headers, footers,
sidebars, forms, scripts, adverts, reader comments), by tag or by class, id and role, are cut before.
"""

from __future__ import annotations

import html as htmllib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import light_batches, pick, table

#: Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object select xmp noembed noframes".split())
BOILER = frozenset("head nav header footer aside form button dialog menu label fieldset legend figure".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Class tokens, ids and roles that mark furniture, whole; parts such as has- or no- before them say something else.
_FURNITURE = re.compile(
    r"(?!(?:[^\s]*[_-])?(?:has|have|no|not|with|without)[_-])(?:[^\s]*[_-])?(?:ad|ads|advert\w*|adbox|banner|breadcrumbs?|byline|comments?|commentlist|cookies?|consent|copyright|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|tags|toolbar|widget)(?:[_-][^\s]*)?",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|$)|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
#: An attribute, name and value, whole: what stands inside a value is no attribute.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?。，；：！？、]")
#: A path is content if its score reaches this part of the page's mean score, weighted by text.
THRESHOLD = 0.65
#: Weight of a neighbouring block of a sibling path in smoothing; share of the content that the main element holds.
SIBLING, MAIN = 0.25, 0.9
#: Share of a block's text inside links above which it is a list of links.
LINKS = 0.6


class _Node:
    __slots__ = ("element", "path", "text", "linked", "heading", "inside")

    def __init__(self, element: int, path: int, heading: bool, inside: int):
        self.element, self.path, self.text, self.linked, self.heading, self.inside = element, path, [], 0, heading, inside


class Page:
    """A page's text blocks outside of furniture, in page order, and its open elements and tag paths.

    Elements and paths are numbers; parents[e] and path_parents[p] are those one level up (0, the page, is its own), and
    holders[c] is the article or main element around the article or main element c (0: none)."""

    def __init__(self) -> None:
        self.nodes: list[_Node] = []
        self.parents, self.path_parents, self.holders = [0], [0], [0]
        self._paths: dict[tuple[int, str], int] = {}

    def element(self, parent: int, path: int, name: str) -> tuple[int, int]:
        """A new element below parent: its number and its path."""
        own = self._paths.get((path, name))
        if own is None:
            own = self._paths[path, name] = len(self.path_parents)
            self.path_parents.append(path)
        self.parents.append(parent)
        return len(self.parents) - 1, own


def blocks(page: str) -> Page:
    """Read a page, which may be broken in any way, from its first to its last character."""
    out = Page()
    stack: list[tuple[str, int, int]] = []  # open elements that are no inline elements: tag, element, path
    opened: dict[str, int] = {}  # how many of a tag are open
    containers: list[tuple[int, int]] = []  # (depth, number) of the open article or main elements
    links = skip = 0  # skip: depth of the furniture element that is open, from 1
    node: _Node | None = None
    at, n = 0, len(page)

    def close(depth: int) -> None:
        nonlocal skip
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1
        if skip > depth:
            skip = 0
        while containers and containers[-1][0] >= depth:
            containers.pop()

    def take(text: str) -> None:
        nonlocal node
        if skip or not text:
            return
        if node is None:
            if text.isspace():
                return
            heading = any(t[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for t in stack[-2:])
            node = _Node(stack[-1][1] if stack else 0, stack[-1][2] if stack else 0, heading, containers[-1][1] if containers else 0)
            out.nodes.append(node)
        node.text.append(text)
        if links:
            node.linked += len(text)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            take(page[at:start])
        if start == n:
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a lone <
            take("<")
            at = start + 1
            continue
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                node = None
                if opened.get(name) and name not in ("html", "body"):
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    close(depth)
            continue
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                take(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if name == "br":
            take(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else n
            continue
        if name in VOID:
            if name == "hr":
                node = None
            continue
        if name in INLINE:
            links += name == "a"
            continue
        node = None
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
            # An unclosed paragraph or item ends where the next begins; any block ends a paragraph.
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            if stack[-1][0] in same:
                close(len(stack) - 1)
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        above = stack[-1] if stack else ("", 0, 0)
        stack.append((name, *out.element(above[1], above[2], name)))
        opened[name] = opened.get(name, 0) + 1
        if not skip:
            attributes: dict[str, str] = {}
            for k, v in _ATTRIBUTE.findall(m[3]) if m[3] else ():
                attributes.setdefault(k.lower(), v.strip("\"'"))  # of a repeated attribute the first counts
            named = " ".join([attributes.get(k, "") for k in ("class", "id", "role")]).split()
            furniture = name in BOILER and not (name == "header" and containers) and name != "figure"
            marked = [w for w in named if _FURNITURE.fullmatch(w)]
            if containers:
                marked = [w for w in marked if "header" not in w.lower()]
            if name not in ("article", "main", "body", "html") and (furniture or "hidden" in attributes or marked):
                skip = len(stack)
            elif name in ("article", "main"):
                out.holders.append(containers[-1][1] if containers else 0)
                containers.append((len(stack) - 1, len(out.holders) - 1))
    return out


def path_scores(nodes: list[tuple[int, int, int, int]], path_parents: list[int]) -> dict[int, float]:
    """The score of each path of (path, text length, punctuation, text length in links) nodes in page order.

    The ratios of a path, text and punctuation per node, are fused as the logarithm of their product and lowered by the path's share
    of links; nodes are smoothed with the ones before and behind, if of the same or a sibling path."""
    totals: dict[int, list[int]] = {}
    for path, size, marks, linked in nodes:
        t = totals.setdefault(path, [0, 0, 0, 0])
        for k, v in enumerate((size, marks, linked, 1)):
            t[k] += v
    fused = {p: math.log1p(t / n) + math.log1p(m / n) for p, (t, m, _, n) in totals.items()}
    fused = {p: v * (1 - min(1.0, totals[p][2] / max(1, totals[p][0]))) for p, v in fused.items()}
    sums = dict.fromkeys(totals, 0.0)
    for i, (path, *_) in enumerate(nodes):
        total, weight = fused[path], 1.0
        for j in (i - 1, i + 1):
            if 0 <= j < len(nodes):
                other = nodes[j][0]
                w = 1.0 if other == path else SIBLING if path_parents[other] == path_parents[path] and path and other else 0.0
                total, weight = total + w * fused[other], weight + w
        sums[path] += total / weight
    return {p: v / totals[p][3] for p, v in sums.items()}


def content(nodes: list[tuple[int, int, int, int]], path_parents: list[int]) -> list[bool]:
    """Whether each node's path reaches THRESHOLD of the mean score."""
    scores = path_scores(nodes, path_parents)
    size = sum(n[1] for n in nodes)
    mean = sum(scores[n[0]] * n[1] for n in nodes) / max(1, size)
    return [scores[n[0]] >= THRESHOLD * mean for n in nodes]


def main_element(parents: list[int], found: list[tuple[int, int]]) -> tuple[int, int]:
    """(first, last) number of the deepest element, and all within it, that holds MAIN of the (element, text length) found."""
    mass, last = [0] * len(parents), list(range(len(parents)))
    for element, size in found:
        mass[element] += size
    total = sum(mass)
    for e in range(len(parents) - 1, 0, -1):
        mass[parents[e]] += mass[e]
        last[parents[e]] = max(last[parents[e]], last[e])
    best = max((e for e in range(len(parents)) if mass[e] >= MAIN * total), default=0)  # they hold one another
    return best, last[best]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by one line feed, "" if there is none."""
    if not page:
        return ""
    read = blocks(page)
    found = []
    for node in read.nodes:
        text = _SPACE.sub(" ", "".join(map(htmllib.unescape, node.text))).strip()
        if text:
            found.append((node, text))
    if not found:
        return ""
    measured = [(x.path, len(t), len(_MARKS.findall(t)), min(x.linked, len(t))) for x, t in found]
    linked = [x.linked > LINKS * sum(map(len, x.text)) for x, _ in found]
    good = [ok and not link for ok, link in zip(content(measured, read.path_parents), linked)]
    if any(x.inside for x, _ in found):
        # Article elements come out whole, if they or those within them hold content; if none does, all of them.
        kept = {x.inside for (x, _), ok in zip(found, good) if ok and x.inside} or {x.inside for x, _ in found if x.inside}
        for c in range(len(read.holders) - 1, 0, -1):
            if c in kept:
                kept.add(read.holders[c])
        return "\n".join([t for x, t in found if x.inside and x.inside in kept])
    places = [i for i, ok in enumerate(good) if ok]
    if not places:
        return ""
    first, last = main_element(read.parents, [(found[i][0].element, len(found[i][1])) for i in places])
    keep = [False] * len(found)
    inside = [i for i in places if first <= found[i][0].element <= last]
    for i in range(inside[0], inside[-1] + 1):
        keep[i] = good[i] or not linked[i] and first <= found[i][0].element <= last
    for i, (node, _) in enumerate(found):  # a heading stands before content, else it belongs to what was cut
        if node.heading:
            keep[i] = not linked[i] and any(good[j] and keep[j] and not found[j][0].heading for j in range(i + 1, min(i + 4, len(found))))
    return "\n".join([t for k, (_, t) in zip(keep, found) if k])


def extract(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, text and n_chars (code points) of each page, one row per row of pages.

    The whole html is read, however long or deep; null or empty html gives "" and 0. Keys may be null or repeat,
    and repeated pages are rows of their own.
    """
    light_batches(pages.sparkSession)
    source = pick(pages, **{f"k{i}": c for i, c in enumerate(carry)}, html=html)
    n = len(carry)
    fields = "".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}, " for i in range(n))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*[f"k{i}" for i in range(n)], "text", "n_chars"])

    return source.mapInArrow(run, fields + "text string, n_chars long").toDF(*carry, "text", "n_chars")


def op2_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"))
