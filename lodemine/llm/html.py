"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with the path of open elements from the root.
Each root-to-leaf tag path gets two ratios, its text length and its punctuation per block. Both are
smoothed along the page and fused (the root of their product); elements weigh: an ``article`` or
``main`` element lifts what it holds, a class, id or role that speaks of adverts, comments and the
like lowers it. Paths whose weighted mean reaches ``share`` of the page's (each path counts by its own
value, so that many small ones don't lower the bar) are content, and so are all their blocks. The
region is the deepest element that holds ``cover`` of the content text (the article element around it,
if there is one): its other blocks, such as headings, list items and code, are returned too unless a
mark inside the region lowers them. Content outside the region is kept; on pages without an article
so are the blocks between it and the region and the headings right before.

Never read: what HTML itself sets apart from the content (nav, footer, aside, a header outside the
article, forms, dialogs, scripts, styles, media fallbacks), hidden elements, and, where an article or
main element exists, marked elements outside it. A form is a wrapper, and is read but for its fields,
labels and buttons, if it holds an article or main element, or on pages without one most of what
stands in paragraphs (in blocks, where there are no paragraphs).

A null or empty page gives the empty text. Broken markup is read as browsers do: a block's start
ends an open paragraph, stray quotes belong to attribute names or values, a tag goes up to its ``>``;
only a tag without one before the page's end is dropped. Time is linear in the page's length, however
deep its elements nest. Repeated rows give repeated rows, other columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import read

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
SKIP = frozenset("head nav footer aside script style noscript iframe template button select textarea option input dialog menu svg math object canvas audio video map title xmp noembed noframes".split())
FIELDS = frozenset("label legend fieldset output datalist progress meter".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_INLINE = ENDS_P | {"li", "td", "th", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role attributes that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside complementary footer contentinfo masthead share sharing social related recommended recommendations comment comments reply replies discussion disqus respond toolbar search widget skip hidden".split()
)
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?>{_VALUE}))*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(rf"([^\s=>/]+)(?:\s*=\s*({_VALUE}))?")
_lower = {c: c + 32 for c in range(65, 91)}
_split = re.compile(r"[^a-z0-9]+")
_punct = re.compile(r"[.,;:!?…。，、；：！？]")


#: Those that mark an article element itself: it is then a comment, a teaser or an advert.
NOT_THE_ARTICLE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments reply replies related recommended recommendations".split())
_about_others = re.compile(r"(?:has|with|without|no|is-not|enable|disable)-")


#: Weights: of an article or main element, of a mark on a container or one that can only mean an advert
#: or a notice, and of any other mark on a paragraph (a "comment" there may be the author's own).
ARTICLE, MARKED, DOUBTFUL = 8.0, 0.02, 0.5
CERTAIN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre figcaption".split())
# Elements that never are the region by themselves.
PARTS = LEAVES | frozenset("tr tbody thead table ul ol dl".split())


def _weight(tag: str, attrs: str) -> float:
    """Of an element by its attributes: 0 if it is hidden."""
    if not attrs or tag in ("html", "body", "main"):
        return 1.0
    marks, weight = NOT_THE_ARTICLE if tag == "article" else MARKS, 1.0
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return 0.0
        if name in ("class", "id", "role"):
            # "has-sidebar" tells of a part, not of the element itself
            found = marks.intersection(w for v in value.split() if not _about_others.match(v) for w in _split.split(v))
            if found:
                weight = min(weight, MARKED if tag not in LEAVES or found & CERTAIN else DOUBTFUL)
    return weight


class _Open(NamedTuple):
    tag: str
    node: int  # the element itself, of an inline element the one around it
    never: bool  # inside an element that is never read
    apart: bool  # inside an element that HTML sets apart
    form: int  # the outermost form around it; 0: none


class Node(NamedTuple):
    parent: int
    tag: str
    weight: float
    path: int
    article: int  # the nearest article or main element, itself included; 0: none


def _blocks(page: str) -> tuple[list[tuple[str, int]], list[Node]]:
    """Blocks in page order as (text, node), and the element tree in page order."""
    nodes = [Node(-1, "", 1.0, 0, 0)]
    paths: dict[tuple[int, str, bool], int] = {}
    stack = [_Open("", 0, False, False, 0)]
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements on the stack
    blocks: list[tuple[str, int]] = []
    forms: list[int] = []  # of each block
    n_forms, holders = 0, set()  # the forms (0: none) that article and main elements stand in
    parts: list[str] = []
    owner = form_of = 0

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, owner))
                forms.append(form_of)
            parts.clear()

    def text(raw: str) -> None:
        nonlocal owner, form_of
        if raw and not stack[-1].never:
            if not parts:
                owner, form_of = stack[-1].node, stack[-1].form
            parts.append(raw)

    def push(element: _Open) -> None:
        places[element.tag].append(len(stack))
        stack.append(element)

    def close(tags: Iterable[str], stop: Iterable[str] = ()) -> None:
        """Ends the innermost open element of tags, if none of stop stands inside it."""
        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        k = last(tags)
        if k and k > last(stop):
            while len(stack) > k:
                tag = stack.pop().tag
                places[tag].pop()
                if tag not in INLINE:
                    flush()

    at, size = 0, len(page)
    lower = None
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        m = TOKEN.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, end = m[2].lower(), m[1] == "/"
        if m[4] == "":  # the page's end cuts the tag off
            break
        if end:
            if tag == "br":
                text(" ")
            elif tag in INLINE:
                close((tag,), ENDS_INLINE)
            else:
                if tag == "p" and not places["p"]:
                    flush()  # stands for an empty paragraph
                close((tag,))
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close(("p",), ("article", "div", "section", "td", "li"))
                flush()
            continue
        if tag in ENDS_P:
            close(("p",), ("article", "main", "div", "section", "td", "th", "li", "blockquote", "button", "body"))
        elif tag == "li":
            close(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            close(("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            close(("td", "th"), ("table", "tr"))
        elif tag == "tr":
            close(("tr",), ("table",))
        if tag not in INLINE:
            flush()
        above = stack[-1]
        parent = nodes[above.node]
        own = _weight(tag, m[3])
        form = above.form
        if tag == "form" and not form:
            form = n_forms = n_forms + 1
        apart = above.apart or tag in SKIP or form and tag in FIELDS or tag == "header" and not parent.article
        never = bool(above.never or apart or not own)
        if tag in RAW:
            lower = lower if lower is not None else page.translate(_lower)
            stop = lower.find("</" + tag, at)
            at = size if stop < 0 else (page.find(">", stop) + 1 or size)
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        if tag in INLINE:
            push(_Open(tag, above.node, never, apart, form))
            continue
        inside = tag in ("article", "main")
        weight = parent.weight * own
        if inside and not parent.article:
            # a main element is the content, whatever its wrappers are called
            weight = ARTICLE * (own if tag == "main" else weight)
        path = paths.setdefault((parent.path, tag, own < 1), len(paths) + 1)
        nodes.append(Node(above.node, tag, weight, path, len(nodes) if inside else parent.article))
        if inside and own == 1 and not never:
            holders.add(form)
        push(_Open(tag, len(nodes) - 1, never, apart, form))
    flush()
    if n_forms:
        in_p = [nodes[n].tag == "p" for _, n in blocks]
        counted = in_p if any(in_p) else [True] * len(blocks)
        chars = [0] * (n_forms + 1)
        for (t, _), f, c in zip(blocks, forms, counted):
            chars[f] += len(t) * c
        read_too = holders if holders else {f for f, c in enumerate(chars) if 2 * c > sum(chars)}
        blocks = [b for b, f in zip(blocks, forms) if not f or f in read_too]
    return blocks, nodes


def _smooth(x: list[float], radius: int = 1) -> list[float]:
    weights = [math.exp(-2.0 * k * k) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(x)):
        near = [(w, x[i + k]) for k, w in zip(range(-radius, radius + 1), weights) if 0 <= i + k < len(x)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_paths(blocks: list[tuple[str, int]], paths: list[int], weights: list[float], share: float) -> set[int]:
    """The paths that the ratios select. paths, weights: of each block."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for (t, _), p in zip(blocks, paths):
        chars[p] += len(t)
        marks[p] += len(_punct.findall(t))
        count[p] += 1
    by_text = _smooth([chars[p] / count[p] for p in paths])
    by_mark = _smooth([marks[p] / count[p] for p in paths])
    score = defaultdict(float)
    for p, a, b, w in zip(paths, by_text, by_mark, weights):
        score[p] += math.sqrt(a * (1 + b)) * w / count[p]
    total = sum(score.values())
    if not total:
        return set()
    bar = share * sum(s * s for s in score.values()) / total
    return {p for p, s in score.items() if s >= bar}


def main_text(page: str | None, share: float = 0.3, cover: float = 0.9) -> str:
    """The article's blocks joined by two line feeds."""
    if not page:
        return ""
    blocks, nodes = _blocks(page)
    if any(n.article for n in nodes):  # what is marked outside the article is no part of it
        blocks = [(t, n) for t, n in blocks if nodes[n].article or nodes[n].weight >= DOUBTFUL]
    if not blocks:
        return ""
    weights = [nodes[n].weight for _, n in blocks]
    content = content_paths(blocks, [nodes[n].path for _, n in blocks], weights, share)
    selected = [nodes[n].path in content for _, n in blocks]
    held = [0] * len(nodes)  # content text below each node
    for (t, n), s in zip(blocks, selected):
        held[n] += len(t) * s
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].parent] += held[k]
    # nodes are numbered in page order: of those with nearly all content the last one is the deepest
    region = max(k for k, h in enumerate(held) if h >= cover * held[0])
    while nodes[region].tag in PARTS:
        region = nodes[region].parent
    region = nodes[region].article or region
    inside = [False] * len(nodes)
    for k in range(region, len(nodes)):
        inside[k] = k == region or nodes[k].parent >= region and inside[nodes[k].parent]
    sound = [w >= DOUBTFUL * nodes[region].weight for w in weights]
    whole = nodes[region].tag not in ("", "html", "body")
    kept = [s or whole and inside[n] and ok for (_, n), s, ok in zip(blocks, selected, sound)]
    if not nodes[region].article:
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        while first and nodes[blocks[first - 1][1]].tag in HEADINGS and sound[first - 1]:
            first -= 1
        kept = [k or first <= i <= last and ok for i, (k, ok) in enumerate(zip(kept, sound))]
    return "\n\n".join([t for (t, _), k in zip(blocks, kept) if k])


def extract(pages: DataFrame, html: str = "html", share: float = 0.3, cover: float = 0.9) -> DataFrame:
    """Adds ``text`` and ``n_chars`` and drops the markup."""

    @F.arrow_udf("string")
    def text(col: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), share, cover) for x in col], pa.string())

    return pages.withColumn("text", text(F.col(html))).drop(html).withColumn("n_chars", F.length("text").cast("long"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: For pages whose article holds nothing but headings, paragraphs, line breaks and bold text, which
#: the tables' pages are made of; character references as far as those name them.
OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(?:</article>|<[^>]*\z|\z)', 1, 's') AS t FROM pages
), b AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>', chr(30), 'g'), chr(30)) AS parts FROM a
), c AS (
  SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) for x in parts] AS blocks FROM b
)
SELECT page_id, url, array_to_string([x for x in blocks if x <> ''], chr(10) || chr(10)) AS text,
  CAST(length(array_to_string([x for x in blocks if x <> ''], chr(10) || chr(10))) AS BIGINT) AS n_chars
FROM c
"""
