"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut.

A page is read once into text blocks (runs of text between the borders of block
elements) and the elements around them. Every block gets two costs, one for
each label: the log-odds of a logistic classifier over its own text (length, links,
punctuation, place), learned on blocks whose elements leave no doubt, plus a
fixed cost for what its elements say (``article`` against ``nav``, ``aside``, class names
and so on). The costs are the terminal capacities of a graph; neighbouring blocks
(adjacency) and blocks with the elements around them (proximity in the page's tree) are joined
by smoothness edges that say how dear it is to label them differently. The
minimum cut is the cheapest labelling of the whole page.

Nodes whose own costs outweigh all their edges keep their label in some minimum
cut, so they are settled first and their edges move into their neighbours' terminals;
augmenting paths run on what is left. Pages are independent of each other.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML by their role.
BLOCKS = frozenset(
    """address article aside blockquote body button center details dialog dd dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th
    thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("applet audio canvas datalist head iframe math noembed noframes object script style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes script style textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REJECTED = frozenset("aside button dialog fieldset footer form menu nav noscript option search select".split())
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

# Words in class, id and role that speak for boilerplate or content.
BOILERPLATE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs byline-share captcha carousel
    complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus dialog feedback foot footer form gdpr
    header legal links login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup
    promo promoted promotion rail recommended recommendations register related replies reply respond responses search share sharing side sidebar sidebars sidenav signin signup skip social
    sponsor sponsored subscribe subscription tags toolbar topbar trending widget widgets""".split()
)
# A name with one of these tells a state or a topic, not what the element is.
ONLY_STATE = frozenset("category closed enabled format has is no not open tag type with without".split())
CONTENT = frozenset("article articlebody blogpost content entry hentry main mainbody post prose story text".split())

HINT = 12.0  # what an element that says what it is weighs
NEXT, APART = 1.6, 0.5  # neighbouring blocks in one element, and for each element between them (a factor)
INSIDE, ABOVE = 0.8, 0.4  # a block and its element, an element and the one around it

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<(?=[a-zA-Z/])[^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    name: str
    parent: int
    depth: int
    hint: float  # > 0 content, < 0 boilerplate, of this element and those around it
    barred: bool  # stands in boilerplate for certain


@dataclass
class Block:
    element: int
    text: str
    linked: int = 0
    heading: bool = False


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _says(name: str, attrs: str, above: Element | None) -> tuple[float, bool]:
    """Hint of an element, given the one around it."""
    hint, barred = (above.hint, above.barred) if above else (0.0, False)
    bad, good, hidden = set(), False, False
    if attrs and not attrs.isspace():
        for key, *values in _ATTR.findall(attrs):
            key, value = key.lower(), unescape("".join(values))
            if key in ("class", "id", "role", "itemprop"):
                for token in value.split():
                    parts = {*_PART.findall(_CAMEL.sub(" ", token).lower()), *_PART.findall(token.lower())}
                    told = {x for x in parts if x in BOILERPLATE or x.startswith("comment") and x != "commentary"}
                    good = good or not parts.isdisjoint(CONTENT)
                    if parts.isdisjoint(ONLY_STATE) and (name not in ("article", "main") or told == parts):
                        bad |= told
            elif key == "style":
                hidden = hidden or "display:none" in value.replace(" ", "").lower()
            elif key == "aria-hidden":
                hidden = hidden or value.lower() == "true"
        hidden = hidden or re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTR.sub(" ", attrs).lower()) is not None
    if name in ("body", "html"):
        bad = set()
    if (good or name in HEADINGS) and bad <= {"header", "tags", "links"}:
        bad = set()
    if barred or hidden or name in REJECTED:
        return -HINT, True
    if name == "header":
        return (hint, False) if above and above.hint > 0 else (-HINT, False)
    if bad:
        return -HINT, True
    if name in ("article", "main"):
        return HINT, False
    if good and hint <= 0:
        return max(hint, 0.0) + HINT / 4, False
    return hint, False


def read(html: str) -> Page:
    """The blocks of a page, without what browsers don't show, and the block elements around them.

    Unclosed and misplaced tags are taken as browsers do in the common cases:
    block elements end a paragraph, items end items, an end tag closes what is open inside.
    """
    page = Page([Element("", -1, 0, 0.0, False)])
    stack = [0]  # open block elements
    parts: list[str] = []
    links, linked, unseen, unseen_depth = 0, 0, "", 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                page.blocks.append(Block(stack[-1], text, linked, any(page.elements[k].name in HEADINGS for k in stack[-3:])))
        linked = 0

    def close(names: set[str], stops: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            name = page.elements[stack[at]].name
            if name in names:
                del stack[at:]
                return
            if name in stops:
                return

    at = 0
    while at < len(html):
        found = _TOKEN.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text and not unseen:
            parts.append(unescape(text))
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        name, attrs, ends = found["name"], found["attrs"], found["end"]
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not ends:
            over = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = over.end() if over else len(html)
            continue
        if unseen:
            if unseen == "head" and not ends and (name in BLOCKS or name == "a"):
                unseen = ""
            else:
                if name == unseen:
                    unseen_depth += -1 if ends else not attrs.endswith("/")
                    unseen = unseen if unseen_depth else ""
                continue
        if ends:
            if name in BLOCKS or name == "noscript":
                flush()
                close({name}, set())
            elif name == "a":
                links = 0
            continue
        if name in UNSEEN:
            if not attrs.endswith("/"):
                unseen, unseen_depth = name, 1
            continue
        if name == "br":
            parts.append(" ")
        elif name in BLOCKS or name == "noscript":
            flush()
            if page.elements[stack[-1]].name == "p":
                stack.pop()
            if name in CLOSED_BY:
                close(CLOSED_BY[name], STOPS[name])
            if name in VOID or attrs.endswith("/") and name == "hr":
                continue
            above = page.elements[stack[-1]]
            hint, barred = _says(name, attrs, above)
            if name in ("article", "main") and links:
                links = 0
            page.elements.append(Element(name, stack[-1], above.depth + 1, hint, barred))
            stack.append(len(page.elements) - 1)
        elif name == "a":
            links = 1
    flush()
    return page


FEATURES = 10


def features(page: Page) -> np.ndarray:
    """One row for each block; nothing that elements say about themselves."""
    n = len(page.blocks)
    out = np.zeros((n, FEATURES))
    for at, block in enumerate(page.blocks):
        text = block.text
        size = len(text)
        words = text.count(" ") + 1
        marks = sum(map(text.count, ".,;!?"))
        out[at] = (
            1.0,
            np.log1p(size) / 4,
            min(1.0, block.linked / size),
            min(1.0, marks / words * 4),
            text[-1] in ".!?:\"'”»)",
            words < 4,
            block.heading,
            at / n,
            (at / n) ** 2,
            "\N{COPYRIGHT SIGN}" in text,
        )
    return out


# The classifier without training: the sign of what each feature says.
PRIOR = np.array([-1.0, 1.0, -3.0, 0.5, 0.5, -0.5, 0.5, 0.0, 0.0, -2.0])


def learn(pages: DataFrame, html_col: str = "html", sample: int = 2000, blocks: int = 20_000, seed: int = 5, rounds: int = 25) -> np.ndarray:
    """Weights of the classifier from at most ``blocks`` blocks of the ``sample`` different pages with the smallest hashes.

    Blocks are labelled by elements that leave no doubt (``HINT``); with one kind of
    label only, or none, the prior stays.
    """
    hashed = pages.select(F.col(f"`{html_col}`").alias("html")).where("html IS NOT NULL").select(F.xxhash64("html", F.lit(seed)).alias("key"), "html")
    bound = hashed.select("key").distinct().orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if bound is None:
        return PRIOR
    some = hashed.where(F.col("key") <= bound).groupBy("key").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("html"), strict=True):
                page = read(value.as_py())
                hints = np.array([page.elements[b.element].hint for b in page.blocks])
                sure = np.flatnonzero(np.abs(hints) >= HINT)
                if len(sure):
                    x = pa.FixedSizeListArray.from_arrays(features(page)[sure].ravel(), FEATURES).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(sure), pa.int64()), "at": pa.array(sure, pa.int64()), "x": x, "y": pa.array(hints[sure] > 0)})

    found = some.mapInArrow(run, "key long, at long, x array<double>, y boolean")
    rows = found.orderBy(F.xxhash64("key", "at"), "key", "at").limit(blocks).select("x", "y").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, FEATURES)
    y = np.array(rows["y"].to_pylist(), dtype=float)
    if not 0 < y.sum() < len(y):
        return PRIOR
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weights = PRIOR.copy()
    pull = np.diag(np.full(FEATURES, 1e-2 * len(y)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - y)) + pull @ (weights - PRIOR)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def graph(page: Page, weights: np.ndarray) -> tuple[list[float], list[dict[int, float]]]:
    """Cost of boilerplate less cost of content for each node, and the smoothness edges. Nodes: blocks, then elements."""
    n = len(page.blocks)
    odds = np.clip(features(page) @ weights, -3, 3).tolist() if n else []
    gain = [o + page.elements[b.element].hint for o, b in zip(odds, page.blocks, strict=True)] + [0.0] * len(page.elements)
    edges: list[dict[int, float]] = [{} for _ in gain]

    def join(a: int, b: int, weight: float) -> None:
        edges[a][b] = edges[a].get(b, 0.0) + weight
        edges[b][a] = edges[b].get(a, 0.0) + weight

    seen: set[int] = set()
    for at, block in enumerate(page.blocks):
        join(at, n + block.element, INSIDE)
        if at:
            a, b, steps = page.blocks[at - 1].element, block.element, 0
            while a != b:
                if page.elements[a].depth >= page.elements[b].depth:
                    a = page.elements[a].parent
                else:
                    b = page.elements[b].parent
                steps += 1
            join(at - 1, at, NEXT * APART ** max(0, steps - 2))
        k = block.element
        while k > 0 and k not in seen:
            seen.add(k)
            join(n + k, n + page.elements[k].parent, ABOVE)
            k = page.elements[k].parent
    return gain, edges


def cut(gain: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Labels of a minimum cut: node i costs gain[i] if it is positive and i is False, -gain[i] if negative and True,
    and each edge costs its weight where labels differ. Of equal cuts, the one with the fewest True nodes."""
    gain, edges = list(gain), [dict(e) for e in edges]
    label: list[bool | None] = [None] * len(gain)
    loose = [sum(e.values()) for e in edges]
    work = list(range(len(gain)))
    while work:
        node = work.pop()
        if label[node] is not None or abs(gain[node]) <= loose[node] + 1e-9:
            if label[node] is not None or edges[node] or gain[node]:
                continue
        label[node] = gain[node] > 0
        for other, weight in edges[node].items():
            gain[other] += weight if label[node] else -weight
            loose[other] -= weight
            del edges[other][node]
            work.append(other)
        edges[node] = {}
    rest = [k for k, x in enumerate(label) if x is None]
    # Shortest augmenting paths from nodes with gain (source side) to those with loss.
    flow = edges
    while True:
        before: dict[int, int] = {k: -1 for k in rest if gain[k] > 1e-9}
        queue, end = deque(before), -1
        while queue and end < 0:
            node = queue.popleft()
            for other, left in flow[node].items():
                if left > 1e-9 and other not in before:
                    before[other] = node
                    if gain[other] < -1e-9:
                        end = other
                        break
                    queue.append(other)
        if end < 0:
            break
        node, most = end, -gain[end]
        while before[node] >= 0:
            most = min(most, flow[before[node]][node])
            node = before[node]
        most = min(most, gain[node])
        gain[node] -= most
        gain[end] += most
        node = end
        while before[node] >= 0:
            flow[before[node]][node] -= most
            flow[node][before[node]] += most
            node = before[node]
    for k in rest:
        label[k] = k in before
    return [bool(x) for x in label]


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    page = read(html or "")
    labels = cut(*graph(page, weights))
    return " ".join(b.text for b, kept in zip(page.blocks, labels, strict=False) if kept)


def extract(
    pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: id, url, text (blocks of the main text joined by a space), n_chars (its code points).

    Without ``weights`` they are learned from ``pages``. White space, also no-break
    spaces, counts as one space. Null and empty html, and pages without main text, give an
    empty text. Rows are independent: repeated rows give equal rows, null ids and urls
    stay null, other columns are not read and may have any name.
    """
    known = learn(pages, html_col) if weights is None else weights
    own = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    out = T.StructType([own.schema["id"], own.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), known) for value in batch.column("html")]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": sizes})

    return own.mapInArrow(run, out)
