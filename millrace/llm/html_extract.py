"""HTML extraction as minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). A logistic classifier over the text and the own tag
of a block (length, links, stops, kind of element) gives it a log odds of being content, whose two costs are the
capacities to the terminals. Elements that say by tag, name or style what they hold (article, nav, class="ad", hidden)
are nodes too, with capacities that grow with the number of their blocks. Smoothness edges tie neighbours on the page,
consecutive children of one parent, and blocks to the nearest such element. The minimum cut, found by max-flow,
separates content from boilerplate: it keeps the short paragraphs of an article, whose own odds are against them, and
drops the prose of an advert, whose own odds are for it. Blocks on the content side, in page order, are the text.

The classifier is fitted on a bounded sample of pages as in iterated graph cuts: the cut under the present weights
labels the sample's blocks, and a logistic regression with a prior around the first weights is fitted to these labels.
Only the weights of the text's features are free.

Nodes whose costs differ by more than all their edges weigh are settled before the flow (that is exact). Pages are
read in time linear in their length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended, hashed_sample
from millrace.llm.labelled import logistic

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Element names of HTML by their role, and name parts that tell a part of a page.
RAW = frozenset("script style noscript template textarea title iframe svg object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog button".split())
PARAGRAPHS, ITEMS = frozenset("p pre blockquote td".split()), frozenset("li option".split())
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
CONTENT_NAMES = frozenset("article articlebody content entry main post story text body".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement advertising alert banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies disclaimer disqus footer form gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promotion reaction reactions related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe tags teaser toolbar topbar widget".split()
)
#: First weights of the classifier: constant, length, share in links, stops, heading, paragraph, list item.
WEIGHTS = (-1.0, 0.5, -3.0, 0.6, 1.0, 1.0, -0.5)
#: A block's odds are within these; smoothness edges: neighbours on the page, consecutive children of one parent.
MOST_ODDS, ADJACENT, SIBLING = 7.0, 0.4, 0.6
#: Of elements that say what they hold: the edge to each of their blocks, and the odds for themselves and for each block.
CONTENT_EDGE, CONTENT_ODDS, CONTENT_EACH = 5.0, 30.0, 1.5
BOILER_EDGE, BOILER_ODDS, BOILER_EACH = 9.0, -60.0, -8.0
#: Pages that the classifier is fitted on at most, those with the smallest hashes; bytes of html of each; rounds of cuts.
SAMPLE_PAGES, SAMPLE_BYTES, ROUNDS = 200, 200_000, 2
#: Weight of the prior for each of the classifier's weights: those of kinds of elements stay, as they are a sample's templates' habits rather than its texts'.
PRIOR = (100.0, 100.0, 100.0, 100.0, 1e9, 1e9, 1e9)


class Block:
    """A run of text. `holder` numbers the nearest element that says what it holds (0: none), `kind` what that says: 1, -1 or 0."""

    __slots__ = ("holder", "kind", "linked", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, parent: int, holder: int, kind: int) -> None:
        self.text, self.linked, self.tag, self.parent, self.holder, self.kind = text, linked, tag, parent, holder, kind

    def features(self) -> tuple[float, ...]:
        n = len(self.text)
        stops = min(3, sum(self.text.count(c) for c in ".,;:!?"))
        return 1.0, math.log1p(n / 20), self.linked / n, stops, float(self.tag in HEADINGS), float(self.tag in PARAGRAPHS), float(self.tag in ITEMS)

    def odds(self, weights: Sequence[float] = WEIGHTS) -> float:
        return max(-MOST_ODDS, min(MOST_ODDS, sum(w * x for w, x in zip(weights, self.features(), strict=True))))


ENDS_PARAGRAPH = frozenset("div section article main ul ol table h1 h2 h3 h4 h5 h6 nav aside footer header form pre blockquote figure hr".split())
#: Of the names of an article or main element, those that make it boilerplate all the same.
SAID_ANYWAY = frozenset("comment comments related ad ads sponsored promo teaser".split())
ENDINGS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
NAMING, HIDING = frozenset(("class", "id", "role", "itemprop")), re.compile(r"(?:^|\s)hidden(?:\s|/|$)")


class Open(NamedTuple):
    """An open element: its number, whether it is in content or boilerplate or hidden, its holder, the place of its nearest element that isn't inline."""

    tag: str
    node: int
    content: bool
    boiler: bool
    hidden: bool
    holder: int
    base: int

    @property
    def kind(self) -> int:
        return -1 if self.boiler or self.hidden else int(self.content)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order. Tags that are left open end with their parents."""
    out: list[Block] = []
    stack = [Open("", 0, False, False, False, 0, 0)]
    opened: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    linked = nodes = 0
    head = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = stack[stack[-1].base]
                says = stack[-1] if stack[-1].kind < 0 else own
                out.append(Block(text, min(linked, len(text)), own.tag, stack[own.base - 1].node if own.base else 0, says.holder, says.kind))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not head:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    def close(at: int) -> None:
        for x in stack[at:]:
            opened[x.tag] -= 1
        del stack[at:]

    pos, end = 0, page.rfind(">") + 1  # what follows the last > is text
    while True:
        m = TOKEN.search(page, pos, end)
        if m is None:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "head":
                head = False
            at = len(stack) - 1 if opened[name] else 0
            while at and stack[at].tag != name:
                at -= 1
            if name not in INLINE or (at and stack[-1].base >= at):
                flush()
            if at:
                close(at)
            continue
        if name == "br":
            parts.append(" ")
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            if name != "textarea" and attributes.endswith("/"):
                continue
            closing = ENDINGS[name].search(page, pos, end)
            pos = closing.end() if closing else len(page)
            parts.append(" ")
            continue
        if name == "head":
            head = True
        elif name == "body":
            head = False
        if name not in INLINE:
            flush()
            at = stack[-1].base
            if name in CLOSED_BY_SAME:
                if at and stack[at].tag == "p" and name != "p":
                    at = stack[at - 1].base
                if at and stack[at].tag == name:
                    close(at)
            elif name in ENDS_PARAGRAPH and at and stack[at].tag == "p":
                close(at)
        if name in VOID or attributes.endswith("/"):
            continue
        above = stack[-1]
        content, boiler, hidden = above.content, above.boiler, above.hidden
        if attributes and name not in ("html", "body"):
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in NAMING:
                    named = {x for x in re.split(r"[^a-z0-9]+", value.lower()) if x} | {value.lower()}
                    if named & BOILER_NAMES and not (name in CONTENT_TAGS and not named & SAID_ANYWAY):
                        boiler = boiler or name not in HEADINGS
                    elif named & CONTENT_NAMES:
                        content = True
                elif key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value.lower() == "true":
                    hidden = True
            if HIDING.search(attributes):
                hidden = True
        if name in CONTENT_TAGS:
            content = True
            # a form around the whole page doesn't make its article boilerplate
            if boiler and opened["form"] and not any(opened[x] for x in BOILER_TAGS if x != "form"):
                first = next(i for i, x in enumerate(stack) if x.tag == "form")
                boiler = stack[first - 1].boiler
        elif name in BOILER_TAGS or (name == "header" and not content):
            boiler = True
        nodes += 1
        says = (content, boiler, hidden) != (above.content, above.boiler, above.hidden)
        opened[name] += 1
        stack.append(Open(name, nodes, content, boiler, hidden, nodes if says else above.holder, above.base if name in INLINE else len(stack)))
    flush()
    return out


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut: node i has capacity odds[i] from the source, or -odds[i] to the sink."""
    n, side = len(odds), {}
    weight = [0.0] * n
    for (i, j), w in edges.items():
        weight[i] += w
        weight[j] += w
    for i, z in enumerate(odds):
        if abs(z) > weight[i]:
            side[i] = z > 0
    if len(side) == n:
        return [side[i] for i in range(n)]
    source, sink = n, n + 1
    residual: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def connect(a: int, b: int, forth: float, back: float) -> None:
        residual[a][b] = residual[a].get(b, 0.0) + forth
        residual[b][a] = residual[b].get(a, 0.0) + back

    for i, z in enumerate(odds):
        if i not in side:
            connect(source, i, max(z, 0.0), 0.0)
            connect(i, sink, max(-z, 0.0), 0.0)
    for (i, j), w in edges.items():
        if i in side and j in side:
            continue
        if i in side or j in side:
            settled, free = (i, j) if i in side else (j, i)
            connect(*((source, free) if side[settled] else (free, sink)), w, 0.0)
        else:
            connect(i, j, w, w)
    while True:  # Dinic: levels, then augmenting paths along them
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in residual[a].items():
                if c > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return [side[i] if i in side else i in level for i in range(n)]
        ways = {a: iter(residual[a]) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(residual[x][y] for x, y in zip(path, path[1:], strict=False))
                first = None
                for k, (x, y) in enumerate(zip(path, path[1:], strict=False)):
                    residual[x][y] -= flow
                    residual[y][x] += flow
                    if first is None and residual[x][y] <= 1e-12:
                        first = k
                del path[first + 1 :]
                ways[path[-1]] = iter(residual[path[-1]])
                continue
            for b in ways[a]:
                if residual[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
                level[a] = -1


def cut(blocks: list[Block], weights: Sequence[float] = WEIGHTS) -> list[bool]:
    """Which blocks of a page are content."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    odds = [b.odds(weights) for b in blocks]
    at: dict[tuple[int, int], int] = {}  # nodes of the elements that say what they hold
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = ADJACENT
        if b.parent in last:
            edges[last[b.parent], i] = edges.get((last[b.parent], i), 0.0) + SIBLING
        last[b.parent] = i
        if b.kind:
            holder = at.get((b.holder, b.kind))
            if holder is None:
                holder = at[b.holder, b.kind] = len(odds)
                odds.append(CONTENT_ODDS if b.kind > 0 else BOILER_ODDS)
            odds[holder] += CONTENT_EACH if b.kind > 0 else BOILER_EACH
            edges[i, holder] = CONTENT_EDGE if b.kind > 0 else BOILER_EDGE
    return minimum_cut(odds, edges)[: len(blocks)]


def main_text(page: str | None, weights: Sequence[float] = WEIGHTS) -> str:
    """The main text of a page: its content blocks, joined by line feeds."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, k in zip(blocks, cut(blocks, weights), strict=True) if k)


def fit(pages: list[str], rounds: int = ROUNDS, prior: Sequence[float] = PRIOR) -> tuple[float, ...]:
    """The classifier's weights after so many rounds of cuts over the pages and regressions on their labels."""
    cuts, weights = [blocks_of(p) for p in pages], WEIGHTS
    x = np.array([b.features() for blocks in cuts for b in blocks]).reshape(-1, len(WEIGHTS))
    for _ in range(rounds if len(x) else 0):
        y = np.array([k for blocks in cuts for k in cut(blocks, weights)], float)
        weights = tuple(logistic(x, y, ridge=np.array(prior), prior=np.array(WEIGHTS)).tolist())
    return weights


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, most_bytes: int = SAMPLE_BYTES) -> tuple[float, ...]:
    """Weights fitted on at most `sample` pages of at most `most_bytes` each. Null html is left out; no pages give the first weights."""
    own = pages.select(F.col(f"`{html_col}`").alias("html")).where(F.octet_length("html") <= most_bytes)
    taken = hashed_sample(own, F.xxhash64("html"), sample, own.count())
    return fit(sorted(r["html"] for r in taken.collect()))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """pages with text_col: the main text of the whole html, by the weights given or else by those that `train` fits on pages.

    Null and empty html, and pages without content, have the empty text. Repeated pages get equal texts, an empty
    table stays empty, and a column of pages named text_col gives way. Nothing is shuffled; a page's blocks and their
    edges are what a task holds at once.
    """
    weights = train(pages, html_col) if weights is None else weights
    pages, schema = appended(pages, [T.StructField(text_col, T.StringType())])
    html_at, names = pages.columns.index(html_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), weights) for x in batch.column(html_at)], pa.string())
            yield pa.record_batch([*batch.columns, texts], names=names)

    return pages.mapInArrow(run, schema)
