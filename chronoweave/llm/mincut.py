"""Main text of web pages by minimum cut.

A page is a row of blocks, each a leaf of the tree of elements. A logistic classifier on measurements of a block
(length, links, end of sentence, tag, its container's text, what class names call it) gives each block a cost for
either label; the costs become capacities to the two terminals. Adjacent blocks, and the next blocks of one container,
are tied by smoothness edges. An ``article`` or ``main`` element is a node of its own, drawn to content and tied to
each of its blocks, so it stands or falls with them and carries its weak blocks (a one-word paragraph, a line of
links) along. The cut of least capacity, found by maximum flow, separates content from the rest.

Training labels come from another source than the features: which blocks of a page lie inside its ``article`` or
``main`` element. That membership is no feature of the classifier.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("head title script style template noscript iframe object svg canvas audio video select datalist button textarea map".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FRAME = frozenset("nav footer aside menu dialog".split())
_MAIN = frozenset("article main".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_HOLDS = {"p": {"div", "article", "section", "main", "td", "th", "li", "blockquote", "body", "aside", "nav", "footer", "header", "form", "button"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Parameters, of no format: words that authors of pages use in class, id and role names for a part of the page.
_NOISE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice alert popup modal overlay sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs toc pagination pager share sharing social related recommended recommendations newsletter subscribe subscription signup login footer masthead topbar toolbar copyright disclaimer paywall complementary contentinfo search skip hidden".split())
_TALK = frozenset("comment comments commentlist reply replies respond disqus discussion reviews".split())
_BODY = frozenset("article content post entry story main text body".split())
#: Words that only say what sort of box it is.
_BOX = frozenset("area bar block box bottom button buttons col column container footer group header heading holder inner item items left links list outer panel region right row section site top unit wrap wrapper".split())
#: A name that begins so describes the page, not a part of it ("with-sidebar", "no-comments").
_STATE = frozenset("has hide is no not show with without".split())
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def named(value: str) -> tuple[float, float, float]:
    """How far a class, id or role calls its element noise, reader comments and body, each from 0 to 1: the
    largest share of such words in one name ("ad-box" is noise, "category-search" half so)."""
    noise = talk = body = 0.0
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        found = _WORDS.findall(name)
        said = [w for w in found if w in _NOISE or w in _TALK or w not in _BOX]
        if said and found[0] not in _STATE:
            noise = max(noise, sum(w in _NOISE for w in said) / len(said))
            talk = max(talk, sum(w in _TALK for w in said) / len(said))
            body = max(body, sum(w in _BODY for w in said) / len(said))
    return noise, talk, body


@dataclass(slots=True)
class Block:
    text: str
    node: int
    linked: int


@dataclass(slots=True)
class Page:
    """Blocks in order, and the elements that are no inline ones in order of their beginning (0 is the page)."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    names: list[tuple[float, float, float]] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    title: str = ""


class _Parser(HTMLParser):
    """Text between block-level tags. Inline tags, line breaks and unseen elements end no block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, unseen
        self.parts: list[str] = []
        self.links = self.linked = 0
        self.title: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # as browsers take "<![": up to the next ">"

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.page.blocks.append(Block(text, self.stack[-1][1], min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _INLINE and tag not in _UNSEEN:
            self.flush()
            if tag in _CLOSE_P:
                self._close({"p"}, _HOLDS["p"])
            if tag in _CLOSES and tag != "p":
                self._close(_CLOSES[tag], _HOLDS[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        _, node, unseen = self.stack[-1]
        unseen |= tag in _UNSEEN
        noise = talk = body = 0.0
        for name, value in attrs:
            if name in ("class", "id", "role") and value and tag not in ("html", "body"):
                noise, talk, body = map(max, (noise, talk, body), named(value))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                unseen = True
        if tag not in _INLINE and not unseen:
            page = self.page
            page.parent.append(node)
            page.depth.append(page.depth[node] + 1)
            page.tag.append(tag)
            page.names.append((noise, talk, body))
            node = len(page.tag) - 1
        self.stack.append((tag, node, unseen))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tags: set[str], within: set[str]) -> None:
        """Close an open element of ``tags``, unless one of ``within`` stands between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                self._cut(i)
                if "p" in tags and len(tags) == 1:
                    return
            elif self.stack[i][0] in within or self.stack[i][0] not in _INLINE and len(tags) == 1:
                return

    def _cut(self, i: int) -> None:
        self.links -= sum(x[0] == "a" for x in self.stack[i:])
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE and tag not in _UNSEEN:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1][2]:
            if self.stack[-1][0] == "title":
                self.title.append(data)
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def parse(html: str) -> Page:
    p = _Parser()
    p.feed(html)
    p.close()
    p.flush()
    p.page.title = " ".join("".join(p.title).split())
    return p.page


#: An element that holds this share of a page's words is not what a class name says of it: it names the page.
MOST_NOISE, MOST_TALK = 0.5, 0.9


@dataclass(slots=True)
class Setting:
    """What the tree says of each element: strength of noise, talk, body and frame around it, its outermost
    article or main element (or -1), and its share of the page's words outside links."""

    said: list[tuple[float, float, float, float]]
    hub: list[int]
    words: list[int]
    linked: list[int]
    held: list[int]
    share: list[float]


def setting(page: Page) -> Setting:
    n = len(page.tag)
    words, linked, chars, held, mains = [0] * n, [0] * n, [0] * n, [0] * n, [int(t in _MAIN) for t in page.tag]
    for b in page.blocks:
        words[b.node] += b.text.count(" ") + 1
        linked[b.node] += b.linked
        chars[b.node] += len(b.text)
        held[b.node] += 1
    for k in range(n - 1, 0, -1):  # children come after their parents
        for sums in (words, linked, chars, held, mains):
            sums[page.parent[k]] += sums[k]
    every = max(1, words[0])
    plain = [w * (1 - x / c) if c else 0.0 for w, x, c in zip(words, linked, chars)]
    said, hub = [(0.0, 0.0, 0.0, 0.0)], [-1]
    for k in range(1, n):
        noise, talk, body, frame = said[page.parent[k]]
        own_noise, own_talk, own_body = page.names[k]
        whole, tag = mains[k] == mains[0], page.tag[k]
        if not (whole and words[k] >= MOST_NOISE * every):
            noise = max(noise, own_noise)
            frame = max(frame, tag in _FRAME or tag == "form" or tag == "header" and hub[page.parent[k]] < 0)
        if not (whole and words[k] >= MOST_TALK * every):
            talk = max(talk, own_talk)
        if max(own_noise, own_talk) == 0:
            body = max(body, own_body)
        said.append((noise, talk, body, float(frame)))
        above = hub[page.parent[k]]
        hub.append(above if above >= 0 else k if tag in _MAIN and max(noise, talk, frame) < 1 else -1)
    total = max(1.0, plain[0])
    return Setting(said, hub, words, [x / max(1, c) for x, c in zip(linked, chars)], held, [x / total for x in plain])


FEATURES = 15
#: Where training starts and what it is drawn to: weights for content (above 0) or against it.
PRIOR = np.array([-1.5, 4.0, 1.0, -4.0, -2.0, 1.0, 0.5, 0.0, -0.5, -7.0, -8.0, 1.0, -7.0, 1.0, 1.0])


def block_features(page: Page, around: Setting) -> np.ndarray:
    """Bias; own length, end of sentence, links; container's links and words a block; text tag, heading, list or
    cell; noise, talk, body, frame; container's share of the page's words; words in common with the page's title."""
    title = set(page.title.lower().split())
    rows = []
    for b in page.blocks:
        found = b.text.split(" ")
        box, tag = page.parent[b.node], page.tag[b.node]
        end = b.text[-1] in ".!?:;\"'»”…。！？"
        mean = around.words[box] / max(1, around.held[box])
        alike = sum(w.lower() in title for w in found[:50]) / min(50, len(found)) if title else 0.0
        rows.append((1, min(math.log1p(len(found)) / 5, 1.5), end, b.linked / len(b.text), around.linked[box], min(math.log1p(mean) / 5, 1.5), tag in ("p", "pre", "blockquote"), tag in ("h1", "h2", "h3", "h4"), tag in ("li", "dt", "dd", "td", "th", "option"), *around.said[b.node], around.share[box], alike))
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES)


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the gains forgone and the edges cut: gain > 0 speaks for True. Dinic's maximum flow."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            add(s, i, g, 0.0)
        elif g < 0:
            add(i, t, -g, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                level[a] = -2
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


#: Capacities: adjacent blocks of one container (less across containers), the next blocks of one container, a block and
#: its article or main element, and such an element's pull to content for each of its blocks.
ADJACENT, SAME_CONTAINER, MEMBER, PULL = 1.0, 1.5, 3.0, 2.5


def smoothness(page: Page, around: Setting) -> list[tuple[int, int, float]]:
    """Adjacent blocks, less so the farther apart in depth; and each block with the next one of its container. An
    edge between blocks of which only one is called noise, talk or frame is weak: the border runs there."""

    def alike(a: Block, b: Block) -> float:
        x, y = around.said[a.node], around.said[b.node]
        return 1 - 0.8 * max(abs(x[i] - y[i]) for i in (0, 1, 3))

    edges, last = [], {}
    for i, b in enumerate(page.blocks):
        box = page.parent[b.node]
        if i:
            a = page.blocks[i - 1]
            edges.append((i - 1, i, alike(a, b) * (ADJACENT if page.parent[a.node] == box else ADJACENT / (2 + abs(page.depth[a.node] - page.depth[b.node])))))
        if box in last:
            edges.append((last[box], i, alike(page.blocks[last[box]], b) * SAME_CONTAINER))
        last[box] = i
    return edges


def graph(page: Page, weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Gains (above 0 for content) of all blocks and then of all article and main elements, and the edges."""
    around = setting(page)
    gain = (block_features(page, around) @ weights).tolist()
    edges, hubs = smoothness(page, around), {}
    for i, b in enumerate(page.blocks):
        h = around.hub[b.node]
        if h >= 0:
            if h not in hubs:
                hubs[h] = len(gain)
                gain.append(0.0)
            gain[hubs[h]] += PULL
            edges.append((i, hubs[h], MEMBER))
    return gain, edges


def settle(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """``minimum_cut``, where a node whose gain outweighs all its edges is labelled at once: no labelling of its
    neighbours could make the other label cheaper. Its edges then add to the neighbours' gains, and so on; only what
    is left needs flow."""
    gain, near, sums = list(gain), [[] for _ in gain], [0.0] * len(gain)
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
        sums[a] += c
        sums[b] += c
    label: list[bool | None] = [None] * len(gain)
    queue = deque(range(len(gain)))
    while queue:
        a = queue.popleft()
        if label[a] is not None or abs(gain[a]) <= sums[a] + 1e-9:
            continue
        label[a] = gain[a] > 0
        for b, c in near[a]:
            if label[b] is None:
                gain[b] += c if label[a] else -c
                sums[b] -= c
                queue.append(b)
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        at = {i: k for k, i in enumerate(left)}
        found = minimum_cut([gain[i] for i in left], [(at[a], at[b], c) for a, b, c in edges if a in at and b in at])
        for i, x in zip(left, found):
            label[i] = x
    return label


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    page = parse(html or "")
    if not page.blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(page.blocks, settle(*graph(page, weights))) if keep)


#: Training pages, at most, and how many blocks they weigh as much as against the penalty, whatever their number.
SAMPLE_PAGES, SAMPLE_WEIGHT = 2000, 1000


def labelled(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page's blocks: on a page with an article or main element outside of noise, those in
    it are content and all others are not. Blocks in it that its own tree calls noise, talk or frame say nothing."""
    around = setting(page)
    x = block_features(page, around)
    inside = np.array([around.hub[b.node] >= 0 for b in page.blocks], dtype=bool)
    odd = np.array([max(around.said[b.node][i] for i in (0, 1, 3)) > 0 for b in page.blocks], dtype=bool)
    use = ~(inside & odd) if inside.any() else np.zeros(len(inside), bool)
    return x[use], inside[use]


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES, steps: int = 50) -> np.ndarray:
    """Weights fitted on a bounded sample of whole pages that have an article or main element (see ``labelled``).
    The penalty draws every weight to PRIOR, which stays where no page says more. Pages count by the hash of their
    html: the ``sample`` distinct ones of least hash, each once. Null and empty pages and tables teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [labelled(parse(t.as_py() or "")) for t in b.column(0)]
            x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else (np.zeros((0, FEATURES)), np.zeros(0, bool))
            # Sums by distinct row: features repeat.
            data, n = np.unique(np.column_stack([(x * 8).round() / 8, y]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in data], pa.binary()), pa.array(n, pa.int64())], ["x", "n"])

    known = pages.select(F.col(f"`{html}`").alias("html")).filter(F.col("html").isNotNull()).withColumn("h", F.xxhash64("html"))
    # Only hashes meet in one place; the pages themselves are then taken where they lie, each text once.
    last = known.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return PRIOR
    picked = known.filter(F.col("h") <= last).groupBy("h").agg(F.first("html").alias("html")).select("html")
    rows = picked.mapInArrow(run, "x binary, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").collect()
    if not rows:
        return PRIOR
    data = np.array([np.frombuffer(r["x"]) for r in rows])
    x, y, n = data[:, :-1], data[:, -1], np.array([r["n"] for r in rows], dtype=np.float64)
    n /= n.sum() / SAMPLE_WEIGHT
    w = PRIOR.copy()
    for _ in range(steps):  # Newton's method on the penalised log-likelihood, which is concave
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - (w - PRIOR)
        if np.abs(slope).max() < 1e-6:
            break
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(FEATURES)
        w = w + np.linalg.solve(bend, slope)
    return w


def extract(pages: DataFrame, weights: np.ndarray = PRIOR, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, text and n_chars (code points) for every page. Null, empty and text-free html
    gives the empty text. Repeated rows and nulls in other columns stay; other columns are not read. Map only."""
    given = [w for w in np.asarray(weights, dtype=np.float64)]
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(given)
        for b in batches:
            texts = [main_text(t.as_py(), w) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)
