"""Main text of web pages by a tree-structured graphical model over their DOM.

Every block-level element and every block of text is a node with a hidden label, content or not. A node's tag, class
names and text shape depend on its label; its label depends on its parent's (the pairwise potential). Potentials are
counted on labelled pages. Sum-product messages pass from the leaves to the root and back, which gives each block its
exact marginal probability of being content; blocks of one half or more make the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playseq.llm import html_examples
from playseq.llm.common import map_text

#: Most pages, and most characters of one of them, that potentials are counted on.
PAGES, PAGE_CHARS = 400, 200_000
#: With fewer labelled pages among those drawn, the package's own examples are counted too.
LEAST_PAGES = 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never part of a page's text.
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video textarea select title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: An opening tag on the left closes open elements on the right, up to the named boundary elements.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDARY = frozenset("ul ol dl table div section article body html td th".split())
#: Kinds of tags, and of words in class, id and role, that share a potential.
KINDS = {
    "frame": "nav header footer aside form menu dialog button fieldset",
    "story": "article main",
    "section": "div section body html center",
    "prose": "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption",
    "list": "ul ol li dl dt dd table tbody thead tr td th",
}
WORDS = {
    "frame": "ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments cookie copyright disclaimer feedback footer form header legal login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommend recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar topbar widget",
    "story": "article articlebody body content entry main post story text",
}
#: Prior chance of content below a node that is not, by the kind of the child; the chance of the reverse is LEAVE.
#: Each prior counts as PRIOR observed pairs. An article may begin at any section, seldom at a paragraph.
ENTER = {"text": 0.0005, "frame": 0.001, "story": 0.5, "section": 0.05, "prose": 0.0005, "list": 0.0005, "other": 0.002}
LEAVE = {"text": 0.0005, "frame": 0.9}
PRIOR = 50.0
#: Share of a label's nodes that every value of a feature is given beforehand, so that few labelled pages don't settle
#: it; the values that say "frame" need no such care.
SMOOTHING, SURE = 0.02, 0.0005
_KINDS = {kind: i for i, kind in enumerate(ENTER)}
_KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags.split()}
_WORD = {word: kind for kind, words in WORDS.items() for word in words.split()}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(/?)(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Node:
    parent: int
    depth: int
    tag: str
    names: tuple[str, ...] = ()
    text: str | None = None  # of a block of text
    features: list[str] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """Nodes in page order: block-level elements, and leaves that hold a block of text each. Node 0 is the page."""
    nodes = [Node(-1, 0, "html")]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the node each belongs to
    pieces: list[str] = []
    in_link, linked, dropped = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            owner = stack[-1][1]
            leaf = Node(owner, nodes[owner].depth + 1, "#text", text=text)
            share = min(1.0, linked / len(text))
            leaf.features = [
                f"size={min(10, len(text).bit_length())}",
                f"links={math.ceil(share * 3)}",
                f"end={text[-1] in '.!?:;\"»”…'}",
                f"sign={'©' in text[:80]}",
            ]
            nodes.append(leaf)
        linked = 0

    opened: Counter[str] = Counter()  # open elements by tag

    def pop_to(depth: int) -> None:
        nonlocal in_link, dropped
        while len(stack) > depth:
            tag = stack.pop()[0]
            opened[tag] -= 1
            in_link -= tag == "a"
            dropped -= tag in DROPPED

    def add_text(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        if not match:
            add_text(page[at:])
            break
        add_text(page[at : match.start()])
        at = match.end()
        closing, opening, attributes = match.group(1), match.group(2) or match.group(5), match.group(3) or match.group(6) or ""
        if closing:
            tag = closing.lower()
            if not opened[tag]:
                # An end tag without a start; only these two mean something.
                if tag in ("br", "p"):
                    flush()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    if any(t not in INLINE for t, _ in stack[depth:]):
                        flush()
                    pop_to(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break  # a stray inline end tag closes no block
            continue
        if not opening:
            continue
        tag = opening.lower()
        if tag in ("html", "body") and any(t == tag for t, _ in stack[1:]):
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID and not attributes.endswith("/"):
                stack.append((tag, stack[-1][1]))
                opened[tag] += 1
                in_link += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        if tag == "body":
            pop_to(next((i for i, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        closed = ("p",) if tag in BLOCKS else CLOSES.get(tag, ())
        depth = len(stack) - 1
        while depth > 0 and closed:
            if stack[depth][0] in closed:
                pop_to(depth)
            elif stack[depth][0] in BOUNDARY:
                break
            depth -= 1
        owner = stack[-1][1]
        names = tuple(w for m in _NAMES.finditer(attributes) for w in _SPLIT.split((m.group(1) or m.group(2) or m.group(3) or "").lower()) if w) if attributes else ()
        node = Node(owner, nodes[owner].depth + 1, tag, names)
        node.features = [f"kind={_KIND.get(tag, 'other')}", *(f"word={w}" for w in set(names)), f"words={next((_WORD[w] for w in names if _WORD.get(w) == 'frame'), next((_WORD[w] for w in names if w in _WORD), 'none'))}"]
        nodes.append(node)
        stack.append((tag, len(nodes) - 1))
        opened[tag] += 1
        dropped += tag in DROPPED
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
    flush()
    return nodes


def semantic_labels(nodes: Sequence[Node]) -> list[int] | None:
    """Labels of pages that mark their article up: what lies in article or main, but in no frame inside it, is content.

    None for a page without such markup: it is not learned from. The default labeller; ``fit`` takes any other.
    """
    labels: list[int] = []
    for node in nodes:
        above = labels[node.parent] if node.parent >= 0 else 0
        if node.text is not None:
            labels.append(above)
        elif node.tag in ("article", "main"):
            labels.append(1)
        elif node.tag in DROPPED or _KIND.get(node.tag) == "frame" or any(_WORD.get(w) == "frame" for w in node.names):
            labels.append(0)
        else:
            labels.append(above)
    return labels if any(n.tag in ("article", "main") for n in nodes) else None


@dataclass
class Potentials:
    """Log potentials: of a label given the parent's (kind of child x 2 x 2), and of features given a label."""

    pair: np.ndarray
    features: dict[str, tuple[float, float]]

    def marginals(self, pages: Sequence[Sequence[Node]]) -> list[np.ndarray]:
        """Probability of content of every node of every page, by two passes of messages over all pages at once."""
        sizes = [len(p) for p in pages]
        starts = np.cumsum([0, *sizes[:-1]])
        own = np.array([[sum(x) for x in zip((0.0, 0.0), *(self.features[f] for f in n.features if f in self.features))] for p in pages for n in p]).reshape(-1, 2)
        parent = np.array([n.parent + s if n.parent >= 0 else -1 for p, s in zip(pages, starts) for n in p], dtype=np.int64)
        depth = np.array([n.depth for p in pages for n in p], dtype=np.int64)
        kind = np.array([_KINDS["text" if n.text is not None else _KIND.get(n.tag, "other")] for p in pages for n in p], dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else [0]
        levels = [order[a:b] for a, b in zip(bounds, bounds[1:])]
        below = own.copy()  # own potential and the messages of all children
        up = np.zeros_like(own)
        for level in reversed(levels[1:]):
            pair = self.pair[kind[level]]  # by parent's label, own label
            up[level] = np.logaddexp(pair[:, :, 0] + below[level, 0, None], pair[:, :, 1] + below[level, 1, None])
            np.add.at(below, parent[level], up[level])
        down = np.zeros_like(own)
        down[parent < 0] = [0.0, -3.0]  # the page as a whole is seldom all content
        for level in levels[1:]:
            pair = self.pair[kind[level]]
            rest = down[parent[level]] + below[parent[level]] - up[level]
            down[level] = np.logaddexp(rest[:, 0, None] + pair[:, 0], rest[:, 1, None] + pair[:, 1])
        belief = down + below
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        return [content[s : s + n] for s, n in zip(starts, sizes)]


def count(pages: Sequence[Sequence[Node]], labels: Sequence[Sequence[int]]) -> Potentials:
    """Potentials from labelled pages: conditional frequencies, smoothed by the priors above."""
    pair = np.array([[[1 - ENTER[k], ENTER[k]], [LEAVE.get(k, 0.01), 1 - LEAVE.get(k, 0.01)]] for k in _KINDS]) * PRIOR
    seen: dict[str, Counter] = defaultdict(Counter)
    nodes = {True: Counter({0: 1, 1: 1}), False: Counter({0: 1, 1: 1})}  # of text blocks and elements, by label
    for page, own in zip(pages, labels):
        for node, label in zip(page, own):
            if node.parent >= 0:
                pair[_KINDS["text" if node.text is not None else _KIND.get(node.tag, "other")], own[node.parent], label] += 1
            nodes[node.text is not None][label] += 1
            for f in node.features:
                seen[f][label] += 1
    for f in ("kind=frame", "words=frame"):
        seen[f][0] += 1
    seen["words=story"][1] += max(1, nodes[False][1] // 10)
    features = {}
    for f, counts in seen.items():
        total = nodes[f.split("=")[0] in ("size", "links", "end", "sign")]
        least = SURE if f.endswith("=frame") else SMOOTHING
        features[f] = tuple(math.log(counts[y] / total[y] + least) for y in (0, 1))
    return Potentials(np.log(pair / pair.sum(axis=2, keepdims=True)), features)


def fit(pages: DataFrame, labels: Callable[[Sequence[Node]], list[int] | None] = semantic_labels, most: int = PAGES) -> Potentials:
    """Count potentials on at most ``most`` pages (those with the smallest hash) that ``labels`` can label.

    If that leaves fewer than LEAST_PAGES, as in tables whose pages mark no article up, on ``examples`` as well.
    """
    size = pages.where(F.col("html").isNotNull()).count()
    few = pages.where((F.length("html") <= PAGE_CHARS) & (F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < min(1_000_000, 3_000_000 * most // max(1, size))))
    drawn = few.select(F.xxhash64("html").alias("h"), "html").orderBy("h").limit(most).collect()
    parsed = [p for p in (parse(r["html"]) for r in drawn)]
    known = [(p, own) for p, own in ((p, labels(p)) for p in parsed) if own is not None]
    if len(known) < LEAST_PAGES:
        known += examples()
    return count([p for p, _ in known], [own for _, own in known])


def examples() -> list[tuple[list[Node], list[int]]]:
    """The package's own labelled pages: the labels of a page hold for its variants."""
    out = []
    for marked, others in html_examples.labelled():
        own = semantic_labels(parse(marked))
        out += [(parse(other), own) for other in others]
    return out


def extract(pages: DataFrame, potentials: Potentials, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Add ``text`` and ``n_chars`` to the columns ``keep``; kept columns with these names are replaced.

    The whole of each page is parsed. White space inside a block becomes one space, blocks are joined by a line break in
    page order. Null or empty html, and pages without content, give an empty text. Unclosed and cut-off markup is read
    as browsers do, roughly: what is open at the end is closed there.
    """
    shared = pages.sparkSession.sparkContext.broadcast(potentials)

    def make():
        known = shared.value

        def work(texts):
            out = []
            for i in range(0, len(texts), 64):
                trees = [parse((t or b"").decode(errors="replace")) for t in texts[i : i + 64]]
                for tree, content in zip(trees, known.marginals(trees)):
                    out.append("\n".join(n.text for n, p in zip(tree, content) if n.text is not None and p >= 0.5))
            return [out, [len(t) for t in out]]

        return work

    return map_text(pages, keep, "html", [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)


def main_text(pages: DataFrame) -> DataFrame:
    """Learn the potentials from ``pages`` themselves (see ``fit``) and extract all of them."""
    return extract(pages, fit(pages))
