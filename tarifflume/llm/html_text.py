"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the whole tree.

A page becomes a tree of block elements; text between blocks is a node of its own. For each node
the trees see its tag and attribute words, those of its ancestors, and figures on its subtree's
text, links, controls, depth and siblings. Their score says whether the subtree holds main text.
Decoding then chooses the set of nodes with the greatest total in which a node is kept only
under kept ancestors, so no choice contradicts another.

No table has labelled nodes, so the trees are trained on pages that `training_pages` writes,
with known roles for all parts, in many layouts, with and without telling attributes.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflume.llm.common import ship

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("applet audio canvas embed head iframe math meta noframes noscript object picture script style svg template title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
CONTROLS = frozenset("button input option select textarea".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
HOLDS = frozenset("ul ol dl table select menu html body".split())

# Words of tags and attributes that the trees may ask for.
TAGS = "#text a address article aside blockquote body button center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html input label li main menu nav ol option p pre section select summary table tbody td textarea th thead tr ul".split()
WORDS = (
    "ad ads advert advertisement alert article author banner bar body box breadcrumb breadcrumbs button byline caption card comment comments consent "
    "container content contentinfo cookie cookies copyright detail disqus discussion entry feedback footer foot form gdpr head header hero links list login "
    "logo main masthead menu message modal nav navbar navigation newsletter note notice notification overlay page pager pagination popup post posts privacy "
    "promo recommended related replies reply respond responses rail role search share sharing side sidebar signup site social sponsor sponsored story "
    "subscribe tags teaser text thread title toc toolbar top topbar trending warning widget wrapper"
).split()
_TAG_AT, _WORD_AT = {t: k for k, t in enumerate(TAGS)}, {w: k for k, w in enumerate(WORDS)}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_STOPS = HOLDS | ENDS_PARAGRAPH | {"td", "th", "li"}  # an element that must end does not end beyond these
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: tuple[str, ...] = ()
    runs: list = field(default_factory=list)  # texts and child numbers, in page order
    children: list = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    stops: int = 0
    controls: int = 0
    tags: int = 0
    blocks: int = 0
    place: int = 0  # among its parent's children
    same: int = 0  # siblings of its tag


@lru_cache(maxsize=4096)
def _attribute_words(attributes: str) -> tuple[str, ...]:
    found = [w.lower() for m in _NAMED.finditer(attributes) for w in _ATTRIBUTE_WORD.findall(m[1] or m[2] or m[3] or "")]
    return tuple(dict.fromkeys(w for w in found if w in _WORD_AT))


class _TagEnds:
    """Where tags end: the first > outside quotes.

    What lies behind a place outside quotes is the same for every tag that gets there, so the
    answer is kept for each place and a page is passed once, whatever its tags leave open.
    """

    def __init__(self, page: str):
        self.page = page
        self.known: dict[int, int] = {}  # a > or an opening quote, and the end; -1 without one
        self.gap = (0, -1)  # places without a special sign before the second number

    def after(self, at: int) -> int:
        """The end of a tag whose name ends at `at`, or -1. Calls come in page order."""
        if not self.gap[0] <= at <= self.gap[1]:
            self.gap = (at, self._special(at))
        passed, q = [], self.gap[1]
        while q < len(self.page) and q not in self.known and self.page[q] != ">":
            passed.append(q)
            closing = self.page.find(self.page[q], q + 1)
            q = self._special(closing + 1) if closing >= 0 else len(self.page)
        end = -1 if q == len(self.page) else self.known.get(q, q + 1)
        for k in passed:
            self.known[k] = end
        return end

    def _special(self, at: int) -> int:
        m = _SPECIAL.search(self.page, at)
        return m.start() if m else len(self.page)


def _decoded(data: str) -> str:
    """Character references decoded; numbers of any length, those out of range as U+FFFD."""
    if "&#" in data:
        data = _HUGE.sub("\ufffd", _ZEROS.sub("&#", data))
    return html.unescape(data) if "&" in data else data


def parse(page: str) -> list[Node]:
    """Block nodes in page order, the root first. Tags that are not closed end with what must end them.

    Each step costs what it reads or closes, so the time is linear in the page, malformed or not.
    """
    nodes = [Node("html", -1, 0)]
    path: list[tuple[str, int]] = [("html", 0)]  # open elements; a hidden or inline one has the block around it
    places: dict[str, list[int]] = {}  # where in `path` each tag is open, but for the root
    solid: list[int] = []  # where elements are that are not inline
    stops: list[int] = []  # where elements of _STOPS are
    ends_of = _TagEnds(page)
    links = hidden = 0
    at = begin = 0  # what is read; the begin of text not yet taken

    def text(data: str) -> None:
        if hidden or not data:
            return
        nodes[path[-1][1]].runs.append((_decoded(data), links > 0))

    def push(tag: str, block: int) -> None:
        k = len(path)
        path.append((tag, block))
        places.setdefault(tag, []).append(k)
        if tag not in INLINE:
            solid.append(k)
        if tag in _STOPS:
            stops.append(k)

    def close(down_to: int) -> None:
        nonlocal links, hidden
        while len(path) > down_to:
            tag, _ = path.pop()
            places[tag].pop()
            if tag not in INLINE:
                solid.pop()
            if tag in _STOPS:
                stops.pop()
            links -= tag == "a"
            hidden -= tag in HIDDEN

    def innermost(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while (at := page.find("<", at)) >= 0:
        mark = at
        if page.startswith(("<!", "<?"), at):
            cdata = page.startswith("<![CDATA[", at)
            closing = "-->" if page.startswith("<!--", at) else "]]>" if cdata else ">"
            inner = at + (4 if closing == "-->" else 9 if cdata else 2)
            stop = page.find(closing, inner)
            text(page[begin:mark])
            at = begin = stop + len(closing) if stop >= 0 else len(page)
            if cdata:
                text(page[inner : stop if stop >= 0 else len(page)])
            continue
        m = _TAG.match(page, at)
        end = ends_of.after(m.end()) if m else -1
        if end < 0:
            at += 1  # the sign itself is text
            continue
        text(page[begin:mark])
        at = begin = end
        tag = m[2].lower()
        if m[1]:
            k = innermost(tag)
            # an end tag does not reach out of what it cannot be in
            barrier = solid[-1] if solid and tag in INLINE else innermost("table") if tag in ENDS_PARAGRAPH else 0
            if k and k >= barrier:
                close(k)
            continue
        if tag == "html":
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "body":
            while path[-1][0] == "head" or hidden:
                close(len(path) - 1)
        ends = ("p",) if tag in ENDS_PARAGRAPH else ENDS_ITSELF.get(tag, ())
        while (k := innermost(*ends)) and k >= (stops[-1] if stops else 0):
            close(k)
            if tag not in ("tr", "tbody", "tfoot"):
                break
        if tag in CONTROLS and not hidden:
            nodes[path[-1][1]].controls += 1
        if tag in VOID:
            if tag not in INLINE and not hidden:
                text(" ")
            continue
        if tag in RAW:
            last = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = page.find(">", last.end()) if last else -1
            at = begin = stop + 1 if stop >= 0 else len(page)
            continue
        around = path[-1][1]
        if tag in INLINE or tag in HIDDEN or hidden:
            push(tag, around)
            links += tag == "a"
            hidden += tag in HIDDEN
            nodes[around].tags += 1
            continue
        attributes = page[m.end() : end - 1]
        nodes.append(Node(tag, around, nodes[around].depth + 1, _attribute_words(attributes) if attributes else ()))
        nodes[around].runs.append(len(nodes) - 1)
        nodes[around].children.append(len(nodes) - 1)
        push(tag, len(nodes) - 1)
    text(page[begin:])
    return _with_text_nodes(nodes)


def _with_text_nodes(nodes: list[Node]) -> list[Node]:
    """Text beside block children becomes a node; then figures are summed up the tree."""
    for i in range(len(nodes)):
        node = nodes[i]
        if node.children:
            runs, part = [], []
            for r in [*node.runs, None]:
                if r is None or isinstance(r, int):
                    if any(t.strip() for t, _ in part):
                        nodes.append(Node("#text", i, node.depth + 1, runs=part))
                        runs.append(len(nodes) - 1)
                    part = []
                    if r is not None:
                        runs.append(r)
                else:
                    part.append(r)
            node.runs = node.children = runs
    for node in nodes:
        count = Counter(nodes[c].tag for c in node.children)
        for k, c in enumerate(node.children):
            nodes[c].place, nodes[c].same = k, count[nodes[c].tag] - 1
        if not node.children:
            for t, linked in node.runs:
                n = len(t.strip())
                node.chars += n
                node.linked += n * linked
                node.stops += t.count(".") + t.count(",")
            node.blocks = 1 if node.chars else 0
        node.tags += 1
    done = [len(n.children) for n in nodes]
    ready = [i for i, k in enumerate(done) if not k]
    while ready:
        i = ready.pop()
        up = nodes[i].parent
        if up >= 0:
            node, parent = nodes[i], nodes[up]
            for name in ("chars", "linked", "stops", "controls", "tags", "blocks"):
                setattr(parent, name, getattr(parent, name) + getattr(node, name))
            done[up] -= 1
            if not done[up]:
                ready.append(up)
    return nodes


#: Numbers of a node, and where each is cut into yes-or-no questions.
NUMBERS = ("chars", "share", "linked", "parent_linked", "density", "stops", "controls", "depth", "place", "siblings", "same", "sibling_share", "chars_a_block", "blocks")
CUTS = {
    "chars": (1, 10, 25, 50, 100, 200, 400, 800, 1600, 3200),
    "share": (0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "linked": (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "parent_linked": (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "density": (5, 10, 20, 40, 80, 160),
    "stops": (0.001, 0.005, 0.01, 0.02, 0.03, 0.05),
    "controls": (1, 2, 4),
    "depth": (1, 2, 3, 4, 5, 6, 8),
    "place": (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99),
    "siblings": (1, 2, 3, 5, 8, 15),
    "same": (1, 2, 3, 5, 8),
    "sibling_share": (0.01, 0.05, 0.2, 0.5, 0.8, 0.99),
    "chars_a_block": (5, 10, 20, 40, 80, 160, 320),
    "blocks": (1, 2, 3, 5, 10, 20),
}
N_QUESTIONS = 2 * (len(TAGS) + len(WORDS)) + sum(map(len, CUTS.values()))


def questions(nodes: list[Node], first: int = 0, stop: int | None = None) -> np.ndarray:
    """Nodes x questions: own tag and words, ancestors' tags and words, numbers over their cuts.

    The nodes from `first` to before `stop`; long pages are asked slice by slice.
    """
    stop = len(nodes) if stop is None else stop
    width = len(TAGS) + len(WORDS)
    rows = range(first, stop)
    out = np.zeros((len(rows), N_QUESTIONS), bool)
    for side, masks in enumerate(_masks(nodes)):
        data = np.frombuffer(b"".join(masks[i].to_bytes(-(-width // 8), "little") for i in rows), np.uint8)
        out[:, side * width : (side + 1) * width] = np.unpackbits(data.reshape(len(rows), -1), axis=1, count=width, bitorder="little")
    numbers = np.zeros((len(rows), len(NUMBERS)))
    total = max(1, nodes[0].chars)
    for row, i in enumerate(rows):
        node = nodes[i]
        parent = nodes[node.parent] if node.parent >= 0 else node
        siblings = len(parent.children) - 1 if node.parent >= 0 else 0
        numbers[row] = (
            node.chars, node.chars / total, node.linked / max(1, node.chars), parent.linked / max(1, parent.chars), node.chars / max(1, node.tags), node.stops / max(1, node.chars),
            node.controls, node.depth, node.place / max(1, siblings), siblings, node.same, node.chars / max(1, parent.chars), node.chars / max(1, node.blocks), node.blocks,
        )
    at = 2 * width
    for k, name in enumerate(NUMBERS):
        cuts = np.array(CUTS[name])
        out[:, at : at + len(cuts)] = numbers[:, k, None] >= cuts
        at += len(cuts)
    return out


def _masks(nodes: list[Node]) -> tuple[list[int], list[int]]:
    """Tag and words of each node, and those of all its ancestors, as bits."""
    own, above = [], []
    for i, node in enumerate(nodes):
        k = _TAG_AT.get(node.tag)
        bits = 0 if k is None else 1 << k
        for w in node.words:
            bits |= 1 << len(TAGS) + _WORD_AT[w]
        own.append(bits)
        above.append(own[node.parent] | above[node.parent] if node.parent >= 0 else 0)
    return own, above


def scores_of(nodes: list[Node], trees: Trees, rows: int = 20_000) -> np.ndarray:
    """Scores of a page's nodes, `rows` nodes at a time."""
    return np.concatenate([trees.scores(questions(nodes, a, min(a + rows, len(nodes)))) for a in range(0, len(nodes), rows)])


@dataclass
class Trees:
    """Boosted trees of fixed depth over yes-or-no questions, for the logistic loss."""

    start: float
    asked: np.ndarray  # trees x inner nodes
    leaves: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.full(len(x), self.start), int(math.log2(self.leaves.shape[1]))
        rows = np.arange(len(x))
        for asked, leaves in zip(self.asked, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + x[rows, asked[at]]
            out += leaves[at - (len(leaves) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 100, depth: int = 3, rate: float = 0.3, penalty: float = 2.0) -> Trees:
    mean = y.mean()
    start = math.log(mean / (1 - mean))
    packed, of = np.unique(np.packbits(x, axis=1), axis=0, return_inverse=True)  # nodes with equal answers weigh together
    x = np.unpackbits(packed, axis=1, count=x.shape[1]).astype(bool)
    total, good = np.bincount(of.ravel()), np.bincount(of.ravel(), y)
    f, b = np.full(len(x), start), x.astype(np.float32)
    all_asked, all_leaves = [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h = good - total * p, total * p * (1 - p)
        at, asked = np.zeros(len(x), np.int64), np.zeros(2**depth - 1, np.int64)
        for level in range(depth):
            first = 2**level - 1
            one = (at[:, None] == np.arange(first, 2 * first + 1)).astype(np.float32)
            gs, hs = one * g[:, None].astype(np.float32), one * h[:, None].astype(np.float32)
            yes_g, yes_h = b.T @ gs, b.T @ hs
            no_g, no_h = gs.sum(0) - yes_g, hs.sum(0) - yes_h
            gain = yes_g**2 / (yes_h + penalty) + no_g**2 / (no_h + penalty)
            asked[first : 2 * first + 1] = gain.argmax(0)
            at = 2 * at + 1 + x[np.arange(len(x)), asked[at]]
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        f += value[leaf]
        all_asked.append(asked)
        all_leaves.append(value)
    return Trees(start, np.array(all_asked), np.array(all_leaves))


def decode(nodes: list[Node], scores: np.ndarray) -> list[bool]:
    """The nodes kept: greatest total score with each kept node's parent kept."""
    gain = np.clip(scores, -6, 6).tolist()
    order = sorted(range(len(nodes)), key=lambda i: -nodes[i].depth)
    for i in order:
        if nodes[i].parent >= 0 and gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [False] * len(nodes)
    for i in reversed(order):
        kept[i] = gain[i] > 0 and (nodes[i].parent < 0 or kept[nodes[i].parent])
    return kept


def kept_text(nodes: list[Node], kept: list[bool]) -> str:
    """White space inside a block becomes one space; blocks in page order are joined by one space."""
    out, stack = [], [0] if kept[0] else []
    while stack:
        i = stack.pop()
        if nodes[i].children:
            stack += [c for c in reversed(nodes[i].children) if kept[c]]
        else:
            out += "".join(t for t, _ in nodes[i].runs).split()
    return " ".join(out)


# --- training pages ---------------------------------------------------------------------


def training_pages(n: int, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Pages and the marks of their main texts: each text carries a mark of its own."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda *of: of[int(rng.integers(len(of)))]
    chance = lambda p: rng.random() < p
    letters = np.array(list("etaoinshrdlucmfwypvbg"))
    pool = ["".join(letters[rng.integers(0, len(letters), k)]) for k in rng.integers(1, 9, 3000)]
    pages = []
    for _ in range(n):
        main: set[str] = set()
        count = 0

        def words(low, high):
            return [pool[k] for k in rng.integers(0, len(pool), int(rng.integers(low, high + 1)))]

        def text(low, high, is_main, stops=True):
            nonlocal count
            count += 1
            mark = f"q{count}z"
            if is_main:
                main.add(mark)
            own = [mark, *words(low, high)]
            draws = rng.random(len(own))
            for k in range(1, len(own)):
                if stops and draws[k] < 0.12:
                    own[k] += "," if draws[k] < 0.04 else "."
                if draws[k] > 0.99:
                    own[k] = pick(f"<b>{own[k]}</b>", f"<em>{own[k]}</em>", f'<a href="/x">{own[k]}</a>', f"{own[k]} &amp;")
            return " ".join(own)

        def links(low, high, tag=None):
            items = [f'<a href="/{k}">{text(0, 3, False, False)}</a>' for k in range(int(rng.integers(low, high + 1)))]
            kind = tag or pick("ul", "ul", "plain", "p", "div")
            if kind == "ul":
                return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
            return {"p": "<p>" + " | ".join(items) + "</p>", "plain": " ".join(items), "div": "".join(f"<div>{x}</div>" for x in items)}[kind]

        def named(*of):
            word = pick(*of)
            name = pick(word, f"{pick('site', 'page', 'main', 'top', 'box')}-{word}", f"{word}-{pick('list', 'wrapper', 'box', 'container')}", f"{word}{int(rng.integers(9))}")
            return pick(f' class="{name}"', f' id="{name}"', f' class="{name} {pick("a", "b1", "x")}"')

        def paragraphs(low, high, is_main, most=60):
            return "".join(f"<p>{text(0, int(rng.integers(1, most)), is_main)}</p>" for _ in range(int(rng.integers(low, high + 1))))

        def content():
            out = []
            if chance(0.1):  # hardly any text
                return f"<h1>{text(0, 1, True, False)}</h1>" * chance(0.8) + f"<p>{text(0, 1, True)}</p>" * int(rng.integers(1, 3))
            if chance(0.85):
                head = f"<h1>{text(0, 12, True, False)}</h1>"
                out.append(f"<header>{head}</header>" if chance(0.15) else head)
            n_parts = int(rng.integers(1, 3)) if chance(0.25) else int(rng.integers(1, 12))
            for _ in range(n_parts):
                kind = rng.random()
                if kind < 0.7:
                    body = text(0, 5, True) if chance(0.3) else text(3, 120, True)
                    out.append(pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<div>{body}</div>" if chance(0.3) else f"<p>{body}</p>"))
                elif kind < 0.8:
                    out.append(f"<h2>{text(0, 6, True, False)}</h2>")
                elif kind < 0.87:
                    out.append("<ul>" + "".join(f"<li>{text(0, 15, True)}</li>" for _ in range(int(rng.integers(1, 6)))) + "</ul>")
                elif kind < 0.91:
                    out.append(f"<blockquote>{paragraphs(1, 2, True)}</blockquote>")
                elif kind < 0.94:
                    out.append("<table>" + "".join(f"<tr><td>{text(0, 3, True, False)}</td><td>{text(0, 3, True, False)}</td></tr>" for _ in range(int(rng.integers(1, 5)))) + "</table>")
                elif kind < 0.96:
                    out.append(f"<pre>{text(2, 20, True)}</pre>")
                elif kind < 0.98:
                    out.append(f"<figure><img src=x><figcaption>{text(1, 10, True)}</figcaption></figure>")
                else:
                    out.append(f"<section>{paragraphs(1, 3, True)}</section>")
            if chance(0.3):
                extra = pick(advert, share, related, comments, form, notice, aside)()
                out.insert(int(rng.integers(1, len(out) + 1)), extra)
            return "".join(out)

        def advert():
            body = pick(text(2, 30, False), paragraphs(1, 2, False, 30), links(1, 3))
            return pick(f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'sponsor')}>{body}</div>", f"<aside{named('ad', 'promo')}>{body}</aside>")

        def share():
            return f"<div{named('share', 'social', 'sharing', 'toolbar')}>{links(2, 5)}</div>"

        def related():
            return pick(f"<div{named('related', 'recommended', 'trending', 'teaser')}><h3>{text(1, 2, False)}</h3>{links(2, 8)}</div>", f"<aside><h3>{text(0, 2, False)}</h3>{links(3, 8, 'ul')}</aside>")

        def comments():
            one = lambda: f"<div{named('comment', 'reply') if chance(0.7) else ''}><p>{text(0, 2, False)}</p>{paragraphs(1, 2, False)}</div>"
            body = f"<h3>{text(0, 2, False)}</h3>" * chance(0.6) + "".join(one() for _ in range(int(rng.integers(1, 8))))
            if chance(0.2):
                body = "<ol>" + "".join(f"<li>{paragraphs(1, 2, False)}</li>" for _ in range(int(rng.integers(1, 6)))) + "</ol>"
            return pick(f"<section{named('comments', 'discussion', 'responses', 'replies', 'thread')}>{body}</section>", f"<div{named('comments', 'disqus', 'respond', 'feedback')}>{body}</div>")

        def form():
            body = f"<p>{text(0, 12, False)}</p>" * chance(0.6) + f"<label>{text(0, 2, False)}</label><input name=q>" + f"<button>{text(0, 1, False)}</button>" * chance(0.7)
            body = f"<form action=/s>{body}</form>"
            return pick(body, f"<div{named('newsletter', 'subscribe', 'signup', 'login', 'search')}>{body}</div>")

        def notice():
            body = pick(text(4, 40, False), paragraphs(1, 2, False, 30)) + f"<button>{text(0, 1, False)}</button>" * chance(0.4)
            return f"<div{named('cookie', 'cookies', 'consent', 'notice', 'gdpr', 'privacy', 'notification', 'alert', 'popup', 'modal', 'overlay', 'warning', 'message')}>{body}</div>"

        def aside():
            body = pick(links(2, 8), paragraphs(1, 3, False, 30), f"<h3>{text(0, 2, False)}</h3>{links(2, 6)}", related(), form())
            return pick(f"<aside>{body}</aside>", f"<div{named('sidebar', 'side', 'rail', 'widget')}>{body}</div>", f"<aside{named('sidebar', 'widget')}>{body}</aside>")

        def menu():
            body = links(2, 12)
            return pick(f"<nav>{body}</nav>", f"<nav>{body}</nav>", f"<div{named('nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'pagination', 'pager', 'toc')}>{body}</div>", f"<div>{links(4, 12, 'ul')}</div>", links(3, 10, "ul"))

        def header():
            body = pick(f"<h1>{text(0, 2, False, False)}</h1>", f"<div>{text(0, 2, False)}</div>", f"<p>{text(1, 8, False)}</p>", text(0, 4, False)) + menu() * chance(0.6)
            return pick(f"<header>{body}</header>", f"<div{named('header', 'masthead', 'topbar', 'head', 'logo')}>{body}</div>")

        def footer():
            body = pick(text(2, 25, False), paragraphs(1, 2, False, 40), links(2, 6), f"&copy; x &middot; {text(1, 15, False)}")
            return pick(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div{named('footer', 'copyright', 'foot', 'contentinfo')}>{body}</div>")

        body = content()
        where = rng.random()
        if where < 0.4:
            body = f"<article>{body}</article>"
        elif where < 0.5:
            body = f"<main>{body}</main>"
        elif where < 0.6:
            body = f"<main><article>{body}</article></main>"
        elif where < 0.9:
            body = f"<{pick('div', 'div', 'section')}{named('content', 'article', 'post', 'entry', 'story', 'body', 'text', 'main', 'detail')}>{body}</div>"
        else:
            body = f"<div>{body}</div>"
        if chance(0.25):
            body = f"<div{pick(' class=wrapper', ' id=page', '', ' class=container')}>{pick('', aside(), menu())}{body}{pick('', aside(), comments(), related())}</div>"
        before = "".join(pick(menu, menu, header, header, advert, notice, form, aside)() for _ in range(int(rng.integers(0, 5))))
        after = "".join(pick(footer, footer, aside, comments, related, share, advert, notice, menu, form)() for _ in range(int(rng.integers(0, 5))))
        pages.append((f"<html><head><title>{text(1, 8, False)}</title></head><body>{before}{body}{after}</body></html>", main))
    return pages


def labels(nodes: list[Node], main: set[str]) -> np.ndarray:
    """Whether each node's subtree holds main text."""
    out = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if not node.children and any(w in main for t, _ in node.runs for w in t.split()):
            while i >= 0 and not out[i]:
                out[i] = True
                i = nodes[i].parent
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 1200, seed: int = 5) -> Trees:
    """Trees fitted to `pages` training pages; nodes without text are left out."""
    x, y = [], []
    for page, main in training_pages(pages, seed):
        nodes = parse(page)
        some = np.array([n.chars > 0 for n in nodes])
        x.append(questions(nodes)[some])
        y.append(labels(nodes, main)[some])
    return boost(np.concatenate(x), np.concatenate(y).astype(float))


def main_text(page: str | None, trees: Trees) -> str:
    if not page:
        return ""
    nodes = parse(page)
    return kept_text(nodes, decode(nodes, scores_of(nodes, trees)))


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of `pages`, from the whole html.

    A null html or one without main text gives an empty text. Null and repeated ids and urls are
    rows like any other; an empty table gives no rows. Trees of any origin may be given.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees or trained())

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = []
            source = batch.column(2).to_pylist()
            a = 0
            while a < len(source):  # pages of some thousand nodes together are scored at once
                parsed, size = [], 0
                while a < len(source) and size < 20_000:
                    parsed.append(parse(source[a]) if source[a] else [])
                    size += len(parsed[-1])
                    a += 1
                if len(parsed) == 1:
                    scores = scores_of(parsed[0], own) if parsed[0] else np.zeros(0)
                else:
                    asked = [questions(p) for p in parsed[:-1] if p]
                    scores = np.concatenate([own.scores(np.concatenate(asked)) if asked else np.zeros(0), scores_of(parsed[-1], own) if parsed[-1] else np.zeros(0)])
                at = 0
                for p in parsed:
                    texts.append(kept_text(p, decode(p, scores[at : at + len(p)])) if p else "")
                    at += len(p)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
