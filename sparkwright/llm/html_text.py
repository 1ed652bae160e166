"""Main text of web pages: gradient-boosted trees over DOM nodes.

A page is parsed into a tree (tag soup allowed). Runs of text and inline elements
right under the scaffolding (root, html, body) become anonymous blocks. Each block,
and each inline element whose attributes name a kind of part, gets features of its
tag, attribute tokens, depth, siblings and subtree (text, link and tag density),
and boosted regression trees score it as content or boilerplate. Decoding is
hierarchical: one pass from the leaves up finds the labelling of the whole tree
with the best total score in which nothing under a dropped element is kept, so that
ancestors and descendants never contradict each other.

The model is fitted on pages made from a rule (``training_pages``), with known
labels; it depends on no corpus and is the same everywhere.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import arrow_map

# Fixed values of the HTML syntax.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul #run".split()
)
SCAFFOLD = ("#root", "html", "body")
#: Elements that never hold page text.
SILENT = frozenset("script style head title noscript template svg math iframe object embed applet noembed noframes select option textarea button input datalist canvas audio video map".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "option": {"option"},
}
_P_CLOSERS = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "caption", "summary", "figcaption"}
#: Elements that closing by a start tag does not reach past.
_FENCE = frozenset("table ul ol dl div article section main aside nav header footer form body blockquote td th li".split())

_NONE, _P = frozenset(), frozenset("p")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth", "index", "foreign")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.foreign = tag in ("svg", "math") or parent is not None and parent.foreign
        self.index = 0


class _Open:
    """The open elements, and which tags are among them: in all, since the last one
    that closing by a start tag does not pass (``_FENCE``), and since the last block.
    A walk up is made only where it ends in closing all it passes."""

    def __init__(self, root: Node):
        self.here, self.all, self.fences, self.blocks = root, Counter(), [Counter()], [Counter()]

    def enter(self, node: Node) -> None:
        tag = node.tag
        self.here = node
        self.all[tag] += 1
        if tag in _FENCE:
            self.fences.append(Counter())
        self.fences[-1][tag] += 1
        if tag in BLOCK:
            self.blocks.append(Counter())
        else:
            self.blocks[-1][tag] += 1

    def close(self, tags) -> None:
        """Close the nearest element of these tags, and all within it."""
        while True:
            node = self.here
            tag, self.here = node.tag, node.parent
            self.all[tag] -= 1
            if tag in _FENCE:
                self.fences.pop()
            else:
                self.fences[-1][tag] -= 1
            if tag in BLOCK:
                self.blocks.pop()
            else:
                self.blocks[-1][tag] -= 1
            if tag in tags:
                return


def parse(page: str) -> Node:
    """A tree of elements and text; unclosed and stray tags are put right."""
    root = Node("#root", "", None)
    at, open_ = 0, _Open(root)
    n = len(page)
    while at < n:
        here = open_.here
        m = _TOKEN.search(page, at)
        if not m:
            here.children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            here.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in _P_CLOSERS or tag in CLOSES:
                closes = CLOSES.get(tag, _NONE) | (_P if tag in _P_CLOSERS else _NONE)
                while any(open_.fences[-1][t] for t in closes):
                    open_.close(closes)
                    if tag not in ("tr", "tbody", "tfoot", "thead"):
                        break
            node = Node(tag, m[3] or "", open_.here)
            open_.here.children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                node.children.append(page[at : end.start()])
                at = end.end()
            elif tag not in VOID and not (node.foreign and node.attrs.endswith("/")):
                # Outside SVG and MathML a slash at the end of a start tag means nothing.
                open_.enter(node)
        elif m[1]:
            tag = m[1].lower()
            # An inline end tag does not close blocks.
            if (open_.all if tag in BLOCK else open_.blocks[-1])[tag]:
                open_.close((tag,))
    _wrap_runs(root)
    return root


def _wrap_runs(root: Node) -> None:
    """Put each run of inline content right under the scaffolding into a block of its
    own (``#run``, with the attributes of its elements). An inline element with blocks
    in it is scaffolding too."""
    holders: set[int] = set()
    scaffold, stack = [], [(root, True)]
    while stack:
        node, bare = stack.pop()
        if node.tag in SILENT:
            continue
        bare = bare and (node.tag in SCAFFOLD or node.tag not in BLOCK)
        if bare:
            scaffold.append(node)
        if node.tag in BLOCK:
            up = node.parent
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
        stack.extend((c, bare) for c in node.children if isinstance(c, Node))
    for node in scaffold:
        if node.tag not in SCAFFOLD and id(node) not in holders:
            continue
        out: list[Node | str] = []
        run: list[Node | str] = []
        for c in [*node.children, None]:
            if isinstance(c, str) or c is not None and (c.tag in SILENT or c.tag not in BLOCK and id(c) not in holders):
                run.append(c)
                continue
            if any(_has_text(x) for x in run):
                block = Node("#run", " ".join(x.attrs for x in run if isinstance(x, Node)), node)
                block.children = run
                for x in run:
                    if isinstance(x, Node):
                        x.parent = block
                out.append(block)
            else:
                out += run
            run = []
            if c is not None:
                out.append(c)
        node.children = out


def _has_text(item: Node | str) -> bool:
    todo = [item]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return True
        elif x.tag not in SILENT:
            todo += x.children
    return False


#: Attribute tokens with a meaning of their own, by the kind of part they name.
TOKENS = {
    "content": "article content entry post story main body text page prose copy",
    "navigation": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip links",
    "edge": "header masthead banner footer bottom top copyright colophon legal",
    "side": "sidebar side aside related rail recommended widget widgets trending popular more",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert privacy toast paywall subscribe newsletter signup",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad adsense dfp outbrain taboola",
    "comment": "comment comments reply replies discussion respond disqus thread feedback reviews",
    "social": "share social sharing tags tag follow meta byline author toolbar login search form",
}
_KIND = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_TAGS = ("article", "main", "section", "div", "p", "li", "ul", "nav", "header", "footer", "aside", "form", "h1", "h2", "table", "td", "blockquote", "pre", "figure", "body", "dialog", "details", "fieldset", "#run", "#inline")
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
N_FEATURES = len(_TAGS) + 2 * len(TOKENS) + 15


def _tokens(node: Node) -> np.ndarray:
    out = np.zeros(len(TOKENS), np.float32)
    if node.attrs:
        for name, a, b, c in _ATTRIBUTE.findall(node.attrs):
            if name.lower() in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
                for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
                    k = _KIND.get(word)
                    if k is None and word.endswith("s"):
                        k = _KIND.get(word[:-1])
                    if k is not None:
                        out[k] = 1
    return out


def elements(root: Node) -> tuple[list[Node], np.ndarray]:
    """Block elements, and inline ones that attributes name, in page order (each after
    its ancestors), and their features."""
    nodes: list[Node] = []
    named: list[np.ndarray] = []
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if node.tag in SILENT:
            continue
        own = _tokens(node)
        if node.tag in BLOCK or node is root or own.any():
            node.index = len(nodes)
            nodes.append(node)
            named.append(own)
        else:
            node.index = -1
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    n = len(nodes)
    own_text, own_link, own_tags = np.zeros(n), np.zeros(n), np.zeros(n)

    def gather(block: Node) -> None:
        up = block.parent
        while up is not None and up.tag != "a" and up.tag not in BLOCK:
            up = up.parent
        todo: list[tuple[Node, bool]] = [(block, block.tag == "a" or up is not None and up.tag == "a")]
        k = block.index
        while todo:
            node, link = todo.pop()
            for c in node.children:
                if isinstance(c, str):
                    length = len(c.strip())
                    own_text[k] += length
                    own_link[k] += length * link
                elif c.tag not in SILENT:
                    own_tags[k] += 1
                    if c.index < 0:
                        todo.append((c, link or c.tag == "a"))

    up = np.full(n, -1)
    for node in nodes:
        gather(node)
        p = node.parent
        while p is not None and p.index < 0:
            p = p.parent
        up[node.index] = p.index if p is not None else -1
    text, link, tags = own_text.copy(), own_link.copy(), own_tags.copy()
    size = np.ones(n)
    for k in range(n - 1, 0, -1):
        for a in (text, link, tags, size):
            a[up[k]] += a[k]
    x = np.zeros((n, N_FEATURES), np.float32)
    siblings, before = np.zeros(n), np.zeros(n)
    for k in range(1, n):
        before[k] = siblings[up[k]]
        siblings[up[k]] += 1
    total = max(text[0], 1)
    at = len(_TAGS)
    for k, node in enumerate(nodes):
        t = _TAG_AT.get(node.tag if node.tag in BLOCK or node is root else "#inline")
        if t is not None:
            x[k, t] = 1
        x[k, at : at + len(TOKENS)] = named[k]
        # What ancestors are named, and which of their tags frame content.
        if up[k] >= 0:
            x[k, at + len(TOKENS) : at + 2 * len(TOKENS)] = np.maximum(x[up[k], at + len(TOKENS) : at + 2 * len(TOKENS)], x[up[k], at : at + len(TOKENS)])
    at += 2 * len(TOKENS)
    parent = np.maximum(up, 0)
    frames = [("article", "main"), ("nav", "footer", "form", "header"), ("aside", "dialog")]
    inside = np.zeros((n, 3), np.float32)
    for k in range(1, n):
        for f, names in enumerate(frames):
            inside[k, f] = max(inside[up[k], f], nodes[up[k]].tag in names)
    columns = [
        np.log1p(text), np.log1p(own_text), link / np.maximum(text, 1), text / np.maximum(tags + 1, 1), text / total, np.array([v.depth for v in nodes]),
        siblings[parent], before, siblings, np.log1p(size), text[parent] / total, link[parent] / np.maximum(text[parent], 1), inside[:, 0], inside[:, 1], inside[:, 2],
    ]
    x[:, at:] = np.stack(columns, 1)
    return nodes, x


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, by histograms."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.3, bins: int = 32):
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def _cuts(self, values: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Between all values where they are few (rare flags included), else by quantiles."""
        if len(values) <= self.bins:
            return (values[1:] + values[:-1]) / 2
        return np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [self._cuts(np.unique(c), c) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f, width, m = np.full(len(y), self.base), self.bins + 1, x.shape[1]
        self.trees = []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-6
            leaf, nodes = np.zeros(len(y), int), {}
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                at = leaf - first
                cell = ((at[:, None] * m + np.arange(m)) * width + b).ravel()
                gs = np.bincount(cell, np.repeat(g, m), count * m * width).reshape(count, m, width)
                hs = np.bincount(cell, np.repeat(h, m), count * m * width).reshape(count, m, width)
                gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
                gt, ht = gs.sum(2)[:, :1, None], hs.sum(2)[:, :1, None]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
                best = gain.reshape(count, -1).argmax(1)
                for k in range(count):
                    j, c = divmod(int(best[k]), width - 1)
                    if gain[k, j, c] <= 1e-6 or c >= len(self.cuts[j]):
                        j, c = 0, width
                    nodes[first + k] = (j, c)
                j = np.array([nodes[first + k][0] for k in range(count)])[at]
                c = np.array([nodes[first + k][1] for k in range(count)])[at]
                leaf = 2 * leaf + 1 + (b[np.arange(len(b)), j] > c)
            first, count = (1 << self.depth) - 1, 1 << self.depth
            value = self.rate * np.bincount(leaf - first, g, count) / (np.bincount(leaf - first, h, count) + 1)
            f += value[leaf - first]
            features = np.array([nodes[k][0] for k in range(first)])
            bounds = np.array([self.cuts[j][c] if c < len(self.cuts[j]) else np.inf for j, c in (nodes[k] for k in range(first))], np.float32)
            self.trees.append((features, bounds, value))
        self.features, self.bounds, self.values = (np.stack(a) for a in zip(*self.trees, strict=True))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds, all trees and rows at once."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.features))
        at = np.zeros((len(x), len(trees)), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.features[trees, at]] >= self.bounds[trees, at])
        return self.base + self.values[trees, at - ((1 << self.depth) - 1)].sum(1)


def training_pages(count: int = 1200, seed: int = 5):
    """Pages made from a rule, each with the set of its content elements: marked by
    data-c="1". Layouts vary: with or without semantic tags, class names, sidebars,
    notices, adverts, forms, comments, lists, quotes and tables; some have bare text
    right under the body, as the article or as clutter beside it."""
    rng = random.Random(seed)
    syllables = "ba ke li mo nu ra se ti vo wa en er on st".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    named = lambda kind: f' {rng.choice(["class", "id", "class"])}="{rng.choice(TOKENS[kind].split())}{rng.choice(["", "-box", "_area", " wide", "-1"])}"'
    c = ' data-c="1"'

    def links(n):
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n))

    def clutter(kind):
        name = named(kind) if rng.random() < 0.55 else ""
        body = rng.choice([
            lambda: f"<ul>{links(rng.randint(2, 9))}</ul>", lambda: f"<p>{words(3, 30)}</p>", lambda: words(2, 25), lambda: f"<h3>{words(1, 4)}</h3><p>{words(5, 40)}</p><p><a href=#>{words(1, 3)}</a></p>",
            lambda: f'<a href="/x">{words(2, 9)}</a>', lambda: f"<div><p>{words(8, 60)}</p></div>" * rng.randint(1, 4),
        ])()
        tag = {"navigation": ["nav", "nav", "div", "ul"], "edge": ["header", "footer", "div"], "side": ["aside", "aside", "div", "section"], "notice": ["div", "div", "dialog", "section"],
               "advert": ["div", "div", "aside", "section"], "comment": ["section", "div", "ol"], "social": ["div", "form", "ul"]}[kind]
        tag = rng.choice(tag)
        if tag == "form":
            body = f"<label>{words(1, 3)}</label><input name=q><p>{words(1, 12)}</p>"
        if kind == "comment":
            body = "".join(f'<div{named("comment")}><p>{words(4, 60)}</p></div>' for _ in range(rng.randint(1, 6)))
        if not name and tag in ("div", "section", "ul", "ol"):
            name = named(kind)
        return f"<{tag}{name}>{body}</{tag}>"

    def aside():
        """Inline clutter, and inline content with a name."""
        tag = rng.choice(["span", "span", "a", "small", "em"])
        if rng.random() < 0.6:
            return f'<{tag}{named(rng.choice(["advert", "advert", "social", "side", "notice", "navigation", "comment"]))}>{words(1, 9)}</{tag}>'
        return f'<{tag}{c}{named("content")}>{words(1, 9)}</{tag}>'

    def sentence():
        """Words with links, emphasis or clutter among them."""
        inner = lambda: rng.choice([f'<a href="/{word()}">{words(1, 3)}</a>', f"<b>{words(1, 3)}</b>", f"<i>{words(1, 3)}</i>", aside()])
        most = rng.choice([3, 12, 40])
        return "".join(f"{words(1, most)} {inner()} " for _ in range(rng.choice([1, 1, 2, 3]))) + words(1, most)

    def content():
        r = rng.random()
        if r < 0.55:
            return f"<p{c}>{words(1, 90)}</p>"
        if r < 0.7:
            return f"<p{c}>{sentence()}</p>"
        if r < 0.78:
            return f"<h2{c}>{words(1, 8)}</h2>"
        if r < 0.86:
            return f"<ul{c}>" + "".join(f"<li{c}>{words(1, 25)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if r < 0.9:
            return f"<blockquote{c}><p{c}>{words(5, 50)}</p></blockquote>"
        if r < 0.93:
            return f"<table{c}><tbody{c}>" + "".join(f"<tr{c}>" + f"<td{c}>{words(1, 6)}</td>" * 2 + "</tr>" for _ in range(rng.randint(1, 4))) + "</tbody></table>"
        if r < 0.96:
            return f"<pre{c}>{words(2, 30)}</pre>"
        return f"<section{c}><h2{c}>{words(1, 6)}</h2><p{c}>{words(5, 60)}</p><div{c}><p{c}>{words(3, 40)}</p></div></section>"

    def bare():
        """Text for an article without a wrapper; the label is in an element without text."""
        marked = [lambda: words(1, 12), lambda: words(8, 70), sentence, sentence]
        return f"<template{c}></template>" + rng.choice(["<br>", "<br><br>\n", " "]).join(rng.choice(marked)() for _ in range(rng.choice([1, 1, 2, 3, 6])))

    def stray():
        """Clutter without a block."""
        return rng.choice([
            lambda: rng.choice([" | ", " ", "<br>"]).join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(1, 9))),
            lambda: f'<span{named(rng.choice(kinds))}>{words(1, 12)}</span>', lambda: f'{rng.choice(["&copy;", "(c)"])} <a href="/">{words(1, 3)}</a>', lambda: f'<a{named("navigation")} href="#c">{words(1, 4)}</a>',
        ])()

    kinds = list(TOKENS)[1:]
    for _ in range(count):
        if rng.random() < 0.3:
            parts = [f"<h1{c}>{words(1, 14)}</h1>"] * (rng.random() < 0.7)
            for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
                parts.append(bare())
                parts += [content() for _ in range(rng.choice([0, 1, 1, 2]))] or [f"<hr{c}>"]
            # Blocks keep stray text from joining the article's.
            before = [rng.choice([lambda: clutter(rng.choice(kinds)), lambda: stray() + clutter(rng.choice(kinds))])() for _ in range(rng.choice([0, 0, 0, 1, 2]))]
            after = [rng.choice([lambda: clutter(rng.choice(kinds)), lambda: f"<hr>{stray()}"])() for _ in range(rng.choice([0, 0, 0, 1, 2]))]
            page = f"{''.join(before)}{''.join(parts)}{''.join(after)}"
            yield page if rng.random() < 0.3 else f"<html{c}><head><title>{words(1, 9)}</title></head><body{c}>{page}</body></html>"
            continue
        inner = []
        if rng.random() < 0.9:
            inner.append(f"<h1{c}>{words(2, 14)}</h1>" if rng.random() < 0.7 else f"<header{c}><h1{c}>{words(2, 10)}</h1></header>")
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14, 25])):
            inner.append(content())
            if rng.random() < 0.25:
                inner.append(clutter(rng.choice(["advert", "social", "side", "comment", "notice"])))
        if rng.random() < 0.35:
            inner.append(clutter("comment"))
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        name = named("content") if tag in ("div", "section") or rng.random() < 0.2 else ""
        body = f"<{tag}{name}{c}>{''.join(inner)}</{tag}>"
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            outer = rng.choice(["div", "main", "div"])
            around = [clutter(rng.choice(kinds)) for _ in range(rng.choice([0, 0, 1, 2]))]
            body = f'<{outer}{c} class="{rng.choice(["wrap", "container", "row", "content", "layout", "page"])}">' + "".join(around[:1]) + body + "".join(around[1:]) + f"</{outer}>"
        before = [clutter(rng.choice(kinds)) if rng.random() < 0.8 else stray() for _ in range(rng.randint(0, 4))]
        after = [clutter(rng.choice(kinds)) if rng.random() < 0.8 else stray() for _ in range(rng.randint(0, 4))]
        yield f"<html{c}><head><title>{words(1, 9)}</title></head><body{c}>{''.join(before)}{body}{''.join(after)}</body></html>"


@functools.cache
def model() -> Boosted:
    xs, ys = [], []
    for page in training_pages():
        nodes, x = elements(parse(page))
        xs.append(x)
        ys.append(np.array([v.tag == "#root" or "data-c=" in v.attrs for v in nodes], float))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def choose(nodes: list[Node], scores: np.ndarray) -> np.ndarray:
    """Of all labellings with every dropped element's descendants dropped, the one
    of the greatest sum of scores over kept elements. Page scaffolding (root, html,
    body) has no score of its own."""
    n = len(nodes)
    up = np.full(n, -1)
    for v in nodes:
        p = v.parent
        while p is not None and p.index < 0:
            p = p.parent
        up[v.index] = p.index if p is not None else -1
    best = np.where([v.tag in SCAFFOLD for v in nodes], 0.0, scores)
    for k in range(n - 1, 0, -1):
        best[up[k]] += max(best[k], 0)
    keep = np.zeros(n, bool)
    for k in range(n):
        keep[k] = (k == 0 or keep[up[k]]) and best[k] > 0
    return keep


def _render(root: Node, keep: np.ndarray) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACES.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    # (node, position): a walk without recursion; a block's text ends where it or a block within begins or ends.
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, at = stack.pop()
        breaks = node.tag in BLOCK or node is root
        if at == 0 and breaks:
            end()
        if at >= len(node.children):
            if breaks:
                end()
            continue
        stack.append((node, at + 1))
        child = node.children[at]
        if isinstance(child, str):
            line.append(child)
        elif child.tag == "br":
            line.append(" ")
        elif child.tag not in SILENT:
            if child.index < 0 or keep[child.index]:
                stack.append((child, 0))
            elif child.tag in BLOCK:
                end()
            else:
                line.append(" ")
    end()
    return "\n".join(blocks)


def main_text(page: str, boosted: Boosted) -> str:
    """The article of a page as lines of text, one a block; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes, x = elements(root)
    keep = choose(nodes, boosted.score(x))
    return _render(root, keep)


def extract(pages: DataFrame, html_col: str = "html", keep_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep_cols``, text and n_chars (its code points) for every row.

    A null or empty page has an empty text; a page of any length is read whole. Kept
    columns pass through, null or repeated; other columns, also ones named text or
    n_chars, are not looked at. An empty table gives an empty result."""
    boosted = model()
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep_cols)

    def rows(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(p or "", boosted) for p in part.column(len(keep_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(keep_cols)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep_cols, "text", "n_chars"]
            )

    return arrow_map(pages.select(*(F.col(c) for c in keep_cols), F.col(html_col)), rows, f"{kinds}, text string, n_chars long")
