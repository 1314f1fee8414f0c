"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of its block elements. Every node is main text or not; a node potential scores its
features (element, words of class, id and role, amount and density of text), and a potential on every
parent-child edge ties labels along the tree. Sum-product message passing, once from the leaves up and once
from the root down, gives the exact marginal of every node; all pages of a slice are passed at once, level
by level, with numpy. The weights maximise the likelihood of the labelled pages (``labelled_pages``), with
the same message passing for the gradient. The text of a page is the text of all blocks whose node is main
text, in page order.

Each page is worked on alone, so the job is one map over the table without a shuffle.

Text rules: scripts, styles, markup, comments and the head are dropped; character references are decoded;
white space in a block becomes one space; blocks are trimmed and joined by one space; a line break ends a
word. Broken pages (unclosed elements or tags, cut ends) are read as browsers read them; like there, blocks nested
deeper than ``DEEPEST`` hang on their ancestor at that depth. A page is read in time linear in its length: the open
elements are kept by name, so no tag searches the others.

Words of class, id and role count where they stand: on the page's root and on a wrapper, an element that holds an
article (or, by its own words, the text) which no such word disowns, they say nothing about the text. An article
that is named as text is disowned by words of replies only, and a long-running section inside an article not by words that may
be its subject (social, legal, author).

Defined cases: a null or empty html, or one without main text, gives the empty text. Null ids and urls stay
null, repeated rows are pages of their own, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T
from quiver.llm.labelled_pages import PAGES
from quiver.session import ship_package

# Elements, as HTML names them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe canvas audio video head".split())
_TO_END = frozenset("script style title textarea".split())  # never closed, these hold the rest of the page
BLOCKS = ["body", "article", "main", "section", "div", "p", "h", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "tr", "td",
          "blockquote", "pre", "figure", "dl", "dd", "button", "label", "other"]
_ALIAS = {f"h{i}": "h" for i in range(1, 7)} | {"th": "td", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "td", "figcaption": "figure", "dt": "dd", "menu": "ul",
                                               "address": "other", "details": "other", "summary": "other", "fieldset": "form", "legend": "label", "dialog": "aside", "center": "div",
                                               "hgroup": "header", "search": "form", "select": "label", "optgroup": "label", "option": "label", "frameset": "div", "html": "body"}
_KIND = {name: i for i, name in enumerate(BLOCKS)} | {name: BLOCKS.index(kind) for name, kind in _ALIAS.items()}
# An opening element closes these open elements, up to the given limits
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}
_IN_P = frozenset("button label legend select optgroup option".split())
# Words of class, id and role attributes, by what they hint at
HINTS = {
    "menu": "nav navigation menu navbar menubar breadcrumb breadcrumbs toc pager pagination skip toolbar tabs",
    "top": "header banner masthead top topbar logo brand branding",
    "bottom": "footer contentinfo bottom copyright colophon imprint legal",
    "side": "sidebar side aside complementary widget widgets rail related recommended more promo teaser trending",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored banner2 doubleclick adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup disclaimer warning paywall",
    "replies": "comment comments commentlist reply replies disqus discussion respond reader responses feedback reviews",
    "share": "share sharing social tags meta byline author login search form",
    "text": "content article main post entry story text body page-content body-text prose",
}
_HINT = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
_WORD = re.compile(r"[a-z]+|\d+")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
# The rest of a tag: attributes, whose value may be quoted; possessive, so read in one pass
_TAG = re.compile(r"""(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+>""")
N_FEATURES = len(BLOCKS) + len(HINTS) + 12
DEEPEST = 512
_PARTS = (1 << (len(HINTS) - 1)) - 1  # every hint but the last names a part that is not main text
_TEXT = 1 << (len(HINTS) - 1)
_SOFT = sum(1 << list(HINTS).index(k) for k in ("menu", "top", "bottom", "share"))  # also name what a section is about
_REPLIES = 1 << list(HINTS).index("replies")


class Page:
    """Block elements of a page in page order, with the runs of text in them."""

    def __init__(self, source: str, marks: bool = False) -> None:
        self.kind, self.parent, self.hints, self.label = [0], [-1], [0], [0]
        self.chars, self.link_chars, self.stops, self.depth = [0], [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements and the block node each belongs to
        places: dict[str, list[int]] = {}  # where the open elements of a name are, the first one aside
        blocks: list[int] = []  # where the open blocks are
        held: list[str] = []
        links = 0

        def flush() -> None:
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    node = stack[-1][1]
                    self.runs.append((node, text))
                    self.chars[node] += len(text)
                    self.stops[node] += text.count(".") + text.count(",")

        def say(raw: str) -> None:
            text = entities.unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                self.link_chars[stack[-1][1]] += len(text)

        def last(*names: str) -> int:
            """Place of the innermost open element of these names, or 0."""
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        def enter(name: str, node: int) -> None:
            places.setdefault(name, []).append(len(stack))
            if name in _KIND:
                blocks.append(len(stack))
            stack.append((name, node))

        def leave(at: int) -> None:
            nonlocal links
            while len(stack) > at:
                name, _ = stack.pop()
                places[name].pop()
                if name in _KIND:
                    blocks.pop()
                links -= name == "a"

        def close(at: int) -> None:
            flush()
            leave(at)

        at, size, find = 0, len(source), source.find
        while at < size:
            begin = find("<", at)
            if begin < 0:
                say(source[at:])
                break
            if begin > at:
                say(source[at:begin])
            lead = source[begin + 1 : begin + 2]
            if lead in ("!", "?"):
                if source.startswith("<!--", begin):
                    end = find("-->", begin + 4)
                    at = size if end < 0 else end + 3
                else:
                    end = find(">", begin)
                    at = size if end < 0 else end + 1
                continue
            closing = lead == "/"
            found = _NAME.match(source, begin + 1 + closing)
            if not found:
                if closing:  # a bogus comment
                    end = find(">", begin)
                    at = size if end < 0 else end + 1
                else:
                    held.append("<")
                    at = begin + 1
                continue
            name = found.group().lower()
            end = _tag_end(source, found.end())
            if end < 0:
                break  # the page was cut inside a tag
            rest = source[found.end() : end]
            at = end + 1
            if closing:
                if name == "br" or name == "p" and not places.get("p"):
                    flush()
                    continue
                i = last(name)
                if not i:
                    continue
                if name in _KIND:
                    if name in ("tr", "table", "tbody", "td", "th") or last("td", "th") <= i:
                        close(i)
                elif not blocks or blocks[-1] < i:
                    leave(i)
                continue
            if name in ("br", "hr", "wbr"):
                if name != "wbr":
                    flush()
                continue
            if name in VOID:
                continue
            if name in RAW:
                at = _raw_end(source, name, at)
                continue
            if name in ("html", "body"):
                self._attributes(0, rest, marks)
                continue
            if name not in _KIND:
                if name == "text":  # svg places its texts apart
                    held.append(" ")
                if name == "a" or not rest.endswith("/"):  # svg and math close empty elements so
                    links += name == "a"
                    enter(name, stack[-1][1])
                continue
            flush()
            if name not in _IN_P:
                i = last("p")
                if i > last("td", "th", "button", "table"):
                    close(i)
            if name in _CLOSES:
                ended, limits = _CLOSES[name]
                i = last(*ended)
                if i > last(*limits):
                    close(i)
            node, above = len(self.kind), stack[-1][1]
            if self.depth[above] >= DEEPEST:
                above = self.parent[above]
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.kind.append(_KIND[name])
            self.chars.append(0)
            self.link_chars.append(0)
            self.stops.append(0)
            self.hints.append(0)
            self.label.append(self.label[stack[-1][1]])
            if rest:
                self._attributes(node, rest, marks)
            enter(name, node)
        flush()

    def _attributes(self, node: int, rest: str, marks: bool) -> None:
        bits = 0
        for _, value in _ATTRIBUTE.findall(rest):
            for word in _WORD.findall(value.lower()):
                hint = _HINT.get(word)
                if hint is not None:
                    bits |= 1 << hint
        self.hints[node] |= bits
        if marks:
            words = rest.split()
            self.label[node] = 1 if "main" in words else 0 if "skip" in words else self.label[node]


def _tag_end(source: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, quoted values aside; -1: the source ends before."""
    found = _TAG.match(source, at)
    if found:
        return found.end() - 1
    return source.find(">", at)  # a quote that never closes


def _raw_end(source: str, name: str, at: int) -> int:
    close = re.compile(rf"</{name}\b[^>]*(>|$)" if name != "head" else r"</head\b[^>]*>|(?=<body\b)|(?=<(?:article|div|p|nav|main|header|section|h1)\b)", re.I)
    found = close.search(source, at)
    if found:
        return found.end()
    return len(source) if name in _TO_END else at


class Forest:
    """Trees of several pages as arrays: parents, levels and features."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.kind) for p in pages])
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        join = lambda name: np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages])
        self.base = np.cumsum(sizes) - sizes
        parent = join("parent")
        self.root = parent < 0
        self.parent = np.where(self.root, np.arange(len(parent)), parent + base)
        self.kind, self.hints = join("kind"), join("hints")
        self.label = join("label")
        depth = join("depth")
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        chars, links, stops = join("chars").astype(float), join("link_chars").astype(float), join("stops")
        below, below_links = chars.copy(), links.copy()
        hinted = np.zeros(len(parent), np.int64)
        semantic = np.isin(self.kind, [_KIND["article"], _KIND["main"]])
        inside = np.zeros(len(parent), bool)
        named_text = semantic & (self.hints & _TEXT > 0)
        self.hints[named_text] &= _TEXT | _REPLIES  # e.g. a post among featured ones
        owned = self.hints & _PARTS == 0
        holds = semantic & owned  # an article that no word disowns, here or below
        for level in self.levels[:0:-1]:
            np.add.at(below, self.parent[level], below[level])
            np.add.at(below_links, self.parent[level], below_links[level])
            np.logical_or.at(holds, self.parent[level], holds[level])
        text_below = (self.hints & _TEXT > 0) & owned & (below > 0.5 * below[np.repeat(self.base, sizes)])
        for level in self.levels[:0:-1]:
            np.logical_or.at(text_below, self.parent[level], text_below[level])
        wraps = (self.root | (holds | text_below) & ~semantic) & ~owned
        self.hints[wraps] &= _TEXT
        for level in self.levels[1:]:
            inside[level] = inside[self.parent[level]] | semantic[self.parent[level]]
        density = below_links / np.maximum(below, 1)
        runs_on = inside & (self.kind == _KIND["section"]) & (below > 150) & (density < 0.2) & (self.hints & _REPLIES == 0)
        self.hints[runs_on] &= ~_SOFT
        for level in self.levels[1:]:
            hinted[level] = hinted[self.parent[level]] | self.hints[self.parent[level]]
        n = len(parent)
        x = np.zeros((n, N_FEATURES))
        x[np.arange(n), self.kind] = 1
        for i in range(len(HINTS)):
            x[:, len(BLOCKS) + i] = self.hints >> i & 1
        extra = len(BLOCKS) + len(HINTS)
        x[:, extra] = 1
        x[:, extra + 1] = chars > 0
        x[:, extra + 2] = chars > 80
        x[:, extra + 3] = stops > 1
        x[:, extra + 4] = (density > 0.5) & (below > 0)
        x[:, extra + 5] = inside
        x[:, extra + 6] = inside & (self.kind == _KIND["header"])
        x[:, extra + 7] = np.minimum(np.log1p(below), 8) / 8
        x[:, extra + 8] = self.root
        x[:, extra + 9] = (hinted & _PARTS) > 0
        x[:, extra + 10] = semantic & ((self.hints | hinted) & _PARTS == 0)
        x[:, extra + 11] = runs_on
        self.x = x
        # edges: 0 plain child, 1 child that names a part of a page
        self.edge = (np.isin(self.kind, [_KIND[k] for k in ("nav", "header", "footer", "aside", "form", "article", "main")]) | (self.hints > 0)).astype(int)


def marginals(forest: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product on every tree: P(node label), P(parent label, child label), log partition sum."""
    n = len(forest.kind)
    phi = np.zeros((n, 2))
    phi[:, 1] = forest.x @ weights
    psi = edges[forest.edge]  # (n, parent label, child label)
    up = phi.copy()
    message = np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        message[level] = np.logaddexp.reduce(psi[level] + up[level][:, None, :], axis=2)
        np.add.at(up, forest.parent[level], message[level])
    roots = forest.levels[0]
    log_z = float(np.logaddexp.reduce(up[roots], axis=1).sum())
    belief = up.copy()
    pair = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        above = belief[forest.parent[level]] - message[level]  # the parent without this child
        joint = above[:, :, None] + psi[level] + up[level][:, None, :]
        belief[level] = np.logaddexp.reduce(joint, axis=1)
        joint -= joint.max(axis=(1, 2), keepdims=True)
        pair[level] = np.exp(joint) / np.exp(joint).sum(axis=(1, 2), keepdims=True)
    belief -= np.logaddexp.reduce(belief, axis=1)[:, None]
    return np.exp(belief), pair, log_z


def train(pages: list[str], steps: int = 400, rate: float = 0.1, ridge: float = 0.004) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights of greatest penalised likelihood on labelled pages."""
    forest = Forest([Page(p, marks=True) for p in pages])
    child = np.flatnonzero(~forest.root)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.edge[child], forest.label[forest.parent[child]], forest.label[child]), 1)
    seen_x = forest.x.T @ forest.label
    flat = np.zeros(N_FEATURES + 8)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        weights, edges = flat[:N_FEATURES], flat[N_FEATURES:].reshape(2, 2, 2)
        p, pair, _ = marginals(forest, weights, edges)
        expected = np.zeros((2, 2, 2))
        for kind in (0, 1):
            expected[kind] = pair[child[forest.edge[child] == kind]].sum(axis=0)
        gradient = np.concatenate((seen_x - forest.x.T @ p[:, 1], (seen - expected).ravel())) - ridge * len(pages) * flat
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        flat = flat + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return flat[:N_FEATURES], flat[N_FEATURES:].reshape(2, 2, 2)


@functools.cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(PAGES)


def main_texts(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    parsed = [Page(p or "") for p in pages]
    if not parsed:
        return []
    forest = Forest(parsed)
    keep = marginals(forest, *model)[0][:, 1] > 0.5
    return [" ".join(text for node, text in page.runs if keep[base + node]) for page, base in zip(parsed, forest.base)]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    ship_package(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # about fifty numbers

    def run(batches):
        for batch in batches:
            for a, b in T.slices(batch.column(2), 1 << 20):
                texts = main_texts(batch.column(2).slice(a, b - a).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
