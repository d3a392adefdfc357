"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements; the text between two block
boundaries is a leaf (a run).  Every node gets features: tag, attribute tokens
of its own and of its ancestors, density of text, links and punctuation in its
subtree, depth, place in the page and statistics of its siblings.  Boosted trees
give the log odds that the node holds main text.

Decoding is hierarchical: a node can be kept only with all its ancestors, so the
kept set is the one, closed upwards, with the largest sum of log odds; one pass
from the leaves to the root finds it.  A node that looks like an advert is
dropped with all its paragraphs, and a paragraph isn't kept out of a menu.

The trees are fitted on the driver from generated pages (``training_page``), so
equal pages give equal texts whatever the corpus.

Defined cases: null and empty pages, and pages without main text, give an empty
text; broken markup is read as browsers do in the common cases (unclosed
paragraphs, list items and cells; stray end tags); what the parser can't read is
taken as text; rows of equal id keep their rows; an empty table gives an empty
frame; other columns are kept by ``extract``, whatever their names, unless they
clash with the results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What browsers don't show as text, and form controls; the trees judge all else.
SILENT = {"script", "style", "head", "title", "template", "select", "textarea", "button", "datalist"}
KINDS = (
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div"}, {"section"}, {"article", "main"}, {"nav"}, {"header", "hgroup"},
    {"footer", "address"}, {"aside", "dialog"}, {"form", "fieldset"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"html", "body"}, {"hr", "details", "summary", "center"},
)
BLOCKS = {t: k for k, tags in enumerate(KINDS) for t in tags}
#: An open element that ends where one of the others begins.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Elements that CLOSED_BY doesn't look beyond.
SCOPES = {"ul", "ol", "dl", "table", "body"}
#: Beginnings of attribute tokens, by what they say.
TOKENS = (
    ("article", "content", "post", "entry", "story", "text", "main", "prose", "copy", "body"),
    ("nav", "menu", "breadcrumb", "crumb", "pagination", "pager", "toc", "skip", "tabs"),
    ("ad", "ads", "advert", "adverts", "advertisement", "adslot", "sponsor", "sponsored", "promo", "promoted", "dfp", "outbrain", "taboola"),
    ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "thread", "reader", "reactions"),
    ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "teaser", "more", "rail", "recent"),
    ("footer", "foot", "copyright", "legal", "imprint", "colophon"),
    ("header", "head", "masthead", "logo", "branding", "topbar", "site"),
    ("cookie", "cookies", "consent", "notice", "gdpr", "banner", "popup", "modal", "alert", "overlay", "privacy", "paywall", "toast"),
    ("form", "search", "login", "signup", "newsletter", "subscribe", "subscription", "register", "contact"),
    ("share", "social", "sharing", "follow", "tags", "meta", "byline", "tools", "print", "rating", "likes"),
)
_GROUP = {t: 1 << g for g, tokens in enumerate(TOKENS) for t in tokens}
_CUT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Marks main text in training pages.
MARK = ""


@functools.lru_cache(4096)
def _tokens(value: str) -> int:
    bits = 0
    for t in _CUT.split(_CAMEL.sub(" ", value).lower()):
        bits |= _GROUP.get(t, 0)
    return bits


# ------------------------------------------------------------------ the tree

class Tree(HTMLParser):
    """Nodes in page order, as lists: kind (-1 for a run), parent, attribute groups, text, characters under links."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.kind, self.parent, self.attrs, self.text, self.linked = [15], [-1], [0], [""], [0]
        self.open: list[tuple[str, int]] = [("html", 0)]  # tags, and the nodes they are in
        self.stops = [0]  # places in it where a search for something to close looks
        self.count = {"html": 1}
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.link_parts = 0
        self.feed(html)
        self.close()
        self._end_run()

    def _node(self, kind: int, attrs: int, text: str = "", linked: int = 0) -> int:
        self.kind.append(kind)
        self.parent.append(self.open[-1][1])
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.kind) - 1

    def _end_run(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self._node(-1, 0, text, min(self.link_parts, len(text)))
            self.parts, self.link_parts = [], 0

    def _pop(self) -> None:
        tag, _ = self.open.pop()
        if self.stops[-1] == len(self.open):
            self.stops.pop()
        self.count[tag] -= 1
        if tag in SILENT:
            self.silent -= 1
        elif tag == "a":
            self.links -= 1

    def _close(self, tag: str) -> None:
        while self.open[-1][0] != tag:
            self._pop()
        self._pop()

    def _make_way(self, tag: str) -> None:
        """Closes what the tag closes, up to the nearest scope; tags that neither close nor stop aren't looked at."""
        at = len(self.stops) - 1
        while at >= 0:
            name = self.open[self.stops[at]][0]
            if tag in CLOSED_BY.get(name, ()):
                self._close(name)
                at = len(self.stops) - 1
            elif name in SCOPES or name == "html":
                return
            else:
                at -= 1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            return  # one root; its attributes tell about the whole page
        if tag in VOID:
            if tag == "hr":
                self._end_run()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._end_run()
            if self.count.get("p"):
                self._close("p")
            if self.count.get("head"):
                self._close("head")
            self._make_way(tag)
            bits = 0
            for k, v in attrs:
                if v and k in ("class", "id", "role", "itemprop", "aria-label"):
                    bits |= _tokens(v)
            node = self._node(BLOCKS[tag], bits)
        else:
            node = self.open[-1][1]
            if tag == "a" and self.links:
                self._close("a")
        if tag in CLOSED_BY or tag in SCOPES:
            self.stops.append(len(self.open))
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in SILENT:
            self.silent += 1
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT or tag == "a":  # others stay open, as in browsers
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_run()
        if tag not in ("html", "body") and self.count.get(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.link_parts += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


_MARKUP = re.compile(r"<[A-Za-z/!?]")
_RAW = re.compile(r"<!--|<(script|style|textarea|title)\b", re.IGNORECASE)


def _without_open_end(html: str) -> str:
    """``html`` up to a tag or comment that never ends, as browsers read it; the parser would look for its end again and again."""
    html = html.replace("<!--->", "").replace("<!-->", "")  # empty comments, which the parser takes for text
    begun = _MARKUP.search(html, html.rfind(">") + 1)
    if begun:
        html = html[:begun.start()]
    at = 0
    while found := _RAW.search(html, at):
        if found[1]:
            end = re.compile(f"</{found[1]}", re.IGNORECASE).search(html, found.end())
            if not end:
                return html
            at = end.end()
        else:
            at = html.find("-->", found.start() + 2) + 3
            if at < 3:
                return html[:found.start()]
    return html


def tree(html: str | None) -> Tree:
    html = _without_open_end(html or "")
    try:
        return Tree(html)
    except AssertionError:  # a declaration that the parser doesn't know
        return Tree(html.replace("<![", "&lt;!["))


# ------------------------------------------------------------------ features

_INSIDE = (6, 7, 8, 9, 10, 11)  # article, nav, header, footer, aside, form
N_FEATURES = 1 + len(KINDS) + 2 * len(TOKENS) + len(_INSIDE) + 20
_PUNCTUATION = re.compile(r"[.!?,;:。，！？؟،।]")


def features(t: Tree) -> np.ndarray:
    """A row for each node."""
    n = len(t.kind)
    kind, parent = np.array(t.kind), np.array(t.parent)
    parent[0] = 0
    run = kind < 0
    chars = np.array([len(x) for x in t.text], float)
    size = chars.copy()
    links = np.array(t.linked, float)
    words = np.array([x.count(" ") + 1 if x else 0 for x in t.text], float)
    marks = np.array([len(_PUNCTUATION.findall(x)) if x else 0 for x in t.text], float)
    runs, paragraphs, nodes = run.astype(float), (kind == 1).astype(float), np.ones(n)
    before = np.concatenate(([0], np.cumsum(chars)[:-1]))
    depth, inside, above, children = np.zeros(n), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
    attrs = np.array(t.attrs)
    up = parent.tolist()
    inside_bit = [1 << _INSIDE.index(k) if k in _INSIDE else 0 for k in t.kind]
    d, i, a, c, place = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(1, n):
        p = up[k]
        d[k] = d[p] + 1
        i[k] = i[p] | inside_bit[k]
        a[k] = a[p] | t.attrs[k]
        place[k] = c[p]
        c[p] += 1
    depth, inside, above, children, place = (np.array(x) for x in (d, i, a, c, place))
    sums = np.stack([size, links, words, marks, runs, paragraphs, nodes], 1).tolist()
    largest = [0.0] * n
    for k in range(n - 1, 0, -1):
        mine, his = sums[k], sums[up[k]]
        for j in range(7):
            his[j] += mine[j]
        if mine[0] > largest[up[k]]:
            largest[up[k]] = mine[0]
    size, links, words, marks, runs, paragraphs, nodes = np.array(sums).T
    one = np.maximum
    page = one(size[0], 1)
    stats = [
        np.log1p(size), np.log1p(words), links / one(size, 1), marks / one(words, 1), np.log1p(runs), np.log1p(paragraphs),
        size / page, size / one(size[parent], 1), size / one(runs, 1), nodes / one(size, 1),
        np.minimum(depth, 30), place / one(children[parent], 1), np.log1p(children[parent]), before / page, size / one(np.array(largest)[parent], 1),
        size[parent] / page, links[parent] / one(size[parent], 1), np.log1p(paragraphs[parent]), np.log1p(children), np.log1p(runs[parent]),
    ]
    cols = [run, *(kind == k for k in range(len(KINDS))), *((attrs >> g) & 1 for g in range(len(TOKENS))), *((above >> g) & 1 for g in range(len(TOKENS))), *((inside >> b) & 1 for b in range(len(_INSIDE))), *stats]
    return np.stack([np.asarray(x, np.float32) for x in cols], 1)


# ------------------------------------------------------------------ boosted trees

class Boosted:
    """Trees of equal depth on binned features, fitted to the logistic loss by second-order boosting."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 32, share: float = 0.4):
        self.trees, self.depth, self.rate, self.bins, self.share = trees, depth, rate, bins, share

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])
        self.feature = np.zeros((self.trees, (1 << self.depth) - 1), np.int32)
        self.cut = np.full((self.trees, (1 << self.depth) - 1), np.inf, np.float32)
        self.leaf = np.zeros((self.trees, 1 << self.depth), np.float32)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(n, self.base)
        rng = np.random.default_rng(0)
        useful = np.array([j for j, e in enumerate(self.edges) if len(e)])
        for k in range(self.trees):
            tried = rng.choice(useful, max(1, int(len(useful) * self.share)), replace=False)  # each tree sees a part of the features and rows
            drawn = rng.random(n) < 0.7
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * drawn, p * (1 - p) * drawn
            part = np.flatnonzero(drawn)
            at = np.zeros(n, np.int64)  # place of each row in its level
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                gain = np.full((m, width, self.bins), -np.inf)
                for j in tried:
                    key = at[part] * self.bins + codes[j, part]
                    sg, sh = (np.bincount(key, w[part], width * self.bins).reshape(width, self.bins) for w in (g, h))
                    lg, lh = sg.cumsum(1), sh.cumsum(1)
                    tg, th = lg[:, -1:], lh[:, -1:]
                    ok = (lh > 1) & (th - lh > 1)
                    gain[j] = np.where(ok, lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1), -np.inf)
                for w in range(width):
                    j, b = divmod(int(gain[:, w].argmax()), self.bins)
                    if gain[j, w, b] > 1e-3 and b < len(self.edges[j]):
                        self.feature[k, first + w], self.cut[k, first + w] = j, self.edges[j][b]
                node = first + at
                at = 2 * at + (x[np.arange(n), self.feature[k, node]] > self.cut[k, node])
            sg, sh = (np.bincount(at, w, 1 << self.depth) for w in (g, h))
            self.leaf[k] = self.rate * sg / (sh + 1)
            score += self.leaf[k, at]  # of the rows not drawn, too
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for k in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[rows, self.feature[k, node]] > self.cut[k, node])
            score += self.leaf[k, at]
        return score


# ------------------------------------------------------------------ decoding

def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The upwards closed set of nodes with the largest sum of log odds."""
    best = odds.tolist()
    for k in range(len(best) - 1, 0, -1):  # children come after their parents
        if best[k] > 0:
            best[parent[k]] += best[k]
    kept = np.zeros(len(best), bool)
    kept[0] = best[0] > 0
    for k in range(1, len(best)):
        kept[k] = kept[parent[k]] and best[k] > 0
    return kept


def texts(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [tree(p) for p in pages]
    if not trees:
        return []
    odds = model.odds(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for t in trees:
        kept = decode(t.parent, odds[at:at + len(t.kind)])
        at += len(t.kind)
        out.append("\n".join(x for x, k in zip(t.text, kept.tolist(), strict=True) if x and k))
    return out


# ------------------------------------------------------------------ Spark

@functools.lru_cache(1)
def model(pages: int = 700, seed: int = 3) -> Boosted:
    """The trees, fitted on ``pages`` generated pages."""
    from salesengine.llm.html_training import training_page

    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        t = tree(training_page(rng))
        y = np.array([MARK in x for x in t.text])
        for k in range(len(y) - 1, 0, -1):
            if y[k]:
                y[t.parent[k]] = True
        t.text = [x.replace(MARK, "") for x in t.text]
        xs.append(features(t))
        ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def _extractor(trees: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            group, size = [], 0
            for h in batch.column("html"):
                group.append(h.as_py())
                size += len(group[-1] or "")
                if size > 1 << 21:
                    out += texts(group, trees)
                    group, size = [], 0
            out += texts(group, trees)
            keep = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*keep, "text", "n_chars"])
    return run


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """The named columns of ``pages`` with the main text of ``html`` and its length in code points, for every row."""
    names = [*dict.fromkeys(keep), "html"]
    if {"text", "n_chars", "html"} & set(keep):
        raise ValueError("text, n_chars and html can't be kept beside the results")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    schema = ", ".join(filter(None, [fields, "text string, n_chars long"]))
    return pages.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(_extractor(model()), schema)
