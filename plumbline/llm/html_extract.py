"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of block elements with their runs of text as leaves; each node is main text (or holds some)
or not. The potential on the edge from a parent to a child says how the child's label follows the parent's: below
a node that isn't main text hardly anything is; below one that is, a logistic score of the child's tag, of the
words in its class, id and role, and for text of its length and share of links decides, and weighs in a learned
measure as evidence for the parent too. Sum-product messages go up the tree and down again and give every node's
marginal; a run of text stays if its marginal of being main text is over one half. The potentials are trained
here, from labelled pages (`html_pages`).

Each page is one row and one tree: no shuffle, and memory in proportion to the page.
"""
from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.llm.common import bounded, table, text_batches
from plumbline.llm.html_pages import NAMES, labelled_pages

NAME = "op6_html_extract"
TRAIN_PAGES, STEPS = 600, 300
EVIDENCE = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)

#: Fixed values from the HTML standard: elements without an end, elements whose text isn't rendered, inline
#: elements (they don't part blocks), and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript template textarea title iframe svg audio video select datalist noembed noframes xmp".split())
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics canvas object a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol table dl article section aside main div body html td th form".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
KNOWN = {w: i for i, w in enumerate(sorted({x for names in NAMES.values() for n in names for x in _NAME.findall(n)}))}
TAGS = {t: i for i, t in enumerate("html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead blockquote pre figure figcaption nav header footer aside form fieldset button dialog details summary address ins label #text".split())}
MAIN = frozenset(len(TAGS) + KNOWN[w] for n in NAMES["article"] for w in _NAME.findall(n))
#: Tags that mean one thing inside an article and another outside of it.
TWOFOLD = {t: i for i, t in enumerate("header footer h1 h2 h3 p ul li div section form #text".split())}
N_FEATURES = len(TAGS) + len(KNOWN) + 12 + len(TWOFOLD)


class Page:
    """The tree: parent, tag number and own features of each node, in document order; and the runs of text."""

    __slots__ = ("parent", "features", "is_text", "texts")

    def __init__(self):
        self.parent, self.features, self.is_text, self.texts = [], [], [], []

    def node(self, parent: int, features: list[int], text: str | None = None) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.is_text.append(text is not None)
        self.texts.append(text)
        return len(self.parent) - 1


def _element_features(tag: str, attrs: str, inside: bool) -> list[int]:
    out = [TAGS[tag]] if tag in TAGS else [len(TAGS) + len(KNOWN)]
    if inside and tag in TWOFOLD:
        out.append(len(TAGS) + len(KNOWN) + 12 + TWOFOLD[tag])
    if "=" in attrs:
        base = len(TAGS)
        found = {KNOWN[w] for m in _ATTR.finditer(attrs) for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower()) if w in KNOWN}
        out.extend(base + i for i in sorted(found))
    return out


def parse(html: str | None) -> Page:
    """The tree of a page; scripts, styles, comments and markup are no part of it."""
    page, text = Page(), html or ""
    top = page.node(-1, [TAGS["html"]])
    stack: list[tuple[str, int, bool]] = [("#top", top, False)]
    run: list[str] = []
    linked, in_link, at = 0, 0, 0
    articles = 0
    places: dict[str, list[int]] = {}  # where on the stack the open elements of a name are, so that none is looked for by a walk

    def flush() -> None:
        nonlocal linked
        if run:
            words = " ".join(_html.unescape("".join(run)).split())
            if words:
                n, base = len(words), len(TAGS) + len(KNOWN)
                share = min(1.0, linked / n)
                features = [TAGS["#text"], base + 1 + min(6, int(math.log2(n + 1)) // 2), base + 8 + (0 if share == 0 else 1 if share < 0.5 else 2)]
                if words[-1] in ".!?\"":
                    features.append(base + 11)
                if articles:
                    features.append(base + 12 + TWOFOLD["#text"])
                page.node(stack[-1][1], features, words)
            run.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal articles
        flush()
        for tag, _, main in stack[depth:]:
            places[tag].pop()
            articles -= main
        del stack[depth:]

    def last(*tags: str) -> int:
        """The place of the innermost open element of these names; 0 for none."""
        return max([0, *[places[t][-1] for t in tags if places.get(t)]])

    size = len(text)
    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            run.append(text[at:])
            break
        if lt > at:
            run.append(text[at:lt])
            if in_link:
                linked += lt - at
        m = _TOKEN.match(text, lt)
        if m is None:  # a plain <
            run.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE and not (tag == "ins" and (attrs.strip() or closing and places.get("ins"))):
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag == "br" or tag == "wbr":
            run.append(" " if tag == "br" else "")
            continue
        if closing:
            if tag == "head" or tag in VOID:
                continue
            depth = last(tag)
            if depth and not (tag in ("p", "li", "td", "tr") and last("table", "body") > depth):
                pop_to(depth)
                in_link = 0
            continue
        if tag in RAW:
            flush() if tag in ("iframe", "svg", "object", "canvas", "video", "audio", "textarea", "select") else None
            if not attrs.endswith("/") or tag in ("script", "style", "textarea", "title", "iframe", "noscript", "template"):
                close = _closing(tag).search(text, at)
                at = close.end() if close else size
            continue
        if tag in ENDS_P and (depth := last("p")) > last("table", "td", "th", "button"):
            pop_to(depth)
        while tag in CLOSES and (depth := last(*CLOSES[tag])) > last(*SCOPE.difference(CLOSES[tag])):
            pop_to(depth)
            if tag in ("li", "dt", "dd", "option", "td", "th"):
                break
        flush()
        in_link = 0
        if tag in VOID or tag == "head":
            continue
        own = page.node(stack[-1][1], _element_features(tag, attrs, articles > 0))
        main = tag in ("article", "main") or not MAIN.isdisjoint(page.features[own])
        stack.append((tag, own, main))
        places.setdefault(tag, []).append(len(stack) - 1)
        articles += main
    flush()
    return page


_CLOSING: dict[str, re.Pattern] = {}


def _closing(tag: str) -> re.Pattern:
    if tag not in _CLOSING:
        _CLOSING[tag] = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)
    return _CLOSING[tag]


class Model:
    """weights and bias: of each feature, for the log-odds of main text below a parent that is main text; leak: the
    chance of it below one that isn't; evidence: how much a child's odds count for its parent (a power)."""

    def __init__(self, weights: np.ndarray, bias: float, leak: float, evidence: float):
        self.weights, self.bias, self.leak, self.evidence = weights.tolist(), bias, leak, evidence

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability of being main text, by one pass up and one down."""
        n, parent, weights, leak = len(page.parent), page.parent, self.weights, self.leak
        below = [1.0] * n  # the odds of main text that a node's children speak for
        edge = [(0.0, 0.0)] * n  # the potentials of a child that isn't and that is, below main text
        message = [1.0] * n  # to the parent: its odds from this child
        for i in range(n - 1, 0, -1):  # children come after their parents
            z = self.bias
            for f in page.features[i]:
                z += weights[f]
            odds = math.exp(min(25.0, max(-25.0, z)))
            scale = (1 + odds) ** (self.evidence - 1)
            edge[i] = no, yes = scale, scale * odds
            message[i] = m = (no + yes * below[i]) / (1 - leak + leak * below[i])
            below[parent[i]] = min(1e100, max(1e-100, below[parent[i]] * m))
        belief = [0.0] * n
        belief[0] = below[0]
        for i in range(1, n):
            rest = belief[parent[i]] / message[i]  # the parent's odds without this child's message
            no, yes = edge[i]
            belief[i] = min(1e100, max(1e-100, below[i] * (leak + yes * rest) / (1 - leak + no * rest)))
        return [x / (1 + x) for x in belief]

    def extract(self, html: str | None) -> str:
        """The main text: its blocks in page order, joined by newlines; empty if there is none."""
        page = parse(html)
        p = self.marginals(page)
        return "\n".join(t for i, t in enumerate(page.texts) if t is not None and p[i] > 0.5)


def _labelled(pages: list[tuple[str, list[int]]]) -> list[tuple[Page, list[int]]]:
    """Pages as trees with each node's label: an element is main text if some text below it is."""
    out = []
    for html, labels in pages:
        page = parse(html)
        if sum(page.is_text) != len(labels):
            raise ValueError("a labelled page's texts and labels differ in number")
        y, todo = [0] * len(page.parent), iter(labels)
        for i, leaf in enumerate(page.is_text):
            if leaf:
                y[i] = next(todo)
        for i in range(len(y) - 1, 0, -1):
            y[page.parent[i]] |= y[i]
        out.append((page, y))
    return out


def train(pages: list[tuple[str, list[int]]] | None = None) -> Model:
    """A model of labelled pages: the score by the children of main text, the measure of evidence by the marginals
    of a fifth of the pages."""
    trees = _labelled(pages if pages is not None else labelled_pages(TRAIN_PAGES))
    cut = max(1, len(trees) * 4 // 5)
    rows = [(page.features[i], y[i]) for page, y in trees[:cut] for i in range(1, len(y)) if y[page.parent[i]]]
    x = np.zeros((len(rows), N_FEATURES), np.float32)
    for i, (r, _) in enumerate(rows):
        x[i, r] = 1
    y = np.array([v for _, v in rows], np.float32)
    w, b = np.zeros(N_FEATURES, np.float32), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):  # Adam on the penalized log-likelihood
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        gw = x.T @ g / max(1, len(y)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= float(g.mean()) if len(y) else 0.0

    def loss(model: Model) -> float:
        found = ((p, own[i]) for page, own in trees[cut:] for i, p in enumerate(model.marginals(page)) if page.is_text[i])
        return sum(-math.log(max(1e-9, p if label else 1 - p)) for p, label in found)

    return min((Model(w, b, 1e-4, e) for e in EVIDENCE), key=loss)


def extract_text(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """pages with text (the main text of the whole html) and n_chars (its code points), which replace columns of
    these names. Null and empty html: empty text. Repeated rows each get theirs; an empty table an empty result."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches):
            texts = [model.extract(h.as_py()) for h in batch[html]]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    text_batches(pages.sparkSession)
    return pages.select(*kept, *[html] * (html not in kept)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
