"""Main text of web pages by sum-product message passing over the tree of their elements.

A page is cut into block elements and the pieces of text between them (leaves); inline markup only
adds to its leaf. Every node is content or not. The model is a tree of pairwise potentials: a
child's label given its parent's, by the child's kind (``P(label | parent's label, kind)``), and
potentials for what is seen of a node: words in its class, id and role, and for leaves their
length, share of linked text and last character. One pass up and one pass down the tree give the
marginal probability of every leaf; the leaves more likely than not are the text.

The potentials are smoothed counts from labelled pages: a few that are written out here (``SEEDS``)
for layouts without telling markup, and a bounded sample of the given pages that mark their article
themselves (one ``article`` or ``main``), where labels follow the markup; the sample is drawn by a hash
of the page, so it is the same in every run and from all sources alike. Counting runs in tasks;
only the counts, as many as there are kinds, reach the driver.

Scripts, styles, text areas, titles, frames, comments of the markup and the head are dropped while
parsing; all else is judged, formulas, drawings, objects and noscript parts too. Text of a block has
its character references decoded and its white space made single; blocks are joined by line feeds.
A null html is empty and gives an empty text. Every row gives one row; null ids and urls are kept.
Other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import units
from quire.llm.shared import batches

LABELLED = 200  # pages of the table that the model is fitted on
SEED_WEIGHT = 20.0  # of a page written out here, next to one from the table
SMOOTH = 0.5
FLOORS = {"leaf": 0.03, "box": 0.003}  # least share of a value that is seen, so that one sight never decides alone

#: Comments, other declarations, end tags without a name, and tags: quotes only count where a value begins.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose inside is no markup: all up to the closing tag is dropped, or to the end of the page without one.
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "html body article main section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody"
    " tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog menu"
    " center hgroup search button label select option".split()
)
#: An element that ends when one of these begins inside its parent.
_ENDS = {"p": _BLOCK - {"button", "label", "select", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
         "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words in class, id and role, the first group that is found counts.
_WORDS = [
    ("comment", r"comment|respond|repl(?:y|ies)|disqus|discussion|guestbook"),
    ("advert", r"\bads?\b|\bads?[-_]|[-_]ads?\b|advert|sponsor|promo|banner-ad|outbrain|taboola"),
    ("notice", r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|paywall|toast"),
    ("aside", r"sidebar|side-?bar|aside|widget|related|recommend|rail\b|trending|popular|teaser|tags?\b|author-?box|bio\b"),
    ("menu", r"nav|menu|breadcrumb|pagination|pager|toc\b|skip|tabs?\b|toolbar|share|social|follow"),
    ("form", r"form|search|login|signup|sign-up|register"),
    ("top", r"header|masthead|banner|topbar|logo|brand"),
    ("bottom", r"footer|copyright|colophon|legal|disclaimer"),
    ("hidden", r"hidden|display:\s*none|screen-reader|sr-only|visually-hidden"),
    ("main", r"article|content|post|entry|story|main|body|text|prose|markdown"),
]
_WORDS = [(name, re.compile(words, re.I)) for name, words in _WORDS]
#: What short leaves outside of articles tend to say.
_SAYS = [
    ("rights", re.compile(r"©|\bcopyright\b|all rights reserved|\bimprint\b|terms of (?:use|service)|privacy policy", re.I)),
    ("notice", re.compile(r"\bcookies?\b|subscribe|newsletter|sign up|log ?in\b", re.I)),
    ("pointer", re.compile(r"^(?:read more|related|share|tweet|advert|sponsored|by the same|more from|you may also)", re.I)),
    ("reply", re.compile(r"^(?:repl(?:y|ies)|comments?\b|\d+ comments|posted by|leave a)", re.I)),
]
#: Kinds whose inside is never part of an article when pages label themselves.
_APART = {"nav", "aside", "footer", "form", "header", "menu", "dialog", "button", "search", "label", "select", "option"}
_APART_WORDS = {"comment", "advert", "notice", "aside", "menu", "form", "bottom", "hidden"}


@dataclass
class Tree:
    """Nodes in page order, so a parent comes before its children; node 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    kind: list[str] = field(default_factory=lambda: ["root"])
    seen: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str | None] = field(default_factory=lambda: [None])
    truth: list[str | None] = field(default_factory=lambda: [None])


def parse(page: str) -> Tree:
    """The tree of a page's block elements and leaves."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("root", 0)]
    buffer: list[str] = []
    linked = links = 0
    drawn = 0  # open svg and math elements, in which "/>" closes any tag
    heading = False  # inside the head, whose tags are skipped one by one
    at = 0

    def add(parent: int, kind: str, seen: tuple, text: str | None, truth: str | None = None) -> int:
        tree.parent.append(parent)
        tree.kind.append(kind)
        tree.seen.append(seen)
        tree.text.append(text)
        tree.truth.append(truth)
        return len(tree.parent) - 1

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(references.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                add(stack[-1][1], "text in " + stack[-1][0], _leaf(text, linked), text)
        linked = 0

    last = page.rfind(">") + 1  # what opens behind the last end of a tag is text
    while True:
        tag = _TAG.search(page, at, last)
        piece = page[at : tag.start() if tag else len(page)]
        if heading and not piece.isspace():
            heading = not piece  # words end it
        if piece:
            buffer.append(piece)
            if links > 0:
                linked += len(piece)
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(tag[1])
        if name in ("svg", "math"):
            if closing:
                drawn = max(0, drawn - 1)
            elif not tag[3].endswith("/"):
                drawn += 1
            continue
        if not closing and name in _RAW:
            if drawn and tag[3].endswith("/"):
                continue
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name == "br" or name == "hr":
            buffer.append(" ")
        if name == "head":
            heading = not closing
            continue
        if name not in _BLOCK:
            continue
        drawn, heading = 0, heading and name == "html"  # an element of the page ends what was left open
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            continue
        while len(stack) > 1 and name in _ENDS.get(stack[-1][0], ()):
            stack.pop()
        if name in ("html", "body") and any(t == name for t, _ in stack):
            continue
        words, truth = _attributes(tag[3])
        stack.append((name, add(stack[-1][1], name, (words,), None, truth)))
    flush()
    return tree


def _attributes(written: str) -> tuple[str, str | None]:
    """Group of the words in class, id and role; the label of a page written out here."""
    if "=" not in written and "hidden" not in written:
        return "none", None
    words, truth = [], None
    for name, value in _ATTRIBUTE.findall(written):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words.append(value)
        elif name == "hidden" or name == "style" and "none" in value or name == "aria-hidden" and value == "true":
            words.append("hidden" if name != "style" else value)
        elif name == "x-label":
            truth = value
    if not words:
        return "none", truth
    joined = " ".join(words)
    return next((group for group, pattern in _WORDS if pattern.search(joined)), "other"), truth


def _leaf(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    size = sum(n >= bound for bound in (12, 30, 80, 200, 600))
    share = min(2, int(3 * linked / max(1, n)))
    says = next((name for name, words in _SAYS if words.search(text)), "none") if n < 600 else "none"
    return f"size {size}", f"links {share}", "stop" if text[-1] in ".!?:;…\"'»”)" else "open", says


def labels(tree: Tree) -> list[int] | None:
    """1 for content, of a page written out here or one that marks its article; else None."""
    marked = any(tree.truth)
    tops = [k for k, kind in enumerate(tree.kind) if kind == "article" or kind == "main"]
    tops = [k for k in tops if not any(tree.kind[a] in ("article", "main") for a in _above(tree, k))]
    if not marked and len(tops) != 1:
        return None
    out = [0] * len(tree.kind)
    for k in range(1, len(out)):
        out[k] = out[tree.parent[k]]
        if marked:
            if tree.truth[k]:
                out[k] = int(tree.truth[k] == "content")
        elif k == tops[0]:
            out[k] = 1
        elif tree.kind[k] in _APART or tree.seen[k][:1] and tree.seen[k][0] in _APART_WORDS:
            out[k] = 0
    return out


def _above(tree: Tree, k: int) -> Iterator[int]:
    while (k := tree.parent[k]) > 0:
        yield k


def counted(tree: Tree, weight: float = 1.0) -> Counter:
    """Counts of a labelled page: child given parent and kind, and what is seen given the label."""
    found: Counter = Counter()
    truth = labels(tree)
    if truth is None:
        return found
    for k in range(1, len(truth)):
        found[f"{tree.kind[k]}|{truth[tree.parent[k]]}|{truth[k]}"] += weight
        leaf = tree.text[k] is not None
        for slot, value in enumerate(tree.seen[k]):
            found[f"{'leaf' if leaf else 'box'} {slot}|{value}|{truth[k]}"] += weight
    return found


class Model:
    """Potentials in logarithms, from counts."""

    def __init__(self, counts: dict[str, float]):
        self.counts = dict(counts)
        self.turns: dict[str, tuple] = {}
        self.views: dict[tuple, tuple[float, float]] = {}
        self.totals: Counter = Counter()
        self.values: dict[str, set] = {}
        for key, n in self.counts.items():
            group, value, label = key.split("|")
            if group.startswith(("leaf ", "box ")):
                self.totals[group, label] += n
                self.values.setdefault(group, set()).add(value)

    def turn(self, kind: str) -> tuple:
        """Logarithms of P(child | parent): ((00, 01), (10, 11))."""
        if kind not in self.turns:
            rows = []
            for above in "01":
                # Where a kind was not met, a child tends to be what its parent is.
                n = [self.counts.get(f"{kind}|{above}|{c}", 0.0) + SMOOTH * (4 if c == above else 1) for c in "01"]
                rows.append(tuple(log(v / sum(n)) for v in n))
            self.turns[kind] = tuple(rows)
        return self.turns[kind]

    def view(self, seen: tuple[str, ...], leaf: bool) -> tuple[float, float]:
        """Logarithms of what is seen of a node, for both labels."""
        if (seen, leaf) not in self.views:
            out = [0.0, 0.0]
            for slot, value in enumerate(seen):
                group = f"{'leaf' if leaf else 'box'} {slot}"
                floor = FLOORS["leaf" if leaf else "box"]
                room = floor * (len(self.values.get(group, ())) + 1)
                for label in (0, 1):
                    total = self.totals[group, str(label)] or 1.0
                    out[label] += log((self.counts.get(f"{group}|{value}|{label}", 0.0) / total + floor) / (1 + room))
            self.views[seen, leaf] = (out[0], out[1])
        return self.views[seen, leaf]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of every node to be content; the root is not."""
        n = len(tree.parent)
        below = [self.view(tree.seen[k], tree.text[k] is not None) if k else (0.0, -60.0) for k in range(n)]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):  # up
            turn, own = self.turn(tree.kind[k]), below[k]
            sent[k] = message = (_plus(turn[0][0] + own[0], turn[0][1] + own[1]), _plus(turn[1][0] + own[0], turn[1][1] + own[1]))
            up = below[tree.parent[k]]
            below[tree.parent[k]] = (up[0] + message[0], up[1] + message[1])
        whole = list(below)
        for k in range(1, n):  # down: what the parent knows without this child
            turn, above = self.turn(tree.kind[k]), whole[tree.parent[k]]
            rest = (above[0] - sent[k][0], above[1] - sent[k][1])
            top = max(rest)
            rest = (rest[0] - top, rest[1] - top)
            own = below[k]
            whole[k] = (own[0] + _plus(rest[0] + turn[0][0], rest[1] + turn[1][0]), own[1] + _plus(rest[0] + turn[0][1], rest[1] + turn[1][1]))
        return [1 / (1 + exp(min(700.0, max(-700.0, a - b)))) for a, b in whole]

    def extract(self, page: str) -> str:
        tree = parse(page)
        share = self.marginals(tree)
        return "\n".join(t for t, p in zip(tree.text, share, strict=True) if t is not None and p >= 0.5)


def _plus(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def train(pages: DataFrame, labelled: int = LABELLED) -> Model:
    """Fit the potentials on the written pages and on at most ``labelled`` pages that mark their article."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("draw", pa.int64()), ("key", pa.string()), ("n", pa.float64())])
        for batch in source:
            found = (
                (draw, key, n)
                for draw, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for key, n in counted(parse(page.as_py())).items()
            )
            yield from batches(found, schema)

    text = F.col("html")
    marks = [text.contains(m) for m in ("<article", "<main", "<ARTICLE", "<MAIN")]
    marked = pages.where(marks[0] | marks[1] | marks[2] | marks[3]).select(F.xxhash64("page_id", "html").alias("draw"), "html")
    # Some more than are wanted, as not every page can be used; of these the first by their hash.
    share = min(1.0, (4 * labelled + 100) / max(1, marked.count()))
    drawn = marked.where(F.abs(F.col("draw") / F.lit(float(1 << 63))) <= share)
    rows = drawn.mapInArrow(run, "draw long, key string, n double")
    first = rows.select("draw").distinct().orderBy("draw").limit(labelled)
    rows = rows.join(first, "draw").groupBy("key").agg(F.sum("n").alias("n")).collect()
    counts = Counter({r["key"]: r["n"] for r in rows})
    for page in SEEDS:
        counts.update(counted(parse(page), SEED_WEIGHT))
    return Model(counts)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kind = T.StructType(
        [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for begin, end in units.byte_slices(batch.column("html")):
                part = batch.slice(begin, end - begin)
                texts = [model.extract(page or "") for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, kind)


_PARA = "<p>A paragraph of the story that runs on for a good while, with commas, asides and an end, as such paragraphs do.</p>"
_LONG = _PARA * 3 + "<p>Short one.</p>" + _PARA + "<p>" + "A longer one tells more of it, at ease, in many words. " * 6 + "</p>"
_SAID = "I think the writer has a point here, but left out what matters most to those of us who live with it every day of the year. "
_LAW = "Copyright of the publisher, all rights reserved. No part of these pages may be copied without leave of the owners, who are named in the imprint. "
_SELL = "Buy this thing now, it is cheaper than ever before in the shop, and comes to your door within a day or two at no cost at all. "
#: Labelled pages; ``x-label`` says where content begins and where it ends again.
SEEDS = [
    f'<html><body><div class="header"><div class="logo">Site name</div><ul class="nav"><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></div>'
    f'<div id="content" x-label="content"><h1>Title of the story</h1>{_LONG}<div class="share" x-label="no"><a href="#">Share this</a></div></div>'
    f'<div class="sidebar"><h3>Related</h3><ul><li><a href="/x">Another story here</a></li><li><a href="/y">And one more</a></li></ul><p>{_SELL}</p></div>'
    f'<div id="comments"><h3>Comments</h3><div class="comment"><p>{_SAID}</p></div><div class="comment"><p>{_SAID * 3}</p></div></div>'
    f'<div class="footer"><p>{_LAW}</p></div></body></html>',
    f'<html><body><header><h2>The daily page</h2></header><nav><a href="/">Home</a> <a href="/b">News</a></nav><main x-label="content"><h1>Headline</h1>{_LONG}'
    f'<aside x-label="no"><p>More on this in our long guide to the topic. {_SELL}</p></aside><blockquote>A quote that somebody said about it.</blockquote>{_PARA}</main>'
    f'<section class="comments"><h2>Reader comments</h2><ol><li><p>First! {_SAID}</p></li><li>{_SAID * 2}</li></ol></section>'
    f'<footer>{_LAW}</footer></body></html>',
    f'<html><body><div class="cookie-notice"><p>We use cookies to make this site work better for you and for others. {_SELL}</p><button>Accept</button></div>'
    f'<h1 x-label="content">A plain page</h1><div class="story-text" x-label="content">{_LONG}<ul><li>First point of a list in the text</li><li>Second point of it</li></ul></div>'
    f'<form action="/s"><label>Search</label><p>Type words to find pages on this site.</p></form><div id="respond"><p>{_SAID}</p></div></body></html>',
    f'<html><body><div><div><div x-label="content"><h2>Title</h2>{_LONG}<table><tr><td>Cell one</td><td>Cell two</td></tr></table></div></div>'
    f'<div><ul><li><a href="/1">One link</a></li><li><a href="/2">Two links</a></li><li><a href="/3">Three links</a></li></ul></div></div></body></html>',
    f'<html><body><article x-label="content"><header><h1>Title in a header</h1></header>{_LONG}<figure><figcaption>What the picture shows.</figcaption></figure>'
    f'<div class="ad" x-label="no"><p>{_SELL}</p></div>{_PARA}<footer x-label="no"><p>Filed under: things</p></footer></article>'
    f'<div class="newsletter"><p>Get our letter every week, and never miss a story again from us. {_SELL}</p><form><label>Mail</label></form></div><div class="ads">{_SELL}</div></body></html>',
]
