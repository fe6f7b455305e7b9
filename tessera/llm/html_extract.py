"""Main-text extraction with a tree-structured graphical model.

`parse` reads a page into a tree: a node for every block element, and one for every run of text between block borders
(inline elements add to the run around them). Every node has a binary state, content or not. Its unary potential is
linear in indicator features (tag, words of class/id/role, text and link amounts); parent and child share a 2 x 2
potential, chosen by the kind of the child. The tree has no cycles, so one upward and one downward sweep of
sum-product messages give exact marginals; sweeps run level by level over all pages of a batch at once.

`fit` maximises the likelihood of labelled pages (exact gradient: observed minus expected features, from the same
sweeps). A labelled page carries its labels as attributes data-y="1" or data-y="0" on elements; they hold for what is
below, and are never features. `labelled_pages` makes such pages from a seed in many layouts; the default model is
trained on them (TRAIN_PAGES, a fixed bound), and real labelled pages can be given instead.

The extracted text is that of the runs whose content marginal is at least one half: character references decoded,
white space inside a run made one space, runs joined by two line ends in page order. Text of raw and of dropped elements
(RAW, DROPPED) never becomes a run; an svg whose start tag closes itself ends there, and the text of math is inline text.

Defined cases: a null or empty html has the empty text; markup of any brokenness is read in linear time (unclosed elements
end with their parent, unclosed scripts and comments with the page); very long pages are read whole; equal pages give
equal texts; an empty table gives an empty table; extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

import html as _html
import json
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 300
SEED = 5
RENAMED = 0.1
ROUNDS = 300
BATCH = 128

#: Elements whose content is no markup: it ends at the first end tag of the name, or with the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that are read as markup and dropped with all that is in them; an unclosed one ends with its parent.
DROPPED = frozenset("svg object template select button canvas audio video noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta meter output progress q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: MathML is text of the run around it.
INLINE |= frozenset(
    "math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAGS = ("article", "main", "section", "div", "body", "html", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "td", "p", "h1", "h2", "quote", "dialog", "address", "other", "run")
TAG_OF = {t: t for t in TAGS} | {
    "ol": "ul", "dl": "ul", "menu": "nav", "dd": "li", "dt": "li", "tr": "td", "th": "td", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "td",
    "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "fieldset": "form", "center": "div", "hgroup": "div",
}
#: Words of class, id and role that speak for a kind of part.
WORDS = {
    "good": "article articlebody content entry post story main maincontent text body prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar links",
    "ends": "header footer masthead banner copyright colophon legal contentinfo head foot bottom top",
    "side": "sidebar side aside related widget widgets recommended recommendations share social tags popular more rail complementary",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion outbrain taboola",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe subscription paywall gdpr overlay toast message warning",
    "comment": "comment comments reply replies disqus discussion respond reviews feedback commentlist",
    "form": "form login search signup register searchbox contact",
}
_KIND_OF_WORD = {w: k for k, words in WORDS.items() for w in words.split()}
FEATURES = [f"tag:{t}" for t in TAGS] + [f"word:{k}" for k in WORDS] + [f"len:{i}" for i in range(6)] + [f"link:{i}" for i in range(4)] + ["stop", "hidden", "bias"]
INDEX = {f: i for i, f in enumerate(FEATURES)}
EDGE_KINDS = 4  # child is: an element, a named element, a run, a heading or paragraph
CONTENT = 0.5

_STRICT = re.compile(r"<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.IGNORECASE)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>[^>]*)>", re.IGNORECASE)
#: An attribute at the end without quotes takes a slash before the end of the tag as its own.
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+$")
_ATTR = re.compile(r"(class|id|role|data-y|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Tree:
    """parent, level, features (flat, with `ends`), edge kinds, labels and runs of one or many pages."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.level: list[int] = []
        self.tag: list[str] = []
        self.marks: list[frozenset] = []
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.stops: list[int] = []
        self.label: list[int] = []
        self.text: dict[int, str] = {}

    def node(self, parent: int, tag: str, marks: frozenset = frozenset(), label: int = -1) -> int:
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.marks.append(marks)
        self.chars.append(0)
        self.linked.append(0)
        self.stops.append(0)
        self.label.append(label if label >= 0 or parent < 0 else self.label[parent])
        return len(self.parent) - 1


@lru_cache(maxsize=1 << 14)
def _marks(attrs: str) -> tuple[frozenset, int]:
    """(kinds of the words in class, id and role, and 'hidden'; label or -1)."""
    found, label = set(), -1
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()  # noqa: PLW2901
        if name == "data-y":
            label = int(value == "1")
        elif name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or value == "true" or _HIDING.search(value):
                found.add("hidden")
        else:
            found |= {_KIND_OF_WORD[w] for w in _WORD.findall(value) if w in _KIND_OF_WORD}
    return frozenset(found), label


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, start, end or alone (a start tag that closes itself).

    Linear in the page: a raw element that is not closed takes the rest; if a quote in a tag is never closed, tags from
    there on end at their first >; beyond the last > there is no tag.
    """
    at, n, low = 0, len(page), page.lower()
    low = low if len(low) == n else "".join(c.lower() if c.isascii() else c for c in page)
    last, pattern = page.rfind(">"), _STRICT
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        m = pattern.match(page, lt)
        if m is None and pattern is _STRICT and (m := _LOOSE.match(page, lt)) is not None:
            pattern = _LOOSE
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):  # a declaration, or an end tag without a name
                at = page.find(">", lt) + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        at, name, attrs = m.end(), m["tag"].lower(), m["attrs"]
        if m["end"]:
            yield "end", name, ""
        elif attrs.endswith("/") and not _UNQUOTED.search(attrs):
            yield "alone", name, attrs
        else:
            yield "start", name, attrs
        if name in RAW and not m["end"]:
            close = f"</{name}"
            end = low.find(close, at)
            while end >= 0 and low[end + len(close) : end + len(close) + 1] not in ("", ">", "/", " ", "\t", "\n", "\f", "\r"):
                end = low.find(close, end + 1)
            if end < 0:
                return
            yield "text", page[at:end], ""  # dropped, as the element is open
            at = end


_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def parse(page: str | None, tree: Tree) -> None:
    """Adds the page's nodes to the tree."""
    root = tree.node(-1, "html")
    open_: list[tuple[str, int]] = [("html", root)]  # blocks that are open, and dropped or raw elements (node -1)
    names: Counter[str] = Counter()
    run: list[str] = []
    links = linked = dropped = 0

    def close_run() -> None:
        nonlocal run, linked
        text = " ".join(_html.unescape("".join(run)).split()) if run else ""
        if text:
            at = tree.node(open_[-1][1], "run")
            tree.text[at] = text
            tree.chars[at], tree.linked[at] = len(text), min(len(text), linked)
            tree.stops[at] = int(text[-1] in ".!?:;\"'”»…。")
        run, linked = [], 0

    def pop() -> None:
        nonlocal dropped
        name, node = open_.pop()
        names[name] -= 1
        dropped -= node < 0

    for kind, tag, attrs in tokens(page or ""):
        if kind == "text":
            if not dropped:
                run.append(tag)
                if links:
                    linked += len(tag)
            continue
        if kind == "end":
            if tag in INLINE:
                links = 0 if tag == "a" and not dropped else links
            elif names[tag]:
                inside = open_[-1][1] < 0 and (tag in DROPPED or tag in RAW)
                if not inside:
                    while dropped and open_[-1][0] != tag:
                        pop()
                    close_run()
                while open_[-1][0] != tag:
                    pop()
                pop()
                links = links if inside else 0
            continue
        if tag in DROPPED or tag in RAW or dropped:
            if tag not in VOID and tag not in INLINE and kind == "start" or tag in RAW:
                open_.append((tag, -1))
                names[tag] += 1
                dropped += 1
            elif tag in DROPPED and tag != "svg":  # only foreign elements close themselves
                open_.append((tag, -1))
                names[tag] += 1
                dropped += 1
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            elif tag == "br":
                run.append(" ")
            continue
        if tag in ("html", "head"):  # a head has no text of its own
            tree.marks[root] |= _marks(attrs)[0] if attrs and tag == "html" else frozenset()
            continue
        close_run()
        if tag in VOID:
            continue
        while len(open_) > 1 and (open_[-1][0] == "p" or open_[-1][0] in _CLOSES.get(tag, ())):
            pop()  # a paragraph ends before any block; items and cells end before the next
        marks, label = _marks(attrs) if attrs else (frozenset(), -1)
        open_.append((tag, tree.node(open_[-1][1], TAG_OF.get(tag, "other"), marks, label)))
        names[tag] += 1
    while dropped:
        pop()
    close_run()


@dataclass
class Forest:
    """Arrays of a Tree, ready for the sweeps."""

    parent: np.ndarray
    edge: np.ndarray
    feature: np.ndarray
    begins: np.ndarray
    levels: list[np.ndarray]
    label: np.ndarray


def forest(tree: Tree) -> Forest:
    n = len(tree.parent)
    parent = np.array(tree.parent, dtype=np.int64)
    level = np.array(tree.level, dtype=np.int64)
    order = np.argsort(level, kind="stable")
    levels = np.split(order, np.searchsorted(level[order], np.arange(1, (level.max() if n else 0) + 1)))
    chars, linked, stops = (np.array(x, dtype=np.int64) for x in (tree.chars, tree.linked, tree.stops))
    for nodes in reversed(levels[1:]):  # amounts of the whole subtree
        for x in (chars, linked, stops):
            np.add.at(x, parent[nodes], x[nodes])
    size = np.searchsorted([1, 25, 80, 250, 1000], chars, side="right")
    share = np.searchsorted([0.01, 0.3, 0.7], linked / np.maximum(chars, 1), side="right")
    tag0, word0 = {t: INDEX[f"tag:{t}"] for t in TAGS}, {k: INDEX[f"word:{k}"] for k in WORDS} | {"hidden": INDEX["hidden"]}
    flat: list[int] = []
    begins, edge = [], []
    size_, share_, stops_ = (size + INDEX["len:0"]).tolist(), (share + INDEX["link:0"]).tolist(), stops.tolist()
    bias, stop = INDEX["bias"], INDEX["stop"]
    for tag, marks, s, h, e in zip(tree.tag, tree.marks, size_, share_, stops_, strict=True):
        begins.append(len(flat))
        flat += (bias, tag0[tag], s, h)
        if e:
            flat.append(stop)
        if marks:
            flat += [word0[k] for k in sorted(marks)]
        edge.append(2 if tag == "run" else 3 if tag in ("p", "h1", "h2", "li", "td", "quote") and not marks else 1 if marks else 0)
    return Forest(parent, np.array(edge, dtype=np.int64), np.array(flat, dtype=np.int64), np.array(begins, dtype=np.int64), levels, np.array(tree.label, dtype=np.int64))


@dataclass(frozen=True)
class Model:
    """weight: of the features, for the content state; pair[kind, parent's state, child's state]."""

    weight: np.ndarray
    pair: np.ndarray

    def to_json(self) -> str:
        """The fitted numbers, by the names of the features; kept with a project, they spare the fit."""
        return json.dumps({"weight": dict(zip(FEATURES, self.weight.tolist(), strict=True)), "pair": self.pair.tolist()})

    @staticmethod
    def from_json(text: str) -> Model:
        held = json.loads(text)
        if set(held["weight"]) != set(FEATURES):
            raise ValueError("the model was fitted on other features")
        return Model(np.array([held["weight"][f] for f in FEATURES]), np.array(held["pair"]))


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(probability of content by node, joint [node, parent's state, own state]): sum-product, up and then down."""
    n = len(f.parent)
    unary = np.zeros((n, 2))
    if n:
        unary[:, 1] = np.add.reduceat(model.weight[f.feature], f.begins)
    pair = model.pair[f.edge]
    up = unary.copy()  # unary and the messages of all children
    to_parent = np.zeros((n, 2))
    for nodes in reversed(f.levels[1:]):
        s = pair[nodes] + up[nodes][:, None, :]
        to_parent[nodes] = _soft(s[:, :, 0], s[:, :, 1])
        np.add.at(up, f.parent[nodes], to_parent[nodes])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for nodes in f.levels[1:]:
        above = belief[f.parent[nodes]] - to_parent[nodes]  # the parent without this child
        s = above[:, :, None] + pair[nodes]
        belief[nodes] = up[nodes] + _soft(s[:, 0], s[:, 1])
        j = s + up[nodes][:, None, :]
        j -= j.max(axis=(1, 2), keepdims=True)
        j = np.exp(j)
        joint[nodes] = j / j.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def fit(pages: Sequence[str], rounds: int = ROUNDS, decay: float = 1e-5) -> Model:
    """Maximum likelihood over labelled pages, by Adam on the exact gradient. Nodes without a label count as not content."""
    tree = Tree()
    for p in pages:
        parse(p, tree)
    f = forest(tree)
    y = np.maximum(f.label, 0)
    counts = np.diff(np.append(f.begins, len(f.feature)))
    inner = f.parent >= 0
    observed = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(observed, (f.edge[inner], y[f.parent[inner]], y[inner]), 1)
    theta = np.zeros(len(FEATURES) + EDGE_KINDS * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        model = Model(theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(EDGE_KINDS, 2, 2))
        p, joint = marginals(f, model)
        g = np.bincount(f.feature, weights=np.repeat(y - p, counts), minlength=len(FEATURES))
        expected = np.zeros((EDGE_KINDS, 2, 2))
        np.add.at(expected, f.edge[inner], joint[inner])
        grad = np.concatenate([g, (observed - expected).ravel()]) / len(y) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(theta[: len(FEATURES)].copy(), theta[len(FEATURES) :].reshape(EDGE_KINDS, 2, 2).copy())


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Pages of invented words in many layouts, labelled by data-y."""
    rng = random.Random(seed)
    parts = ["ka", "ro", "min", "tel", "su", "ver", "ein", "tion", "la", "que", "or", "th", "es", "pa"]
    pick = rng.choice

    def word() -> str:
        return "".join(pick(parts) for _ in range(rng.randint(1, 4)))

    def line(least: int, most: int, stop: str = ".") -> str:
        return " ".join(word() for _ in range(rng.randint(least, most))).capitalize() + stop

    def para() -> str:
        kind = rng.random()
        text = " ".join(line(3, 14) for _ in range(rng.randint(1, 7))) if kind > 0.25 else line(1, 3)
        if rng.random() < 0.2:
            text += f' <a href="/{word()}">{word()}</a> {line(2, 6)}'
        if rng.random() < 0.2:
            text = f"<b>{line(1, 6)}<br>" + text if rng.random() < 0.5 else f"<em>{word()}</em> " + text
        return f"<p>{text}" + pick(["</p>", "</p>", "</p>", ""])

    def items(linked: bool, n: int) -> str:
        tag = pick(["ul", "ul", "ol"])
        each = "".join(f'<li><a href="/{word()}">{word()}</a></li>' if linked else f"<li>{line(2, 12, pick(['.', '']))}</li>" for _ in range(n))
        return f"<{tag}>{each}</{tag}>"

    def named(tag: str, names: str, body: str, always: bool = False) -> str:
        attr = f' {pick(["class", "class", "id"])}="{pick(names.split())}{pick(["", "", "-" + word(), " " + word()])}"' if always or rng.random() < 0.75 else ""
        return f'<{tag}{attr} data-y="0">{body}</{tag}>'

    def article() -> str:
        body = pick(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"]).format(line(2, 9, pick(["", "."])))
        for _ in range(pick([1, 1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.72:
                body += para()
            elif kind < 0.8:
                body += f"<h2>{line(1, 6, '')}</h2>"
            elif kind < 0.87:
                body += items(False, rng.randint(2, 6))
            elif kind < 0.91:
                body += f"<blockquote>{para()}</blockquote>"
            elif kind < 0.94:
                body += "<table>" + "".join(f"<tr><td>{word()}</td><td>{line(1, 4, '')}</td></tr>" for _ in range(3)) + "</table>"
            elif kind < 0.96:
                body += f"<pre>{line(3, 9)}</pre>"
            elif kind < 0.98:
                body += named("div", WORDS["advert"], line(3, 12), True)
            else:
                body += f"<section><h2>{line(1, 4, '')}</h2>{para()}{para()}</section>"
        shell = rng.random()
        if shell < 0.55:
            return f'<article data-y="1">{body}</article>'
        if shell < 0.7:
            return f'<main data-y="1">{body}</main>'
        if shell < 0.92:
            return f'<div {pick(["class", "id"])}="{pick(WORDS["good"].split())}" data-y="1">{body}</div>'
        return f'<div data-y="1">{body}{para()}{para()}{para()}</div>'

    def comments() -> str:
        each = "".join(f'<div class="comment"><b>{word()}</b>{para()}</div>' if rng.random() < 0.6 else f"<li>{para()}</li>" for _ in range(rng.randint(1, 5)))
        return named(pick(["section", "div", "ul"]), "comments comment-list discussion replies", f"<h3>{line(1, 3, '')}</h3>{each}", True)

    def form() -> str:
        return named("form", WORDS["form"], f'<label>{line(1, 3, "")}</label><input name="q"><p>{line(2, 8)}</p><button>{word()}</button>')

    def above() -> str:
        out = ""
        if rng.random() < 0.5:
            out += named("header", "header masthead site-header top", f"<h1>{line(1, 3, '')}</h1><p>{line(2, 7)}</p>" if rng.random() < 0.5 else items(True, 4))
        if rng.random() < 0.85:
            out += named(pick(["nav", "nav", "div"]), WORDS["menu"], items(True, rng.randint(2, 9)), False) if rng.random() < 0.7 else f'<nav data-y="0">{items(True, rng.randint(2, 9))}</nav>'
        if rng.random() < 0.3:
            out += named("div", "cookie-notice consent notice alert banner", f"<p>{line(6, 18)}</p><button>{word()}</button>", True)
        if rng.random() < 0.6:
            out += named(pick(["div", "aside"]), WORDS["advert"], pick([line(3, 14), para()]), True)
        return out

    def below() -> str:
        out = ""
        if rng.random() < 0.4:
            out += comments()
        if rng.random() < 0.25:
            out += form()
        if rng.random() < 0.35:
            out += named("div", WORDS["side"], f"<h3>{line(1, 3, '')}</h3>{items(True, 5)}", True)
        if rng.random() < 0.9:
            out += named("footer", "footer site-footer", pick([f"&copy; {word()} &middot; {line(2, 9)}", f"<p>{line(2, 8)}</p>{items(True, 3)}", para()])) if rng.random() < 0.8 else named("div", "footer copyright bottom", line(3, 12), True)
        return out

    def side() -> str:
        return named(pick(["aside", "aside", "div"]), WORDS["side"], f"<h3>{line(1, 3, '')}</h3>" + pick([items(True, 5), para() + para()]), True) if rng.random() < 0.35 else ""

    out = []
    for _ in range(n):
        a, s = article(), side()
        inner = s + a if rng.random() < 0.5 else a + s
        if rng.random() < 0.35:
            inner = f'<div class="{pick(["container", "wrapper", "page", word()])}" data-y="0">{inner}</div>'
        page = f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title></head><body>{above()}{inner}{below()}" + pick(["</body></html>", "</body></html>", ""])
        if rng.random() < RENAMED:  # names that say nothing: only tags, sizes and links are left to learn from
            page = re.sub(r' (class|id)="[^"]*"', lambda m: f' {m[1]}="x{word()}"', page)
        out.append(page)
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def extract(pages: Sequence[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    tree, ends = Tree(), []
    for p in pages:
        parse(p, tree)
        ends.append(len(tree.parent))
    p, _ = marginals(forest(tree), model)
    found: list[list[str]] = [[] for _ in pages]
    page_of = np.searchsorted(ends, np.fromiter(tree.text, dtype=np.int64, count=len(tree.text)), side="right").tolist()
    for (node, text), k in zip(tree.text.items(), page_of, strict=True):
        if p[node] >= CONTENT:
            found[k].append(text)
    return ["\n\n".join(x) for x in found]


def extract_table(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                b = batch.slice(at, BATCH)
                texts = extract(b.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract_query(pages: DataFrame) -> DataFrame:
    return extract_table(pages)
