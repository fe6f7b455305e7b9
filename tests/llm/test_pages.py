"""Main-text extraction: broken markup, long pages, names that the features do not know, and the true text of given pages."""

import os
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import html_extract as H

FIRST, LAST = "First words of the story, told at some length.", "Last words of the story, with its end in sight."


def article(middle):
    return f"<nav><a href=/x>Home</a></nav><article><h1>Title here</h1><p>{FIRST}</p>{middle}<p>{LAST}</p></article><footer>c 2024</footer>"


@pytest.fixture(scope="module")
def model():
    return H.default_model()


@pytest.mark.parametrize("middle,inside", [
    ("<svg><svg><text>gone</text></svg><text>gone</text></svg>", None),
    ("<template><template>gone</template><p>gone, too, as it is inside.</p></template>", None),
    ("<object><object>gone</object>gone</object>", None),
    ("<title-card><p>Words of a card stand here too.</p></title-card>", "Words of a card stand here too."),
    ("<video-player><p>Words of a player stand here too.</p></video-player><video>gone</video>", "Words of a player stand here too."),
    ("<object-x><p>Words of a thing stand here too.</p></object-x><object>gone</object>", "Words of a thing stand here too."),
    ("<p>Inner words <button>gone</button> go on here.</p>", "Inner words go on here."),
    ("<div><button>gone</div>", None),
    ("<script>if (a </b) x('</p>')</script><style>p > a {}</style>", None),
    ("<scripted><p>Words of another tag stand here.</p></scripted>", "Words of another tag stand here."),
    ("<p>a < b and b > c, as <!-- gone --> all know.</p>", "a < b and b > c, as all know."),
    ("<select><option>gone<option>gone</select>", None),
    ("<noscript><img src=x>gone</noscript>", None),
])
def test_markup(model, middle, inside):
    assert H.extract([article(middle)], model) == ["\n\n".join(["Title here", FIRST, *([inside] if inside else []), LAST])]


def test_unclosed(model):
    """What is never closed takes the rest of the page at most, and no code becomes text."""
    page = article("<script>var leak = 1;")
    assert H.extract([page], model) == [f"Title here\n\n{FIRST}"]
    assert "leak" not in H.extract(["<p>Some words that stay.</p><script>var leak = 1;"], model)[0]
    quoted = H.extract([article("<p title=\"it's>Words behind a broken quote stay here.</p>")], model)[0]
    assert FIRST in quoted and LAST in quoted


@pytest.mark.parametrize("piece", ["<button>", "<div>", "<p title='", "<!-- ", "<svg><g>", "<", "<!", "</section>", "<script>", "<a href=\"x", "<div></p>", "<b><i>"])
def test_linear(model, piece):
    page = "<article><p>Words.</p>" + piece * 10_000 + "<p>More.</p>"
    began = time.perf_counter()
    H.parse(page, H.Tree())
    assert time.perf_counter() - began < 5


def test_long_page(model):
    page = article("".join(f"<p>Sentence number {i} of a very long page.</p>" for i in range(20_000)))
    assert H.extract([page], model)[0].count("\n\n") == 20_002


def test_unknown_names(model):
    """Held-out pages on which every class and id is a word that no feature knows."""
    pages = [re.sub(r' (class|id)="[^"]*"', r' \1="zq"', p) for p in H.labelled_pages(120, 991)]
    tree = H.Tree()
    for p in pages:
        H.parse(p, tree)
    f = H.forest(tree)
    p, _ = H.marginals(f, model)
    runs = sorted(tree.text)
    assert ((p[runs] >= 0.5) == (f.label[runs] == 1)).mean() > 0.9


def test_saved_model(model):
    again = H.Model.from_json(model.to_json())
    assert (again.weight == model.weight).all() and (again.pair == model.pair).all()
    with pytest.raises(ValueError):
        H.Model.from_json('{"weight": {}, "pair": []}')


class Plain(HTMLParser):
    """Text of the article element's blocks, read by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "a", "i", "em"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b", "a", "i", "em"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def true_text(page):
    p = Plain()
    p.feed(page)
    return "\n\n".join(t for t in (" ".join(b.split()) for b in p.blocks) if t)


def test_given_pages(model):
    pq = pytest.importorskip("pyarrow.parquet")
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no given pages")
    pages = [x or "" for x in pq.read_table(path, columns=["html"]).column(0).to_pylist()]
    want = [true_text(p) for p in pages]
    assert np.mean([bool(w) for w in want]) > 0.9
    assert H.extract(pages, model) == want
