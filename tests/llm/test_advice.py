"""Inputs on which the operators did less than the whole job."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tessera.llm import html_extract, secrets, suffix_dedup, vector_search


def test_vector_search_repeated_query_rows(spark):
    """Rows of the query's own id, and near copies of it, take no place among the k that bound the reading."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 64))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    for copies, near in ((2, 0), (6, 3), (12, 0), (12, 3)):
        rows = np.vstack([x, np.repeat(x[:1], copies - 1, axis=0), x[:1] + rng.integers(-2, 3, (near, 64)) / 256])
        ids = np.concatenate([np.arange(2000), np.zeros(copies - 1, dtype=np.int64), 5000 + np.arange(near)])
        df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
        y = np.floor(256 * rows)
        want = set()
        for j in (0, 1):
            score = (y @ y[j]).astype(np.int64)
            other = np.flatnonzero(ids != j)
            best = sorted(zip((-score[other]).tolist(), ids[other].tolist(), strict=True))[:5]
            want |= {(j, r + 1, i, -s) for r, (s, i) in enumerate(best)}
        assert {tuple(r) for r in vector_search.top_k(df, df.where("vec_id < 2")).collect()} == want


def test_vector_search_common_vector(spark):
    """Two thirds of the rows hold one vector, some ids many times: the smallest ids win, and no query meets them all."""
    rng = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, 0.125]) for i in range(300)] + [(i, [0.5, 0.25, 0.125]) for i in (0, 0, 1, 1, 1, 1, 1, 1, 1, 50, 50)]
    rows += [(1000 + i, [float(x) for x in rng.normal(0, 0.3, 3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in vector_search.search_query(df).collect())
    want = []
    y = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    for q, a in {i: v for i, v in y if i % 50 == 0}.items():
        best = sorted((-sum(c * d for c, d in zip(a, b, strict=True)), i) for i, b in y if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    vectors, _ = vector_search.stored(df.selectExpr("vec_id AS id", "embedding AS v"), 5)
    assert vectors.count() <= 6 * 5 + 150


def test_vector_search_large_scores(spark):
    """Scores beyond a long are cut to its ends, and ties there go to the smaller id."""
    rows = [(0, [1e17, 0.0]), (1, [1e17, 1.0]), (2, [2e17, 0.0]), (3, [-1e17, 5.0]), (4, [0.5, 0.5]), (5, [1e300, 1e300]), (6, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vector_search.top_k(df, df.where("vec_id = 0"), k=6).orderBy("rank").collect()]
    most = (1 << 63) - 1
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    score = {i: max(-most - 1, min(most, sum(a * b for a, b in zip(v, whole[0], strict=False)))) for i, v in whole.items() if i}
    assert got == [(0, r + 1, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))]


def test_suffix_dedup_middle_bytes(spark):
    """Repeated rows make stretches of up to 113 bytes; documents differ in one value, at any place."""
    rng = random.Random(5)
    docs = []
    for i in range(150):
        row = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz,;|") for _ in range(rng.randint(22, 27)))
        text = row * 6
        at = rng.randrange(len(text))
        docs += [(2 * i, text), (2 * i + 1, text[:at] + "#" + text[at + 1 :])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert {tuple(r) for r in suffix_dedup.dedup_query(df).collect()} == brute.repeats(docs)


def test_html_self_closed_and_math():
    """A self-closed svg or math takes nothing with it, an open svg is dropped with its text, and text in math stays."""
    model = html_extract.default_model()
    head, tail = "<article><h1>Title here</h1><p>First words of the story.</p>", "<p>Last words of the story.</p></article>"
    want = "Title here\n\nFirst words of the story.\n\n{}Last words of the story."
    middle = "<p>Middle words of the story.</p><svg viewBox='0 0 1 1'><text>drawn</text></svg>"
    for icon in ("<svg/>", "<svg />", "<SVG class='a>b' d=\"m/\" href=x />", "<math/>", "<math display='block' />"):
        assert html_extract.extract([head + icon + middle + tail], model) == [want.format("Middle words of the story.\n\n")]
    for icon in ("<svg>", "<svg class=a/>", "<svg d='a/'>"):  # none of these start tags closes itself
        assert html_extract.extract([head + icon + "gone</svg>" + tail], model) == [want.format("")]
    formula = "<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all words.</p>"
    assert html_extract.extract([head + formula + tail], model) == [want.format("Here x=2 holds for all words.\n\n")]


def test_redact_short_and_one_case_keys(spark):
    """Masking takes keys of 20 characters, of one letter case, and the rest of a key around a base span."""
    rng = random.Random(9)
    key = lambda kinds, n: "".join(rng.choice(kinds) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    keys = ["Zx9Qw3Er7Ty1Ui5Op2As", "q7" + key(low + digits, 30), "K4" + key(up + "234567", 30) + "==", "3f" * 3 + key("0123456789abcdef", 14)]
    keys += ["Zx9Qw3Er7Ty1Ui5Op2As" + "deadbeef01234567" * 2 + "Bn4Vc8Xz1Lk6Jh3Gf7Ds"]
    plain = ["12345678901234567890123", "a-plain-name-of-words-and-2024", "internationalisations", "word " * 30]
    texts = [f"see {k} here" for k in keys] + plain
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert [got[i] for i in range(len(texts))] == ["see [SECRET] here"] * len(keys) + plain
