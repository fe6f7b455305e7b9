"""The pipeline's stages: near copies, clashing names, long texts, and cases that were once lost."""

import hashlib
import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tessera.llm import mixing, quality, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_corpus(seed=3):
    """Bases with copies of many similarities around 4 / 5, exact copies, other case and spacing, nulls and shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = " ".join(word() for _ in range(30))
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  TWO"), (None, "one two"), (None, None)]
    for b in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 60, 200, 900]))]
        texts = [" ".join(base), " ".join(base).upper(), "\n".join(base), line + " " + " ".join(base)]
        for _ in range(8):
            v = list(base)
            for i in rng.sample(range(len(v)), rng.randint(0, max(1, len(v) // 25))):
                v[i] = word()
            texts.append(" ".join(v[: rng.randint(len(v) * 4 // 5, len(v))]))
        rows += [(20 * b + k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,size", [(2048, 4 << 20), (2, 3000)])
def test_simhash_stage(spark, monkeypatch, chunk, size):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "CHUNK_BYTES", size)
    rows = near_corpus()
    rows += [r for r in rows if r[0] is not None][:10]  # repeated rows
    rows += [(5, "the first text of this number is a short one"), (5, "and here the second text that has nothing in common with it")]
    df = spark.createDataFrame([(i, t, "en", "s", 7, i) for i, t in rows], DOCS + ", h long")
    out = simhash.simhash_stage(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text or "") for r in out.collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted(brute.near_kept(rows))
    assert sorted(t for i, t in got if i is None) == ["", "one two"]
    assert simhash.simhash_stage(df.limit(0)).count() == 0


def test_large_groups(spark, monkeypatch):
    """Links of one key, and rows of the rounds, grow with a group of near copies, not with its square; none is lost."""
    rng = random.Random(8)
    schema = "key long, n long, f0 long, f1 long"
    near = lambda n: sum(1 << b for b in rng.sample(range(62), n))
    copies = [(1, k, near(8), near(8)) for k in range(512)]  # at most 32 bits apart
    found = simhash._meet(spark.createDataFrame(copies, schema), ["key"], ["n", "f0", "f1"], simhash._like, 16).collect()
    assert len(found) == 511
    chain = [(1, k, (1 << 40) - 1 if k % 2 else 0, (1 << k) - 1) for k in range(60)]  # two far groups, each joined in places only
    rows = copies + [(1, 1000 + n, f | 3 << 60, g) for _, n, f, g in chain] + [(2, n, 0, 0) for n in (5, 1000)]
    found = [tuple(r) for r in simhash._meet(spark.createDataFrame(rows, schema), ["key"], ["n", "f0", "f1"], simhash._like, 16).collect()]
    prints = {(key, n): (f0, f1) for key, n, f0, f1 in rows}

    def groups(nodes, links):
        up = {x: x for x in nodes}
        for a, b in links:
            old, new = up[a], up[b]
            up = {x: new if r == old else r for x, r in up.items()}
        return {frozenset(x for x in nodes if up[x] == r) for r in up.values()}

    like = lambda x, y: (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count() <= simhash.WIDE_DISTANCE
    want = [(a, b) for (k, a), x in prints.items() for (m, b), y in prints.items() if k == m and a < b and like(x, y)]
    nodes = {n for _, n in prints}
    assert groups(nodes, found) == groups(nodes, want)

    made, write = [], simhash.materialised
    monkeypatch.setattr(simhash, "materialised", lambda df, tag: made.append((tag, write(df, tag))) or made[-1][1])
    monkeypatch.setattr(simhash, "discard", lambda *_: None)
    stars = [(c, m) for c in range(30) for m in range(30, 330)]
    got = simhash.components(spark.range(330).select("id", F.col("id").alias("first")), spark.createDataFrame(stars, "a long, b long"), "id")
    assert {tuple(r) for r in got.collect()} == {(x, 0) for x in range(330)}
    assert [t.count() for tag, t in made if tag == "edges"][-1] <= 2 * 330


def test_similar_links():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 60, 50, dtype=np.uint64))
    sets = [base, base[:40], base[:39], base[10:], np.empty(0, "<u8"), np.empty(0, "<u8")]
    found = {frozenset(x) for x in simhash.similar_links(sets)}
    parent = {i: i for i in range(6)}
    for a, b in (tuple(x) for x in found):
        assert 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
        parent = {k: parent[a] if v == parent[b] else v for k, v in parent.items()}
    assert len(set(parent.values())) == 2  # 0 - 1 (40 / 50), 1 - 2 (39 / 40), 0 - 3 (40 / 50); the empty ones


def clashing(spark, n=120):
    """Documents with columns of the stages' own names."""
    rng = random.Random(4)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(k))
    rows = [(i, words(rng.randint(40, 90)) + (" password=Hidden1234" if i % 3 else ""), "en", f"src{i % 5}", i, 77, "f", "b", 777, "row", 5, "m", 9) for i in range(n)]
    return spark.createDataFrame(rows, DOCS + ", copies long, found string, base string, n_words long, _row string, _tokens long, _masked string, id long")


def test_stages_keep_columns(spark):
    df = clashing(spark)
    before = {r.doc_id: r for r in df.collect()}
    for stage in (quality.quality_stage, simhash.simhash_stage, secrets.secrets_stage, mixing.mixing_stage):
        out = stage(df)
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        rows = out.collect()
        assert rows
        for r in rows:
            was = before[r.doc_id]
            if stage is secrets.secrets_stage:
                assert r.text == (was.text.replace("password=Hidden1234", "[SECRET]")) and r.n_chars == (len(r.text) if r.text != was.text else was.n_chars)
                assert r[5:] == was[5:]
            else:
                assert r == was


def test_mixing_weight_zero(spark):
    """A source of weight 0 gives nothing, empty texts included; of others, empty texts may be taken."""
    rows = [(i, None if i % 4 == 0 else "some words here", "en", f"src{i % 2}", None) for i in range(40)]
    rows += [(100 + i, "", "xx", "src1", None) for i in range(3)]
    df = spark.createDataFrame(rows, DOCS)
    mix = mixing.Mix(weights={"source": {"src0": 0}})
    got = mixing.mixing_query(df, mix).collect()
    assert all(r.copies == 0 for r in got if r.source == "src0" or r.lang == "xx") and any(r.copies for r in got)
    duckdb = pytest.importorskip("duckdb")
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(mixing._mixing_sql(mix)).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def entropy_spans(text):
    """All spans, straight from the definitions."""
    base = [(int(s), int(e)) for _, s, e in (x.split(":") for x in brute.secrets(text).split(",") if x)]
    found = []
    for m in re.finditer(secrets.CANDIDATE, text):
        t = m[0]
        if any(re.fullmatch(p, t) for p in secrets.ALLOWED):
            continue
        kind = "hex" if re.fullmatch("[0-9a-fA-F]+", t) else next((k for k, p in secrets.ONE_CASE.items() if re.search(p, t)), "base64")
        mixed = kind == "hex" or (re.search("[0-9]", t) and (kind in secrets.ONE_CASE or (re.search("[a-z]", t) and re.search("[A-Z]", t))))
        if not mixed:
            continue
        w = secrets.WINDOW
        hits = [i for i in range(len(t) - w + 1) if sum(secrets.clog(t[i : i + w].count(c)) for c in set(t[i : i + w])) <= secrets.most_clog(kind)]
        if hits:
            s, e = m.start() + hits[0], m.start() + hits[-1] + w
            if not any(a <= s and e <= b for a, b in base):
                found.append((s, e))
    return base + found


def test_secrets_masked(spark):
    rng = random.Random(12)
    kinds = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "abcXYZ0189+/_=-", "ab1"]
    texts = ["", "x", "é" * 5000 + " password=abcdefgh1 " + "ü" * 9000]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 30)):
            parts.append(rng.choice(["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 60))), "plain words", "token = ", "api_key:", "é", "AKIA" + "Q" * 14, "a-b-c-2024", "\n"]))
        texts.append(rng.choice([" ", "", "="]).join(parts))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    spans = {r.doc_id: r.spans for r in secrets.secrets_query(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.masked(t, entropy_spans(t)), t
        assert sorted(tuple(map(int, x.split(":")[1:])) for x in spans[i].split(",") if x) == sorted(entropy_spans(t))


@pytest.mark.parametrize("text", [
    "x " + "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000)) + " y",
    "token=abcdefgh1 " * 100_000,
    "a-b1-" * 200_000,
], ids=["base64", "assign", "joined"])
def test_secrets_linear(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    began = time.perf_counter()
    r = secrets.secrets_query(df).first()
    masked = secrets.redact(df).first().text
    assert time.perf_counter() - began < 90
    assert r.base_sha256 == hashlib.sha256(brute.secrets(text).encode()).hexdigest()
    if text[0] == "x":
        assert r.spans.startswith("entropy:2:") and masked == "x [SECRET] y"
    if text[0] == "t":
        assert r.n_assign == 100_000 and masked == "[SECRET] " * 100_000


def test_quality_short_circuit(spark):
    """Whatever the order, the verdict is the same, and a measure of a later rule is not computed for what is rejected."""
    rows = clashing(spark, 40).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(900, "# $ % " * 40), (901, "same line here\n" * 30), (902, None), (903, "a b c " * 40 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    verdicts = set()
    for order in (quality.RULES, quality.RULES[::-1]):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(quality, "ordered", lambda *a, order=order: list(order))
            judged = quality.apply_rules(df).collect()
            verdicts.add(frozenset(r.doc_id for r in judged if r.rejected_by is None))
            if order is quality.RULES:
                assert all(r.n_repeat_words == r.n_symbols == r.n_lines == 0 for r in judged if r.rejected_by == "few_words")
    assert len(verdicts) == 1
    with pytest.MonkeyPatch.context() as m:  # positions that do not fit are compared by words
        m.setattr(quality, "POSITION_BITS", 2)
        for r in quality.quality_query(df).collect():
            assert r.n_repeat_words == brute.quality(dict(rows)[r.doc_id])[4]
