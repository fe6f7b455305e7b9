"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tessera.llm import chat, html_extract, mixing, quality, secrets, sentencepiece_fst, simhash, suffix_dedup, vector_search, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed=1):
    """Texts with shared passages, copies, near copies, nulls, junk and one long text."""
    rng = random.Random(seed)
    shared = [passage(rng, 20) for _ in range(4)]
    texts = [None, "", "x", " \n\t ", "a" * 300, "a" * 120 + "b", "ab" * 100, passage(rng, 4000)]
    for _ in range(40):
        texts.append(" ".join(rng.choice([passage(rng, rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 30) :]]) for _ in range(3)))
    texts += texts[10:20]  # exact copies
    for t in texts[20:26]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [("word word word line\n" * 30), "A# B$ " * 60]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "en" if k % 3 else None, f"src{k % 5}" if k % 7 else None, None) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_repeat_groups():
    a, b, c = b"xx0123456789yy", b"zz0123456789yy", b"q0123456789"
    found = {(n, tuple(sorted(zip(s.tolist(), o.tolist(), strict=True)))) for n, s, o, _ in suffix_dedup.repeat_groups([a, b, c], 10)}
    assert found == {(12, ((0, 2), (1, 2))), (10, ((0, 2), (1, 2), (2, 1)))}


def test_repeat_groups_random():
    rng = random.Random(0)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        least = rng.randint(2, 5)
        want = {}
        for i, t in enumerate(texts):
            for p in range(len(t)):
                for n in range(least, len(t) - p + 1):
                    want.setdefault(t[p : p + n], []).append((i, p))
        maximal = {}
        for s, at in want.items():
            left = {texts[i][p - 1 : p] if p else i for i, p in at}
            right = {texts[i][p + len(s) : p + len(s) + 1] or (i, "end") for i, p in at}
            if len(at) > 1 and (len(left) > 1 or any(not p for _, p in at)) and (len(right) > 1 or any(p + len(s) == len(texts[i]) for i, p in at)):
                maximal[s] = sorted(at)
        found = {texts[s[0]][o[0] : o[0] + n]: sorted(zip(s.tolist(), o.tolist(), strict=True)) for n, s, o, _ in suffix_dedup.repeat_groups(texts, least)}
        assert found == maximal


@pytest.mark.parametrize("block,hot", [(4 << 20, 1000), (300, 1000), (4 << 20, 10**9)])
def test_suffix_dedup(spark, docs, monkeypatch, block, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    if hot > 10**6:  # every gram that comes more than twice takes the hot way
        monkeypatch.setattr(suffix_dedup, "max", lambda *a: 2 if a[:1] == (16,) else max(*a), raising=False)
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", hot)
    assert {tuple(r) for r in suffix_dedup.dedup_query(docs).collect()} == brute.repeats(pairs(docs))


def test_suffix_dedup_repeated_ids(spark):
    t = "0123456789" * 6
    rows = [(1, t), (1, t), (1, "other " + t), (2, "z" + t), (None, t)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_query(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (1, 66, 0), (2, 61, 60)]


@pytest.mark.parametrize("chunk,hot", [(2048, 1000), (2, 1000), (2048, 3)])
def test_simhash(docs, monkeypatch, chunk, hot):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, 6, chunk))
    monkeypatch.setattr(simhash, "HOT_SHARE", hot)
    assert {tuple(r) for r in simhash.simhash_query(docs).collect()} == brute.simhash(pairs(docs))


def test_simhash_hot(spark):
    """Two thirds of the rows share one fingerprint, with repeated rows, null texts and null ids."""
    text = "one two three four five six seven eight"
    rows = [(i, text if i % 3 else f"{i} own words {i * i} here {i + 1} and {i * 7} there") for i in range(5, 60)] + [(9, None), (7, text), (None, text), (None, None)]
    got = [tuple(r) for r in simhash.simhash_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = {f: c for _, f, c in brute.simhash([(i, t) for i, t in rows if i is not None and (i, t) != (9, None)] + [(9.5, None)])}
    assert len(got) == len(rows) and all(c == (want[f] if want[f] != 9.5 else 9) for _, f, c in got)
    assert simhash.simhash_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_links(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base for _ in range(20)}
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    for chunk in (2048, 3):
        group, parent = brute.components(prints), {x: x for x in prints}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in simhash.links(nodes, chunk=chunk).collect():
            a, b = a % (1 << 64), b % (1 << 64)  # noqa: PLW2901
            assert (a ^ b).bit_count() <= 3
            parent[root(a)] = root(b)
        assert len({root(x) for x in prints}) == len(set(group.values()))


def test_chat(spark):
    rows = [(1, 2, "bob", "hi"), (1, 1, "ann", "hé"), (1, 1, "ann", "hé"), (1, 0, "system", None), (2, 0, "system", "only"), (None, None, None, "x"), *[(3, t, "ab"[t % 2], "t") for t in range(700)]]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = chat.rotate(df, chunk=64)
    assert got.where("conv_id = 2").count() == 0 and got.where("conv_id IS NULL").count() == 1
    for r in chat.render(got).collect():
        parts = got.where(f"perspective = '{r.perspective}' AND conv_id <=> {'NULL' if r.conv_id is None else r.conv_id}").orderBy("seq").collect()
        assert [p.seq for p in parts] == list(range(1, len(parts) + 1))
        for p in parts:
            assert r.text[p.start : p.end] == p.segment
            if p.role == r.perspective:
                assert r.text[p.mask_start : p.mask_end].endswith("<|im_end|>") and "im_start" not in r.text[p.mask_start : p.mask_end]
    text = chat.render(got).where("conv_id = 1 AND perspective = 'bob'").first().text
    assert text == "<|im_start|>system\n<|im_end|>\n" + "<|im_start|>user name=ann\nhé<|im_end|>\n" * 2 + "<|im_start|>assistant\nhi<|im_end|>\n"


def test_warc(spark, tmp_path):
    long_ = "<p>" + "é" * 80
    rows = [(3, "http://a/\n", long_), (1, None, long_), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long_), (1, "v", long_)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(map(tuple, warc.warc_query(df).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), sha(t), "revisit" if i == 3 else "response", 1 if i == 3 else None) for i, _, t in rows]
    assert got == sorted(want, key=str)
    assert warc.warc_query(df.limit(0)).count() == 0


def test_warc_frames(spark, tmp_path):
    import zstandard

    payloads = [f"page {i} with common words in it".encode() * 20 for i in range(50)]
    dictionary = warc.train_dictionary(payloads)
    w = warc.Writer(dictionary)
    for i, p in enumerate(payloads):
        w.add(warc.record(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None))
    data = w.close()
    assert [b.split(b"\r\n\r\n", 1)[1] for _, b in warc.records(data)] == payloads
    (tmp_path / "a.warc.zst").write_bytes(data)
    assert warc.read_files(spark, str(tmp_path / "a.warc.zst")).count() == 50
    zipped = zstandard.ZstdCompressor().compress(dictionary)  # a dictionary that is itself compressed
    start = 8 + len(dictionary)
    again = data[:4] + len(zipped).to_bytes(4, "little") + zipped + data[start:]
    assert sum(1 for _ in warc.records(again)) == 50
    for bad in (data[:-3], data[: start + 20], data[:start] + b"junk" + data[start:], data[:start] + w.zip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nxx\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.records(bad))


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1050, None), (1100, [None] * 8), (1150, [float("nan")] * 8), (1200, [float("inf")] * 8), (None, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    want = brute.top([(r.vec_id, r.embedding) for r in df.collect()])
    assert {tuple(r) for r in vector_search.search_query(df).collect()} == want
    with pytest.MonkeyPatch.context() as m:  # many blocks, groups and query blocks
        m.setattr(vector_search, "BLOCK", 16)
        m.setattr(vector_search, "GROUP_BYTES", 300)
        m.setattr(vector_search, "QUERIES", 2)
        assert {tuple(r) for r in vector_search.top_k(df, df.where("vec_id % 50 = 0")).collect()} == want
    assert vector_search.search_query(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5, 2.0]), (2, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_search.search_query(few).orderBy("rank").collect()] == [(0, 1, 1, 256 * 128), (0, 2, 2, 0)]


def test_vector_cells_prune():
    rng = np.random.default_rng(3)
    x, q = np.floor(256 * rng.normal(0, 0.2, (3000, 32))), np.floor(256 * rng.normal(0, 0.2, (4, 32)))
    exact = q @ x.T
    for scale in (1, 3, 4097):
        upper, lower = vector_search.Cells.of(scale * x).bounds(q)
        assert (lower <= scale * exact).all() and (scale * exact <= upper).all()
    cells = vector_search.Scan(5)
    c = vector_search.Cells.of(x)
    cells.add(3000, 32, c.step, np.arange(3000).tobytes(), np.arange(3000).tobytes(), c.codes.tobytes())
    found = cells.candidates(q, np.array([-1, -2, -3, 7]))
    assert len(found[0]) < 4 * 3000 / 20  # few exact vectors are left to read
    for j, own in enumerate((-1, -2, -3, 7)):
        best = [i for i in np.argsort(-exact[j], kind="stable") if i != own][:5]
        assert set(best) <= set(found[1][found[0] == own].tolist()) and own not in found[1][found[0] == own]


def test_secrets(spark, docs):
    key = "Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6"
    texts = [None, "", "token: abcdefgh", "PassWord='short'", "é api_key=\"x.y-z/1234\" AKIAABCDEFGHIJKL12", "0" * 40, "deadbeef" * 8, f"see {key} here", "password=" + key, f"k {key}\n" * 3,
             "123e4567-e89b-12d3-a456-426614174000 some-long-words-joined-by-dashes-everywhere 12345678901234567890123456"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in secrets.secrets_query(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(brute.secrets(t).encode()).hexdigest()
    assert got[7].spans == f"entropy:4:{4 + len(key)}" and got[8].spans.startswith("assign:0:") and "entropy" not in got[8].spans
    assert got[10].spans == "" and got[5].n_hex == 1
    text = secrets.redact(df).where("doc_id = 9").first().text
    assert key not in text and text.count("[SECRET]") == 3
    assert {r.doc_id: r.base_sha256 for r in secrets.secrets_query(docs).collect()} == {i: hashlib.sha256(brute.secrets(t).encode()).hexdigest() for i, t in pairs(docs)}


def test_secrets_long_text(spark):
    """Many short runs around one of each kind: a text of 200,000 characters, in seconds."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghz0123AKI") for _ in range(rng.randint(1, 9))) for _ in range(34000)]
    text = " ".join([*words, "ab" * 20, "AKIA" + "X" * 14, "AKIAAKIA0", "AKIAAKIA" + "9" * 9, "f" * 31, "token=secret: abcdefgh"])
    r = secrets.secrets_query(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.base_sha256 == hashlib.sha256(brute.secrets(text).encode()).hexdigest() and (r.n_access, r.n_hex) == (2, 1)


def test_html():
    model = html_extract.default_model()
    held = html_extract.labelled_pages(60, 77)
    tree = html_extract.Tree()
    for p in held:
        html_extract.parse(p, tree)
    f = html_extract.forest(tree)
    p, _ = html_extract.marginals(f, model)
    runs = sorted(tree.text)
    assert ((p[runs] >= 0.5) == (f.label[runs] == 1)).mean() > 0.98
    page = "<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three.<p>Four <b>five</b>.<script>no()</script></article><footer>c</footer>"
    assert html_extract.extract([page, None, "", "<", "<p"], model) == ["A & B\n\nOne two three.\n\nFour five.", "", "", *html_extract.extract(["<", "<p"], model)]


def test_html_marginals():
    """Sum-product against adding up all labellings of a small tree."""
    rng = np.random.default_rng(0)
    tree = html_extract.Tree()
    html_extract.parse("<div class=ad><p>a b.</p>x<ul><li>q</li></ul></div><p>z", tree)
    f = html_extract.forest(tree)
    model = html_extract.Model(rng.normal(size=len(html_extract.FEATURES)), rng.normal(size=(html_extract.EDGE_KINDS, 2, 2)))
    unary = np.add.reduceat(model.weight[f.feature], f.begins)
    n, total, content = len(f.parent), 0.0, np.zeros(len(f.parent))
    for bits in range(1 << n):
        y = np.array([bits >> k & 1 for k in range(n)])
        w = np.exp(unary @ y + sum(model.pair[f.edge[k], y[f.parent[k]], y[k]] for k in range(1, n)))
        total += w
        content += w * y
    assert np.allclose(html_extract.marginals(f, model)[0], content / total)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Text here.</p></article>", 3), (2, None, None, 3)], "page_id long, url string, html string, text int")
    assert sorted(tuple(r) for r in html_extract.extract_query(df).collect()) == [(1, "u", "Text here.", 10), (2, None, "", 0)]


def fill(budget, children):
    """Water filling by whole steps, as a check on the closed form: (weight, cap) each."""
    got = [0.0] * len(children)
    open_ = [i for i, (w, cap) in enumerate(children) if w > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        step = min([left / total] + [(children[i][1] - got[i]) / children[i][0] for i in open_])
        for i in open_:
            got[i] += step * children[i][0]
        left -= step * total
        open_ = [i for i in open_ if children[i][1] - got[i] > 1e-9]
    return got


def test_mixing(spark, docs):
    tree = mixing.with_tree(docs)
    mix = mixing.Mix(weights={"domain": {"d0": 5, "d1": 1}, "lang": {"en": 3}}, share=(9, 10), max_epochs=2)
    leaves = [r.asDict() for r in mixing.leaf_budgets(tree, mix).collect()]
    total = sum(x["supply"] for x in leaves)
    assert sum(x["budget"] for x in leaves) == total * 9 // 10
    domains = sorted({x["_domain"] for x in leaves})
    weigh = [(mix.weights["domain"].get(d, 1), 2 * sum(x["supply"] for x in leaves if x["_domain"] == d)) for d in domains]
    for d, want in zip(domains, fill(total * 9 // 10, weigh), strict=True):
        assert abs(sum(x["budget"] for x in leaves if x["_domain"] == d) - want) <= 1
    taken = {}
    for r in mixing.select_prefix(tree, mixing.leaf_budgets(tree, mix), mix).collect():
        k = (r._domain, r._lang, r._source)
        taken[k] = taken.get(k, 0) + r.copies * r._tokens
    for x in leaves:
        k = (x["_domain"], x["_lang"], x["_source"])
        assert taken[k] <= x["budget"] <= 2 * x["supply"]
    few = {r.doc_id: r.copies for r in mixing.mixing_query(docs, mixing.Mix(buckets=2)).collect()}
    assert few == {r.doc_id: r.copies for r in mixing.mixing_query(docs, mixing.Mix(buckets=4096)).collect()}
    assert mixing.mixing_query(docs.limit(0)).count() == 0


def test_sentencepiece(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    t = sentencepiece_fst.Transducer(sentencepiece_fst.Model.load(sentencepiece_fst.MODEL))
    rng = random.Random(1)
    for _ in range(1500):
        s = "".join(rng.choice(["a", "e", "the", "in", " ", "   ", "\n", "é", "▁", "ß", "😀", "\t", "27", "ing", "\0x"]) for _ in range(rng.randint(0, 14)))
        assert t.encode(s).tolist() == sp.encode(s)
        assert t.decode(sp.encode(s)) == sp.decode(sp.encode(s))
    rows = {r.doc_id: r for r in sentencepiece_fst.sentencepiece_query(docs).collect()}
    for i, text in pairs(docs):
        assert rows[i].ids == sp.encode(text or "") and rows[i].round_trip and rows[i].n_tokens == len(rows[i].ids)
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode_table(sentencepiece_fst.sentencepiece_query(docs)).collect()}
    assert back == {i: text or "" for i, text in pairs(docs)}


def test_unigram_path():
    pieces = (("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -3.5, 1), ("▁a", -1.0, 1), ("ba", -9.0, 1))
    t = sentencepiece_fst.Transducer(sentencepiece_fst.Model(pieces, False, False, True, True))
    name = lambda s: [pieces[i][0] for i in t.encode(s)]
    assert name("ab") == ["▁a", "b"] and name(" aab ") == ["▁a", "ab"] and name("azzb") == ["▁a", "<unk>", "b"]


def test_quality(spark, docs):
    df = docs.withColumn("n_words", docs.n_chars).withColumn("kept", docs.n_chars)
    got = {r.doc_id: r for r in quality.quality_query(df).collect()}
    for i, text in pairs(docs):
        want = brute.quality(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {i for i, r in got.items() if r.kept}
    assert {r.doc_id for r in quality.quality_stage(docs).collect()} == kept
    assert quality.quality_query(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(corpus(2), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id for r in new.collect()} <= before
        if name == "simhash_dedup":
            assert {(r.doc_id, r.text or "") for r in new.collect()} == brute.near_kept(pairs(docs))
        if name != "sentencepiece":
            assert new.columns == docs.columns
        docs = new
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
