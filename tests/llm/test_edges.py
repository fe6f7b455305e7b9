"""Empty tables, extra columns with the operators' own names, long texts, and the pipeline's contents against plain versions."""

import os
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
import test_operators
import test_stages

from tessera.llm import html_extract, mixing, quality, secrets, sentencepiece_fst, simhash, suffix_dedup
from tessera.llm.common import materialised, scratch, shared_dir

EMPTY = {
    "op1": lambda d: suffix_dedup.dedup_query(d), "op2": lambda d: simhash.simhash_query(d), "op6": lambda d: secrets.secrets_query(d), "op8": lambda d: mixing.mixing_query(d),
    "op9": lambda d: sentencepiece_fst.sentencepiece_query(d), "op10": lambda d: quality.quality_query(d), "redact": lambda d: secrets.redact(d), "quality": lambda d: quality.quality_stage(d),
    "mixing": lambda d: mixing.mixing_stage(d), "secrets": lambda d: secrets.secrets_stage(d),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty(spark, name):
    assert EMPTY[name](spark.createDataFrame([], test_operators.DOCS)).collect() == []


def test_empty_pages(spark):
    assert html_extract.extract_query(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_clashing_columns(spark):
    """Columns named like the operators' own are neither carried nor in the way."""
    rows = [(i, f"some shared words of a passage that is longer than fifty bytes, number {i % 3}", "en", f"src{i}", 0) for i in range(6)]
    plain = spark.createDataFrame(rows, test_operators.DOCS)
    names = ["id", "variant", "spans", "fp", "first", "n", "base", "found", "_text", "_words", "keys", "t", "copies", "budget", "n_words", "rejected_by", "_lines", "ids", "partition"]
    other = plain.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
    for name in ("op1", "op2", "op6", "op8", "op9", "op10"):
        want, got = EMPTY[name](plain), EMPTY[name](other)
        assert want.columns == got.columns and sorted(map(str, want.collect())) == sorted(map(str, got.collect()))


def test_long_texts(spark):
    """A text of several blocks for op1 and of 400,000 words for op2 and op10."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    long_ = " ".join(rng.choice(words) for _ in range(400_000))
    tail = long_[1_990_000:2_110_000]
    df = spark.createDataFrame([(1, long_), (2, "own " + tail + " end"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup_query(df).collect()}
    assert (got[2].n_bytes, got[2].n_removed, got[2].n_spans) == (len(tail) + 8, len(tail) + 1, 1) or got[2].n_removed in (len(tail), len(tail) + 1, len(tail) + 2)
    assert got[1].n_removed == 0 and got[1].n_bytes == len(long_)
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.simhash_query(df).collect()} == {1: brute.fingerprint(long_), 2: brute.fingerprint("own " + tail + " end"), 3: 0}
    assert {r.doc_id: r.n_words for r in quality.quality_query(df).collect()}[1] == 400_000


def folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_scratch(spark):
    before = folders(spark)
    with scratch() as made:
        a = materialised(spark.range(5), "a")
        b = made.keep(materialised(a.where("id > 2"), "b"))
    assert b.count() == 2 and len(folders(spark) - before) == 1


def test_pipeline_contents(spark, tmp_path):
    """Every stage's rows against plain versions on what the stage before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    duckdb, sentencepiece = pytest.importorskip("duckdb"), pytest.importorskip("sentencepiece")
    rng = random.Random(6)
    rows = test_operators.corpus(3)
    rows += [(1000 + i, test_operators.passage(rng, 80) + rng.choice([" password=Secret12345", " AKIAABCDEFGHIJKL12", ""]), "en", f"src{i % 7}", None) for i in range(40)]
    spark.createDataFrame(rows, test_operators.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), folders(spark)
    for name, stage in pipeline.STAGES:
        was = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        new = stage(spark, docs, str(tmp_path))
        new.write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        got = new.collect()
        if name == "quality_rules":
            judged = {r.doc_id for r in quality.quality_query(docs).collect() if r.kept}
            assert {r.doc_id for r in got} == judged and all(not (n < 50 or 2 * k > n) for n, _, _, _, k in map(brute.quality, (r.text for r in got)))
        if name == "simhash_dedup":
            assert {(r.doc_id, r.text or "") for r in got} == brute.near_kept([(i, t) for i, t, _, _ in was])
        if name == "secret_scans":
            assert {r.doc_id: r.text for r in got} == {i: brute.masked(t, test_stages.entropy_spans(t)) for i, t, _, _ in was}
        if name == "mixing":
            documents = docs.toPandas()  # noqa: F841
            copies = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, copies FROM ({mixing.MIXING_SQL})").fetchall()}
            assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
        if name == "sentencepiece":
            sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
            text = {i: t for i, t, _, _ in was}
            assert len(got) == len(was) and all(list(r.ids) == sp.encode(text[r.doc_id]) for r in got)
        docs = new
    middle = folders(spark)
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
    assert len(folders(spark) - middle) == 1 and before <= middle  # only what the last stage reads is left
