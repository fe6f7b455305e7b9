"""The automata of the SentencePiece transducer, each alone, and long inputs."""

import random
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from tessera.llm import sentencepiece_fst as fst


@pytest.fixture(scope="module")
def shipped():
    return fst.Transducer(fst.Model.load(fst.MODEL))


def small(pieces, **flags):
    kinds = {"bpe": False, "byte_fallback": False, "dummy_prefix": True, "squeeze": True} | flags
    return fst.Transducer(fst.Model(tuple(pieces), **kinds))


def test_normaliser():
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1)]
    for text, plain, squeezed in (("", "", ""), ("a", "▁a", "▁a"), (" a  b ", "▁▁a▁▁b▁", "▁a▁b"), ("   ", "▁▁▁▁", ""), ("a b", "▁a▁b", "▁a▁b")):
        assert small(pieces, squeeze=False).normalise(text) == plain
        assert small(pieces).normalise(text) == squeezed
        assert small(pieces, dummy_prefix=False).normalise(text) == squeezed[1:]


def test_byte_fallback():
    pieces = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -1.0, 1), ("é", -2.0, 1)]
    t = small(pieces, byte_fallback=True)
    assert t.encode("é€").tolist() == [257, 258, *(1 + b for b in "€".encode())]
    assert t.decode(t.encode("é€ x")) == "é€ x"


def test_shortest_path_random():
    """Least weight over all cuts of a short text, by trying every cut."""
    rng = random.Random(2)
    for _ in range(60):
        words = {"".join(rng.choice("ab▁") if k == 0 else rng.choice("ab") for k in range(rng.randint(1, 4))) for _ in range(8)} | {"▁"}
        pieces = [("<unk>", 0.0, 2), *((w, -rng.uniform(1, 9), 1) for w in sorted(words))]
        t = small(pieces)
        s = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 8)))
        norm = t.normalise(s)
        best = {0: 0.0}
        for end in range(1, len(norm) + 1):
            ways = [best[a] - t.model.pieces[t.ids[norm[a:end]]][1] for a in range(end) if norm[a:end] in t.ids]
            ways += [best[end - 1] + t.unknown_weight] if norm[end - 1] not in t.ids else []
            best[end] = min(ways, default=float("inf"))
        got, at, weight = t.encode(s).tolist(), 0, 0.0
        for i in got:
            if i == t.unknown:
                while at < len(norm) and norm[at] not in t.ids:
                    at, weight = at + 1, weight + t.unknown_weight
            else:
                weight, at = weight - t.model.pieces[i][1], at + len(t.model.pieces[i][0])
        if float("inf") not in best.values() and got.count(0) <= 1:
            assert at == len(norm) and abs(weight - best[len(norm)]) < 1e-6


def test_runs_of_spaces(shipped):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=fst.MODEL)
    rng = random.Random(5)
    for n in [*range(40), 100, 257]:
        for s in (" " * n, "a" + " " * n, " " * n + "word", "x\n" + " " * n + "y" + " " * rng.randint(0, 20) + "\n" + " " * n):
            assert shipped.encode(s).tolist() == sp.encode(s)


def test_long_inputs(shipped):
    rng = random.Random(6)
    began = time.perf_counter()
    for s in (" " * 100_000, "a" + " " * 100_000 + "b", "".join(rng.choice("abcdefXYZ0189+/") for _ in range(300_000)), "ab" * 50_000, "€" * 50_000):
        assert shipped.decode(shipped.encode(s)) == s
        assert all(len(k) <= fst.SHORT for k in [*shipped.inner, *shipped.outer, *shipped.spaced])
    assert time.perf_counter() - began < 30


def test_tables(spark):
    df = spark.createDataFrame([(1, "some text", "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.n_tokens, r.round_trip) for r in fst.sentencepiece_query(df).collect())
    assert got[0][0] == 1 and got[1:] == [(2, 0, True)] * 2
    assert fst.sentencepiece_query(df.limit(0)).count() == 0
