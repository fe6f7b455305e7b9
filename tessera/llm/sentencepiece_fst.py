"""SentencePiece encoding and decoding as a weighted finite-state transducer.

`Model.load` reads a model file (protocol buffer). `Transducer` compiles it:
  N  normaliser: a transducer of three states (start, in a word, after a space) with an arc for a space and one for any
     other character: dummy prefix, white-space escape, removal of extra white space (as the model's flags say);
  L  lexicon: a trie of pieces, each accepting path emitting the piece's id at the piece's weight;
  B  byte fallback: a loop of 256 arcs, one for each byte, that a character without piece goes through byte by byte, at a
     weight above any piece's; without byte fallback one arc to the unknown id;
  G  only for BPE models: an acceptor over pairs of neighbouring pieces, of weight 0 where the model's merges leave the
     pair as it is and infinite elsewhere. A sequence of pieces is the model's own exactly if all its pairs are, so the
     path of finite weight is the model's encoding, and so is the best path to each place: one finite path leads there.
     Unigram models weigh pieces by their negative score instead, and many paths are finite.
An input is composed with N, L, B and G from left to right, and the path of least weight (tropical semiring) is read off.

Neither model kind joins a character other than the escape mark to a following mark (no piece does), and none joins a
character that has no piece; so words and the parts between such characters are composed by themselves, and a worker
keeps the answers of the last MEMO short ones. Runs of several marks in a BPE model are the one exception to G: their
pieces have equal scores, which pairs cannot tell apart, so they are merged by a heap of neighbours.

Defined cases: a null or empty text has no ids and decodes to ''; very long texts go word by word, and time is linear in a
word's length (a run of n spaces takes n log n); repeated rows give equal ids; a text holding the escape mark itself
decodes with spaces in its place; an empty table gives an empty table; extra columns, whatever their names, are not
carried. Charmap normalisers are refused when the model is loaded.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # where no path is given and MODEL_CONF is unset
MODEL_CONF = "spark.tessera.sentencepiece.model"
MEMO, SHORT = 3 << 18, 64
START, WORD, SPACE = 0, 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = data[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + size]
        i += size


@dataclass(frozen=True)
class Model:
    """pieces: (text, score, type) by id."""

    pieces: tuple[tuple[str, float, int], ...]
    bpe: bool
    byte_fallback: bool
    dummy_prefix: bool
    squeeze: bool

    @staticmethod
    def load(path: str) -> Model:
        with open(path, "rb") as f:
            return Model.parse(f.read())

    @staticmethod
    def parse(data: bytes) -> Model:
        pieces, trainer, norm = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                d = dict(_fields(value))
                pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2):
            raise ValueError("this model's normaliser has a character map, which is not supported")
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        return Model(tuple(pieces), trainer.get(3, 1) == 2, bool(trainer.get(35, 0)), bool(norm.get(3, 1)), bool(norm.get(4, 1)))


class _Memo(dict):
    """Answers by input: at most MEMO, in two halves of which the older goes, so that frequent inputs stay."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if isinstance(key, str) and len(key) > SHORT:  # long ones are not kept, so the memory is bounded
                return found
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def normaliser(dummy_prefix: bool, squeeze: bool) -> dict[tuple[int, bool], tuple[str, bool, int]]:
    """N: (state, whether the character is a space) -> (what is put out, whether the character follows, next state).

    A space that is put out only if a word follows waits in the state SPACE.
    """
    first = MARK if dummy_prefix else ""
    if squeeze:
        return {
            (START, True): ("", False, START), (START, False): (first, True, WORD),
            (WORD, True): ("", False, SPACE), (WORD, False): ("", True, WORD),
            (SPACE, True): ("", False, SPACE), (SPACE, False): (MARK, True, WORD),
        }
    return {
        (START, True): (first + MARK, False, WORD), (START, False): (first, True, WORD),
        (WORD, True): (MARK, False, WORD), (WORD, False): ("", True, WORD),
    }


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER) and p}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        scores = [s for _, s, kind in model.pieces if kind == NORMAL]
        self.unknown_weight = 10.0 - min(scores, default=0.0)
        self.known = {c for p in self.ids for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on past the start of a word")
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.fits = _Memo(self._fits)
        self.trie: list = [None, {}]  # id of the piece that ends here, and what may follow
        for p, i in self.ids.items():  # reversed, as the composition looks back from a position
            if model.bpe and self._edged(p) is None:
                continue  # G has no path through a piece that the merges never build
            node = self.trie
            for c in reversed(p):
                node = node[1].setdefault(c, [None, {}])
            node[0] = i
        self.arcs = normaliser(model.dummy_prefix, model.squeeze)
        self.inner = _Memo(lambda s: self.compose(self.normalise(s, WORD)))  # a word, or a space and a word, further on
        self.outer = _Memo(lambda s: self.compose(self.normalise(s, START)))  # the first one
        lead = self.normalise(" x", WORD)[:-1]  # what N puts out for a space before a word
        self.spaced = _Memo(lambda s: self.compose(lead + s if s else self.normalise(" ", WORD)))  # a word after one space
        self.composed = _Memo(self.compose)
        self.out = [self._surface(i) for i in range(len(model.pieces))]

    def normalise(self, text: str, state: int = START) -> str:
        """The input composed with N."""
        if " " not in text:  # all arcs of a word but the first put out what they read
            return self.arcs[state, False][0] + text if text else ""
        out = []
        for part in re.findall(" |[^ ]+", text):
            ahead, follows, state = self.arcs[state, part == " "]
            out.append(ahead + part if follows else ahead)
        return "".join(out)

    def merge(self, text: str, until: int = 1) -> list[str]:
        """The model's merges: the best-scored neighbours first, leftmost of equals, by a heap of neighbours."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        left, pieces, ids = len(parts), self.model.pieces, self.ids
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (made := ids.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (-pieces[made][1], k, parts[k] + parts[after[k]]))

        for k in range(len(parts) - 1):
            offer(k)
        while heap and left > until:
            _, k, piece = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] is None or nxt < 0 or parts[k] + parts[nxt] != piece:
                continue  # one of the two has changed since
            parts[k], parts[nxt] = piece, None
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            left -= 1
            offer(before[k])
            offer(k)
        return [p for p in parts if p is not None]

    def _edged(self, piece: str) -> tuple[list, list] | None:
        if piece not in self.edges:
            self.edges[piece] = self._edges(piece)
        return self.edges[piece]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """(right, left): the symbols at that edge while the merges build the piece, each with the rank of its making.

        None if the merges never build the piece. Pieces are ranked after the pieces they are made of, so a symbol is
        there from its own rank until that of the next.
        """
        if len(piece) == 1:
            return [(piece, -1.0)], [(piece, -1.0)]
        parts = self.merge(piece, until=2)
        if len(parts) != 2 or "".join(parts) not in self.ids or self.merge(piece) != [piece]:
            return None
        a, b = self._edged(parts[0]), self._edged(parts[1])
        if a is None or b is None:
            return None
        mine = (piece, -self.model.pieces[self.ids[piece]][1])
        return [*b[0], mine], [*a[1], mine]

    def _fits(self, pair: int) -> bool:
        """G: whether the merges leave the neighbours apart; pair: a's id times the number of pieces, plus b's.

        Walks through the times at which the symbols on both sides of the border change. The border is crossed if the
        two then there make a piece that ranks before the next change on the left, and not after that on the right (of
        equal ranks the leftmost goes first).
        """
        i, j, ids, pieces = 0, 0, self.ids, self.model.pieces
        a, b = divmod(pair, len(pieces))
        right, left = self._edged(pieces[a][0])[0], self._edged(pieces[b][0])[1]
        while True:
            made = ids.get(right[i][0] + left[j][0])
            next_a = right[i + 1][1] if i + 1 < len(right) else INFINITE
            next_b = left[j + 1][1] if j + 1 < len(left) else INFINITE
            if made is not None:
                rank = -pieces[made][1]
                if rank < next_a and rank <= next_b:
                    return False
            if next_a == next_b == INFINITE:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _fallback(self, c: str) -> list[int]:
        """B: the ids put out for a character without piece."""
        if self.model.byte_fallback:
            return [self.bytes[x] for x in c.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def compose(self, s: str) -> bytes:
        """Ids (int32) of the least-weight path for a normalised stretch."""
        if self.model.bpe and MARK in s[1:]:  # runs of marks: pieces of equal score, which pairs cannot tell apart
            ids: list[int] = []
            for part in re.findall(f"[{MARK}]+[^{MARK}]*|[^{MARK}]+", s):
                for p in self.merge(part):
                    ids += [self.ids[p]] if p in self.ids else self._fallback(p)
            return np.array(ids, "<i4").tobytes()
        return self._bpe_path(s) if self.model.bpe else self._path(s)

    def _bpe_path(self, s: str) -> bytes:
        """With G, one finite path leads to each place: the first arc that fits is its last one."""
        n, fits, size, trie = len(s), self.fits, len(self.model.pieces), self.trie
        last, back = [-1] * (n + 1), list(range(-1, n))  # the piece of the best arc into each place (-1: an arc of B), and its start
        for end in range(1, n + 1):
            node, start = trie, end
            while start:
                start -= 1
                node = node[1].get(s[start])
                if node is None:
                    break
                piece = node[0]
                if piece is not None:
                    before = last[start]
                    if before < 0 or fits[before * size + piece]:
                        last[end], back[end] = piece, start
                        break
        ids, at = [], n
        while at > 0:
            start = back[at]
            ids += [last[at]] if last[at] >= 0 else reversed(self._fallback(s[start:at]))
            at = start
        ids.reverse()
        return struct.pack(f"<{len(ids)}i", *ids)

    def _path(self, s: str) -> bytes:
        n, pieces = len(s), self.model.pieces
        weight = [0.0] + [INFINITE] * n
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # (piece or -1, start) of the best arc into each position
        for end in range(1, n + 1):
            node, start = self.trie, end
            while start > 0 and (node := node[1].get(s[start - 1])) is not None:
                start -= 1
                if (piece := node[0]) is not None and weight[start] - pieces[piece][1] < weight[end]:
                    weight[end], last[end] = weight[start] - pieces[piece][1], (piece, start)
            if last[end] is None or s[end - 1] not in self.ids:
                w = weight[end - 1] + self.unknown_weight  # the arcs of B
                if w < weight[end]:
                    weight[end], last[end] = w, (-1, end - 1)
        ids, at = [], n
        while at > 0:
            piece, start = last[at]
            ids += [piece] if piece >= 0 else reversed(self._fallback(s[start:at]))
            at = start
        ids.reverse()
        if not self.model.byte_fallback:  # neighbouring unknowns are one
            ids = [x for k, x in enumerate(ids) if not (k and x == self.unknown == ids[k - 1])]
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        out: list[bytes] = []
        if self.model.squeeze or MARK in text:
            return self._plain(self.normalise(text))
        lone = "\n" not in self.known
        memo = self.outer  # until something was read
        for k, line in enumerate(text.split("\n") if lone else [text]):
            if k:
                out.append(memo["\n"])
                memo = self.inner
            if not line:
                continue
            if "  " in line or line[-1:] == " " or line[:1] == " ":
                for run in re.findall(" *[^ ]+| +", line):
                    out.append(memo[run])
                    memo = self.inner
                continue
            first, *rest = line.split(" ")
            out.append(memo[first])
            memo = self.inner
            out += map(self.spaced.__getitem__, rest)
        return np.frombuffer(b"".join(out), "<i4")

    def _plain(self, s: str) -> np.ndarray:
        """Stretches of a normalised text, each a run of marks and what follows."""
        parts = re.findall(f"[{MARK}]+[^{MARK}]*|[^{MARK}]+", s)
        return np.frombuffer(b"".join(self.composed[p] for p in parts), "<i4")

    def _surface(self, i: int) -> bytes:
        p, _, kind = self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(p[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()

    def decode(self, ids) -> str:
        data = b"".join(map(self.out.__getitem__, ids))
        return (data[1:] if self.model.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _compiled(data: bytes) -> Transducer:
    return Transducer(Model.parse(data))


def _model_bytes(spark: SparkSession, path: str | None) -> bytes:
    """The model file, read on the driver: from the path given, or the one that the session's MODEL_CONF names."""
    with open(path or spark.conf.get(MODEL_CONF, MODEL), "rb") as f:
        return f.read()


def encode_table(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """key, n_tokens, ids, round_trip (the ids decode to the text). The model file's bytes travel with the job."""
    data = _model_bytes(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _compiled(data)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                found, same = [], []
                for x in b.column(1):
                    s = x.as_py() or ""
                    ids = t.encode(s)
                    found.append(ids)
                    same.append(t.decode(ids.tolist()) == s)
                ends = np.cumsum([0, *map(len, found)])
                arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), arrays, pa.array(same, pa.bool_())], [key, "n_tokens", "ids", "round_trip"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode_table(tokens: DataFrame, ids: str = "ids", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """key, text."""
    data = _model_bytes(tokens.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _compiled(data)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x.as_py() or []) for x in b.column(1)], pa.string())], [key, "text"])

    kind = dict(tokens.dtypes)[key]
    return tokens.select(key, F.col(ids).cast("array<int>").alias("i")).mapInArrow(run, f"`{key}` {kind}, text string")


def sentencepiece_query(docs: DataFrame) -> DataFrame:
    return encode_table(docs)
