"""Repeated passages by enhanced suffix arrays.

`repeat_groups` is the method: suffixes are sorted, neighbours' common prefixes make the LCP array, and one scan with a
stack visits the tree of LCP intervals. An interval whose occurrences have different bytes in front (or start a
stretch) cannot be extended to the left, so it is a maximal repeat; it is returned with all its occurrences, not just
neighbours.

`covered_spans` runs it over a corpus. Every LENGTH-byte window belongs to the smallest hash among its GRAM-byte grams,
which depends on the window alone; consecutive windows of one gram are one stretch, so equal windows meet under one
key and a stretch stands for many windows. The keys are handled in PASSES (or more, so that a pass has MOST_PARTITIONS at
most), one after another, which divides the disk that the stretches take on their way. In a pass, tasks
  1. cut documents into stretches; of equal stretches seen in one block only that of the smallest document goes on (the
     others are covered by it; their bytes are compared); stretches go out packed, a compressed row for each partition
     and FLUSH_BYTES;
  2. read a partition (PARTITION_BYTES or less before compression, by bytes measured beforehand), keep its rows packed by
     bucket (about BUCKET_BYTES) and take one bucket at a time: keys of one document are dropped; equal stretches become
     one that stands for all; the suffixes of these at windows that come twice are sorted and scanned, and each occurrence
     in a document that is not the interval's smallest is covered;
  3. send the merged spans on, a packed row for each task and group of documents, where they are put together.
A gram that holds more than 1 / HOT_SHARE of a sample's stretches is hot: its windows are sent under their own hashes
instead, so that a passage or line found everywhere does not fill one bucket (its equal windows fold inside each block).
The sample only chooses the route; either way every window is compared.

`remove_repeats` joins the spans to the documents and cuts them.

Defined cases: a null or empty text, or one under LENGTH bytes, loses nothing; documents of one doc_id never remove
each other's bytes (rows of one doc_id with different texts are told apart by `variant`, a hash of the text); rows of null doc_id lose and
remove nothing; very long texts are cut in pieces that overlap by a window; an empty table gives an empty table; extra columns, whatever their names, are not
carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialised, released

LENGTH = 50
GRAM = 16
MOST_WINDOWS = 64
BLOCK_BYTES = 2 << 20
SAMPLE_DOCS = 4000
HOT_SHARE = 1000
PASSES = 2
SPREAD = 4  # a byte of text is in fewer than four stretches, on average
PARTITION_BYTES = 64 << 20  # what a task keeps compressed; more on larger executors
MOST_PARTITIONS = 20_000  # of a pass; beyond, there are more passes
BUCKET_BYTES = 4 << 20
FLUSH_BYTES = 16 << 20
FLUSH_SPANS = 1 << 18
EXPAND = 1 << 18
DIVERSE = -1
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), in place."""
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[: len(x) - k] | (x[k:] << _U(8 * k))
    return x


def _gram_hashes(eights: np.ndarray) -> np.ndarray:
    x = eights[:-8] * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x += eights[8:]
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xC2B2AE3D27D4EB4F)  # its upper bits, which decide the smallest, depend on all 16 bytes
    return x


def _window_hashes(eights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each position of `at`."""
    h = np.zeros(len(at), dtype=np.uint64)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h = _mixed((h + _U(0x9E3779B97F4A7C15)) * _U(0xC2B2AE3D27D4EB4F) ^ eights[at + k])
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span, m = 1, x
    while 2 * span <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return m if span == w else np.minimum(m[: len(x) - w + 1], m[w - span :])


def _true(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(a)


def _intervals(stretches: list[bytes], keep: np.ndarray, rank: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(own, offset, length, low, high, smallest): the suffix array at `keep`, and its left-diverse LCP intervals.

    own and offset are the stretch and the place of each suffix, in order; an interval holds the suffixes low..high.
    A stretch that stands for several equal ones (times > 1) repeats by itself: its first suffix is an interval too.
    """
    n = np.array([len(s) for s in stretches], dtype=np.int64)
    buf = np.frombuffer(b"".join(stretches), dtype=np.uint8)
    first = np.cumsum(n) - n
    own = np.searchsorted(first, keep, side="right") - 1
    while (n[own] == 0).any():  # empty stretches share a start with the next
        own = own + (n[own] == 0)
    left_len = first[own] + n[own] - keep
    wide = int(left_len.max())
    padded = np.concatenate([buf, np.zeros(wide, dtype=np.uint8)])
    suffix = np.lib.stride_tricks.sliding_window_view(padded, wide)[keep].copy()
    suffix[np.arange(wide)[None, :] >= left_len[:, None]] = 0
    short = np.argsort(left_len, kind="stable")  # padding equals zero bytes: of suffixes equal but for that, the shorter comes first
    order = short[np.argsort(suffix[short].view(f"S{wide}").ravel(), kind="stable")]
    suffix, own, at, left_len = suffix[order], own[order], keep[order], left_len[order]
    differs = suffix[1:] != suffix[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    lcp = np.minimum(lcp, np.minimum(left_len[1:], left_len[:-1]))
    offset = at - first[own]
    before = np.where(offset > 0, buf[np.maximum(at - 1, 0)].astype(np.int64), DIVERSE)
    alone = (times[own] > 1) & (offset == 0) & (left_len >= least)
    found: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []  # open intervals: length, first place, smallest rank, byte in front or DIVERSE
    for i, (nxt, small, front, again) in enumerate(zip(lcp.tolist() + [0], rank[own].tolist(), before.tolist(), alone.tolist(), strict=True)):
        # the node that ends here, at first the suffix itself, is the last child of every interval deeper than nxt
        start = i
        if again:
            found.append((int(left_len[i]), i, i, small))
        while stack and stack[-1][0] > nxt:
            length, start, other, ahead = stack.pop()
            small, front = min(small, other), front if front == ahead else DIVERSE  # noqa: PLW2901
            if front == DIVERSE:
                found.append((length, start, i, small))
        if nxt < least:
            continue
        if stack and stack[-1][0] == nxt:
            top = stack[-1]
            top[2] = min(top[2], small)
            top[3] = front if front == top[3] else DIVERSE
        else:
            stack.append([nxt, start, small, front])
    length, low, high, smallest = np.array(found, dtype=np.int64).reshape(-1, 4).T
    return own, offset, length, low, high, smallest


def repeat_groups(stretches: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(length, stretch, offset, smallest stretch) of every maximal repeat of at least `least` bytes, with all its occurrences."""
    n = np.array([len(s) for s in stretches], dtype=np.int64)
    count = np.maximum(n - least + 1, 0)
    if count.sum() < 2:
        return
    keep = _places(count, np.cumsum(n) - n)
    own, offset, length, low, high, smallest = _intervals(stretches, keep, np.arange(len(n)), np.ones(len(n), dtype=np.int64), least)
    for k, a, z, small in zip(length.tolist(), low.tolist(), high.tolist(), smallest.tolist(), strict=True):
        yield k, own[a : z + 1], offset[a : z + 1], small


def _places(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (count[k] of them) for each k, end to end."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class _Packer:
    """Stretches of one pass, packed by partition.

    A stretch's route comes from its mixed key: the pass, the partition, and (of the upper half, which travels) the
    bucket within the partition. Stretches are held over many blocks, up to FLUSH_BYTES, so that a packed row stays long
    enough to compress however many partitions there are.
    """

    def __init__(self, partitions: int, hot: np.ndarray, part: int = 0, passes: int = 1):
        import zstandard

        self.partitions, self.hot, self.part, self.passes = partitions, hot, part, passes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def pieces(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, start, windows) of the stretches of documents that lie end to end in data."""
        eights = _eights(data)
        low = _sliding_min(_gram_hashes(eights), LENGTH - GRAM + 1)  # of the window from each position
        valid = np.zeros(len(low), dtype=bool)
        for b, n in zip(begins.tolist(), lengths.tolist(), strict=True):
            valid[b : max(b, b + n - LENGTH + 1)] = True
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
        new[begins[begins < len(low)]] = True
        run = _true(new)
        length = np.diff(np.append(run, len(low)))
        ok = valid[run]
        # a run may go on past the last window of its document
        ends = np.minimum(run + length, np.repeat(begins + np.maximum(lengths - LENGTH + 1, 0), 1)[np.searchsorted(begins, run, side="right") - 1])
        run, length = run[ok], (ends - run)[ok]
        many = -(-length // MOST_WINDOWS)
        if (many > 1).any():
            part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            total = np.repeat(length, many)
            run = np.repeat(run, many) + part * MOST_WINDOWS
            length = np.minimum(MOST_WINDOWS, total - part * MOST_WINDOWS)
        key = low[run]
        if len(self.hot) and (is_hot := np.isin(key, self.hot)).any():
            times = length[is_hot]
            alone = np.repeat(run[is_hot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            run, length, key = (np.concatenate(x) for x in ((run[~is_hot], alone), (length[~is_hot], np.ones(len(alone), dtype=length.dtype)), (key[~is_hot], _window_hashes(eights, alone))))
        return key, run, length, eights

    def add(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ids: np.ndarray, variants: np.ndarray, shifts: np.ndarray) -> bytes | None:
        """Takes a block in; returns the packed spans that are covered already."""
        if len(data) < LENGTH:
            return None
        key, run, length, eights = self.pieces(data, begins, lengths)
        route = _mixed(key ^ _U(0x5851F42D4C957F2D))
        if self.passes > 1:
            mine = route % _U(self.passes) == _U(self.part)
            route, run, length = route[mine], run[mine], length[mine]
        if not len(route):
            return None
        doc = np.searchsorted(begins, run, side="right") - 1
        doc = doc if not (lengths == 0).any() else _last_full(begins, lengths, run)
        tail = run + length + LENGTH - 1
        mark = _mixed(_window_hashes(eights, run) ^ (_window_hashes(eights, tail - LENGTH) * _U(3)) + length.astype(np.uint64))
        for k in range(LENGTH, MOST_WINDOWS, LENGTH):  # every byte between the first and the last window is in the mark too
            longer = _true(length > k)
            mark[longer] = _mixed(mark[longer] ^ _window_hashes(eights, run[longer] + k))
        # of equal stretches the smallest document's goes on
        order = np.lexsort((ids[doc], mark))
        route, run, length, doc, mark = route[order], run[order], length[order], doc[order], mark[order]
        same = np.zeros(len(route), dtype=bool)
        same[1:] = mark[1:] == mark[:-1]
        head = np.maximum.accumulate(np.where(~same, np.arange(len(route)), 0))
        text = data.tobytes()
        covered = same & (ids[doc] > ids[doc[head]])
        at, of, size = _true(covered), head[covered], length[covered] + LENGTH - 1
        covered[at] = [text[a : a + n] == text[b : b + n] for a, b, n in zip(run[at].tolist(), run[of].tolist(), size.tolist(), strict=True)]
        go = ~covered  # also a document's own second copy
        r, m, d = run[go], length[go], doc[go]
        body = np.empty(len(r), dtype=object)
        body[:] = [text[a:z] for a, z in zip(r.tolist(), (r + m + LENGTH - 1).tolist(), strict=True)]
        self.held.append((route[go], ids[d], r - begins[d] + shifts[d], m, variants[d], body))
        self.size += int((m + LENGTH - 1).sum())
        if not covered.any():
            return None
        d, r = doc[covered], run[covered]
        starts = r - begins[d] + shifts[d]
        return pack_spans(*_merge(ids[d], variants[d], starts, starts + length[covered] + LENGTH - 1))

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """(partition, payload) of all that is held."""
        if not self.held:
            return
        route, ids, starts, windows, variants, body = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        to = ((route >> _U(8)) % _U(self.partitions)).astype(np.int64)
        order = np.lexsort((route, to))
        cuts = np.searchsorted(to[order], np.arange(self.partitions + 1))
        for p in _true(np.diff(cuts)):
            rows = order[cuts[p] : cuts[p + 1]]
            yield int(p), _payload(self.zip, (route[rows] >> _U(32)).astype("<u4"), ids[rows], starts[rows], windows[rows], variants[rows], body[rows])


def _payload(zip_, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray, windows: np.ndarray, variants: np.ndarray, body: np.ndarray) -> bytes:
    parts = (keys.astype("<u4"), ids.astype("<i8"), starts.astype("<i8"), windows.astype("u1"), variants.astype("<i8"))
    return zip_.compress(len(keys).to_bytes(4, "little") + b"".join(_planes(x) for x in parts) + b"".join(body.tolist()))


def _last_full(begins: np.ndarray, lengths: np.ndarray, run: np.ndarray) -> np.ndarray:
    full = _true(lengths > 0)
    return full[np.searchsorted(begins[full], run, side="right") - 1]


def _planes(x: np.ndarray) -> bytes:
    """A column's bytes, all first bytes before all second ones (this compresses better)."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _columns(data: bytes) -> tuple[list[np.ndarray], int]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for kind in ("<u4", "<i8", "<i8", "u1", "<i8"):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out, at


def pack_spans(ids: np.ndarray, variants: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x, dtype="<i8").tobytes() for x in (ids, variants, starts, ends))


def _spans_of(data: bytes) -> np.ndarray:
    """ids, variants, starts, ends."""
    return np.frombuffer(data, "<i8").reshape(4, -1)


def _merge(ids: np.ndarray, variants: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans as maximal runs of each document."""
    order = np.lexsort((starts, variants, ids))
    ids, variants, starts, ends = ids[order], variants[order], starts[order], ends[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (variants[1:] != variants[:-1])
    group = np.cumsum(new) - 1
    far = int(ends.max(initial=0)) + 1
    reach = np.maximum.accumulate(ends + group * far) - group * far if len(ids) else ends
    new[1:] |= starts[1:] > reach[:-1]
    at = _true(new)
    last = np.append(at[1:], len(ids)) - 1 if len(at) else at
    return ids[at], variants[at], starts[at], reach[last]


class _Bucket:
    """Rows of payloads: columns and stretches."""

    def __init__(self, payloads: list[bytes]):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        columns, self.text = [], []
        for p in payloads:
            data = unzip.decompress(p)
            found, at = _columns(data)
            columns.append(found)
            ends = at + np.cumsum(found[3].astype(np.int64) + LENGTH - 1)
            self.text += [data[a:z] for a, z in zip([at, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        self.key, self.ids, self.starts, windows, variants = (np.concatenate(x) for x in zip(*columns, strict=True))
        self.windows, self.variants = windows.astype(np.int64), variants.astype(np.int64)


def split_payloads(payloads: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload): the rows of some payloads of a partition, by bucket."""
    import zstandard

    b = _Bucket(payloads)
    body = np.empty(len(b.text), dtype=object)
    body[:] = b.text
    to = b.key % np.uint32(buckets)
    zip_ = zstandard.ZstdCompressor(level=1)
    for k in range(buckets):
        rows = _true(to == k)
        if len(rows):
            yield k, _payload(zip_, b.key[rows], b.ids[rows], b.starts[rows], b.windows[rows], b.variants[rows], body[rows])


def solve_bucket(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """(ids, variants, starts, ends) of covered spans: all payloads of one bucket.

    Rows carry the upper half of their keys: keys that share it are looked at together, and only bytes decide.
    """
    b = _Bucket(payloads)
    order = np.argsort(b.key, kind="stable")
    key = b.key[order]
    new = np.append(True, key[1:] != key[:-1])
    at = _true(new)
    least, most = np.minimum.reduceat(b.ids[order], at), np.maximum.reduceat(b.ids[order], at)
    rows = order[np.repeat(least < most, np.diff(np.append(at, len(key))))]  # of keys seen in one document only, nothing is covered
    none = np.empty(0, dtype=np.int64)
    if not len(rows):
        return none, none, none, none
    # equal stretches are one, that stands for all of them
    known: dict[bytes, int] = {}
    name = np.array([known.setdefault(b.text[r], len(known)) for r in rows.tolist()], dtype=np.int64)
    texts = list(known)
    del known
    b.text = []
    by_name = np.argsort(name, kind="stable")
    rows = rows[by_name]
    times = np.bincount(name)
    begin = np.cumsum(times) - times
    small = np.minimum.reduceat(b.ids[rows], begin)
    spans = none, none, none, none
    for own, offset, length, low, high, smallest in _scans(texts, small, times):
        # rows that the suffixes of each interval stand for, some intervals at a time
        upto = np.append(0, np.cumsum(times[own]))
        weight = np.cumsum(upto[high + 1] - upto[low])
        for some in np.split(np.arange(len(low)), np.searchsorted(weight, np.arange(EXPAND, weight[-1] if len(weight) else 0, EXPAND))):
            count = high[some] - low[some] + 1
            place = _places(count, low[some])
            s = own[place]
            row = rows[_places(times[s], begin[s])]
            o, n, least = (np.repeat(x, times[s]) for x in (offset[place], np.repeat(length[some], count), np.repeat(smallest[some], count)))
            hit = b.ids[row] > least
            row, start = row[hit], b.starts[row[hit]] + o[hit]
            spans = _merge(*(np.concatenate(x) for x in zip(spans, (b.ids[row], b.variants[row], start, start + n[hit]), strict=True)))
    return spans


def _scans(texts: list[bytes], rank: np.ndarray, times: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
    """_intervals over those windows whose hash comes twice and over stretches that come twice; own counts texts.

    Parts hold about `most` places; windows of one hash are in one part, and so are all that two stretches share there.
    """
    n = np.array([len(s) for s in texts], dtype=np.int64)
    eights = _eights(np.frombuffer(b"".join(texts), dtype=np.uint8))
    first = np.cumsum(n) - n
    at = _places(n - LENGTH + 1, first)
    h = _window_hashes(eights, at)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice[np.cumsum(n - LENGTH + 1)[:-1][times[1:] > 1]] = True  # first windows of stretches that stand for several
    twice[:1] |= times[0] > 1
    keep, h = at[twice], h[twice]
    if not len(keep):
        return
    own = np.searchsorted(first, keep, side="right") - 1
    for part in _by_class(h, most):
        used, spot = np.unique(own[part], return_inverse=True)
        lens = n[used]
        moved = np.sort(keep[part] - first[used][spot] + (np.cumsum(lens) - lens)[spot])
        s, *rest = _intervals([texts[i] for i in used.tolist()], moved, rank[used], times[used], LENGTH)
        yield (used[s], *rest)


def _by_class(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Indexes in parts of about `size`, equal hashes together."""
    parts = max(1, -(-len(h) // size))
    which = (h % _U(parts)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    return np.split(order, np.searchsorted(which[order], np.arange(1, parts)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(data, begins, lengths, ids, variants, shifts) of pieces of documents, BLOCK_BYTES at most."""
    step = BLOCK_BYTES - LENGTH + 1
    for batch in batches:
        ids, variants, col = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        offsets = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        held: list[tuple[int, int, int, int]] = []  # (document, from, to, shift)
        size = 0

        def out(held: list[tuple[int, int, int, int]], data: np.ndarray = data, ids: np.ndarray = ids, variants: np.ndarray = variants) -> tuple[np.ndarray, ...]:
            k, a, z, s = np.array(held, dtype=np.int64).T
            n = z - a
            return np.concatenate([data[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)]), np.cumsum(n) - n, n, ids[k], variants[k], s

        for k in range(len(col)):
            a, z = int(offsets[k]), int(offsets[k + 1])
            for at in range(a, max(a + 1, z - LENGTH + 1), step):
                to = min(z, at + BLOCK_BYTES)
                if to - at < LENGTH:
                    continue
                if held and size + to - at > BLOCK_BYTES:
                    yield out(held)
                    held, size = [], 0
                held.append((k, at, to, at - a))
                size += to - at
        if held:
            yield out(held)


def _hot_keys(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Grams over 1 / HOT_SHARE of a bounded sample's stretches (at most HOT_SHARE of them); bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(1, np.empty(0, np.uint64))
        for data, begins, lengths, *_ in _blocks(batches):
            if len(data) >= LENGTH:
                key, count = np.unique(packer.pieces(data, begins, lengths)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "n"])

    docs = docs.select("id", "variant", "text")
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sample = docs.sample(min(1.0, SAMPLE_DOCS / max(n, 1)), seed=1) if n > SAMPLE_DOCS else docs
    counts = materialised(sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(16, total // HOT_SHARE)).select("key").toPandas()["key"].to_numpy()
    return found.astype(np.int64).view(np.uint64), size


def _by_document(ids: np.ndarray, variants: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, packed spans): merged spans by a hash of their document."""
    to = (_mixed(ids.astype("<i8").view("<u8") ^ variants.astype("<i8").view("<u8")) % _U(groups)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(groups + 1))
    for g in _true(np.diff(cuts)):
        rows = order[cuts[g] : cuts[g + 1]]
        yield int(g), pack_spans(ids[rows], variants[rows], starts[rows], ends[rows])


def _table(rows: list[tuple[int, bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring rows of equal number (they come sorted), one group at a time."""
    now, held = None, []
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if number != now and held:
                yield now, held
                held = []
            now = number
            held.append(payload.as_buffer().to_pybytes())
    if held:
        yield now, held


def _slots(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a number that Spark's hash partitioning sends there, so that no two share a task."""
    numbers = spark.range(32 * n + 64).select(F.col("id").cast("int").alias("v"))
    found = numbers.groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).toPandas()
    slots = np.arange(n)  # a partition that no number hits (very unlikely) shares a task
    slots[found["p"].to_numpy()] = found["v"].to_numpy()
    return slots


def _pass(docs: DataFrame, hot: np.ndarray, slots: np.ndarray, buckets: int, part: int, passes: int) -> DataFrame:
    """doc_group, spans (packed): the spans found by the keys of one pass."""
    partitions = len(slots)

    def sent(p: int, payload: bytes, settled: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slots[p]], pa.int32()), pa.array([settled]), pa.array([payload], pa.binary())], ["partition", "settled", "payload"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = _Packer(partitions, hot, part, passes), TaskContext.get().partitionId()
        for k, block in enumerate(_blocks(batches)):
            settled = packer.add(*block)
            if settled:
                yield sent((task + k) % partitions, settled, True)
            if packer.size >= FLUSH_BYTES:
                for p, payload in packer.packed():
                    yield sent(p, payload, False)
        for p, payload in packer.packed():
            yield sent(p, payload, False)
        released()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        size = waiting = 0
        coarse: list[bytes] = []
        held: dict[int, dict[int, list[bytes]]] = {}  # packed rows by partition and bucket: all that a task keeps

        def spread(partition: int) -> None:
            for k, p in split_payloads(coarse, buckets):
                held.setdefault(partition, {}).setdefault(k, []).append(p)

        def out() -> Iterator[pa.RecordBatch]:
            merged = _merge(*(np.concatenate(x) for x in zip(*found, strict=True)))
            for g, spans in _by_document(*merged, partitions):
                yield _table([(int(slots[g]), spans)], ["doc_group", "spans"])

        now = None
        for batch in batches:
            for partition, settled, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = payload.as_buffer().to_pybytes()
                if settled:
                    found.append(tuple(_spans_of(data)))
                    size += len(found[-1][0])
                    if size >= FLUSH_SPANS:
                        yield from out()
                        found, size = [], 0
                    continue
                if coarse and (partition != now or waiting >= FLUSH_BYTES // 8):
                    spread(now)
                    coarse, waiting = [], 0
                now = partition
                coarse.append(data)
                waiting += len(data)
        if coarse:
            spread(now)
            coarse = []
        for partition in list(held):
            mine = held.pop(partition)
            while mine:
                found.append(solve_bucket(mine.popitem()[1]))
                size += len(found[-1][0])
                if size >= FLUSH_SPANS:
                    yield from out()
                    found, size = [], 0
        if size:
            yield from out()
        released()

    packed = docs.select("id", "variant", "text").mapInArrow(cut, "partition int, settled boolean, payload binary")
    return packed.repartition(partitions, "partition").mapInArrow(solve, "doc_group int, spans binary")


def covered_spans(docs: DataFrame, bucket_bytes: int | None = None, passes: int | None = None) -> DataFrame:
    """id, variant, spans (int64 pairs): docs has id (long), variant (long) and text (binary), none null."""
    spark = docs.sparkSession
    hot, size = _hot_keys(docs)
    passes = passes or max(PASSES, -(-size * SPREAD // (MOST_PARTITIONS * PARTITION_BYTES)))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * SPREAD // (passes * PARTITION_BYTES)))
    buckets = max(1, -(-size * SPREAD // (passes * partitions * (bucket_bytes or BUCKET_BYTES))))
    slots = _slots(spark, partitions)
    found = [materialised(_pass(docs, hot, slots, buckets, k, passes), "spans") for k in range(passes)]
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionAll(more)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packed in _groups_of(batches):
            ids, variants, starts, ends = _merge(*(np.concatenate(x) for x in zip(*map(_spans_of, packed), strict=True)))
            at = _true(np.append(True, (ids[1:] != ids[:-1]) | (variants[1:] != variants[:-1])))
            both = np.column_stack([starts, ends]).astype("<i8")
            each = [both[a:z].tobytes() for a, z in zip(at.tolist(), np.append(at[1:], len(ids)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(variants[at]), pa.array(each, pa.binary())], ["id", "variant", "spans"])

    return spans.repartition(partitions, "doc_group").sortWithinPartitions("doc_group").mapInArrow(gather, "id long, variant long, spans binary")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, if keep, kept (the bytes left)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    ids = docs.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if ids.limit(1).count():
        rows = rows.join(ids.withColumn("twice", F.lit(True)), "id", "left")
        rows = rows.withColumn("variant", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("twice")
    else:
        rows = rows.withColumn("variant", F.lit(0).cast("long"))
    spans = covered_spans(rows.where("id IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(4 + keep)]
                for t, found in zip(b.column(1), b.column(2), strict=True):
                    data = t.as_py()
                    spans = np.frombuffer(found.as_py() or b"", "<i8")
                    edges = [0, *spans.tolist(), len(data)]
                    left = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if len(spans) else data
                    for c, v in zip(cols, (len(data), len(data) - len(left), len(spans) // 2, hashlib.sha256(left).hexdigest(), left), strict=keep):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=keep)]], [key, *names[: len(cols)]])
        released()

    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    joined = rows.join(spans, ["id", "variant"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)


def dedup_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, keep=False)
