"""Plain versions of what the operators must return."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs, length=50):
    """op1: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    docs = sorted((i, (t or "").encode()) for i, t in docs)
    first = {}
    for i, b in docs:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = set()
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.add((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fingerprints, distance=3):
    """{fingerprint: group number} of all fingerprints within the distance."""
    known = sorted(set(fingerprints))
    array, parent = np.array(known, dtype=np.uint64), list(range(len(known)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(known)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= distance):
            parent[root(i)] = root(i + 1 + int(j))
    return {x: root(i) for i, x in enumerate(known)}


def simhash(docs):
    """op2: (doc_id, fingerprint, component_id)."""
    prints = {i: fingerprint(t) for i, t in docs}
    group = components(prints.values())
    best = {}
    for i, f in prints.items():
        best[group[f]] = min(best.get(group[f], i), i)
    return {(i, f"{f:016x}", best[group[f]]) for i, f in prints.items()}


KINDS = (
    ("assign", re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    """op6: base spans, joined."""
    found = [(m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(x for _, _, x in sorted(found))


def quality(text):
    """op10: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    twice = {g for g in grams if grams.count(g) > 1}
    hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def top(vectors, k=5, every=50):
    """op5: (query_id, rank, vec_id, score)."""
    good = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in good.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def shingles(text, n=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def near_kept(rows):
    """The pipeline's near-duplicate stage: (doc_id, text) that stay, of rows with an id."""
    known = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [shingles(t) for _, t in known]
    parent = list(range(len(known)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(known):
        for j in range(i):
            if a == known[j][1] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    best = {}
    for i, (doc, t) in enumerate(known):
        key = (doc, hashlib.md5(t.encode()).digest())
        if root(i) not in best or key < best[root(i)][0]:
            best[root(i)] = (key, (doc, t))
    return {x for _, x in best.values()}


def masked(text, spans, mark="[SECRET]"):
    """text with (start, end) replaced, overlapping ones as one."""
    out, at = "", 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += text[at:s] + mark
        at = e
    return out + text[at:]
