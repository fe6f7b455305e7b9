"""SimHash near-duplicates by pigeonhole blocks.

1. `fingerprints`: 64-bit SimHash of a text's word shingles (XXH64, seed 42; a bit is set if more than half the shingles
   set it), in Arrow batches.
2. Equal fingerprints are one node. `blocks` cuts the 64 bits into BLOCKS parts; two fingerprints that differ in at most
   DISTANCE bits agree on some choice of BLOCKS - DISTANCE parts, so they share one of its keys.
3. Within a key, fingerprints are compared by XOR and bit count. A key's links are returned as a spanning forest (at
   most one link per member), never as all pairs. Keys with more than `chunk` members are cut into parts, so no task
   holds an unbounded key. First each part meets the first one. Only where that leaves a key in more than one component,
   the members outside of its largest one meet the whole key, part by part (`_linked`): rows and links grow with a
   group of near copies, not with its square, and every pair that may still join two components is compared.
4. `components` finds each node's smallest doc_id over all links by hooking and pointer jumping, with a written table
   per round in the shared folder; before, `_contracted` makes the links about as few as the nodes.
5. Documents take their fingerprint's component. A fingerprint that holds more than 1 / HOT_SHARE of all rows is hot; the
   labels of those (fewer than HOT_SHARE rows, by counting) are broadcast, so its documents do not meet in one task.

`simhash_stage`, for the pipeline, finds texts of five-word Jaccard similarity 4 / 5 or more. A SimHash of 64 bits at such
a similarity differs in about ten bits, too many for blocks of plain bits; so the stage uses a wide fingerprint: the
distinct shingles are dealt into classes by their hash, about CLASS_LOAD to a class, and each of CLASSES classes gives a
64-bit block, the SimHash of its shingles. Texts that differ in fewer shingles than there are classes share a block for
certain (pigeonhole); at a similarity of 4 / 5 a class is untouched with a chance of at least 0.17, so all 32 are touched
in less than 0.3 % of pairs. Texts that share a block are compared by Hamming distance on a 128-bit SimHash of the whole
text (about 19 bits at 4 / 5; WIDE_DISTANCE leaves 3.7 standard deviations); then the texts of each cluster of such links
are compared whole, set with set, and only links of similarity 4 / 5 or more count.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other; fewer words than a
shingle give the whole sequence as one shingle; equal texts and repeated rows share a node; rows of null doc_id keep a
row, and their node's smallest other doc_id (null if there is none); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boxed, discard, materialised, released, text_or_empty, unboxed

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
CHUNK = 2048
#: A fingerprint with more than 1 / HOT_SHARE of the rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: The stage: words of a shingle, least Jaccard similarity, classes that give blocks, shingles of a class at most (about),
#: bits by which the two halves of the wide fingerprint may differ, bytes of text in a chunk of a cluster.
STAGE_SHINGLE = 5
SIMILARITY = (4, 5)
CLASSES = 32
CLASS_LOAD = 8
WIDE_DISTANCE = 34
CHUNK_BYTES = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(g, SEED) for g in grams], dtype="<u8")


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingles' XXH64, sorted."""
    return np.unique(_hashes(text, n))


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """SimHash as an unsigned 64-bit number."""
    return _majority(_hashes(text, n))


def _majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (long, the bits of the fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])
        b = None
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bit masks of every choice of blocks - distance parts."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks(nodes: DataFrame, n: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """mask, key, fp: a row for each mask; fingerprints that agree under a mask share (mask, key)."""
    keys = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(n, distance))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.mask", "k.key", "fp")


def _forest(rest: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of at most `distance` bits that connect what is connected: each unseen member is taken by one near to it."""
    links = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _joining(found: list[tuple[int, int]], comp: dict[int, int]) -> list[tuple[int, int]]:
    """The links that join two components which those before them have not joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in found:
        p, q = root(comp[a]), root(comp[b])
        if p != q:
            up[p] = q
            kept.append((a, b))
    return kept


def _ordered(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(rows: DataFrame, key: list[str], node: str, weight: Column, chunk: int, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b: links that connect what is connected by links within the keys. A written table.

    solve gets rows with i, j, part and comp and gives links among the rows of one key, i and j. A key whose weights
    add up to more than `chunk` is cut into parts. First each part meets part 0; then the rows of a key that are not in
    its largest component (by weight) meet all its rows, in pairs of parts. Rows of one component need not meet.
    """
    spark = rows.sparkSession
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64(node, *key), n).cast("int")
    sizes = rows.groupBy(*key).agg(F.sum(weight).alias("size"), F.count(F.lit(1)).alias("many")).where("many > 1")
    sizes = sizes.select(*key, parts(F.col("size")).alias("parts"))
    met = rows.join(sizes, key).withColumn("part", dealt(F.col("parts"))).withColumns({"i": F.lit(0), "comp": F.col(node)})
    last = F.col("parts") - 1
    met = met.withColumn("j", F.explode(F.when(F.col("part") == 0, F.sequence(F.least(F.lit(1), last), last)).otherwise(F.array("part")))).drop("parts")
    first = materialised(_ordered(solve(met)), "links")
    large = materialised(sizes.where("parts > 1").select(*key), "large")  # few rows; all sizes would be many files
    if not large.limit(1).count():
        discard(spark, large)
        return first
    ends = first.select(F.explode(F.array("a", "b")).alias(node)).distinct().withColumn("first", F.col(node))
    labels = components(ends, first, node)
    members = rows.join(large, key).join(labels, node, "left").withColumn("comp", F.coalesce("component", node)).drop("component")
    held = members.groupBy(*key, "comp").agg(F.sum(weight).alias("w"))
    mixed = held.groupBy(*key).agg(F.count(F.lit(1)).alias("comps"), F.sum("w").alias("size"), F.max(F.struct("w", "comp")).alias("main")).where("comps > 1")
    mixed = materialised(mixed.select(*key, F.col("main.comp").alias("main"), parts(F.col("size") - F.col("main.w")).alias("rest"), parts(F.col("main.w")).alias("parts")), "mixed")
    if mixed.limit(1).count():  # the rest has parts 0 to rest - 1, the largest component those after them
        inside = F.col("comp") == F.col("main")
        met = members.join(mixed, key).withColumn("part", F.when(inside, F.col("rest") + dealt(F.col("parts"))).otherwise(dealt(F.col("rest"))))
        others = F.sequence(F.lit(0), F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("parts")) - 1)
        pairs = F.transform(others, lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
        met = met.withColumn("p", F.explode(pairs)).withColumns({"i": F.col("p.i"), "j": F.col("p.j")}).drop("p", "main", "rest", "parts")
        both = materialised(first.unionAll(_ordered(solve(met))), "links")
        discard(spark, first)
        first = both
    for used in (large, labels, mixed):
        discard(spark, used)
    return first


def _meet(rows: DataFrame, key: list[str], values: list[str], solve: Callable[[np.ndarray], list[tuple[int, int]]], chunk: int) -> DataFrame:
    """a, b: links that `solve` finds among the rows of a key (in chunks). All columns are whole numbers, values[0] the node.

    solve gets i, j, part and the values of one group as a table.
    """
    group = [*key, "i", "j"]
    width = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(table: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if len(table):
                cut = np.flatnonzero((table[1:, :width] != table[:-1, :width]).any(axis=1)) + 1
                for one in np.split(table, cut):
                    if len(one) > 1:
                        links = solve(one[:, width - 2 : -1])
                        found += _joining(links, dict(zip(one[:, width + 1].tolist(), one[:, -1].tolist(), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if not (held[-1][-1, :width] != held[0][0, :width]).any():
                continue  # still the same group
            table = np.vstack(held)
            last = int(np.flatnonzero((table[:, :width] != table[-1, :width]).any(axis=1))[-1]) + 1
            yield out(table[:last])
            held = [table[last:]]
        if held:
            yield out(np.vstack(held))
        held, batch, table = [], None, None
        released()

    def within(met: DataFrame) -> DataFrame:
        met = met.repartition(*group).sortWithinPartitions(*group, "part", values[0])
        return met.select(*group, "part", *values, "comp").mapInArrow(run, "a long, b long")

    return _linked(rows, key, values[0], F.lit(1), chunk, within)


def links(nodes: DataFrame, distance: int = DISTANCE, n: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """a, b: links between different fingerprints; for every two within the distance, a path of links joins them."""

    def solve(group: np.ndarray) -> list[tuple[int, int]]:
        return [(_signed(x), _signed(y)) for x, y in _forest(group[:, 3].astype("<i8").view("<u8"), distance)]

    return _meet(blocks(nodes, n, distance), ["mask", "key"], ["fp"], solve, chunk)


def _contracted(edges: DataFrame) -> DataFrame:
    """a, b (a < b), a written table: no more links than edges (also a written table) has, that connect the same nodes.

    Each node keeps its link to the smallest of its smaller neighbours, which takes its links to the others; of equal
    links one stays. This goes on while a fourth of the links or more fall together: stars with many centres become one.
    """
    spark = edges.sparkSession
    now, written = edges, False
    many = now.count()
    while True:
        least = now.groupBy("b").agg(F.min("a").alias("m"))
        moved = now.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        nxt = materialised(moved.distinct(), "edges")
        if written:
            discard(spark, now)
        now, written, before, many = nxt, True, many, nxt.count()
        if 4 * many > 3 * before or not many:
            return now


def components(nodes: DataFrame, edges: DataFrame, node: str = "fp", label: str = "first") -> DataFrame:
    """node, component: the smallest label reachable from each node that has a link (a < b). Labels must not be null.

    Every round, each node takes the smallest label of itself and its neighbours, then that of the node which holds its
    label's pointer; the table is written after each round. It ends when nothing changes.
    """
    spark = nodes.sparkSession
    few = _contracted(edges)
    both = few.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = both.unionAll(both.select(F.col("y").alias("x"), F.col("x").alias("y")))
    linked = both.select(F.col("x").alias(node)).distinct()
    now = materialised(nodes.join(linked, node).select(node, F.struct(F.col(label).alias("l"), F.col(node).alias("n")).alias("best")), "labels")
    while True:
        near = both.join(now.withColumnRenamed(node, "y"), "y").groupBy(F.col("x").alias(node)).agg(F.min("best").alias("near"))
        step = now.join(near, node).select(node, "best", F.least("best", "near").alias("to"))
        jump = now.select(F.col(node).alias("via"), F.col("best").alias("far"))
        nxt = step.join(jump, F.col("to.n") == F.col("via")).select(node, F.least("to", "far").alias("best"), (F.least("to", "far") != F.col("best")).alias("moved"))
        nxt = materialised(nxt, "labels")  # moved is read only below
        moved = nxt.where("moved").limit(1).count()
        discard(spark, now)
        now = nxt
        if not moved:
            discard(spark, few)
            out = now.select(node, F.col("best.l").alias("component"))
            out._tessera_path = now._tessera_path  # for discard
            return out


def near_duplicates(docs: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    rows = materialised(fingerprints(docs, text), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = nodes.select("fp", F.coalesce("first", F.lit((1 << 63) - 1)).alias("first"))
    near = links(nodes.select("fp"), distance)
    found = components(named, near)
    discard(docs.sparkSession, near)
    best = nodes.join(found, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id"))
    best = best.withColumn("component_id", F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")))
    return _labelled(rows, materialised(best, "components"))


def _labelled(rows: DataFrame, best: DataFrame) -> DataFrame:
    """rows with their fingerprint's component. Rows of hot fingerprints stay where they are: those labels are sent to them."""
    hot = F.col("n") * HOT_SHARE > rows.count()
    sent = best.where(hot).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    split = rows.join(F.broadcast(sent), "fp", "left")
    cold = split.where("is_hot IS NULL").select("doc_id", "fp").join(best.where(~hot).select("fp", "component_id"), "fp")
    return split.where("is_hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionAll(cold.select("doc_id", "fp", "component_id"))


def simhash_query(docs: DataFrame) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def signature(text: str | None, n: int = STAGE_SHINGLE, classes: int = CLASSES, load: int = CLASS_LOAD) -> tuple[int, int, np.ndarray]:
    """(fingerprint's two halves, keys of its blocks) of the set of a text's shingles, for similarities of 4 / 5 and more."""
    h = shingle_set(text, n)
    halves = [_majority(h), _majority(_mixed(h * np.uint64(0x9E3779B97F4A7C15)))]
    if not len(h):
        return 0, 0, np.zeros(1, "<i8")
    to = _mixed(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
    keys = []
    # a text of similarity 4 / 5 has at most 5 / 4 of the shingles, so one of the two levels is shared
    for level in {max(classes, 1 << max(0, -(-m // load) - 1).bit_length()) for m in (len(h), len(h) * 5 // 4)}:
        which = to % np.uint64(level)
        some = np.flatnonzero(which < classes)
        some = some[np.argsort(which[some], kind="stable")]
        if len(some):
            begins = np.flatnonzero(np.append(True, which[some][1:] != which[some][:-1]))
            bits = np.unpackbits(h[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
            size = np.diff(np.append(begins, len(some)))
            block = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
            keys.append(_mixed(block ^ _mixed(which[some][begins] + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))))
    return _signed(halves[0]), _signed(halves[1]), np.concatenate(keys or [np.empty(0, "<u8")]).view("<i8")


def signatures(docs: DataFrame, text: str) -> DataFrame:
    """id, h (MD5 of the text), f0, f1, keys of docs' rows with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                found = [signature(t.as_py()) for t in b.column(2)]
                ends = np.cumsum([0, *(len(k) for _, _, k in found)])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([k for _, _, k in found])))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _, _ in found], pa.int64()), pa.array([y for _, y, _ in found], pa.int64()), keys], ["id", "h", "f0", "f1", "keys"])
        batch = b = found = keys = None
        released()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).where("id IS NOT NULL")
    return rows.select("id", F.unhex(F.md5("t")).alias("h"), "t").mapInArrow(run, "id long, h binary, f0 long, f1 long, keys array<long>")


def _grown(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected: each member that is reached takes those near to it among the unreached."""
    found, rest = [], np.arange(size)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(x, rest)
            found += [(x, int(y)) for y in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return found


def _like(group: np.ndarray, distance: int = WIDE_DISTANCE) -> list[tuple[int, int]]:
    """Links between nodes whose wide fingerprints differ in at most `distance` bits; group: i, j, part, node, two halves."""
    node, f0, f1 = group[:, 3], group[:, 4].astype("<i8").view("<u8"), group[:, 5].astype("<i8").view("<u8")
    near = lambda x, rest: np.bitwise_count(f0[rest] ^ f0[x]).astype(int) + np.bitwise_count(f1[rest] ^ f1[x]) <= distance
    return [(int(node[x]), int(node[y])) for x, y in _grown(len(node), near)]


def similar_links(sets: list[np.ndarray], share: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Links between sets (sorted, distinct) of a Jaccard similarity of at least share, as places in the list."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.empty(0, "<u8")])
    first = np.cumsum(size) - size

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        able = (share[0] * np.maximum(size[rest], size[x]) <= share[1] * np.minimum(size[rest], size[x])) & (size[rest] > 0)
        hit = np.zeros(len(rest), dtype=bool)
        hit[(size[rest] == 0) & (size[x] == 0)] = True
        some = rest[able]
        if len(some) and size[x]:
            count = size[some]
            begins = np.cumsum(count) - count
            at = np.arange(count.sum()) - np.repeat(begins, count) + np.repeat(first[some], count)
            spot = np.minimum(np.searchsorted(sets[x], flat[at]), size[x] - 1)
            both = np.add.reduceat((sets[x][spot] == flat[at]).astype(np.int64), begins)
            hit[able] = share[1] * both >= share[0] * (size[x] + count - both)
        return hit

    return _grown(len(sets), near)


def _verified(texts: DataFrame) -> DataFrame:
    """a, b: links between nodes of one cluster whose whole texts are similar. texts: cluster, n, t.

    Clusters of more than CHUNK_BYTES of text are cut into chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(comp: dict[int, int], sets: list[np.ndarray]) -> pa.RecordBatch:
            nodes = list(comp)
            found = _joining([(nodes[x], nodes[y]) for x, y in similar_links(sets)], comp)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        now, comp, sets = None, {}, []
        for batch in batches:
            for *group, n, c, t in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                if group != now and comp:
                    yield out(comp, sets)
                    comp, sets = {}, []
                now = group
                comp[n] = c
                sets.append(shingle_set(t.as_py(), STAGE_SHINGLE))
        if comp:
            yield out(comp, sets)
        comp, sets, batch, t = {}, [], None, None
        released()

    def within(met: DataFrame) -> DataFrame:
        met = met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "part", "n")
        return met.select("cluster", "i", "j", "n", "comp", "t").mapInArrow(run, "a long, b long")

    return _linked(texts, ["cluster"], "n", F.octet_length("t"), CHUNK_BYTES, within)


def similar_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """id, h, kept: every distinct text (MD5 h) with its smallest doc_id, and whether it stays.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is 4 / 5 or more; of the texts that
    links connect, the one with the smallest (id, h) stays.
    """
    spark = docs.sparkSession
    rows = materialised(signatures(docs, text), "signatures")
    firsts = rows.groupBy("h").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("f0", "f1", "keys")])
    nodes = materialised(firsts.withColumn("n", F.monotonically_increasing_id()), "nodes")  # written once, so n stays
    discard(spark, rows)
    members = nodes.select("n", "f0", "f1", F.explode("keys").alias("key"))
    near = _meet(members, ["key"], ["n", "f0", "f1"], _like, CHUNK)
    clusters = components(nodes.select("n", F.col("n").alias("first")), near, "n").select("n", F.col("component").alias("cluster"))
    discard(spark, near)
    at = nodes.select("n", "id", "h").join(clusters, "n")
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    texts = whole.where("id IS NOT NULL").withColumn("h", F.unhex(F.md5("t"))).join(at, ["id", "h"]).select("cluster", "n", "t")
    texts = materialised(texts.dropDuplicates(["n"]), "texts")
    same = _verified(texts)
    discard(spark, texts)
    named = nodes.select("n", F.struct("id", "h").alias("first"))
    found = components(named, same, "n")
    discard(spark, same)
    out = named.join(found, "n", "left").select("first.*", (F.col("component").isNull() | (F.col("component") == F.col("first"))).alias("kept"))
    return out


def simhash_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of texts of five-word Jaccard similarity 4 / 5 or more, one document stays, that of the smallest doc_id.

    Rows of one doc_id with different texts are judged apart; of rows that share doc_id and text one stays; rows without
    a doc_id cannot be told apart and stay. Columns pass through, whatever their names.
    """
    kept = similar_texts(docs).where("kept")
    rows = boxed(docs.where(F.col("doc_id").isNotNull()), id=F.col("doc_id").cast("long"), h=F.unhex(F.md5(text_or_empty())))
    first = rows.join(kept.select("id", "h"), ["id", "h"]).dropDuplicates(["id", "h"])
    return unboxed(first).unionAll(docs.where(F.col("doc_id").isNull()))
