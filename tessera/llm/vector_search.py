"""Exact top-k search with vector-approximation files.

Vectors become whole numbers, floor(256 * x), and are stored once in the shared folder, in two tables:
  vectors  a row for each vector: its number, vec_id and components;
  cells    the approximation file, a row for each block of BLOCK vectors: a byte for each component, floor(x / step), with
           the least power of two as step for which the block's numbers fit a byte.
For a query q, a cell's corners bound the inner product: with lo = step * cell,
q.lo + (step - 1) * sum(negative q) <= q.x <= q.lo + (step - 1) * sum(positive q).

Of equal vectors only those go on that some query can get (`needed`).

  1. Scan. Groups of cell blocks of at most GROUP_BYTES meet every block of queries (both are tables; the driver and
     broadcasts have no part in it). A task holds one group's cells, keeps the k best lower bounds of each query and
     returns the vectors whose upper bound reaches the k-th; then the k-th best lower bound of all groups cuts these down.
  2. Read. The exact vectors of each query's k best upper bounds are joined and scored; then only those whose upper bound
     is not below the k-th exact score so far. No other exact vector is read after the file was written.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows of null vec_id;
of repeated query ids the smallest vector asks; a candidate of the query's own vec_id is never returned; repeated
candidates each count; ties go to the smaller vec_id; vectors of different lengths are padded with zeros; empty
vectors score 0; scores beyond a long are cut to its ends; fewer candidates than k give all; an empty table gives an
empty table; extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialised

K = 5
SCALE = 256
BLOCK = 4096
QUERIES = 256  # in a block
GROUP_BYTES = 32 << 20
EVERY = 50
_LONG = (1 << 63) - 1
_FAR = float(1 << 63)
VECTORS = "row long, id long, v binary"
CELLS = "block long, n int, width int, step double, rows binary, ids binary, codes binary"


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of the rows that take part, their whole-number vectors padded to one length, as float64)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.array([-1 if x is None else x for x in vectors.value_lengths().to_pylist()], dtype=np.int64)
    flat = vectors.flatten()
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    values = np.floor(SCALE * flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    n = np.maximum(lengths, 0)
    row = np.repeat(np.arange(len(vectors)), n)
    bad = np.zeros(len(vectors), dtype=bool)
    bad[row[nulls | ~np.isfinite(values)]] = True
    keep = np.flatnonzero((lengths >= 0) & ~bad)
    width = int(n[keep].max()) if len(keep) else 0
    out = np.zeros((len(vectors), width))
    ok = ~bad[row]
    col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[row[ok], col[ok]] = values[ok]
    return keep, out[keep]


def _exact(x: np.ndarray, q: np.ndarray) -> int:
    """The inner product as a whole number."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(x)) < 2.0**53:
        return int(x @ q)
    return max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(x, q, strict=True))))


class Cells:
    """The approximation of a block of vectors."""

    def __init__(self, step: float, codes: np.ndarray):
        self.step, self.codes = step, codes

    @staticmethod
    def of(x: np.ndarray) -> Cells:
        most = max(x.max(initial=0), -x.min(initial=0) - 1)
        step = 2.0 ** max(0, np.ceil(np.log2((most + 1) / 128))) if most >= 0 else 1.0
        return Cells(step, np.floor(x / step).astype(np.int8))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds, a row for each query, cut to the ends of a long as scores are."""
        width = max(q.shape[1], self.codes.shape[1])
        q, codes = _pad(q, width), _pad(self.codes, width)
        fine = np.abs(q).max(initial=0) < 2**24  # then the query's numbers are exact in 32 bits
        low = self.step * (q.astype(np.float32) @ codes.T.astype(np.float32) if fine else q @ codes.T.astype(np.float64)).astype(np.float64)
        mass = np.abs(q).sum(axis=1)[:, None]
        slack = (width + 4) * (1.2e-7 if fine else 2.3e-16) * 128 * self.step * mass + 0.5  # more than the sums' rounding
        up = (self.step - 1) * np.maximum(q, 0).sum(axis=1)[:, None]
        down = (self.step - 1) * np.minimum(q, 0).sum(axis=1)[:, None]
        with np.errstate(invalid="ignore"):
            upper, lower = low + up + slack, low + down - slack
        unsure = ~(np.isfinite(upper) & np.isfinite(lower))
        upper[unsure], lower[unsure] = _FAR, -_FAR
        return np.clip(upper, -_FAR, _FAR), np.clip(lower, -_FAR, _FAR)


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def needed(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors, those that some query can get: k rows of each of the k + 1 smallest ids (one may be the query's own).

    Both limits are applied before the shuffle too, so a vector that a third of all rows hold meets as few rows.
    """
    copies = F.row_number().over(Window.partitionBy("v", "id").orderBy("row"))
    vectors = vectors.withColumn("r", copies).where(F.col("r") <= k)
    names = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    return vectors.withColumn("r", names).where(F.col("r") <= k + 1).drop("r")


def stored(rows: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, cells) of rows id, v: written once. k: only vectors that are needed for k results."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                keep, x = whole(b.column(1))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(keep))), b.column(0).take(pa.array(keep)), pa.array([v.tobytes() for v in x], pa.binary())], ["row", "id", "v"])
                    row += len(keep)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = _matrix(b.column(2).to_pylist())
                c = Cells.of(x)
                packed = (b.column(0).to_numpy().astype("<i8").tobytes(), b.column(1).to_numpy().astype("<i8").tobytes(), c.codes.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([c.step]), *(pa.array([p], pa.binary()) for p in packed)],
                    ["block", "n", "width", "step", "rows", "ids", "codes"])
                block += 1

    kept = materialised(rows.mapInArrow(vectors, VECTORS), "vectors")
    if k is not None:
        kept = materialised(needed(kept, k), "needed")
    return kept, materialised(kept.mapInArrow(cells, CELLS), "cells")


def _matrix(packed: list[bytes]) -> np.ndarray:
    """Vectors of any lengths, padded with zeros."""
    found = [np.frombuffer(p, "<f8") for p in packed]
    out = np.zeros((len(found), max(map(len, found), default=0)))
    for k, v in enumerate(found):
        out[k, : len(v)] = v
    return out


class Scan:
    """The cells of one group, and what of them may be among the k best of queries."""

    def __init__(self, k: int):
        self.k, self.blocks = k, []

    def add(self, n: int, width: int, step: float, rows: bytes, ids: bytes, codes: bytes) -> None:
        self.blocks.append((Cells(step, np.frombuffer(codes, np.int8).reshape(n, width)), np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")))

    def candidates(self, q: np.ndarray, qid: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, row, vec_id, upper, lower): all whose upper bound reaches the k-th best lower bound of the group."""
        best = np.full((len(q), self.k), -np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        for cells, rows, ids in self.blocks:
            upper, lower = cells.bounds(q)
            own = ids[None, :] == qid[:, None]  # never returned, so they must not raise the floor
            upper[own] = lower[own] = -np.inf
            best = -np.partition(-np.hstack([best, lower]), self.k - 1, axis=1)[:, : self.k]
            at, of = np.nonzero((upper >= best.min(axis=1)[:, None]) & ~own)
            found.append((at, rows[of], ids[of], upper[at, of], lower[at, of]))
        at, rows, ids, upper, lower = (np.concatenate(x) for x in zip(*found, strict=True))
        fine = upper >= best.min(axis=1)[at]
        return qid[at[fine]], rows[fine], ids[fine], upper[fine], lower[fine]


def scan(cells: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, row, id, upper, lower; queries: query_id, q (packed)."""
    spark = cells.sparkSession
    size = cells.agg(F.coalesce(F.sum(F.col("n").cast("long") * F.col("width")), F.lit(0))).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    groups = min(groups, max(1, cells.count()))
    many = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // QUERIES))))
    asked = queries.groupBy(many.alias("block")).agg(F.sort_array(F.collect_list(F.struct("query_id", "q"))).alias("asked"))  # about QUERIES of them
    cell = cells.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    cell = cell.select("group", F.lit(0).alias("kind"), *[c.split()[0] for c in CELLS.split(", ")[1:]], F.lit(None).cast("array<struct<query_id:long,q:binary>>").alias("asked"))
    each = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    each = each.select("group", F.lit(1).alias("kind"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CELLS.split(", ")[1:]], "asked")
    both = cell.unionAll(each).repartition(groups, "group").sortWithinPartitions("group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Scan(k)
        for batch in batches:
            for i in range(batch.num_rows):
                group, kind, *cell = (batch.column(j)[i].as_py() for j in range(8))
                if group != now:
                    now, held = group, Scan(k)
                if kind == 0:
                    held.add(*cell)
                elif held.blocks:
                    asked = batch.column(8)[i].as_py()
                    found = held.candidates(_matrix([x["q"] for x in asked]), np.array([x["query_id"] for x in asked], dtype=np.int64))
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "row", "id", "upper", "lower"])

    return both.mapInArrow(run, "query_id long, row long, id long, upper double, lower double")


def read(chosen: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """chosen (query_id, row, id) with the exact score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for v, q in zip(b.column(3), b.column(4), strict=True):
                pair = _matrix([v.as_py(), q.as_py()])
                scores.append(_exact(pair[0], pair[1]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(scores, pa.int64())], ["query_id", "row", "id", "score"])

    both = chosen.select("query_id", "row", "id").join(vectors.select("row", "v"), "row").join(queries, "query_id")
    return both.select("query_id", "row", "id", "v", "q").mapInArrow(run, "query_id long, row long, id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score."""
    pick = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    vectors, cells = stored(pick(candidates), k)
    good = pick(queries).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).groupBy("id").agg(F.min("v").alias("v"))
    asked, _ = stored(good)
    asked = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = scan(cells, asked, k)
    by = Window.partitionBy("query_id")
    order = by.orderBy(F.desc("lower"))
    floors = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("lower").alias("floor"))
    near = materialised(near.join(floors, "query_id", "left").where("floor IS NULL OR upper >= floor").drop("floor"), "near")
    # a query may have any number of candidates, so they are never gathered: limits apply before the shuffles, the rest are joins
    nearest = near.withColumn("r", F.row_number().over(by.orderBy(F.desc("upper"), "row"))).where(F.col("r") <= k)
    nearest = materialised(nearest.drop("r"), "nearest")
    first = materialised(read(nearest, vectors, asked), "first")
    last = nearest.groupBy("query_id").agg(F.min(F.struct("upper", (-F.col("row")).alias("row"))).alias("last"))
    sure = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).join(last, "query_id")
    beyond = F.struct("upper", (-F.col("row")).alias("row")) < F.col("last")
    left = near.join(sure, "query_id").where(beyond & ((F.col("n") < k) | (F.col("upper") >= F.col("kth"))))
    found = first.unionAll(read(left, vectors, asked))
    rank = F.row_number().over(by.orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def search_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.where(F.col("vec_id") % EVERY == 0))


SEARCH_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
