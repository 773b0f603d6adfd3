"""Approximate nearest neighbours by multi-index hashing.

Codes: the vectors, less the sample's mean, on the sample's principal axes, turned by rotations that bring the sample
closest to the corners of the cube (iterative quantization); the signs are the bits. Two rotations give two bits for
each dimension. A code is split into substrings of about log2(rows of a block) bits, and each block of rows has one
index for each substring: the rows in order of its value.

By the pigeonhole principle a code within Hamming radius R = m * r + a of a query (m substrings, a < m) is within r
of it in one of the first a + 1 substrings or within r - 1 in one of the others, so that probing those neighbouring
substrings retrieves every code within R. What is retrieved is checked against R, and reranked by Euclidean distance of
the vectors in double precision. R is the smallest radius that holds the neighbours in the sample (in a larger table
neighbours are nearer, so the share it holds only grows); where a block has fewer than k codes within R, the radius is
raised there until it has k or all its rows.

Rows are dealt into blocks by hash and shuffled once; every query visits every block, where it leaves k rows at most.
Vectors without any structure (isotropic noise) have neighbours that are hardly nearer than the rest: there probing
retrieves most rows, whatever the index; on clustered vectors it retrieves few (see the tests and the README).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hashed_sample

#: The codes are fitted on at most SAMPLE rows of a dimension, those with the smallest hashes; RECALL is the share of the sample's neighbours that R must hold.
SAMPLE, RECALL, ROUNDS, MAX_BITS = 4096, 0.96, 25, 256
#: Rows of a block, which one task holds with its indexes; bits of a substring at most.
ROW_BLOCK, MOST_SUBSTRING = 16_384, 16
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def ball(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of so many bits in order of their distance from 0, and how many are within each distance."""
    v = np.arange(1 << bits)
    near = POPCOUNT[v & 255] + POPCOUNT[v >> 8]
    return v[np.argsort(near, kind="stable")], np.cumsum(np.bincount(near))


@dataclass
class Codebook:
    mean: np.ndarray
    turn: np.ndarray
    radius: int = 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def fit(x: np.ndarray, k: int, recall: float = RECALL, seed: int = 7) -> Codebook:
    """A codebook for vectors like the rows of x."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(axis=0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean) / max(1, len(x)))[1][:, ::-1]
    bits = min(MAX_BITS, -(-2 * dim // 8) * 8)
    turns = []
    while sum(t.shape[1] for t in turns) < bits:
        wide = min(dim, bits)
        p = (x - mean) @ axes[:, :wide]
        turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(p @ turn).T @ p)
            turn = (u @ v).T
        turns.append(axes[:, :wide] @ turn)
    book = Codebook(mean, np.concatenate(turns, axis=1)[:, :bits])
    asked = min(256, len(x))
    near, codes = min(k, max(1, len(x) - 1)), book.codes(x)
    far = []
    for i in range(asked):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        nearest = np.argpartition(d, near - 1)[:near] if near < len(d) else np.arange(len(d))
        far.append(POPCOUNT[codes[nearest] ^ codes[i]].sum(axis=1))
    book.radius = int(np.quantile(np.concatenate(far), recall, method="higher")) if far else bits
    return book


class Block:
    """The rows of one block with an index of their codes for each substring."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, book: Codebook) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.book = ids[order], x[order], book
        self.codes = book.codes(self.x)
        bits = 8 * self.codes.shape[1]
        width = min(MOST_SUBSTRING, max(4, int(np.log2(max(2, len(ids))))))
        self.cuts = np.linspace(0, bits, max(1, round(bits / width)) + 1).astype(int)  # where substrings begin and end
        self.balls = {w: ball(w) for w in set(np.diff(self.cuts).tolist())}
        own = self.substrings(self.codes)
        self.order = [np.argsort(c, kind="stable") for c in own.T]
        self.start = [np.searchsorted(c[o], np.arange((1 << int(w)) + 1)) for c, o, w in zip(own.T, self.order, np.diff(self.cuts), strict=True)]
        self.probed = self.asked = 0

    def substrings(self, codes: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(codes, axis=1).astype(np.int64)
        return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)], axis=1)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows with a code within the radius: all that the probed substrings hold, then checked."""
        own = self.substrings(code[None])[0]
        m, seen = len(own), np.zeros(len(self.ids), bool)
        r, a = divmod(radius, m)
        for j in range(m):
            width = int(self.cuts[j + 1] - self.cuts[j])
            reach = min(width, r if j <= a else r - 1)
            if reach < 0:
                continue
            masks, counts = self.balls[width]
            probes = masks[: counts[reach]] ^ own[j]
            first, last = self.start[j][probes], self.start[j][probes + 1]
            size = last - first
            # the rows of all probed values, one run after the other
            at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            seen[self.order[j][at]] = True
        found = np.flatnonzero(seen)
        self.probed, self.asked = self.probed + len(found), self.asked + 1
        return found[POPCOUNT[self.codes[found] ^ code].sum(axis=1, dtype=np.int64) <= radius]

    def nearest(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        code, radius = self.book.codes(q[None])[0], self.book.radius
        rows = int((self.ids != own).sum())
        while True:
            at = self.within(code, radius)
            at = at[self.ids[at] != own]
            if len(at) >= min(k, rows) or radius >= 8 * len(code):
                break
            radius = min(8 * len(code), radius + len(self.cuts) - 1)
        d = np.sqrt(((self.x[at] - q) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[at], d))[:k]
        return self.ids[at][best], d[best]


def valid(vector: Column) -> Column:
    """Not null, not empty, not zero, every component a finite number."""
    inf = F.lit(float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)) & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = ROW_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows of vectors that are found for each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Rows and queries without id take no part, nor do vectors that `valid` refuses; a query meets vectors of its own
    length only. A query's own row (the same id) is no candidate. Queries that share an id are one, with the smallest
    vector; rows that share an id are candidates each. Fewer than k candidates are all returned; no queries or no
    vectors give an empty table. Ties go to the smaller id. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & valid(F.col("v"))).withColumn("dim", F.size("v"))

    rows, asked = clean(vectors), clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    books, plan = {}, []
    n_rows = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    for dim in sorted(n_rows):
        got = hashed_sample(rows.where(F.col("dim") == dim).select("v", "id"), F.xxhash64("id", "v"), sample, n_rows[dim]).select("v").toPandas()
        books[dim] = fit(np.stack([np.asarray(v, np.float64) for v in got["v"]]), k)
        plan.append((dim, -(-n_rows[dim] // row_block)))
    sent = spark.sparkContext.broadcast(books)
    blocks = F.broadcast(spark.createDataFrame(plan, "dim int, blocks long"))

    left = rows.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), "blocks")).withColumn("side", F.lit(0))
    right = asked.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    columns = ["dim", "block", "side", "id", "v"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of dim, block and side: a block's vectors, then the queries, which are streamed."""
        at, ids, x, block = None, [], [], None
        for batch in batches:
            dims, numbers, sides, own = (batch.column(i).to_numpy() for i in range(4))
            flat, ends = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.cumsum(dims, dtype=np.int64)
            out: list[tuple[int, int, float]] = []
            cuts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (numbers[1:] != numbers[:-1]) | (sides[1:] != sides[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(dims)], strict=True):
                if at != (dims[lo], numbers[lo]):
                    at, ids, x, block = (dims[lo], numbers[lo]), [], [], None
                some = flat[ends[lo] - dims[lo] : ends[hi - 1]].reshape(hi - lo, -1)
                if sides[lo] == 0:
                    ids.append(own[lo:hi])
                    x.append(some)
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(x), sent.value[int(dims[lo])])
                if block is not None:
                    for q, v in zip(own[lo:hi].tolist(), some, strict=True):
                        out += [(q, i, d) for i, d in zip(*(c.tolist() for c in block.nearest(q, v, k)), strict=True)]
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "vec_id", "score"])

    fed = left.select(columns).union(right.select(columns)).repartition("dim", "block").sortWithinPartitions("dim", "block", "side")
    found = fed.mapInArrow(meet, "query_id long, vec_id long, score double")
    # each block leaves at most k rows for a query; the best k of those, cut to k in every task before the shuffle
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
