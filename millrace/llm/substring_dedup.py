"""Removal of repeated substrings by a sparse, hash-compared suffix sort.

Every byte that a string of `length` bytes covers is removed if that string also starts anywhere else. A suffix array
of all positions is not needed for that. Of each window of `length` bytes the smallest hash of its k-grams is the
anchor (prefix polynomial hashes give every k-gram's hash); equal windows have equal anchors at equal offsets. Windows
that follow each other with one anchor are a block.

Blocks are sorted by anchor and content. A block that stands twice is removed with all its windows; that is decided by
128 bits, the anchor's polynomial hash and an independent hash of the block's bytes. One that stands once, beside other
blocks of the same anchor, is compared with those that agree with it around the anchor as far as a common window must:
if its offset to the anchor is in one of SEGMENTS ranges, so many bytes before and after the anchor agree. Within these
groups the suffixes that start at the anchors and the reversed prefixes that end there are sorted by mergesort, where
prefix polynomial hashes and binary search give the common extension of two strings in logarithmic time and the bytes
themselves are then compared, so that a collision can't count. From the common extensions of neighbours follow the
windows that stand in several blocks. Groups of more than `most_blocks` count their windows' 128-bit hashes instead,
distributed.

Long texts are read in overlapping pieces: a window's anchor follows from its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended, bounded_join, materialise, mix, signed, sliced, sliding_min

LENGTH, GRAM, MOST_BLOCKS, SEGMENTS = 200, 50, 2048, 4
#: Bytes that are turned into arrays at once.
CHUNK = 1_000_000
#: Bytes of texts that are held as Python's objects at once.
SLICE = 8_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
REPEATED, PARTIAL, WITNESS = 1, 2, 4


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(max(n, CHUNK + 1024), BASE, np.uint64), np.full(max(n, CHUNK + 1024), UNBASE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


@dataclass
class Blocks:
    """Blocks of consecutive texts: text number, first and last window start, anchor (all from the text's start), hashes."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def blocks_of(texts: list[bytes], length: int, gram: int, powers: Powers) -> Blocks:
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    start = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    n, width = len(data), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return Blocks(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    up, down = powers.to(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    own = mix((prefix[gram:] - prefix[: n - gram + 1]) * down[: n - gram + 1])
    low = np.uint64(0xFFFFFFFF)
    at = (sliding_min((own & ~low) | np.arange(len(own), dtype=np.uint64), width) & low).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(start))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + length <= start[text + 1])
    if not len(inside):
        return Blocks(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    at, text = at[inside], text[inside]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first, last = inside[new], inside[np.r_[new[1:] - 1, len(inside) - 1]]
    at, text = at[new], text[new]
    digest, view = xxhash.xxh3_64_intdigest, memoryview(joined)
    content = np.fromiter((digest(view[a:b], c) for a, b, c in zip(first.tolist(), (last + length).tolist(), (at - first).tolist(), strict=True)), np.uint64, len(first))
    base = start[text]
    return Blocks(text, first - base, last - base, at - base, own[at], content)


def blocks_in(texts: list[bytes], length: int, gram: int, powers: Powers) -> Iterator[Blocks]:
    """The blocks of texts, for about CHUNK bytes at once. A longer text is cut into pieces that overlap by length - 1 bytes."""
    held: list[tuple[int, int, bytes]] = []  # text number, offset, bytes
    size = 0

    def done() -> Blocks:
        got = blocks_of([x[2] for x in held], length, gram, powers)
        number, offset = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)[got.text]
        return Blocks(number[got.text], got.first + offset, got.last + offset, got.at + offset, got.anchor, got.content)

    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), CHUNK):
            piece = t if len(t) <= CHUNK else t[lo : lo + CHUNK + length - 1]
            if held and size + len(piece) > CHUNK:
                yield done()
                held, size = [], 0
            held.append((i, lo, piece))
            size += len(piece)
            if len(t) <= CHUNK:
                break
    if held:
        yield done()


class Strings:
    """Strings with prefix polynomial hashes, compared in logarithmic time."""

    def __init__(self, strings: list[bytes], powers: Powers) -> None:
        self.strings, width = strings, max(map(len, strings))
        up, _ = powers.to(width + 1)
        padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
        hashes = np.zeros((len(strings), width + 1), np.uint64)
        np.cumsum((padded.astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=hashes[:, 1:])
        self.hashes = hashes

    def common(self, i: int, j: int) -> int:
        """Length of the longest common prefix: binary search on the hashes, then the bytes verify it."""
        a, b, x, y = self.strings[i], self.strings[j], self.hashes[i], self.hashes[j]
        low, high = 0, min(len(a), len(b))
        if x[high] == y[high] and a[:high] == b[:high]:
            return high
        while low < high:
            mid = (low + high + 1) // 2
            if x[mid] == y[mid]:
                low = mid
            else:
                high = mid - 1
        while a[:low] != b[:low]:  # a collision: too long by hash, the true end lies below
            low -= 1
        return low

    def order(self) -> tuple[list[int], np.ndarray]:
        """The strings in order (Python's sort is a mergesort), and the common prefixes of neighbours."""

        def compare(i: int, j: int) -> int:
            n = self.common(i, j)
            a, b = self.strings[i][n : n + 1], self.strings[j][n : n + 1]
            return -1 if a < b else a > b

        order = sorted(range(len(self.strings)), key=cmp_to_key(compare))
        return order, np.array([self.common(i, j) for i, j in zip(order, order[1:], strict=False)], np.int64)


def repeated_windows(contexts: list[bytes], at: np.ndarray, windows: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """For the blocks of one anchor (bytes, the anchor's place in them, number of windows): which offsets j = anchor - start
    (columns) of which block (rows) are windows that another of the blocks has too."""
    size, wide = len(contexts), int(at.max()) + 1
    right, left = Strings([c[a : a + length] for c, a in zip(contexts, at.tolist(), strict=True)], powers), Strings([c[:a][::-1] or b"" for c, a in zip(contexts, at.tolist(), strict=True)], powers) if wide > 1 else None
    offsets = np.arange(wide)

    def classes(strings: Strings | None, depth: np.ndarray) -> np.ndarray:
        """A number for each offset (row) and block (column), equal for blocks that agree to the depth."""
        out = np.zeros((wide, size), np.int64)
        if strings is not None and size > 1:
            order, common = strings.order()
            out[:, order[1:]] = np.cumsum(common[None, :] < depth[:, None], axis=1)
        return out

    key = classes(right, length - offsets) * size + classes(left, offsets)
    exists = (offsets[:, None] <= at[None, :]) & (offsets[:, None] > (at - windows)[None, :])
    key = np.where(exists, key, -1 - np.arange(size)[None, :])
    order = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, order, axis=1)
    same = ranked[:, 1:] == ranked[:, :-1]
    twice = np.zeros_like(exists)
    np.put_along_axis(twice, order, np.c_[same, np.zeros(wide, bool)] | np.c_[np.zeros(wide, bool), same], axis=1)
    return (twice & exists).T


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [tuple(x) for x in edge.reshape(-1, 2).tolist()]


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """docs with kept (binary: what remains of the text's UTF-8 bytes), n_bytes, n_removed and n_spans (maximal removed runs).

    Null texts are empty. Matches may overlap, may lie within one document, and never cross documents; all are judged
    on the input. Rows with equal texts count as several documents, so texts of `length` bytes or more that stand
    twice go wholly. An empty table gives an empty table; columns of docs named like ours give way to them.
    """
    ours = [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]
    docs, schema = appended(docs, ours)
    spark, width, names = docs.sparkSession, len(docs.columns), schema.names
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*text_keys(text), text.cast("binary").alias("text")).where(F.octet_length("text") >= length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in sliced(batches, 2, SLICE):
            seen: dict[tuple[int, int], bytes] = {}  # of equal texts in a batch one is enough: all go wholly
            for a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.setdefault((a, b), t)
            keys, own = list(seen), list(seen.values())
            for got in blocks_in(own, length, gram, powers):
                order = np.lexsort((got.content, got.anchor, got.text))
                doc, anchor, content = got.text[order], got.anchor[order], got.content[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]) if len(doc) else doc
                times = np.diff(np.r_[new, len(doc)])
                h = np.array(keys, np.int64).reshape(-1, 2)[doc[new]]
                yield pa.record_batch([pa.array(signed(anchor[new])), pa.array(signed(content[new])), pa.array(times > 1), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["anchor", "content", "twice", "h1", "h2"])

    cells = texts.mapInArrow(cut, "anchor long, content long, twice boolean, h1 long, h2 long")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of anchor and content; what a row is follows from its neighbours, so one row is held back."""
        before, held = None, None
        for batch in _with_end(batches):
            rows = None if batch is None else np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(5)])
            if held is not None:
                rows = held if rows is None else np.concatenate([held, rows], axis=1)
            if rows is None or not rows.shape[1]:
                continue
            ahead = batch is not None  # the last row waits for the next batch
            a, c = rows[0], rows[1]
            near_a, near = a[1:] == a[:-1], (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            first_a = before is not None and before[0] == a[0]
            first = first_a and before[1] == c[0]
            prev_a, prev, next_a, next_ = np.r_[first_a, near_a], np.r_[first, near], np.r_[near_a, False], np.r_[near, False]
            twice = prev | next_ | (rows[2] > 0)
            kind = np.where(twice, REPEATED, 0)
            beside = (prev_a & ~prev) | (next_a & ~next_)
            kind |= np.where(beside, np.where(twice, WITNESS, PARTIAL), 0)
            n = rows.shape[1] - ahead
            at = np.flatnonzero(kind[:n])
            if ahead:
                if n:
                    before = (a[n - 1], c[n - 1])
                held = rows[:, n:]
            yield pa.record_batch([pa.array(rows[i][at]) for i in (0, 1, 3, 4)] + [pa.array(kind[at].astype(np.int32))], names=["anchor", "content", "h1", "h2", "kind"])

    judged = materialise(cells.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(judge, "anchor long, content long, h1 long, h2 long, kind int"), "substring-blocks")

    # the bytes of the blocks that are to be compared
    is_partial, is_witness = F.col("kind").bitwiseAND(PARTIAL) > 0, F.col("kind").bitwiseAND(WITNESS) > 0
    unsure = materialise(judged.where(is_partial).select("anchor").distinct(), "substring-anchors", light=True)
    asked = judged.where(is_partial | is_witness).groupBy("anchor", "content").agg(F.min(F.struct("h1", "h2")).alias("h"))
    asked = asked.join(unsure, "anchor", "left_semi").select(F.col("h.h1").alias("q1"), F.col("h.h2").alias("q2"), F.struct("anchor", "content").alias("block"))
    asked = materialise(asked.groupBy("q1", "q2").agg(F.collect_list("block").alias("blocks")), "substring-asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            seen = {}
            for a, b, t, want in zip(*(batch.column(x).to_pylist() for x in ("h1", "h2", "text", "blocks")), strict=True):
                seen.setdefault((a, b), (t, {(x["anchor"], x["content"]) for x in want}))
            own, want = [x[0] for x in seen.values()], [x[1] for x in seen.values()]
            for got in blocks_in(own, length, gram, powers):
                out: list[tuple] = []
                for d, first, last, at, key in zip(got.text.tolist(), got.first.tolist(), got.last.tolist(), got.at.tolist(), zip(signed(got.anchor).tolist(), signed(got.content).tolist(), strict=True), strict=True):
                    if key in want[d]:
                        want[d].discard(key)
                        out.append((*key, own[d][first : last + length], at - first, last - first + 1))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "content", "bytes", "at", "windows"])

    held_by = F.col("h1").eqNullSafe(F.col("q1")) & F.col("h2").eqNullSafe(F.col("q2"))
    contexts = bounded_join(texts, asked, held_by, "inner").mapInArrow(fetch, "anchor long, content long, bytes binary, at int, windows int")
    contexts = materialise(contexts, "substring-contexts")
    # a common window whose anchor is j bytes after its start, low <= j < high, has low bytes before the anchor and length - high + 1 from it in common
    cuts = [i * (length - gram + 1) // SEGMENTS for i in range(SEGMENTS + 1)]
    keys = [
        F.when(
            (F.col("at") >= low) & (F.octet_length("bytes") - F.col("at") >= length - high + 1),
            F.xxhash64("anchor", F.lit(low), F.substring("bytes", F.col("at") + 1 - low, F.lit(low + length - high + 1))),
        )
        for low, high in zip(cuts, cuts[1:], strict=False)
    ]
    keyed = contexts.select("anchor", "content", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))
    keyed = materialise(keyed.distinct(), "substring-keys")
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "substring-sizes", light=True)
    block = ["anchor", "content"]
    small = keyed.join(sizes.where(F.col("n") <= most_blocks).select("key"), "key").join(contexts, block).select("key", "content", "anchor", "bytes", "at", "windows")
    large = keyed.join(sizes.where(F.col("n") > most_blocks).select("key"), "key").select(*block).distinct()
    large = contexts.join(materialise(large, "substring-large", light=True), block, "left_semi").dropDuplicates(block)
    ranges = "anchor long, content long, ranges array<struct<lo: int, hi: int>>"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        group: list[tuple] = []

        def done(group: list[tuple]) -> list[tuple]:
            if len(group) < 2:
                return []
            found = repeated_windows([x[3] for x in group], np.array([x[4] for x in group]), np.array([x[5] for x in group]), length, powers)
            return [(x[2], x[1], [{"lo": x[4] + 1 - hi, "hi": x[4] - lo + length} for lo, hi in runs(own)]) for x, own in zip(group, found, strict=True) if own.any()]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], kind)], names=["anchor", "content", "ranges"])

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    out += done(group)
                    group = []
                if not group or row[:3] != group[-1][:3]:  # a block may come from several copies of a text
                    group.append(row)
            yield batch_of(out)
        yield batch_of(done(group))

    partial = small.repartition("key").sortWithinPartitions("key", "content", "anchor").mapInArrow(compare, ranges)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window's place and 128-bit hash, seeded with its anchor's place."""
        for batch in batches:
            for a, c, data, at, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                w1, w2 = _halves([xxhash.xxh3_128_digest(data[i : i + length], at - i) for i in range(n)])
                yield pa.record_batch([pa.array([a] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(w1), pa.array(w2)], names=["anchor", "content", "i", "w1", "w2"])

    each = materialise(large.mapInArrow(windows, "anchor long, content long, i int, w1 long, w2 long"), "substring-windows")
    shared = materialise(each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "substring-shared", light=True)
    hit = each.join(shared, ["w1", "w2"]).select("anchor", "content", F.array(F.struct(F.col("i").alias("lo"), (F.col("i") + length).alias("hi"))).alias("ranges"))
    # a block's findings in all its groups together
    partial = partial.union(hit).groupBy("anchor", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    partial = materialise(partial, "substring-partial")

    whole = judged.where(F.col("kind").bitwiseAND(REPEATED) > 0).select("h1", "h2", F.struct("anchor", "content", F.lit(None).cast("array<struct<lo: int, hi: int>>").alias("ranges")).alias("mark"))
    some = judged.where(is_partial).join(partial, ["anchor", "content"]).select("h1", "h2", F.struct("anchor", "content", "ranges").alias("mark"))
    copies = texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", F.lit(True).alias("copied"))
    copies = materialise(copies, "substring-copies", light=True)
    twice = copies.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"))
    marks = bounded_join(whole.union(some), twice, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left_anti").groupBy("h1", "h2").agg(F.collect_list("mark").alias("marks"))
    every = marks.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("marks", F.array().cast(dict(marks.dtypes)["marks"])))
    every = materialise(every.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "copied", "marks"), "substring-marks")
    keyed = docs.withColumns({"_k1": text_keys(text)[0], "_k2": text_keys(text)[1]})
    marked = keyed.join(every, (F.col("_k1") == F.col("m1")) & (F.col("_k2") == F.col("m2")), "left").select(*[F.col(f"`{c}`") for c in docs.columns], text.cast("binary").alias("_text"), "copied", "marks")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in sliced(batches, width, SLICE):
            own, copied, marks = (batch.column(width + i).to_pylist() for i in range(3))
            gone: list[list[tuple[int, int]]] = [[(0, len(t))] if c and len(t) >= length else [] for t, c in zip(own, copied, strict=True)]
            which = [i for i, (c, m) in enumerate(zip(copied, marks, strict=True)) if m and not c]
            known = [{(x["anchor"], x["content"]): x["ranges"] for x in marks[i]} for i in which]
            for got in blocks_in([own[i] for i in which], length, gram, powers):
                for d, first, last, key in zip(got.text.tolist(), got.first.tolist(), got.last.tolist(), zip(signed(got.anchor).tolist(), signed(got.content).tolist(), strict=True), strict=True):
                    if key in known[d]:
                        part = known[d][key]
                        gone[which[d]] += [(first, last + length)] if part is None else [(first + x["lo"], first + x["hi"]) for x in part]
            kept, removed, spans = [], [], []
            for t, cuts in zip(own, gone, strict=True):
                out, at, n, taken = [], 0, 0, 0
                for a, b in sorted(cuts):
                    if n == 0 or a > at:
                        out.append(t[at:a])
                        n += 1
                        taken += b - a
                        at = b
                    elif b > at:
                        taken += b - at
                        at = b
                out.append(t[at:])
                kept.append(b"".join(out))
                removed.append(taken)
                spans.append(n)
            more = [pa.array(kept, pa.binary()), pa.array([len(t) for t in own], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
            yield pa.record_batch([*batch.columns[:width], *more], names=names)

    return marked.mapInArrow(apply, schema)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
