"""Benchmark decontamination by winnowing.

Of each window of `window` consecutive words the smallest hash of its word k-grams is kept as its fingerprint, on both
sides. Equal windows have equal fingerprints, so every shared span of `window` words or more is found. Documents whose
fingerprints meet those of the benchmark are extended: the window's hash, then its words are compared.

Items of fewer words than a window are one window of their own length; each such length is winnowed by itself.

A benchmark within a bound of bytes is broadcast as an index, and documents are read once. A larger one stays a table:
the documents' fingerprints are joined with its own, and where they meet the windows there are joined by 128-bit hashes
of their words. Texts are then read three times, and moved only where a fingerprint met.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import WordHashes, appended, bounded_join, chunks, grams, materialise, signed, sliced, sliding_min, texts, utf8

WINDOW, GRAM = 13, 5
#: Benchmark text in a broadcast index at most.
BLOCK_BYTES = 2_000_000
#: 0-9, a-z and bytes of non-ASCII characters stay, A-Z become lower case, all else separates words.
WORD_BYTES = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


@dataclass
class Family:
    """The benchmark's windows of one length."""

    length: int
    gram: int
    prints: np.ndarray
    hashes: np.ndarray
    windows: dict[bytes, list[str]]

    @property
    def grams_in_window(self) -> int:
        return self.length - self.gram + 1


def bench_index(items: list[tuple[str | None, bytes | None]], window: int, gram: int) -> list[Family]:
    """The windows of the items by length. Items without id have windows, but no name to list."""
    ids, held = WordHashes(), defaultdict(lambda: (set(), set(), defaultdict(set)))
    for name, text in items:
        words = words_of(text)
        if not words:
            continue
        length = min(window, len(words))
        k = min(gram, length)
        prints, hashes, windows = held[length]
        h = ids.of(words)
        prints.update(sliding_min(grams(h, k), length - k + 1).tolist())
        hashes.update(grams(h, length).tolist())
        for i in range(len(words) - length + 1):
            own = windows[b" ".join(words[i : i + length])]
            if name is not None:
                own.add(name)
    return [Family(n, min(gram, n), np.array(sorted(p), np.uint64), np.array(sorted(w), np.uint64), {k: sorted(v) for k, v in d.items()}) for n, (p, w, d) in sorted(held.items())]


def among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array held."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def found(texts: list[bytes | None], families: list[Family], ids: WordHashes) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """For each text its number of words, the covered spans (start, end in words) and the items that have a window in it."""
    for first, last in chunks(texts):
        words: list[bytes] = []
        bounds = [0]
        for text in texts[first:last]:
            words += words_of(text)
            bounds.append(len(words))
        h, ends = ids.of(words), np.array(bounds)
        cover, names = np.zeros(len(words) + 1, np.int64), defaultdict(set)
        for f in families:
            if len(words) < f.length:
                continue
            least = sliding_min(grams(h, f.gram), f.grams_in_window)
            turns = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            at = np.flatnonzero(np.repeat(among(least[turns], f.prints), np.diff(np.r_[turns, len(least)])))
            doc = np.searchsorted(ends, at, side="right") - 1
            inside = at + f.length <= ends[doc + 1]
            at, doc = at[inside], doc[inside]
            if not len(at):
                continue
            here = np.array([grams(h[i : i + f.length], f.length)[0] for i in at]) if len(at) < 64 else grams(h, f.length)[at]
            same = among(here, f.hashes)
            for i, d in zip(at[same].tolist(), doc[same].tolist(), strict=True):
                own = f.windows.get(b" ".join(words[i : i + f.length]))
                if own is not None:
                    cover[i] += 1
                    cover[i + f.length] -= 1
                    names[d].update(own)
        hit = np.cumsum(cover[:-1]) > 0
        for d in range(len(bounds) - 1):
            own = hit[bounds[d] : bounds[d + 1]]
            if own.any():
                edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                yield len(own), edge.reshape(-1, 2), names[d]
            else:
                yield len(own), np.empty((0, 2), np.int64), set()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(words: list[bytes], length: int, gram: int, ids: WordHashes) -> Iterator[tuple[int, int, int]]:
    """fingerprint, first and last window of each run of windows with one fingerprint."""
    if len(words) < length:
        return
    k = min(gram, length)
    least = sliding_min(grams(ids.of(words), k), length - k + 1)
    turns = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    yield from zip(signed(least[turns]).tolist(), turns.tolist(), (np.r_[turns[1:], len(least)] - 1).tolist(), strict=True)


def window_hash(words: list[bytes], start: int, length: int) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[start : start + length])), "<i8")
    return int(both[0]), int(both[1])


def table_of(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names.split())


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int, gram: int) -> DataFrame:
    """docs with n_words, hit_spans and hit_items, by joins of fingerprints and windows. Equal texts are looked at once a task."""
    long = pa.int64()

    def bench(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordHashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = words_of(text)
                length = min(window, len(words))
                for p, first, last in runs_of(words, length, gram, ids) if words else ():
                    rows += [(length, p, *window_hash(words, i, length), item) for i in range(first, last + 1)]
            yield table_of(rows, "length print w1 w2 item", [long, long, long, long, pa.string()])

    windows = materialise(items.mapInArrow(bench, "length long, print long, w1 long, w2 long, item string").distinct(), "decontam-windows")
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # `window` of them at most
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
    own = docs.select(*keys, text.alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordHashes()
        for batch in batches:
            seen: set[tuple] = set()
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                if (k1, k2) not in seen:
                    seen.add((k1, k2))
                    words = words_of(text)
                    yield table_of([(k1, k2, n, *run) for n in lengths for run in runs_of(words, n, gram, ids)], "k1 k2 length print first last", [long] * 6)

    met = own.mapInArrow(prints, "k1 long, k2 long, length long, print long, first long, last long").join(windows.select("length", "print").distinct(), ["length", "print"])
    asked = met.groupBy("k1", "k2").agg(F.collect_set(F.struct("length", "first", "last")).alias("runs"))
    asked = materialise(asked.withColumnsRenamed({"k1": "a1", "k2": "a2"}), "decontam-asked")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()
            for k1, k2, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3), strict=True):
                if (k1, k2) not in seen:
                    seen.add((k1, k2))
                    words = words_of(text)
                    yield table_of([(k1, k2, r["length"], i, *window_hash(words, i, r["length"])) for r in runs.as_py() for i in range(r["first"], r["last"] + 1)], "k1 k2 length start w1 w2", [long] * 6)

    same = (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2"))
    there = bounded_join(own, asked, same, "inner").select("k1", "k2", "text", "runs").mapInArrow(exact, "k1 long, k2 long, length long, start long, w1 long, w2 long")
    hits = there.join(windows.select("length", "w1", "w2", "item"), ["length", "w1", "w2"])
    each = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("_spans"), F.collect_set("item").alias("_items"))
    each = materialise(each.withColumnsRenamed({"k1": "a1", "k2": "a2"}), "decontam-hits")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    width, text_at = len(docs.columns), docs.columns.index(text_col)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_at):
            n = [len(words_of(t)) for t in texts(batch.column(text_at).cast(pa.string()))]
            spans = [[{"start": a, "end": z} for a, z in merged([(x["start"], x["end"]) for x in own or ()])] for own in batch.column(width).to_pylist()]
            names = [sorted(x or ()) for x in batch.column(width + 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:width], pa.array(n, pa.int64()), pa.array(spans, SPAN_KIND), pa.array(names, pa.list_(pa.string()))], names=schema.names)

    keyed = docs.withColumns({"k1": keys[0], "k2": keys[1]})
    return keyed.join(each, same, "left").select(*[keyed[f"`{c}`"] for c in docs.columns], "_spans", "_items").mapInArrow(told, schema)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPAN_KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, hit_spans (start, end in words, disjoint), hit_items (sorted as strings), n_hit and contaminated.

    Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null or empty texts have no words; an empty benchmark hits
    nothing; repeated documents get equal rows; items that share an id are listed once. Columns of docs with these
    names give way to ours. A benchmark of at most block_bytes is broadcast, and nothing is shuffled; a larger one is
    joined.
    """
    spark = docs.sparkSession
    ours = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("n_hit", T.LongType()), T.StructField("contaminated", T.BooleanType())]
    docs, _ = appended(docs, ours)
    out, schema = appended(docs, ours[:3])
    width, text_at, names = len(docs.columns), docs.columns.index(text_col), schema.names

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if total <= block_bytes:
        index = spark.sparkContext.broadcast(bench_index([(r["item"], None if r["words"] is None else r["words"].encode()) for r in items.toLocalIterator()], window, gram))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = WordHashes()
            for batch in sliced(batches, text_at):
                n, spans, hits = [], [], []
                for words, edge, own in found(utf8(batch.column(text_at)), index.value, ids):
                    n.append(words)
                    spans.append([{"start": a, "end": z} for a, z in edge.tolist()])
                    hits.append(sorted(own))
                more = [pa.array(n, pa.int64()), pa.array(spans, SPAN_KIND), pa.array(hits, pa.list_(pa.string()))]
                yield pa.record_batch([*batch.columns[:width], *more], names=names)

        out = out.mapInArrow(apply, schema)
    else:
        out = _joined(docs, items, text_col, window, gram).select(*[F.col(f"`{c}`") for c in names])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
