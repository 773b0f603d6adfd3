"""Line dedup on sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. The index holds for each pair of
key and document how often the line stands there (its references). From that table follow the number of documents
that hold a key and the largest of them. Keys in `min_docs` documents or more are *heavy*: they lose all lines except
those of the largest document.

The cuckoo filters, one for each shard of the key space, stand in front of the exact table: they hold the heavy keys,
support insertion and deletion, and have no false negatives. Documents that come or go change the reference counts of
their keys; a key that becomes heavy is inserted into its shard's filter, one that no longer is gets deleted from it, and
only a shard that is full is built anew, larger. A line that its filter doesn't know stays without any look at the exact
table; the others are looked up there, so false positives never drop a line.

Keys are compared by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended, materialise, signed, sliced, utf8

MIN_CHARS, MIN_DOCS, SHARDS = 40, 5, 64
#: Bytes of heavy keys with their documents, and of filters, that are sent to every executor at most. Beyond the first the
#: suspected lines are joined with the exact table; beyond the second the lines go to the filters, each of which is in SALTS places.
BROADCAST_KEY_BYTES, BROADCAST_FILTER_BYTES, SALTS = 32_000_000, 64_000_000, 8


class CuckooFilter:
    """Set of 64-bit hashes with 16-bit fingerprints, four to a bucket, that supports deletion; no false negatives.

    It doubles when an insertion finds no room: the caller passes the hashes of what is inside (see `build`).
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int) -> None:
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / self.SLOTS / 0.8))))
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        capacity = len(hashes)
        while True:
            made = cls(capacity)
            if all(made.insert(int(h)) for h in hashes):
                return made
            capacity = max(8, capacity * 2)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        made.buckets = len(made.table)
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(hashes, np.uint64)
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, first, first ^ self._turn(print_)

    def _turn(self, print_: np.ndarray) -> np.ndarray:
        return (np.asarray(print_, np.int64) * 0x5BD1E995) & (self.buckets - 1)

    def insert(self, h: int) -> bool:
        """Adds one hash; False if there is no room (the filter is then to be built anew, larger)."""
        p, a, b = (x[0] for x in self._places(np.array([h], np.uint64)))
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        at = b
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            p, self.table[at, slot] = self.table[at, slot], p
            at = at ^ int(self._turn(p))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        return False

    def delete(self, h: int) -> bool:
        """Takes away one hash that was inserted before; False if it isn't there."""
        p, a, b = (x[0] for x in self._places(np.array([h], np.uint64)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == p)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        p, a, b = self._places(hashes)
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)


def line_keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text; of those with a key of min_chars code points or more the positions and 128-bit hashes."""
    lines = (text or b"").split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip()
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                keys.append(xxhash.xxh3_128_digest(key.lower()))
    return lines, at, keys


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The references of docs: h1, h2 (the key), doc (its document) and refs (times the line stands there).

    A null id is one document of its own, smaller than all others.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids, doc, keys, refs = batch.column(0).to_pylist(), [], [], []
            for i, text in zip(ids, utf8(batch.column(1)), strict=True):
                count: dict[bytes, int] = {}
                for key in line_keys(text, min_chars)[2]:
                    count[key] = count.get(key, 0) + 1
                keys += count
                refs += count.values()
                doc += [i] * len(count)
            h1, h2 = _halves(keys)
            yield pa.record_batch([pa.array(signed(h1)), pa.array(signed(h2)), pa.array(doc, kind), pa.array(refs, pa.int64())], names=["h1", "h2", "doc", "refs"])

    kind = pa.int64() if isinstance(docs.schema[id_col].dataType, T.LongType) else pa.string()
    id_type = "long" if kind == pa.int64() else "string"
    return docs.select(F.col(id_col).cast(id_type), F.col(text_col).cast("string")).mapInArrow(emit, f"h1 long, h2 long, doc {id_type}, refs long")


FILTERS = "shard int, n long, filter binary"


class LineIndex:
    """The exact reference table of a corpus with its filters; insertions and deletions of documents give a new, reversible state.

    `table` has h1, h2, doc, refs, one row for each key and document, refs above 0; `filters` has shard, n (keys) and
    filter, for the shards that have heavy keys.
    """

    def __init__(self, table: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = SHARDS, filters: DataFrame | None = None) -> None:
        self.table, self.min_chars, self.min_docs, self.shards = table, min_chars, min_docs, shards
        self._heavy: DataFrame | None = None
        self.filters = self.built(self.heavy()) if filters is None else filters

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> LineIndex:
        refs = references(docs, id_col, text_col, min_chars)
        return cls(refs.groupBy("h1", "h2", "doc").agg(F.sum("refs").alias("refs")), min_chars, min_docs, shards)

    def heavy(self) -> DataFrame:
        """Keys in min_docs documents or more: h1, h2, n_docs, keep (the largest document)."""
        if self._heavy is None:
            self._heavy = materialise(self.counts(self.table).where(F.col("n_docs") >= self.min_docs), "line-heavy")
        return self._heavy

    @staticmethod
    def counts(table: DataFrame) -> DataFrame:
        return table.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keep"))

    def shard(self) -> Column:
        return F.pmod("h2", F.lit(self.shards)).cast("int").alias("shard")

    def built(self, heavy: DataFrame) -> DataFrame:
        """Filters of the heavy keys of each shard."""

        def build(_: tuple, t: pa.Table) -> pa.Table:
            made = CuckooFilter.build(t.column("h1").to_numpy().view(np.uint64))
            return pa.table({"shard": t.column("shard")[:1], "n": pa.array([len(t)], pa.int64()), "filter": pa.array([made.dump()], pa.binary())})

        keyed = heavy.select(self.shard(), "h1")
        return materialise(keyed.groupBy("shard").applyInArrow(build, FILTERS), "line-filters", light=True)

    def _merged(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> LineIndex:
        more = materialise(references(docs, id_col, text_col, self.min_chars).withColumn("refs", sign * F.col("refs")), "line-changes", light=True)
        merged = self.table.unionByName(more).groupBy("h1", "h2", "doc").agg(F.sum("refs").alias("refs"))
        merged = materialise(merged.where("refs > 0"), "line-index")
        # of the keys that the documents have: which became heavy, and which no longer are
        touched = more.select("h1", "h2").distinct()
        was, now = (self.counts(t.join(touched, ["h1", "h2"], "left_semi")).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", F.lit(True).alias(name)) for t, name in ((self.table, "was"), (merged, "now")))
        moves = was.join(now, ["h1", "h2"], "full").where("was IS NULL OR now IS NULL").select(self.shard(), "h1", F.col("now").isNotNull().alias("comes"))
        after = LineIndex(merged, self.min_chars, self.min_docs, self.shards, self.filters)

        def update(t: pa.Table, moved: pa.Table) -> pa.Table:
            """The shard's filter after deletions and insertions; without a filter if it is full."""
            held = CuckooFilter.load(t.column("filter")[0].as_py()) if len(t) else CuckooFilter(8)
            hashes, comes = moved.column("h1").to_numpy().view(np.uint64), moved.column("comes").to_numpy(zero_copy_only=False)
            for h in hashes[~comes].tolist():
                held.delete(h)
            full = not all(held.insert(h) for h in hashes[comes].tolist())
            n = (t.column("n")[0].as_py() if len(t) else 0) + int(comes.sum()) - int((~comes).sum())
            shard = (t if len(t) else moved).column("shard")[:1]
            return pa.table({"shard": shard.cast(pa.int32()), "n": pa.array([n], pa.int64()), "filter": pa.array([None if full else held.dump()], pa.binary())})

        updated = materialise(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(update, FILTERS), "line-filters", light=True)
        full = [r["shard"] for r in updated.where("filter IS NULL").select("shard").collect()]  # shards at most
        after.filters = updated if not full else updated.where("filter IS NOT NULL").union(after.built(after.heavy().where(after.shard().isin(full))))
        return after

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with docs added."""
        return self._merged(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index without docs, whose texts are those inserted before: inserting and deleting the same rows changes nothing."""
        return self._merged(docs, -1, id_col, text_col)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    shards: int = SHARDS, index: LineIndex | None = None, broadcast_key_bytes: int = BROADCAST_KEY_BYTES, broadcast_filter_bytes: int = BROADCAST_FILTER_BYTES,
) -> DataFrame:
    """docs with the lines that stay, in text_col, and n_lines (before) and n_dropped at the end.

    A null or empty text has one empty line. A key counts once for each distinct id; rows that share an id are one
    document. An empty table gives an empty table. Columns of docs named n_lines or n_dropped give way to ours.
    `index` is the state to decide by; without it, that of docs. Filters and exact keys are broadcast while they are
    within the bounds; beyond, lines are shuffled to the filters, and the suspected ones joined with the exact table.
    """
    spark = docs.sparkSession
    index = index or LineIndex.build(docs, id_col, text_col, min_chars, min_docs, shards)
    heavy = index.heavy()
    width_of = F.lit(16) + F.coalesce(F.octet_length(F.col("keep").cast("string")), F.lit(0))
    key_bytes = heavy.agg(F.sum(width_of)).first()[0] or 0
    filter_bytes = index.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    id_type = dict(heavy.dtypes)["keep"]
    docs, schema = appended(docs, [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    id_at, text_at, shards, min_chars = docs.columns.index(id_col), docs.columns.index(text_col), index.shards, index.min_chars
    width, names = len(docs.columns), schema.names

    small = filter_bytes <= broadcast_filter_bytes
    filters = {r["shard"]: r["filter"] for r in index.filters.toLocalIterator()} if small else {}
    sent = spark.sparkContext.broadcast(filters)

    def suspected(held: dict[int, CuckooFilter], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(h1), bool), signed(h2) % shards
        for s in np.unique(shard):
            if int(s) in held:
                at = np.flatnonzero(shard == s)
                out[at] = held[int(s)].contains(h1[at])
        return out

    def rebuilt(batch: pa.RecordBatch, texts: list[bytes | None], lines: list, dropped: list[set[int]]) -> pa.RecordBatch:
        kept = [b"\n".join(x for i, x in enumerate(own) if i not in gone) if gone else (text or b"") for text, own, gone in zip(texts, lines, dropped, strict=True)]
        columns = [*batch.columns[:width]]
        columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string(), safe=False)
        columns += [pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in dropped], pa.int64())]
        return pa.record_batch(columns, names=names)

    if small and key_bytes <= broadcast_key_bytes:
        rows = heavy.select("h1", "h2", "keep").toArrow()
        h1, h2 = (rows.column(x).to_numpy().astype(np.int64) for x in ("h1", "h2"))
        order = np.lexsort((h2, h1))
        keep = rows.column("keep").take(pa.array(order, pa.int64()))
        exact = spark.sparkContext.broadcast((h1[order], h2[order], keep.combine_chunks()))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s: CuckooFilter.load(x) for s, x in sent.value.items()}
            e1, e2, keep = exact.value
            run = int(np.unique(e1, return_counts=True)[1].max()) if len(e1) else 0
            for batch in sliced(batches, text_at):
                ids, texts = batch.column(id_at).cast(pa.int64() if id_type == "bigint" else pa.string()).to_pylist(), utf8(batch.column(text_at))
                lines, doc, at, keys = [], [], [], []
                for i, text in enumerate(texts):
                    own, where, hashes = line_keys(text, min_chars)
                    lines.append(own)
                    doc += [i] * len(where)
                    at += where
                    keys += hashes
                dropped: list[set[int]] = [set() for _ in texts]
                h1, h2 = _halves(keys)
                likely = np.flatnonzero(suspected(held, h1, h2))
                a, b = signed(h1)[likely], signed(h2)[likely]
                place = np.searchsorted(e1, a)
                for step in range(run):
                    there = np.minimum(place + step, len(e1) - 1)
                    for j in np.flatnonzero((e1[there] == a) & (e2[there] == b)):
                        k = likely[j]
                        if ids[doc[k]] != keep[int(there[j])].as_py():
                            dropped[doc[k]].add(at[k])
                yield rebuilt(batch, texts, lines, dropped)

        return docs.mapInArrow(drop, schema)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter.load(x) for s, x in sent.value.items()}
        for batch in sliced(batches, 1):
            doc, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                own = list(dict.fromkeys(line_keys(text, min_chars)[2]))
                keys += own
                doc += [i] * len(own)
            h1, h2 = _halves(keys)
            at = np.flatnonzero(suspected(held, h1, h2)) if small else np.arange(len(h1))
            yield pa.record_batch([pa.array(signed(h1)[at]), pa.array(signed(h2)[at]), pa.array([doc[k] for k in at], pa.int64() if id_type == "bigint" else pa.string())], names=["h1", "h2", "doc"])

    lines = docs.select(F.col(id_col).cast(id_type), F.col(text_col).cast("string")).mapInArrow(suspects, f"h1 long, h2 long, doc {id_type}")
    if not small:
        lines = _asked(lines, index, id_type)
    gone = lines.join(heavy, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keep"))).groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("_gone"))
    joined = docs.join(gone.withColumnRenamed("doc", "_doc"), F.col(id_col).cast(id_type).eqNullSafe(F.col("_doc")), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_at):
            texts, lines, dropped = utf8(batch.column(text_at)), [], []
            for text, gone in zip(texts, batch.column(len(batch.columns) - 1).to_pylist(), strict=True):
                own, at, keys = line_keys(text, min_chars)
                mine = {(x["h1"], x["h2"]) for x in gone or ()}
                h1, h2 = _halves(keys)
                lines.append(own)
                dropped.append({i for i, a, b in zip(at, signed(h1).tolist(), signed(h2).tolist(), strict=True) if (a, b) in mine})
            yield rebuilt(batch, texts, lines, dropped)

    return joined.mapInArrow(cut, schema)


def _asked(lines: DataFrame, index: LineIndex, id_type: str) -> DataFrame:
    """Of lines (h1, h2, doc) those that the filter of their shard knows: each filter stands in SALTS places, where the lines of a share of the documents come by."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of shard, salt and filter, which comes first; the lines are streamed."""
        at, held = None, None
        for batch in batches:
            shard, salt, keep = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.zeros(batch.num_rows, bool)
            first = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])])
            for lo, hi in zip(first, np.r_[first[1:], len(shard)], strict=True):
                if at != (shard[lo], salt[lo]):
                    at, held = (shard[lo], salt[lo]), None
                if batch.column(2)[int(lo)].is_valid:
                    held = CuckooFilter.load(batch.column(2)[int(lo)].as_py())
                    lo += 1
                if held is not None:
                    keep[lo:hi] = held.contains(batch.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            took = pa.array(np.flatnonzero(keep), pa.int64())
            yield pa.record_batch([batch.column(i).take(took) for i in (3, 4, 5)], names=["h1", "h2", "doc"])

    none = F.lit(None)
    places = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "filter", none.cast("long").alias("h1"), none.cast("long").alias("h2"), none.cast(id_type).alias("doc"))
    own = lines.select(index.shard(), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), none.cast("binary").alias("filter"), "h1", "h2", "doc")
    fed = places.union(own).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return fed.mapInArrow(ask, f"h1 long, h2 long, doc {id_type}")
