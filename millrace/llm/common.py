"""What the operators share: materialised tables, text tokens and hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import shared_dir

#: Words that one Python worker remembers the hash of.
WORD_CACHE = 50_000
#: Bytes of a table that a join may broadcast.
BROADCAST_BYTES = 32_000_000
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Text bytes that are turned into arrays at once; one longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000


#: What this process has written to the shared folder and not yet deleted.
_written: list[str] = []


def materialise(df: DataFrame, label: str, light: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage: what a lost executor held is read again from there.

    A light table (a few numbers for each row of something that was written in full) is written by an eighth of the
    shuffle partitions, so that it doesn't leave as many files. The operators' results read these tables, so they stay
    until `clean` is called.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)) if light else df
    # no marker of success: the table is read by whom the write has returned to
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that operators of this process wrote; to be called when their results are no longer read."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def hashed_sample(df: DataFrame, draw: Column, rows: int, total: int) -> DataFrame:
    """The `rows` rows of df (of `total`) with the smallest hash `draw` of those whose hash is in a thin residue class.

    Depends on the rows alone, not on their partitions. The residue class leaves about four times as many rows as are
    wanted, whatever the size of df, so that what partitions send to the driver doesn't grow with their number.
    """
    step = max(1, total // (4 * rows))
    thin = df.withColumn("_draw", draw).where(F.pmod("_draw", F.lit(step)) == 0) if step > 1 else df.withColumn("_draw", draw)
    return thin.orderBy("_draw").limit(rows).drop("_draw")


def appended(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """df without the columns that fields name (ours win), and the schema with fields at its end."""
    ours = {f.name.lower() for f in fields}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ours])
    return df, T.StructType([*df.schema.fields, *fields])


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return pc.cast(column, pa.binary()).to_pylist()


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8 bytes, one at a time."""
    for value in pc.cast(column, pa.large_binary()):
        yield value.as_py()


def sliced(batches: Iterable[pa.RecordBatch], text_at: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices with about `most` bytes of text in a column, one longer text alone, so that a worker holds little besides what it was sent."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.cast(pc.binary_length(batch.column(text_at)), pa.int64()), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
        if not batch.num_rows:
            yield batch


def bounded_join(big: DataFrame, small: DataFrame, on: Column, how: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A join that broadcasts `small` only if its rows, each measured as text, are within the bound; else both sides are shuffled."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in small.columns), F.lit(24))
    held = small.agg(F.sum(width)).first()[0] or 0
    return big.join(F.broadcast(small) if held <= most_bytes else small, on, how)


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(text: bytes, ids: WordHashes) -> np.ndarray:
    """The hashes of a text's words (A-Z lower-cased, parted by ASCII white space); long texts are split piece by piece."""
    if len(text) <= CHUNK_BYTES:
        return ids.of(text.lower().split())
    out, start = [], 0
    while start < len(text):
        gap = BLANK.search(text, min(start + CHUNK_BYTES, len(text)))
        end = gap.start() if gap else len(text)
        out.append(ids.of(text[start:end].lower().split()))
        start = end + 1
    return np.concatenate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES each."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text or b"") > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text or b"")
    if first < len(texts):
        yield first, len(texts)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive elements, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
