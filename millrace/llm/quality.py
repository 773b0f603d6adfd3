"""Quality by compression: zstandard dictionaries built from good and from bad labelled text.

A text is compressed with either dictionary. The score comes from two normalised differences of sizes, between the text
and what either dictionary leaves of it: (size - good) / (size + good) and (size - bad) / (size + bad). One against the
other says what kind of text it resembles; both together how much it repeats itself. A logistic curve of second degree,
fitted on labelled texts that the dictionaries weren't built from, turns them into a calibrated score. With too little
labelled text of a class to train a dictionary, its texts themselves are the dictionary, up to DICT_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import appended, sliced, utf8
from millrace.llm.labelled import base_rate, logistic, sample

#: Labelled documents of each class at most, bytes of a dictionary, compression level.
PER_CLASS, DICT_BYTES, LEVEL = 1000, 112_640, 3
FEATURES = 6
#: Bytes of labelled text the driver takes at most, for each class.
SAMPLE_BYTES = 16_000_000


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        made = []
        for d in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(d) if d else None
            if dictionary:
                dictionary.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(made)


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, ...]:
    n, g, b = len(text), len(good.compress(text)), len(bad.compress(text))
    x, y = 10 * (n - g) / (n + g), 10 * (n - b) / (n + b)
    return 1.0, x, y, x * x / 10, x * y / 10, y * y / 10


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; the bare texts where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICT_BYTES]


def fit(rows: list[tuple[int, bytes]], rate: float) -> Model:
    """A model from (label, text) rows: one half makes the dictionaries, the other calibrates, and the reverse for the weights."""
    if len({label for label, _ in rows}) < 2:
        return Model(b"", b"", np.r_[np.log(rate / (1 - rate)), np.zeros(FEATURES - 1)])
    x, y = [], []
    for half in (0, 1):
        own = [r for i, r in enumerate(rows) if i % 2 == half]
        made = Model(dictionary([t for label, t in own if label == 1]), dictionary([t for label, t in own if label == 0]), np.zeros(FEATURES))
        good, bad = made.compressors()
        for i, (label, text) in enumerate(rows):
            if i % 2 != half:
                x.append(features(text, good, bad))
                y.append(label)
    full = Model(dictionary([t for label, t in rows if label == 1]), dictionary([t for label, t in rows if label == 0]), np.zeros(FEATURES))
    weights = logistic(np.array(x), np.array(y, float), steps=100)
    share = np.clip(np.mean(y), 1e-6, 1 - 1e-6)
    weights[0] += np.log(rate / (1 - rate)) - np.log(share / (1 - share))  # classes were sampled by themselves
    return Model(full.good, full.bad, weights)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of labelled documents outside the held-out remainder, whose labels are never read.

    Null ids, labels and texts, empty texts and ids with several labels are left out; repeated rows count as often as
    they stand. Without labels of both classes every text gets the share of label 1.
    """
    rows, size = [], {0: 0, 1: 0}
    for r in sample(docs, labels, label_col, modulus, held_out, per_class).orderBy("draw", "text").toLocalIterator():
        text = r["text"].encode()
        if text and size[r["label"]] + len(text) <= SAMPLE_BYTES:
            size[r["label"]] += len(text)
            rows.append((r["label"], text))
    return fit(rows, base_rate(labels, label_col, modulus, held_out))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, from 0 to 1, higher where label 1 is likelier, from the whole text alone.

    Null and empty texts get the score of the empty text; a column of docs of that name gives way. Equal texts get
    equal scores; an empty table stays empty.
    """
    docs, schema = appended(docs, [T.StructField(score_col, T.DoubleType())])
    sent, text_at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = sent.value.compressors()
        for batch in sliced(batches, text_at):
            x = np.array([features(t or b"", good, bad) for t in utf8(batch.column(text_at))]).reshape(-1, len(sent.value.weights))
            p = 1 / (1 + np.exp(-np.clip(x @ sent.value.weights, -30, 30)))
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=names)

    return docs.mapInArrow(score, schema)
