"""Toxicity by weak supervision.

Voters: words and word beginnings that stand out in toxic labelled documents (a lexicon mined from a bounded sample),
patterns of writing (capitals, exclamation marks, repeated letters, long runs of signs), and whether none, one or more of
the lexicon fire.
A generative model with a hidden class estimates by expectation maximisation how often each voter fires in either
class, from the votes on labelled and on unlabelled documents alike. The labels choose the voters, give the first
estimates, and are one more voter, whose accuracy is estimated as that of all others: a wrong label is outvoted by what its
document says. From the votes' covariances within a class the model learns which voters repeat each other; what fires
together with others that it is tied to counts once for all of them. Its
posteriors are the labels on which a linear classifier over all lexicon entries and patterns is trained; the classifier
scores the whole text of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import WORD_CACHE, appended, hashed_sample, sliced
from millrace.llm.labelled import base_rate, logistic, sample

#: Labelled documents of each class at most; unlabelled ones; lexicon entries; times that a toxic document is to be covered by entries.
PER_CLASS, UNLABELLED, ENTRIES, COVER = 1500, 1500, 400, 4
#: Bytes of a document that the model learns from, and of the entries (8 bytes each) of all of them that the driver takes, at most.
DOC_BYTES, SAMPLE_BYTES = 200_000, 100_000_000
SHORTEST, LONGEST = 4, 9
#: Pseudo-rows that a voter's first rates count as; correlation from which two voters are tied; first accuracy of a label; lexicon votes of class 0 from which its shares are its own;
#: bounds of what a lexicon entry's share says.
STRENGTH, TIED, TRUST, FEW, BETTER = 50.0, 0.3, 0.8, 100.0, (-0.5, 2.0)
#: Bytes that part words: all of ASCII but letters.
PARTS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
SIGNS = re.compile(rb"[*#$%&@]{3}")
REPEATS = re.compile(rb"([a-z])\1{3}")
PATTERNS = 4


def entries_of(word: bytes) -> tuple[int, ...]:
    """The lexicon entries that a word can fire: itself and its beginnings. Each is a hash with its length (15: the word) in the last four bits."""
    begins = [(word[:n], n) for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]
    return tuple(xxhash.xxh64_intdigest(x, n) & ~15 | n for x, n in (*begins, (word, 15)))


def facts(text: str | None) -> tuple[set[bytes], list[bool]]:
    """The distinct words of a text, in lower case, and which patterns it shows."""
    text = text or ""
    raw, low = np.frombuffer(text.encode("utf-8", "replace"), np.uint8), text.lower().encode("utf-8", "replace")
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    # a letter that stands four times: found by comparison first, as the pattern is slow
    again = len(raw) > 3 and bool(((raw[3:] == raw[:-3]) & (raw[2:-1] == raw[:-3]) & (raw[1:-2] == raw[:-3])).any()) and REPEATS.search(low) is not None
    shown = [capitals > 0.4 * max(1, len(text)), text.count("!") * 20 > max(1, text.count(" ")), again, SIGNS.search(low) is not None]
    return set(low.translate(PARTS).split()), shown


def entries_in(words: set[bytes]) -> np.ndarray:
    """All entries that the words can fire, in order."""
    return np.unique(np.fromiter((e for w in words for e in entries_of(w)), np.uint64))


@dataclass
class Model:
    lexicon: dict[int, int]  # entry to number
    weights: np.ndarray  # of the lexicon entries, then of the patterns, then the constant


def mine(fired: list[np.ndarray], labels: np.ndarray, entries: int = ENTRIES, cover: int = COVER) -> list[int]:
    """Of the entries that rows can fire those that stand out in toxic rows, so chosen that each toxic row is covered up to `cover` times."""
    toxic = [x for x, y in zip(fired, labels, strict=True) if y]
    n1, n0 = len(toxic), len(fired) - len(toxic)
    found, ones = np.unique(np.concatenate(toxic), return_counts=True)
    found, ones = found[ones >= max(3, n1 // 200)], ones[ones >= max(3, n1 // 200)]
    zeros = np.zeros(len(found), np.int64)
    for x, y in zip(fired, labels, strict=True):
        if not y:
            zeros[np.isin(found, x, assume_unique=True)] += 1
    good = ones / n1 > 12 * (zeros + 0.3) / n0
    found, zeros = found[good], zeros[good]
    at: list[list[int]] = [[] for _ in found]
    for i, x in enumerate(toxic):
        for e in np.flatnonzero(np.isin(found, x, assume_unique=True)):
            at[e].append(i)
    # of entries that fire alike, the longest is kept
    alike: dict[tuple, int] = {}
    for e in sorted(range(len(found)), key=lambda e: (int(found[e]) & 15, int(found[e]))):
        alike[(tuple(at[e]), int(zeros[e]))] = e
    need, chosen = np.full(n1, cover), []
    left = {e: np.array(at[e]) for e in alike.values()}
    while left and len(chosen) < entries:
        gain = {e: int((need[i] > 0).sum()) - 3 * int(zeros[e]) for e, i in left.items()}
        best = max(sorted(gain), key=lambda e: (gain[e], int(found[e]) & 15))
        if gain[best] < 2:
            break
        need[left.pop(best)] -= 1
        chosen.append(int(found[best]))
    return chosen


def label_model(votes: np.ndarray, labels: np.ndarray, prior: float, entries: int, rounds: int = 25, strength: float = STRENGTH, tied: float = TIED) -> tuple[np.ndarray, tuple[float, float]]:
    """Posterior of class 1 for each row of votes (fired or not; a voter that doesn't fire abstains), and how often a label of either class is right.

    The first `entries` voters are the lexicon. How many of them fire is said by voters of its own; which of them do
    counts by the shares that each has of all firing in either class.

    labels: 0, 1, or -1 where there is none. They give each voter's first rates, which go on as `strength` pseudo-rows,
    and are one more voter, whose accuracies are estimated as those of all others.
    """
    v, given = votes.astype(float), labels >= 0
    share = np.where(given, (labels == 1).sum() / max(1, given.sum()), prior).clip(0.01, 0.99)  # labelled rows were sampled class by class
    first = [(v[labels == c].sum(0) + 0.5) / ((labels == c).sum() + 1.0) for c in (1, 0)]
    rates, repeat, right = first, np.ones(v.shape), (TRUST, TRUST)
    for _ in range(rounds):
        a, b = (np.clip(r, 1e-4, 1 - 1e-4) for r in rates)
        # class 0 fires the lexicon seldom: its shares are class 1's but for what many rows say
        fires = b[:entries] * len(v)
        a[:entries] = a[:entries] / max(1e-9, a[:entries].sum())
        b[:entries] = (fires + FEW * a[:entries]) / (fires.sum() + FEW)
        says = np.log(a / b)
        says[:entries] = np.clip(says[:entries], *BETTER)  # an entry was chosen for being better than chance
        odds = np.log(share / (1 - share)) + (v * says / repeat).sum(1)
        odds += np.where(labels == 1, np.log(right[0] / (1 - right[1])), np.where(labels == 0, np.log((1 - right[0]) / right[1]), 0.0))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        rates = [((v * w[:, None]).sum(0) + strength * f) / (w.sum() + strength) for w, f in zip((q, 1 - q), first, strict=True)]
        right = tuple(float(np.clip((w[labels == c].sum() + strength * TRUST) / (w[given].sum() + strength), 0.5, 0.999)) for c, w in ((1, q), (0, 1 - q)))
        # correlation within the classes: what fires in a row with others that it is tied to counts once for all of them
        rest = v - np.outer(q, rates[0]) - np.outer(1 - q, rates[1])
        scale = np.sqrt((rest**2).mean(0)) + 1e-6
        corr = (rest / scale).T @ (rest / scale) / max(1, len(v))
        ties = np.where(corr >= tied, corr, 0.0)
        ties[:entries, entries:] = ties[entries:, :entries] = 0.0  # an entry's share and the number of entries say different things
        repeat = np.clip(v @ ties, 1, None)
    return q, right


def fit(rows: list[tuple[int, np.ndarray, list[bool]]], rate: float) -> Model:
    """A model from rows of label (0, 1 or -1: none), entries and patterns shown; `rate` is the share of label 1."""
    labels = np.array([r[0] for r in rows], int)
    base = np.log(rate / (1 - rate))
    if not (labels == 0).any() or not (labels == 1).any():
        return Model({}, np.r_[np.zeros(PATTERNS), base])
    lexicon = np.array(mine([r[1] for r in rows if r[0] >= 0], labels[labels >= 0]), np.uint64)
    n = len(lexicon)
    votes = np.zeros((len(rows), n + PATTERNS + 3), bool)
    for i, (_, own, shown) in enumerate(rows):
        votes[i, :n] = np.isin(lexicon, own)
        votes[i, n : n + PATTERNS] = shown
    fired = votes[:, :n].sum(axis=1)
    votes[:, n + PATTERNS :] = np.stack([fired == 0, fired == 1, fired > 1], axis=1)  # that the lexicon is silent is a vote, too
    post, _ = label_model(votes, labels, rate, n)
    weights = logistic(np.c_[votes[:, : n + PATTERNS].astype(float), np.ones(len(rows))], post, ridge=0.01)
    share = np.clip(post.mean(), 1e-6, 1 - 1e-6)
    weights[-1] += base - np.log(share / (1 - share))  # labelled rows were sampled class by class
    return Model({e: i for i, e in enumerate(lexicon.tolist())}, weights)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, label_col: str = "toxic", per_class: int = PER_CLASS, unlabelled: int = UNLABELLED) -> Model:
    """A model from a bounded sample of labelled documents and one of documents whose labels aren't looked at.

    Labels of the held-out remainder are never read. Null ids, labels, texts, ids with several labels and documents
    of more than DOC_BYTES are left out of the samples (never of the scoring); repeated rows count as often as they stand. Without
    labels of both classes every text gets the share of label 1.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            got = [facts(t) for t in batch.column("text").to_pylist()]
            entries = pa.array([entries_in(x[0]).tobytes() for x in got], pa.binary())
            yield pa.record_batch([batch.column("draw"), batch.column("label"), entries, pa.array([x[1] for x in got], pa.list_(pa.bool_()))], names=["draw", "label", "entries", "shown"])

    fits = docs.where(F.octet_length("text") <= DOC_BYTES).withColumn("_text", F.xxhash64("text"))
    known = sample(fits, labels, label_col, modulus, held_out, per_class)
    # texts are chosen by their hashes alone, each once
    drawn = hashed_sample(fits.select("_text"), F.xxhash64("_text"), unlabelled, fits.count()).distinct()
    some = fits.select("_text", "text").join(F.broadcast(drawn), "_text").groupBy("_text").agg(F.first("text").alias("text"))
    taken = known.union(some.select("_text", F.lit(-1), "text")).mapInArrow(learn, "draw long, label int, entries binary, shown array<boolean>")
    rows, size = [], 0
    for r in taken.orderBy(F.col("label").desc(), "draw", "entries").toLocalIterator():
        size += len(r["entries"])
        if size <= SAMPLE_BYTES:
            rows.append((r["label"], np.frombuffer(bytes(r["entries"]), np.uint64), r["shown"]))
    return fit(rows, base_rate(labels, label_col, modulus, held_out))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, from 0 to 1, higher where label 1 is likelier, from the whole text alone.

    Null and empty texts fire no voter and get the score of that; a column of docs of that name gives way. Equal
    texts get equal scores; an empty table stays empty.
    """
    docs, schema = appended(docs, [T.StructField(score_col, T.DoubleType())])
    sent, text_at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), schema.names

    class Fires(dict):
        """The entries that a word fires, remembered for a bounded number of words."""

        def __missing__(self, word: bytes) -> tuple[int, ...]:
            if len(self) >= WORD_CACHE:
                self.clear()
            lexicon = sent.value.lexicon
            got = self[word] = tuple(lexicon[e] for e in entries_of(word) if e in lexicon)
            return got

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fires, w = Fires(), sent.value.weights
        first = len(sent.value.lexicon)
        for batch in sliced(batches, text_at):
            out = []
            for text in batch.column(text_at).to_pylist():
                words, shown = facts(text)
                hit = {i for x in words if (own := fires[x]) for i in own}
                out.append(w[-1] + sum(w[i] for i in hit) + sum(w[first + j] for j, s in enumerate(shown) if s))
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=names)

    return docs.mapInArrow(score, schema)
