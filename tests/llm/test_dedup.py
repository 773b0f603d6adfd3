"""Line dedup, substring dedup, n-gram join and decontamination against brute force, with edge cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.decontam import decontaminate, words_of
from millrace.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines
from millrace.llm.ngram_join import PartEnum, jaccard_components, keep_one
from millrace.llm.substring_dedup import Powers, Strings, blocks_in, remove_repeats

DOCS = "doc_id long, text string, lang string, n_words long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed: int = 3) -> list[tuple]:
    """Texts with copies, near copies, shared lines and passages, nulls, empty and repeated rows."""
    rng = random.Random(seed)
    passage, line = " ".join(words(rng, 60)), " ".join(words(rng, 12))
    texts: list[str | None] = [None, "", " \n\t", "one", "One", "two words", "a b c d", "x" * 3000, "ab " * 900, "é" * 150 + " ü " + "é" * 150]
    for _ in range(14):
        own = words(rng, rng.randint(20, 200))
        texts.append(" ".join(own[:10]) + "\n" + line.upper() + "\n" + " ".join(own[10:]))
        if rng.random() < 0.5:
            texts.append(texts[-1])
        if rng.random() < 0.7:
            near = list(own)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        if rng.random() < 0.5:
            texts.append(" ".join(own[:5]) + " " + passage + " " + " ".join(own[5:9]))
    rows = [(i, t, "en", 7) for i, t in enumerate(texts)]
    return [*rows, rows[-1], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def key_of(line: str) -> str:
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def brute_lines(rows: list[tuple]) -> list[tuple]:
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 40:
                held[key_of(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= 40 and len(held[key_of(x)]) >= 5 and max(held[key_of(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"broadcast_key_bytes": 0}, {"broadcast_key_bytes": 0, "broadcast_filter_bytes": -1}])
def test_line_dedup(spark, docs, bounds):
    got = dedup_lines(docs.withColumn("N_Lines", F.lit("clash")), **bounds)
    assert sum(c.lower() == "n_lines" for c in got.columns) == 1
    assert sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == brute_lines(corpus())


def test_line_dedup_empty_table_and_null_ids(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    line = "a line that is certainly longer than forty characters"
    rows = [(None, line, None, None), *[(i, line, None, None) for i in range(4)]]
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {None: "", 0: "", 1: "", 2: "", 3: line}


def test_line_index_is_reversible(spark, docs):
    first, second = docs.where("doc_id < 12"), docs.where("doc_id >= 12")
    whole = LineIndex.build(docs)
    grown = LineIndex.build(first).insert(second)
    assert sorted(map(tuple, grown.table.collect())) == sorted(map(tuple, whole.table.collect()))
    back = grown.delete(second)
    assert sorted(map(tuple, back.table.collect())) == sorted(map(tuple, LineIndex.build(first).table.collect()))
    assert sorted(map(tuple, whole.heavy().collect())) == sorted(map(tuple, grown.heavy().collect()))


def held_by(index: LineIndex, keys: list) -> list[bool]:
    filters = {r.shard: CuckooFilter.load(r.filter) for r in index.filters.collect()}
    return [(f := filters.get(k.h2 % index.shards)) is not None and bool(f.contains(np.array([k.h1], np.int64).view(np.uint64))[0]) for k in keys]


def test_filters_follow_insertions_and_deletions(spark):
    """They hold the heavy keys of each state, whichever documents came and went, and hardly any others."""
    rng = random.Random(14)
    pool = [" ".join(words(rng, 3)) for _ in range(60)]
    docs = spark.createDataFrame([(i, "\n".join(rng.sample(pool, rng.randint(1, 6))), "en", 0) for i in range(60)], DOCS)
    parts = [docs.where(f"doc_id % 3 = {i}") for i in range(3)]
    state, states = LineIndex.build(parts[0], min_chars=5, min_docs=3, shards=4), []
    for move, part in (("insert", 1), ("insert", 2), ("delete", 0), ("insert", 0), ("delete", 1)):
        state = getattr(state, move)(parts[part])
        states.append(state)
    every = {(r.h1, r.h2): r for s in states for r in s.heavy().collect()}
    for state in states:
        heavy = state.heavy().collect()
        assert all(held_by(state, heavy)) and sum(r.n for r in state.filters.collect()) == len(heavy)
        gone = [r for k, r in every.items() if k not in {(h.h1, h.h2) for h in heavy}]
        assert sum(held_by(state, gone)) <= 0.02 * len(gone) + 1
    assert len({len(s.heavy().collect()) for s in states}) > 1


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)
    made = CuckooFilter.build(keys[:4000])
    assert made.contains(keys[:4000]).all()
    assert made.contains(keys[4000:]).mean() < 0.01
    for h in keys[:2000]:
        assert made.delete(int(h))
    assert made.contains(keys[2000:4000]).all()
    again = CuckooFilter.load(made.dump())
    assert again.contains(keys[2000:4000]).all()


def brute_repeats(rows: list[tuple], length: int) -> list[tuple]:
    count: dict[bytes, int] = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in data:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("length", "gram", "most"), [(200, 50, 2048), (60, 20, 2048), (60, 20, 1)])
def test_substring_dedup(spark, docs, length, gram, most):
    got = remove_repeats(docs.withColumn("kept", F.lit(1)), length=length, gram=gram, most_blocks=most)
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert rows == brute_repeats(corpus(), length)


def test_substring_dedup_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_hash_compared_suffix_sort():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    made = Strings(strings, Powers())
    order, common = made.order()
    assert [strings[i] for i in order] == sorted(strings)
    for n, i, j in zip(common.tolist(), order, order[1:], strict=False):
        a, b = strings[i], strings[j]
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def brute_components(rows: list[tuple], n: int, num: int, den: int) -> list[tuple]:
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    label = list(range(len(sets)))

    def root(k: int) -> int:
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                label[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_components(spark, docs, n, num, den):
    got = sorted(tuple(r) for r in jaccard_components(docs, n=n, num=num, den=den).collect())
    assert got == brute_components(corpus(), n, num, den)


def test_keep_one(spark, docs):
    kept = sorted(r.doc_id for r in keep_one(docs, n=4, num=85, den=100).collect())
    assert kept == sorted({c for _, _, c in brute_components(corpus(), 4, 85, 100)})
    assert keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_partenum_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    made = PartEnum(85, 100)
    for size in [*range(1, 30), 57, 120, 333, 900]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).view(np.uint64))
            drop, add = rng.integers(0, size // 8 + 1), rng.integers(0, size // 8 + 1)
            b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 63, add, dtype=np.int64).view(np.uint64)])
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
                assert len(np.intersect1d(made.signatures(a), made.signatures(b))) > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 3)]
    for local in (0, 1000):
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(rows: list[tuple], items: list[tuple], window: int) -> list[tuple]:
    wins = defaultdict(set)
    for name, t in items:
        w = words_of(None if t is None else t.encode())
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            wins[tuple(w[k : k + size])].add(str(name))
    out = []
    for i, t, *_ in rows:
        w = words_of(None if t is None else t.encode())
        hit, names = set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names |= own
        out.append((i, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [2_000_000, 200])
def test_decontamination(spark, docs, block_bytes):
    rows = corpus()
    items = [(1, rows[-4][1]), (10, "two, WORDS!"), (9, None), (11, "-- !"), (2, " ".join((rows[15][1] or "").split()[3:22])), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs.withColumn("n_hit", F.lit("clash")), bench, block_bytes=block_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.hit_items), r.contaminated) for r in got.collect()), key=repr) == brute_hits(rows, items, 13)
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0




def test_pieces_of_a_long_text_have_its_blocks_windows(monkeypatch):
    """However a text is cut, each window is in one block, with the same anchor."""
    text = " ".join(words(random.Random(11), 900)).encode()

    def windows(chunk: int) -> dict:
        monkeypatch.setattr("millrace.llm.substring_dedup.CHUNK", chunk)
        out: dict = {}
        for got in blocks_in([b"short", text, text[:500]], 60, 20, Powers()):
            for t, first, last, at, anchor in zip(got.text.tolist(), got.first.tolist(), got.last.tolist(), got.at.tolist(), got.anchor.tolist(), strict=True):
                for start in range(first, last + 1):
                    assert (t, start) not in out
                    out[t, start] = at - start, anchor
        return out

    whole = windows(1_000_000)
    assert len(whole) == len(text) - 59 + 441 and windows(700) == windows(333) == whole


def test_substring_dedup_of_a_very_long_text(spark):
    rng = random.Random(12)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(220_000)).encode()
    passage = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=350)).encode()
    for mark, at in ((b"1", 10), (b"2", 999_700), (b"3", 2_000_100)):
        text = text[:at] + mark + passage + mark + text[at:]
    got = remove_repeats(spark.createDataFrame([(1, text.decode()), (2, None), (None, "x" + passage.decode())], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_removed, by[1].n_spans) == (1050, 3) and bytes(by[1].kept) == text.replace(passage, b"") and bytes(by[None].kept) == b"x" and by[2].n_bytes == 0
