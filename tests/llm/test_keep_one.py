"""keep_one where ids are shared by unlike texts, repeated or null, against brute force over rows."""

from __future__ import annotations

import random

import pytest

from millrace.llm.ngram_join import keep_one

NUM, DEN, N = 80, 100, 3


def text(rng: random.Random) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmno") for _ in range(5)) for _ in range(60)]


def near(words: list[str]) -> list[str]:
    return [*words[:-1], "changed"]


def brute(rows: list[tuple]) -> tuple[list[list[int]], list[int]]:
    """Numbers of the rows of each component, and of the rows without words."""
    sets = [{tuple(w[k : k + N]) for k in range(max(1, len(w) - N + 1))} if (w := (t or "").lower().split()) else set() for _, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and DEN * len(sets[a] & sets[b]) >= NUM * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    worded = [i for i in range(len(rows)) if sets[i]]
    return [[i for i in worded if label[i] == x] for x in sorted({label[i] for i in worded})], [i for i in range(len(rows)) if not sets[i]]


def held(spark, rows: list[tuple]) -> None:
    """Each component keeps one row, which has its smallest id (null last); rows without words all stay; rows' number tells them apart."""
    kept = [r.row for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string, row long"), n=N, num=NUM, den=DEN).collect()]
    groups, bare = brute(rows)
    assert len(kept) == len(groups) + len(bare) and set(bare) <= set(kept)
    for group in groups:
        stays = [i for i in group if i in kept]
        assert len(stays) == 1
        ids = [rows[i][0] for i in group]
        assert rows[stays[0]][0] == min((x for x in ids if x is not None), default=None)


def numbered(rows: list[tuple]) -> list[tuple]:
    return [(i, None if t is None else " ".join(t), k) for k, (i, t) in enumerate(rows)]


def test_unlike_texts_under_one_id(spark):
    rng = random.Random(1)
    a, b = text(rng), text(rng)
    held(spark, numbered([(3, a), (5, near(a)), (5, b)]))


def test_a_repeated_row_leaves_other_ids_alone(spark):
    rng = random.Random(2)
    a, b, c, d, e = (text(rng) for _ in range(5))
    held(spark, numbered([(1, a), (1, a), (2, b), (2, c), (None, d), (None, e), (None, None), (None, []), (7, []), (7, [])]))


def test_copies_under_null_ids(spark):
    rng = random.Random(3)
    a, b, c = (text(rng) for _ in range(3))
    held(spark, numbered([(None, a), (None, a), (None, near(a)), (4, b), (None, b), (None, near(b)), (None, c), (9, None)]))


@pytest.mark.parametrize("seed", [4, 5])
def test_random_ids(spark, seed):
    rng = random.Random(seed)
    texts = [text(rng) for _ in range(8)]
    texts += [near(t) for t in texts[:5]] + [[], None]
    held(spark, numbered([(rng.choice([None, None, 1, 2, 3, 4, 5]), rng.choice(texts)) for _ in range(40)]))
