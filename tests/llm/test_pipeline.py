"""The pipeline's stages against their operators' contracts and brute force, on given and on odd tables."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_dedup import brute_hits, brute_lines, words

import corpus_pipeline
from millrace.llm import quality, toxicity
from millrace.llm.common import clean, materialise
from millrace.llm.decontam import decontaminate
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import jaccard_components, keep_one
from millrace.sources import table

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@given
def test_stages(spark, tmp_path):
    docs, sizes = table(spark, SF, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if i < 4:
            assert set(made.columns) == set(docs.columns)
        made.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i == 2:
            apart = jaccard_components(docs, n=5, num=80, den=100)
            assert apart.where("doc_id <> component_id").count() == 0
        if i == 1:
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert sizes[0] == sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > 0
    assert docs.where("taken > 3 * size OR copies < 1").count() == 0


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A data directory: texts of which some are toxic, share lines, are near copies of others or quote the benchmark."""
    rng, root = random.Random(21), tmp_path_factory.mktemp("made")
    line, bench = " ".join(words(rng, 12)), [" ".join(words(rng, n)) for n in (40, 7, 25)]
    texts, toxic = [], []
    for i in range(90):
        own = words(rng, rng.randint(30, 90))
        if i % 10 == 0:
            own[3:3] = ["zounds", "qwertyuiop"]
            own[9:9] = ["yuckyyucky"]
        toxic.append(i % 10 == 0)
        text = " ".join(own[:15]) + ("\n" + line + "\n" if i % 4 == 1 else "\n") + " ".join(own[15:])
        if i % 9 == 2:
            text += " " + bench[i % 3]
        texts.append(text)
        if i % 6 == 3:
            texts.append(text.replace(own[20], own[20] + "x", 1))
            toxic.append(toxic[-1])
    docs = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), docs, toxic, list(enumerate(bench))


def brute_kept(rows: list[tuple], n: int, num: int, den: int) -> set[int]:
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return {i for i, x in label.items() if i == x}


def test_pipeline_against_brute_force(spark, made):
    root, docs, toxic, bench = made
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    clean_ids = {i for (i, *_), bad in zip(docs, toxic, strict=True) if not bad}
    assert {r.doc_id for r in one.collect()} == clean_ids
    two = stages[1](spark, one, root)
    kept = brute_lines([d for d in docs if d[0] in clean_ids])
    assert sorted((r.doc_id, r.text, r.n_chars) for r in two.collect()) == [(i, t, len(t)) for i, _, _, t in kept] and any(n for _, _, n, _ in kept)
    three = stages[2](spark, two, root)
    left = brute_kept([(i, t) for i, _, _, t in kept], 5, 80, 100)
    assert {r.doc_id for r in three.collect()} == left and len(left) < len(kept)
    four = stages[3](spark, three, root)
    hit = {i for i, _, _, _, bad in brute_hits([(i, t) for i, _, _, t in kept if i in left], bench, 13) if bad}
    rest = {r.doc_id: r for r in four.collect()}
    assert set(rest) == left - hit and hit
    last = corpus_pipeline.run(spark, root).collect()
    sizes = {s: sum(len(r.text.split()) for r in rest.values() if r.source == s) for s in "abc"}
    for s, weight in zip("abc", (1, 2, 3), strict=True):
        own = [r for r in last if r.source == s]
        goal = sum(sizes.values()) * weight / 6
        assert all(r.size == len(r.text.split()) and r.taken == r.copies * r.size and 1 <= r.copies <= 3 for r in own)
        assert own[0].target == pytest.approx(goal) and abs(sum(r.taken for r in own) - goal) <= max(len(r.text.split()) for r in rest.values())


def odd(spark):
    rows = [(None, None, None, None, None), (None, "", "xx", None, 0), (1, "one", None, "s", 3), (1, "one", None, "s", 3), (1, "another text under the same id", None, None, 0), (2, "line of a text, that is longer than forty characters, too\n" * 3, "en", "s", None)]
    rows += [(i, "line of a text, that is longer than forty characters, too", "en", "s", 0) for i in range(3, 9)] + [(None, "a few words of a text without any id", "en", "t", 0)] * 2
    return spark.createDataFrame(rows, SCHEMA), rows


@given
def test_stages_take_nulls_and_repeated_rows(spark):
    docs, rows = odd(spark)
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    every = sorted(((i, t) for i, t, *_ in rows), key=repr)
    assert key(one(spark, docs, SF)) == every and key(four(spark, docs, SF)) == every
    lines = two(spark, docs, SF).collect()
    assert len(lines) == len(rows) and sum("line of" in (r.text or "") for r in lines) == 1
    left = key(three(spark, docs, SF))
    assert left.count((1, "one")) == 1 and (1, "another text under the same id") in left and left.count((None, "a few words of a text without any id")) == 1 and (None, None) in left and (None, "") in left
    assert sum("line of" in (t or "") for _, t in left) == 2
    assert five(spark, docs, SF).where("taken > 3 * size OR copies < 1").count() == 0


@given
def test_stages_take_empty_tables(spark):
    none = odd(spark)[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and {"doc_id", "text", "source"} <= set(out.columns)


def test_very_long_texts(spark):
    """Three megabytes of words, a near copy and a copy, whole through every operator on texts."""
    rng = random.Random(31)
    own = words(rng, 3000)
    long = [f"{rng.choice(own)}{rng.randrange(9999)}" for _ in range(330_000)]
    near = list(long)
    near[1000:1005] = ["changed"] * 5
    passage = " ".join(long[200_000:200_030])
    text = lambda w: "\n".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11))
    docs = spark.createDataFrame([(1, text(long), "a"), (2, text(near), "a"), (3, "zounds " + text(long), "b"), (4, passage, "b"), (5, None, None)], "doc_id long, text string, source string")
    joined = {r.doc_id: r for r in jaccard_components(docs).collect()}
    assert [joined[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 5] and joined[1].n_shingles > 329_000
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 4, 5]
    hits = {r.doc_id: r.n_hit for r in decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert hits == {1: 30, 2: 30, 3: 30, 4: 30, 5: 0}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in dedup_lines(docs, min_docs=3).collect()}
    assert lines[1][0] == 30_000 and 29_000 < lines[1][1] <= 30_000 and lines[3][1] <= 2 and lines[5] == (1, 0)
    words_of = {r.doc_id: r.size for r in mix(docs).collect()}
    assert words_of == {1: 330_000, 2: 330_000, 3: 330_001, 4: 30, 5: 0}
    lexicon = {e: 0 for e in toxicity.entries_of(b"zounds")}
    import numpy as np

    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.Model(lexicon, np.array([9.0, 0, 0, 0, 0, -4.0]))).collect()}
    assert scores[3] > 0.9 > 0.1 > scores[1]
    flat = quality.Model(b"", b"", np.zeros(quality.FEATURES))
    assert {r.score for r in quality.score_quality(docs, flat).collect()} == {0.5}


def test_clean_deletes_what_operators_wrote(spark):
    first = materialise(spark.range(3), "test")
    assert first.count() == 3 and clean(spark) >= 1 and clean(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|not_found|PATH"):
        spark.read.parquet(first.inputFiles()[0]).count()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
