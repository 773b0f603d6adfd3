"""Mixing sources to target weights by entropy balancing.

The documents' rates r minimise the entropy distance to 1, the sum of r log r - r + 1 over all documents, under one
token constraint for each source: its documents' words times rates add up to the source's target. No rate passes
`most`. The solution tilts every document exponentially by its words: r = min(most, exp(m * words / mean words)), with
one multiplier m for each source. The convex dual is solved by Newton iterations, whose gradient and Hessian are sums
over the documents (of which those of one source and size are added up beforehand, exactly); a bracket keeps each
step where the dual's slope changes sign. All of it is tables: sources are never brought to the driver.

Rates become whole copies by error diffusion: the documents of a source are dealt over blocks by a hash of their id;
in each block, from the longest to the shortest, each takes the copies that bring the words taken closest to the
words due. Documents longer than a whole block on average come first, in blocks of their own; what they are over or short
is due in proportion in all other blocks, and what those are over or short in block 0, which comes last. What is left
then is about half of that block's shortest document, unless its documents' words can't make up for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended, bounded_join, materialise

WEIGHTS, MOST, BLOCK_ROWS = (1, 2, 3), 3, 1_000
#: Newton iterations at most, and the share of its target that a source's words may be off when they end.
NEWTON_STEPS, CLOSE = 60, 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with target: all words shared by weight, none above `most` times its size.

    Weights repeat over the sources in order of code points, null last. The order is found without one task for all:
    sources are range-partitioned, and each partition's rows are numbered after those before it.
    """
    ranked = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranked = materialise(ranked.withColumn("_at", F.monotonically_increasing_id()), "mix-sources", light=True)
    counts = {r["p"]: r["n"] for r in ranked.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    before, start = {}, 0
    for p in sorted(counts):
        before[p], start = start, start + counts[p]
    base = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.shiftright("_at", 33)] if before else F.lit(0)
    rank = base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", share).withColumn("cap", F.col("source_size").cast("double") * most).drop("_at")

    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the capped sources only become more; each round is one aggregate over the sources
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        got = weighed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        raised = (total - got["full"]) / got["rest"] if got["rest"] else level
        if raised <= level * (1 + 1e-15):
            break
        level = raised
    return weighed.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).select("source", "source_size", "target")


def tilt(size: Column, mean: Column, m: Column, most: float) -> Column:
    """A document's rate; a null multiplier stands for infinity."""
    return F.when(m.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(m * size / mean, F.lit(50.0)))))


def multipliers(sizes: DataFrame, targets: DataFrame, most: float = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """targets (source, source_size, target) with mean (words of a document) and m: by Newton's iterations over sizes (source, size).

    m is null where every document goes `most` times, 0 for sources without words or target.
    """
    heaps = sizes.where("size > 0").groupBy(F.col("source").alias("_s"), "size").agg(F.count(F.lit(1)).alias("n"))
    heaps = materialise(heaps, "mix-heaps", light=True)
    of = F.col("source").eqNullSafe(F.col("_s"))
    w = F.col("size").cast("double")
    facts = heaps.groupBy("_s").agg((F.sum(w * F.col("n")) / F.sum("n")).alias("mean"), F.sum(w * w * F.col("n")).alias("squares"))
    share = F.try_divide("target", "source_size")
    state = targets.join(facts, of, "left").drop("_s")
    full = share >= most * (1 - 1e-12)
    # the first step as if all documents were as long as the mean word's
    start = F.when(full, None).when(share > 0, F.log(share) * F.col("mean") * F.col("source_size") / F.col("squares")).otherwise(0.0)
    state = state.select("source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), start.alias("m"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (full | ~(share > 0) | share.isNull()).alias("done"))
    state = materialise(state, "mix-dual", light=True)
    for _ in range(steps):
        if state.where("NOT done").isEmpty():
            break
        # one aggregate over the documents: words that the present rates take, and the slope of that
        open_ = state.where("NOT done").select(F.col("source").alias("_of"), "mean", "m")
        x = F.col("m") * w / F.col("mean")
        taken = w * F.col("n") * tilt(w, F.col("mean"), F.col("m"), most)
        sums = heaps.join(open_, F.col("_s").eqNullSafe(F.col("_of"))).groupBy("_s").agg(F.sum(taken).alias("words"), F.sum(F.when(x < F.log(F.lit(float(most))), taken * w / F.col("mean")).otherwise(0.0)).alias("slope"))
        over = F.col("words") - F.col("target")
        state = state.join(sums, of, "left").withColumn("over", F.coalesce(over, F.lit(0.0)))
        state = state.withColumn("lo", F.when(F.col("over") < 0, F.greatest("lo", "m")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("over") > 0, F.least("hi", "m")).otherwise(F.col("hi")))
        newton = F.col("m") - F.try_divide("over", "slope")
        inside = (F.col("slope") > 0) & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        # outside the bracket: its middle, or twice as far where one end is open yet
        middle = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).when(F.col("lo").isNull(), F.col("m") - 1 - F.abs("m")).otherwise(F.col("m") + 1 + F.abs("m"))
        tight = (F.col("hi") - F.col("lo")) <= 1e-14 * (F.abs("hi") + F.abs("lo"))
        done = F.col("done") | (F.abs("over") <= CLOSE * F.col("target")) | F.coalesce(tight, F.lit(False))
        m = F.when(done, F.col("m")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle)
        state = materialise(state.select("source", "source_size", "target", "mean", m.alias("m"), "lo", "hi", done.alias("done")), "mix-dual", light=True)
    return state.select("source", "source_size", "target", "mean", "m")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", size_col: str | None = None, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """docs with size (words of text_col, or size_col where given), source_size, target, copies (0 to most) and taken (copies * size).

    Null texts have size 0; documents without words are taken once where their source's rate is at least a half. A
    null source is a source of its own, the last. Rows that share an id are separate documents. An empty table gives
    an empty table. Columns of docs with these names give way to ours. Reruns agree: nothing depends on partitions.
    """
    kinds = {"size": T.LongType(), "source_size": T.LongType(), "target": T.DoubleType(), "copies": T.IntegerType(), "taken": T.LongType()}
    docs, _ = appended(docs, [T.StructField(k, v) for k, v in kinds.items()])
    sized = docs.withColumn("size", word_count(F.col(text_col)) if size_col is None else F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    # rows with ids of their own are decided on without their other columns, which then come back by id
    narrow = sized.select(F.col(f"`{id_col}`").alias("_mix_id"), F.col(f"`{source_col}`").alias("_mix_from"), "size")
    narrow = materialise(narrow, "mix-sizes")
    sums = narrow.groupBy(F.col("_mix_from").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sums = materialise(sums, "mix-sums", light=True)
    rates = multipliers(narrow.select(F.col("_mix_from").alias("source"), "size"), source_targets(sums.select("source", "source_size"), weights, most), most)
    rates = rates.join(sums.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), "source_size", "target", F.col("mean").alias("_mean"), F.col("m").alias("_m"), F.col("rows").alias("_rows"))
    rates = materialise(rates, "mix-rates", light=True)
    n = narrow.count()
    apart = n == narrow.select("_mix_id").distinct().count()
    if apart:
        carried, key, origin = narrow.select("_mix_id", "_mix_from", "size"), "_mix_id", "_mix_from"
        kept = ["_mix_id", "_mix_from"]
    else:
        carried, key, origin = sized, id_col, source_col
        kept = docs.columns
    joined = carried.join(rates, F.col(f"`{origin}`").eqNullSafe(F.col("_source")), "left")
    draw = F.xxhash64(F.col(f"`{key}`").cast("string"))
    rate = F.when((F.col("target") > 0) & (F.col("size") > 0), tilt(F.col("size"), F.col("_mean"), F.col("_m"), most)).otherwise(F.try_divide("target", "source_size"))
    blocks = F.ceil(F.col("_rows") / F.lit(block_rows))
    # documents longer than a block is on average: at most one for each block
    long_ = (blocks > 1) & (F.col("size") > F.col("source_size") / blocks)
    joined = joined.withColumn("_long", long_).withColumn("_block", F.pmod(draw, F.when(long_, F.ceil(blocks / F.lit(block_rows))).otherwise(blocks))).withColumn("_draw", draw).withColumn("_rate", F.coalesce(rate, F.lit(0.0)))
    joined = joined.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", "_rate", "_source", "_block", "_draw", "_long")
    order = ["_source", "_block", F.col("size").desc(), "_draw", *([] if apart or text_col is None else [F.xxhash64(F.col(f"`{text_col}`").cast("string"))])]
    width = len(kept)
    schema = T.StructType([*carried.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *[T.StructField(k, v) for k, v in kinds.items()]])
    out_names = schema.names

    def diffuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, due, got = object(), 0.0, 0
        for batch in batches:
            size, _, _, rate, source, block = (c.to_pylist() for c in batch.columns[width : width + 6])
            copies = []
            for i, w in enumerate(size):
                if (source[i], block[i]) != at:
                    at, due, got = (source[i], block[i]), 0.0, 0
                due += w * rate[i]
                k = min(most, max(0, int((due - got) / w + 0.5))) if w else int(rate[i] >= 0.5)
                got += k * w
                copies.append(k)
            taken = [k * w for k, w in zip(copies, size, strict=True)]
            yield pa.record_batch([*batch.columns[: width + 3], pa.array(copies, pa.int32()), pa.array(taken, pa.int64())], names=out_names)

    origin = origin if apart else source_col
    decided: DataFrame | None = None
    stages = ("_long", "NOT _long AND _block > 0", "NOT _long AND _block = 0")
    for i, who in enumerate(stages):
        rows = joined.where(who)
        if decided is not None:  # what is due now: the target less what was taken, in proportion to the rates of all that is left
            left = joined.where(" OR ".join(f"({x})" for x in stages[i:])).groupBy("_source").agg(F.sum(F.col("size") * F.col("_rate")).alias("words"), F.first("target").alias("goal"))
            got = decided.groupBy(F.col(f"`{origin}`").alias("_from")).agg(F.sum("taken").alias("got"))
            scale = F.greatest(F.lit(0.0), F.try_divide(F.col("goal") - F.coalesce("got", F.lit(0)), F.col("words")))
            left = left.join(got, F.col("_source").eqNullSafe(F.col("_from")), "left").select(F.col("_source").alias("_of"), scale.alias("_scale"))
            scaled = F.when(F.col("size") > 0, F.col("_rate") * F.coalesce("_scale", F.lit(1.0))).otherwise(F.col("_rate"))
            rows = rows.join(left, F.col("_source").eqNullSafe(F.col("_of")), "left").withColumn("_rate", scaled).drop("_of", "_scale")
        rows = rows.drop("_long").repartition("_source", "_block").sortWithinPartitions(*order).drop("_draw").mapInArrow(diffuse, schema)
        rows = materialise(rows, "mix-copies")
        decided = rows if decided is None else decided.union(rows)
    if not apart:
        return decided
    return bounded_join(docs, decided.drop("_mix_from"), F.col(f"`{id_col}`").eqNullSafe(F.col("_mix_id")), "inner").drop("_mix_id")
