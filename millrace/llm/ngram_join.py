"""N-gram Jaccard self-join with PartEnum signatures.

A document's set holds its distinct word shingles. Two sets of sizes x <= y with Jaccard similarity of num/den or more
differ in at most (x + y) * (den - num) / (den + num) elements. Sizes are cut into bands; a pair meets in the band of
its larger set, so a set signs for its own band and, where a larger partner may be there, for the next ones.

In a band whose pairs differ in at most k elements, the feature domain is partitioned by hash into n1 first-level
partitions, and each of them into N2 second-level ones. With n1 * (K2 + 1) > k, some first-level partition holds at most
K2 differences, so that the pair agrees in one of its subsets of N2 - K2 second-level partitions. Every such subset is
enumerated; its signature is the hash of what the set has there. n1 is somewhat larger than it needs to be, and of its
subsets a set signs with the fullest only (ties by number): as many as d differences can spoil, and one more, where d is
what its partners in this band can differ by. `spoilt` counts them. The fullest subset in which a pair agrees is among
either set's, because only spoilt subsets can stand before it. That keeps empty subsets, and those with little more than a
passage that many texts share, from joining unlike sets.

Sets that share a signature are a group. Groups never become all their pairs:

1. Each set is compared with the smallest of its groups' smallest members (hubs). Linked sets take their hub's label.
2. Groups whose members have several labels stay open; of groups with the same members one stays. Sets that open groups
   connect are a cluster. A cluster's largest label and its other members are dealt into blocks by hash, and each block
   of others meets each block once, within one task that compares what has different labels. Where that would move more
   rows than the cluster's groups have (clusters that hang together by many small groups of unlike sets), the groups
   themselves meet, in blocks too where they are large. Blocks are bounded in sets and in elements.
3. The links of both steps make the components.

What is compared are the sets themselves, exactly. Equal sets are one class from the start. Shingles and classes are
compared by 64-bit hashes. Rows of a group (16 bytes each) are streamed in order; nothing is held for a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WordHashes, bounded_join, grams, materialise, mix, signed, texts, word_hashes
from millrace.llm.components import components

#: Signatures and elements that leave Python at once.
EMIT = 200_000
#: Second-level partitions, of which a subset leaves out K2; first-level partitions for each possible difference; bands.
N2, K2, SLACK, BAND_STEPS = 3, 1, 0.6, 2
#: Sets and elements of a block; buckets of a set's histogram.
BLOCK, BLOCK_ELEMENTS, BUCKETS = 192, 2_000_000, 256
#: Classes that a task remembers, so that it handles equal sets once.
REMEMBERED = 500_000


def shingles(text: bytes | None, n: int, ids: WordHashes) -> np.ndarray:
    """The sorted hashes of the distinct n-word shingles; the whole text's where it has fewer words, none without words."""
    words = word_hashes(text or b"", ids)
    return np.unique(grams(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def set_hash(elements: np.ndarray) -> np.uint64:
    return mix(np.array([mix(elements ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(elements))], np.uint64))[0]


def class_of(elements: np.ndarray) -> int:
    """The class of equal sets, as a signed long."""
    return int(set_hash(elements).view(np.int64))


def spoilt(n1: int, d: int) -> int:
    """Subsets in which two sets can disagree that differ in d elements: a partition's first difference leaves only the subset without it whole."""
    return d * (N2 - 1) if d <= n1 else min(n1 * N2, n1 * (N2 - 1) + d - n1)


class PartEnum:
    """The signatures for one threshold, num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.edges = [(1, 1)]  # smallest and largest size of each band

    def band(self, size: int) -> int:
        while self.edges[-1][1] < size:
            low = self.edges[-1][1] + 1
            high = low
            for _ in range(BAND_STEPS):
                high = high * self.den // self.num
            self.edges.append((low, max(low, high)))
        lo, hi = 0, len(self.edges) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.edges[mid][1] >= size else (mid + 1, hi)
        return lo

    def apart(self, total: int) -> int:
        """Elements that two similar sets of `total` elements together may differ in."""
        return total * (self.den - self.num) // (self.den + self.num)

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        size = len(elements)
        if not size:
            return np.empty(0, np.uint64)
        largest = size * self.den // self.num
        v = mix(elements + np.uint64(0x632BE59BD9B4E019))
        low, high, place = (v & np.uint64(0xFFFFFFFF)).astype(np.float64), (v >> np.uint64(32)).astype(np.float64), elements >> np.uint64(32)
        out = []
        for band in range(self.band(size), self.band(largest) + 1):
            top = self.edges[band][1]
            k = self.apart(2 * top)
            if not k:  # only equal sets are similar
                out.append(mix(np.array([v.sum(dtype=np.uint64) + np.uint64(band)], np.uint64)))
                continue
            n1 = int(np.ceil(SLACK * (k + 1)))
            part = ((place * np.uint64(n1 * N2)) >> np.uint64(32)).astype(np.int64)
            # of each subset of N2 - K2 partitions, that is all but one: how many elements it has, and the sums of their hashes
            count, a, b = (x.reshape(n1, N2) for x in (np.bincount(part, minlength=n1 * N2), np.bincount(part, low, n1 * N2).astype(np.uint64), np.bincount(part, high, n1 * N2).astype(np.uint64)))
            count, a, b = ((x.sum(axis=1, keepdims=True) - x).ravel() for x in (count, a, b))
            keep = min(n1 * N2, spoilt(n1, self.apart(size + min(largest, top))) + 1)
            full = np.argsort(count, kind="stable")[n1 * N2 - keep :]
            out.append(mix(a[full] + mix(b[full] + (full.astype(np.uint64) + np.uint64((band + 1) << 32)) * np.uint64(0xD6E8FEB86659FD93))))
        return np.concatenate(out)


def multi_groups(rows: DataFrame) -> DataFrame:
    """sig, cls, hub: of rows (sig, cls), each once, those whose sig is with two or more different cls; hub is the sig's smallest cls.

    Rows are streamed in order; one is held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig0 = hub0 = last = None  # the last row's group, its hub, and the row's class
        alone = False  # whether that row is the only one of its group so far, and not given out
        for batch in batches:
            sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
            new[0] = sig0 is None or (sig[0], cls[0]) != (sig0, last)
            sig, cls = sig[new], cls[new]
            if not len(sig):
                continue
            goes_on = sig0 is not None and not alone and sig[0] == sig0
            if alone:
                sig, cls = np.r_[sig0, sig], np.r_[last, cls]
            start = np.r_[True, sig[1:] != sig[:-1]]
            first = np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))
            hub = cls[first]
            keep = np.r_[False, ~start[1:]] | np.r_[~start[1:], False]
            if goes_on:
                hub[first == 0], keep[0] = hub0, True
            sig0, hub0, last, alone = sig[-1], hub[-1], cls[-1], not keep[-1]
            yield pa.record_batch([pa.array(x[keep]) for x in (sig, cls, hub)], names=["sig", "cls", "hub"])

    return rows.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(run, "sig long, cls long, hub long")


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, labels: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def histogram(elements: np.ndarray) -> np.ndarray:
    """Elements in each bucket of their hash, 255 at most: what two of them differ by, the sets differ by at least."""
    return np.minimum(np.bincount((elements.view(np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def settle(members: list[tuple], num: int, den: int, first: int | None = None) -> list[tuple[int, int]]:
    """Links (pairs of classes) that join the members (class, label, sorted elements) as all their links would; with
    `first`, as all links between the first so many and the others would."""
    sizes = np.array([len(m[2]) for m in members])
    shape = np.stack([histogram(m[2]) for m in members]).astype(np.int16)
    forest, out = Forest([m[1] for m in members]), []
    for i in range(len(members) - 1 if first is None else first):
        rest = np.arange(i + 1 if first is None else first, len(members))
        total = sizes[i] + sizes[rest]
        near = (np.minimum(sizes[i], sizes[rest]) * den >= np.maximum(sizes[i], sizes[rest]) * num) & (np.abs(shape[rest] - shape[i]).sum(axis=1) * (den + num) <= total * (den - num))
        for j in rest[near].tolist():
            a, b = forest.root(i), forest.root(j)
            if a != b and len(np.intersect1d(members[i][2], members[j][2], assume_unique=True)) * (den + num) >= (sizes[i] + sizes[j]) * num:
                forest.up[max(a, b)] = min(a, b)
                out.append((members[i][0], members[j][0]))
    return out


def upto(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def meetings(rows: DataFrame) -> DataFrame:
    """task, side, cls, label: of rows (kind, of, cls, label, main, others, mains), dealt by hash into `others` and `mains` blocks,
    each block of others meets each block of mains, each other one of others, and itself."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    own, p = F.col("block"), F.col("p")
    met = [
        ("NOT main AND mains > 0", upto(F.col("mains")), own, "m", p, 1),
        ("main AND others > 0", upto(F.col("others")), p, "m", own, 2),
        ("NOT main", F.sequence(own, F.col("others") - 1), own, "o", p, 1),
        ("NOT main AND block > 0", upto(own), p, "o", own, 2),
    ]
    parts = [rows.where(who).withColumn("p", F.explode(each)).select(F.xxhash64("kind", "of", a, F.lit(how), b).alias("task"), F.lit(side).alias("side"), "cls", "label") for who, each, a, how, b, side in met]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def link_groups(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """node, label: the components that links make among the members of groups (sig, cls, hub); sets has cls, n and elements."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (task, side, cls, label, elements) in order of task and side: side 1 meets side 2, or side 1 itself where there is no other.

        Two tasks under one hash would be taken for one, which compares more and misses only what sides 1 or 2 have among themselves."""
        task, members, first, out = None, [], 0, []

        def met() -> list[tuple[int, int]]:
            return settle(members, num, den, first if first < len(members) else None) if len(members) > 1 and first else []

        for batch in batches:
            elements = batch.column(4)
            for i, (t, side, c, label) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if t != task:
                    out += met()
                    task, members, first = t, [], 0
                members.append((c, label, elements[i].values.to_numpy()))
                first += side == 1
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out = []
        out = met()
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # most members are linked by one comparison: that with the smallest of all their hubs
    first = groups.groupBy("cls").agg(F.min("hub").alias("hub")).where("cls <> hub").join(sets.select("cls", "n", "elements"), "cls")
    hubs = sets.select(F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("elements").alias("hub_elements"))
    near = first.join(hubs, "hub").where((F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num) & (F.size(F.array_intersect("elements", "hub_elements")) * (den + num) >= (F.col("n") + F.col("hub_n")) * num))
    links = materialise(near.select(F.col("cls").alias("a"), F.col("hub").alias("b")), "jaccard-links", light=True)
    labels = links.select("a", "b").join(links.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("cls"), F.coalesce("c", "b").alias("label"))

    marked = groups.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    # groups of the same members (by two hashes) need to be looked at once
    facts = [F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("cls")).alias("f0"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("f1")]
    open_ = marked.groupBy("sig").agg(*facts).where("l0 < l1").groupBy("members", "f0", "f1").agg(F.min("sig").alias("sig")).select("sig", "members")
    placed = materialise(marked.join(open_, "sig"), "jaccard-open", light=True)
    clusters = components(placed.select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    held = clusters.select(F.col("node").alias("cls"), F.col("label").alias("cluster")).join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")).join(sets.select("cls", "n"), "cls")
    held = materialise(held, "jaccard-held", light=True)

    def block(largest: Column) -> Column:
        return F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_ELEMENTS) / largest)))

    counts = held.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("size"))
    plan = counts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.max("size").alias("size")).withColumn("block", block(F.col("size")))
    plan = plan.select("cluster", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / F.col("block")).alias("others"), F.ceil(F.col("top.n") / F.col("block")).alias("mains"), "all", F.col("top.n").alias("n"))
    moved = F.col("n") * F.col("others") + (F.col("all") - F.col("n")) * (F.col("mains") + F.col("others"))
    rows = placed.join(held.select("cls", "cluster", "n"), "cls")
    plan = materialise(plan.join(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")), "cluster").withColumn("blocks", moved <= 2 * F.col("rows")), "jaccard-plan", light=True)
    whole = held.join(plan.where("blocks"), "cluster").select(F.lit("c").alias("kind"), F.col("cluster").alias("of"), "cls", "label", (F.col("label") == F.col("top")).alias("main"), "others", "mains")
    rest = rows.join(plan.where("NOT blocks").select("cluster"), "cluster", "left_semi")
    largest = rest.groupBy("sig").agg(F.max("n").alias("size"))
    rest = rest.join(largest, "sig").select(F.lit("g").alias("kind"), F.col("sig").alias("of"), "cls", "label", F.lit(False).alias("main"), F.ceil(F.col("members") / block(F.col("size"))).alias("others"), F.lit(0).cast("long").alias("mains"))
    fed = meetings(whole.union(rest)).join(sets.select("cls", "elements"), "cls").select("task", "side", "cls", "label", "elements")
    settled = fed.repartition("task").sortWithinPartitions("task", "side", "cls").mapInArrow(compare, "a long, b long")
    return components(links.union(materialise(settled, "jaccard-settled")))


def judged_rows(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, cls (hash of the shingle set, null without shingles), component_id and stays for each row of docs.

    `stays` is true of the rows without shingles and, in each component, of the rows with its smallest id (null last)
    and, of that id's sets in the component, the smallest cls. Components may share their smallest id.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    scheme = (num, den)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordHashes()
        for batch in batches:
            sizes, cls = [], []
            for text in texts(batch.column(2)):
                own = shingles(text, n, ids)
                sizes.append(len(own))
                cls.append(class_of(own) if len(own) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(cls, pa.int64())], names=["doc_id", "key", "n_shingles", "cls"])

    kind = dict(docs.dtypes)["doc_id"]
    measured = materialise(docs.select("doc_id", "key", "text").mapInArrow(measure, f"doc_id {kind}, key long, n_shingles long, cls long"), "jaccard-docs")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made = WordHashes(), PartEnum(*scheme)
        seen: set[int] = set()  # equal sets of a task sign once
        sigs, classes, held = [], [], 0

        def out() -> pa.RecordBatch:
            none = [np.empty(0, np.uint64)]
            return pa.record_batch([pa.array(signed(np.concatenate(sigs or none))), pa.array(np.concatenate(classes or [np.empty(0, np.int64)]))], names=["sig", "cls"])

        for batch in batches:
            for text in texts(batch.column(0)):
                own = shingles(text, n, ids)
                if not len(own) or (c := class_of(own)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                sigs.append(made.signatures(own))
                classes.append(np.full(len(sigs[-1]), c, np.int64))
                held += len(sigs[-1])
                if held >= EMIT:
                    yield out()
                    sigs, classes, held = [], [], 0
        yield out()

    groups = materialise(multi_groups(docs.select("text").mapInArrow(sign, "sig long, cls long")), "jaccard-groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = materialise(measured.where("cls IS NOT NULL").groupBy("cls").agg(least.alias("least")), "jaccard-classes", light=True)
    active = classes.join(groups.select("cls").distinct(), "cls").select("cls", F.col("least.doc_id").alias("_least"), F.col("least.key").alias("_key"))
    active = materialise(active, "jaccard-active", light=True)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordHashes()
        seen: set[int] = set()  # repeated rows of a task are given out once

        def out() -> pa.RecordBatch:
            ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            return pa.record_batch([pa.array(cls, pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "n", "elements"])

        for batch in batches:
            cls, rows, held = [], [], 0
            for c, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = shingles(text, n, ids)
                if c in seen or not len(own) or class_of(own) != c:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                cls.append(c)
                rows.append(signed(own))
                held += len(own)
                if held >= EMIT:
                    yield out()
                    cls, rows, held = [], [], 0
            yield out()

    same = F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("key") == F.col("_key"))
    chosen = bounded_join(docs, active, same, "inner")
    # a row that stands several times may come from several tasks; what is compared twice gives the same links
    sets = materialise(chosen.select("cls", "text").mapInArrow(elements, "cls long, n long, elements array<long>"), "jaccard-sets")
    labels = link_groups(groups, sets, num, den).select(F.col("node").alias("cls"), "label")

    # written tables meet here, so that a class or component with many rows is split between tasks
    linked = materialise(classes.join(labels, "cls"), "jaccard-linked", light=True)
    smallest = linked.groupBy("label").agg(F.min(F.struct(F.col("least.none").alias("none"), F.col("least.doc_id").alias("doc_id"), "cls")).alias("f"))
    first = linked.select("cls", "label").join(materialise(smallest, "jaccard-smallest", light=True), "label").select("cls", "f")
    judged = classes.join(first, "cls", "left").select(F.col("cls").alias("_cls"), F.coalesce("f.doc_id", "least.doc_id").alias("_component"), F.coalesce(F.col("f.cls") == F.col("cls"), F.lit(True)).alias("_first"))
    judged = materialise(judged, "jaccard-decided", light=True)
    rows = measured.join(judged, F.col("cls") == F.col("_cls"), "left")
    stays = F.col("cls").isNull() | (F.col("_first") & F.col("doc_id").eqNullSafe(F.col("_component")))
    return rows.select("doc_id", "key", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"), stays.alias("stays"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach, the own included) for each row of docs.

    Two rows link when den * intersection >= num * union of their shingle sets. Null and empty texts, and texts
    without words, have no shingles and link with nothing: their component is their own id. Rows that share an id are
    separate documents. A null id is passed over as component id unless all ids are null. An empty table gives an empty
    table; other columns are ignored.
    """
    return judged_rows(docs, id_col, text_col, n, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """docs with one document of each component, that with the smallest id (null last); documents without words all stay.

    Rows that share an id are separate documents: rows are told apart by id and text, and of several rows with the same
    id and shingle set that would stay, one does (that with the smallest text hash). An empty table gives an empty
    table; other columns stay as they are.
    """
    judged = materialise(judged_rows(docs, id_col, text_col, n, num, den), "jaccard-judged")
    again = judged.where("stays AND cls IS NOT NULL").groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("least")).where("rows > 1")
    gone = judged.where("NOT stays").select("doc_id", "key")
    repeats = not again.isEmpty()
    if repeats:
        other = again.select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls"), "least")
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("cls") == F.col("_cls"))
        gone = gone.union(judged.where("stays").join(other, same).where("key <> least").select("doc_id", "key"))
    gone = materialise(gone.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_key")).distinct(), "jaccard-gone", light=True)
    rows = docs.withColumn("_key", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    out = bounded_join(rows, gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    if repeats:
        bare = judged.where("cls IS NULL").select(F.col("key").alias("_bare")).distinct()  # documents without words aren't copies
        alone = F.when(F.col("_bare").isNotNull(), F.monotonically_increasing_id())
        out = out.join(bare, F.col("_key") == F.col("_bare"), "left").withColumn("_alone", alone).dropDuplicates([id_col, "_key", "_alone"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
