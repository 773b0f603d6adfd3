"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

#: Edges that one task joins by union-find; with more, the steps below are distributed.
LOCAL_EDGES = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}

    def root(x: object) -> object:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.record_batch([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "label"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, label for each end of the edges (columns a, b, of a type with an order): label is the smallest node that edges lead to.

    Up to `local_edges` edges, once counted, one executor joins them. Beyond, this alternates large-star and small-star steps until the edges are stars around their components' smallest nodes.
    Every step is written to the shared folder, so a lost executor costs one step. Loops and repeated edges are fine,
    null ends are ignored, no edges give no rows. A node's neighbours are aggregated, never gathered.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, state = materialise(edges, "cc", light=True), None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        if seen[0] <= local_edges:
            kind = dict(edges.dtypes)["a"]
            return edges.coalesce(1).mapInArrow(_joined, f"node {kind}, label {kind}")
        if seen == state:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        state = seen
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()
        edges = materialise(edges, "cc", light=True)
