"""Connected components by alternating large and small stars, all of it in joins and aggregates. What few edges are left
after a round (or given) are contracted by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.scratch import drop_stored, stored


#: So few edges are contracted by one task: a few MB, whatever the corpus.
TASK_EDGES = 200_000


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, component) of at most TASK_EDGES edges."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, kind = {}, None

        def top(x: object) -> object:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            kind = batch["a"].type
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                root.setdefault(a, a), root.setdefault(b, b)
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array([*root], kind), pa.array([*map(top, root)], kind)], ["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(contract, f"node {kind}, component {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable, for every node with an edge. Each round is written
    to shared storage; the driver sees only a round's size and checksum."""
    edges = stored(_tidy(edges.select("a", "b")), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] <= TASK_EDGES:
            return stored(_contracted(edges), "components")
        if now == mark:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
        before, edges = edges, stored(_tidy(_small_star(_tidy(_large_star(edges)))), "edges")
        drop_stored(before)
