"""Connected components of a graph given as edges, in rounds of two star steps.

Each round joins every node's neighbours to the smallest of them, first the
greater neighbours (large star), then the smaller ones and the node itself
(small star), until nothing changes; every tree then is a star round its
smallest node.  The number of rounds grows with the logarithm of the longest
path.  A node with very many neighbours only meets aggregates with partial
sums and joins whose skewed partitions Spark splits.

Each round is cut by a checkpoint in the shared folder, so lost executors cost
one round at most.  Once no more than ``FEW`` edges are left (counted), one task
joins them instead of further rounds: the result is the same, the table 3 MB,
and the task's own some 60 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import cut, tidy


FEW = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of the one partition."""
    parent: dict = {}

    def root(x):
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = parent[above]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    kind = batch.column(0).type if parent else pa.int64()
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(list(map(root, nodes)), kind)], ["node", "root"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root): root is the smallest node reachable; roots themselves and nodes without edges are left out.

    edges: columns u, v of one sortable type, any order, repeats and loops
    allowed; rows with a null are ignored.
    """
    edges = cut(edges.select("u", "v").where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if now[0] <= few:
            kind = edges.schema["u"].dataType.simpleString()
            return cut(edges.select("u", "v").repartition(1).mapInArrow(tidy(_joined), f"node {kind}, root {kind}"))
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        edges = cut(_small_star(_large_star(edges)))
