"""Connected components of a graph given as edges, by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnfold.llm.common import forget, stored

# As many edges are joined by one task; more of them are joined in rounds.
SMALL = 1 << 16


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a few edges (a, b)."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    roots = [top(x) for x in above]
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it is linked with.

    Every round takes the smallest label among a node and its neighbours and then the label
    of that label, so that labels travel twice as far each time; it ends when no label changes.
    No more than SMALL edges need no rounds.
    """
    edges = stored(edges.select("a", "b").filter("a <> b"))
    if edges.count() <= SMALL:
        few = stored(edges.repartition(1).mapInArrow(_joined, "node bigint, root bigint"))
        forget(edges)
        return few
    both = stored(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    )
    forget(edges)
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    labels = stored(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        onward = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        following = stored(
            lower.join(onward, "root", "left").select("node", "was", F.least("root", F.coalesce("jump", "root")).alias("root"))
        )
        forget(labels)
        if following.filter("root <> was").isEmpty():
            forget(both)
            return following.select("node", "root")
        labels = following.select("node", "root")
        labels.stored_at = following.stored_at


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) with more links (a, b) between their nodes or new ones; only roots are searched again."""
    side = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    joined = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("moved")), "root", "left")
    old = moved.select("node", F.coalesce("moved", "root").alias("root"))
    return stored(old.union(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")))
