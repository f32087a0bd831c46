"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that a task merges at a time.
BLOCK = 500_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task, as stars of the components that they make by themselves."""
    parent: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        below = [(x, root(x)) for x in list(parent)]
        below = [(x, r) for x, r in below if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in below], pa.int64()), pa.array([r for _, r in below], pa.int64())], ["v", "u"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= BLOCK:
            yield stars()
            parent.clear()
            seen = 0
    if parent:
        yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have edges.

    Each task first merges the edges it reads and passes on stars, so little is
    left to join. Then rounds: a node's least smaller neighbour becomes its
    parent, its other smaller neighbours become neighbours of that parent, and
    parents are replaced by their parents. A round has two shuffles, of pairs of
    numbers, and is written to the shared folder; the depth halves in each.
    """
    e = materialize(edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).mapInArrow(_merged, "v long, u long").withColumn("moved", F.lit(True)))
    for _ in range(max_rounds):
        near = e.select("v", "u").repartition("v").distinct()
        parent = near.groupBy("v").agg(F.min("u").alias("p"))
        hung = near.join(parent.hint("merge"), "v").select(F.when(F.col("u") == F.col("p"), F.col("v")).otherwise(F.col("u")).alias("v"), "p", (F.col("u") != F.col("p")).alias("moved"))
        over = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        e = materialize(hung.join(over.hint("merge"), "p", "left").select("v", F.coalesce("pp", "p").alias("u"), (F.col("moved") | F.col("pp").isNotNull()).alias("moved")))
        if e.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components didn't settle within {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
