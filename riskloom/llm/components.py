"""Connected components by alternating large-star and small-star contractions.

Edges of numbers can first be contracted where they lie: each task replaces batches of its edges by stars to their smallest
nodes, which keeps what is connected, shortens chains and leaves fewer edges than nodes a batch. Each step writes its minima and
edges to the shared folder, so the loop has no growing lineage and a lost executor costs a re-read. Minima are a written
table of their own: the join with the edges has a plain exchange on both sides (never a broadcast), and adaptive execution
can split a hub's partition. Nothing is collected but a row count and a checksum per iteration.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import scratch

#: Edges that a task contracts at once.
CONTRACTED = 1 << 18


def smallest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, smallest node that each is connected to) of edges between 64-bit numbers."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return nodes, nodes[root]


def _star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    node, root = smallest_of(table.column("u").to_numpy(), table.column("v").to_numpy())
    moved = node > root
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], ["u", "v"])


def _contracted(batches):
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CONTRACTED:
            yield _star(held)
            held = []
    if held:
        yield _star(held)


def _step(edges: DataFrame, both_ways: bool, name: str) -> DataFrame:
    """One star operation on (u, v) rows with u > v."""
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    minima = scratch.stage(arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-minima")
    joined = arcs.join(minima.hint("merge"), "u")
    if both_ways:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(minima.select("u", F.col("m").alias("v")))
    return scratch.stage(moved.where("u > v").distinct(), name)


def components(edges: DataFrame, in_place: bool = False) -> DataFrame:
    """(node, component) for every node of (a, b) edges; the component is its smallest node.

    Self loops, repeated edges and null ends are dropped; no edges give an empty result. ``in_place`` contracts long
    edges where they lie first, in Arrow batches. Only the returned table stays in the shared folder.
    """
    with scratch.scope(edges.sparkSession) as scope:
        ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if in_place:
            ordered = ordered.mapInArrow(_contracted, "u long, v long")
        now = scratch.stage(ordered.distinct(), "component-edges")
        state = None
        while True:
            found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if found == state or not found[0]:
                break
            state = found
            now = _step(_step(now, True, "large-star"), False, "small-star")
        roots = now.select(F.col("v").alias("node")).distinct()
        member = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        return scope.result(member, "components")
