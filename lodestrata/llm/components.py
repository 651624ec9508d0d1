"""Connected components over an edge table.

Edges are contracted by union-find in tasks of a bounded number of edges, dealt
by both ends: each task replaces its edges by stars on the least node it knows. While more edges
are left than one task may take, an alternating large-star and small-star round
(grouped minima and joins on the node) brings the stars of different tasks
together and the next contraction follows. No unbounded component is ever
gathered in one place; tables are written between rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import drop, materialise, small_enough

#: Edges that one task contracts at most, on average; fixed, whatever the input's size.
TASK_EDGES = 400_000
MAX_ROUNDS = 60


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:  # hang roots on smaller roots, then shorten all paths
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(edges: DataFrame, tasks: int) -> DataFrame:
    def run(batches):
        us, vs = [], []
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
        if us:
            nodes, least = union_find(np.concatenate(us), np.concatenate(vs))
            far = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], ["u", "v"])

    # Dealt by both ends: the edges of one node, a star's centre say, go to all tasks.
    return edges.repartition(tasks, F.xxhash64("u", "v")).mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v: large-star hangs larger neighbours, small-star smaller ones, on the least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # Written, so that the join's sides are plain exchanges, whose hot partitions Spark can split.
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    joined = both.join(F.broadcast(least) if small_enough(least) else least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.filter("u != m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component: the least node reachable, for every node that has an edge to another node.

    Nulls and loops are ignored; repeated edges do no harm; an empty table gives an empty result.
    """
    start = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    at = materialise(start.distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        tasks = max(1, -(-at.count() // task_edges))
        step = materialise(_contract(at, tasks), "edges")
        drop(at)
        at = step
        if tasks == 1:  # all edges met in one bounded task
            break
        step = materialise(_star(_star(at, True).filter("u != v").distinct(), False).filter("u != v").distinct(), "edges")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(at)
        at = step
        if now == seen:  # only stars on least nodes are left
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
