"""Shortest paths over an edge table, leg by leg, by distributed relaxation.

Every round relaxes the edges of the nodes whose distance fell: one join of the
frontier with the edges and one grouped minimum. Distances are written between
rounds, so the lineage stays short and executors can be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.scratch import drop, written

MAX_ROUNDS = 10_000


def allowed_edges(edges: DataFrame, limits: dict[str, float] | None = None, obstacles: DataFrame | None = None, flag_mask: int | None = None) -> DataFrame:
    """Edges whose limits (weight, height) admit the vehicle, without blocked ones and those that lack a flag."""
    for column, need in (limits or {}).items():
        edges = edges.filter(F.col(column).isNull() | (F.col(column) >= need))
    if flag_mask is not None:
        edges = edges.filter(F.col("flags").bitwiseAND(F.lit(flag_mask)) == flag_mask)
    return edges.join(obstacles, "edge_id", "left_anti") if obstacles is not None else edges


def nearest_node(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """node and distance of the node nearest to a point (of equally near ones, the least)."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return nodes.agg(F.min(F.struct(d.alias("distance"), "node")).alias("m")).select("m.node", "m.distance")


def distances(edges: DataFrame, start: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, cost, previous, edge_id: the cheapest way from ``start`` to every node reached. Edges: edge_id, source, target, cost >= 0."""
    spark = edges.sparkSession
    edges = edges.select("edge_id", "source", "target", "cost")
    known = spark.createDataFrame([(start, 0.0, None, None)], "node long, cost double, previous long, edge_id long")
    frontier = known
    for _ in range(max_rounds):
        step = frontier.select(F.col("node").alias("source"), F.col("cost").alias("so_far")).join(edges, "source")
        step = step.select(F.col("target").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"), F.col("source").alias("previous"), "edge_id")
        best = step.groupBy("node").agg(F.min(F.struct("cost", "previous", "edge_id")).alias("m")).select("node", "m.cost", "m.previous", "m.edge_id")
        old = known.select("node", F.col("cost").alias("old"))
        better = written(best.join(old, "node", "left").filter(F.col("old").isNull() | (F.col("cost") < F.col("old"))).drop("old"), "better")
        if better.isEmpty():
            return known
        now = written(known.join(better.select("node"), "node", "left_anti").unionByName(better), "known")
        drop(known, *([frontier] if frontier is not known else []))
        known, frontier = now, better
    raise RuntimeError("the relaxation did not settle")


#: Steps of a route that one job walks back.
HOPS = 16


def _walk_back(known: DataFrame, node: int) -> list:
    """node, edge_id and cost of the way to ``node``, from its end; none if it was not reached. Each job takes ``HOPS`` steps."""
    path = []
    columns = F.struct("node", "cost", "edge_id", "previous")
    while node is not None:
        at = known.filter(F.col("node") == node).select(columns.alias("h0"))
        for i in range(1, HOPS):  # one row meets the table, so it is the side to broadcast
            before = known.select(columns.alias(f"h{i}"))
            at = before.join(F.broadcast(at), F.col(f"h{i}.node") == F.col(f"h{i - 1}.previous"), "right")
        row = at.first()
        if row is None:
            return []
        steps = [row[f"h{i}"] for i in range(HOPS) if row[f"h{i}"] is not None]
        path += steps
        node = steps[-1].previous
    return path


def route(edges: DataFrame, stops: list[int]) -> DataFrame:
    """leg, seq, node, edge_id, cost of the cheapest way through the stops; an unreachable stop ends it with no rows for that leg."""
    spark, rows = edges.sparkSession, []
    for leg, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
        path = _walk_back(distances(edges, a), b)
        rows += [(leg, i, r.node, r.edge_id, r.cost) for i, r in enumerate(reversed(path))]
    return spark.createDataFrame(rows, "leg int, seq int, node long, edge_id long, cost double")
