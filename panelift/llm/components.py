"""Connected components as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.session import spill


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the undirected ``edges``; nodes of one component share a label.

    Each round every node hooks to the neighbour (or itself) of lowest rank and the edges are
    rewritten to those targets, so the graph shrinks by a constant factor. Ranks are hashes, so long
    sorted chains shrink as fast as stars. A round is written to the shared folder: lost executors cost
    at most one round. Grouped minima combine before the shuffle and the joins stand between plain exchanges,
    where Spark may split a hub's edges, so a hub is no hot task.
    Edges with a null end and loops are ignored (a loop alone still names its node).
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    graph = spill(edges.distinct(), "edges")
    labels = None
    turn = 0
    while True:
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = spill(both.groupBy("a").agg(F.least(rank("a"), F.min(rank("b")))["v"].alias("to")), "hooks")
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            step = hooks.select(F.col("a").alias("label"), "to")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = spill(labels, "labels")
        left = hooks.select("a", F.col("to").alias("ta"))
        right = hooks.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        graph = spill(
            graph.join(left, "a").join(right, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(),
            "edges",
        )
        if graph.isEmpty():
            return labels
