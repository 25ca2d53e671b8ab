"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """edges: long a, b. Returns node, component (the smallest node reachable) for every node that has an edge.

    Each round maps a node to the least of itself and its neighbours and contracts the edges by that;
    a component of n nodes is done after about log n rounds. Only counts reach the driver.
    """
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")))
        steps.append(step)
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        edges = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        edges = durable(edges.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
