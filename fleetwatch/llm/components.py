"""Connected components of an edge table: union-find inside tasks, least labels between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import dealt, saved


def _forest(frames):
    """Union-find over the edges of one partition: (node, root), at most one row a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([(x, r) for x, r in found if x != r], columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), both long; the component is the smallest node reachable.

    Rounds of: each node takes the least label of its neighbours, then the
    label of its label. Nothing but counts comes to the driver.
    """
    spark = edges.sparkSession
    forest = saved(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInPandas(_forest, "a long, b long"), "forest")
    both = saved(forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(dealt(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(dealt(near), labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        jump = step.select(F.col("node").alias("at"), F.col("component").alias("far"))
        step = saved(step.join(dealt(jump), step["component"] == jump["at"]).select("node", "old", F.least("component", "far").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
