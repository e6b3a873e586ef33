"""Connected components by contraction, with every round in stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Stages


def connected_components(edges: DataFrame, stages: Stages) -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``edges`` (a, b); null ends and loops are ignored.

    In a round each node points to its smallest neighbour or itself, pointers are followed twice, and
    edges are drawn between the nodes pointed at.  A round at least halves the nodes of each component
    that has an edge left, so it ends after logarithmically many, whatever the shape.  Minima and
    distinct edges are combined before shuffling, so a node with very many edges costs no more than
    they do.
    """
    pair = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current, labels = stages.put(pair, "edges"), None
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        near = stages.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("parent")), "near")
        up = near.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        jumped = stages.put(near.join(up, "parent").select("node", F.col("up").alias("parent")), "jump")
        step = jumped.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        parents = stages.put(jumped.join(step, "parent").select("node", F.col("up").alias("parent")), "parents")
        to_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        drawn = current.join(to_a, "a").join(to_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        following = stages.put(drawn, "edges")
        if labels is None:
            renamed = parents.select("node", F.col("parent").alias("component"))
        else:
            moved = parents.select(F.col("node").alias("component"), F.col("parent").alias("to"))
            renamed = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        before, labels = labels, stages.put(renamed, "labels")
        stages.drop(current, near, jumped, parents, *([before] if before is not None else []))
        current = following
    return labels if labels is not None else current.select(F.col("a").alias("node"), F.col("b").alias("component"))
