"""Connected components of a table of links, by contraction.

Every node points to its least neighbour or itself; links between pointed-to nodes
are the next round's links. The links shrink by at least half in each round that
matters, nothing is collected, and each round is cut from the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b) that has a link; the component is one of its nodes."""
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    steps: list[DataFrame] = []
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")))
        steps.append(step)
        left, right = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        edges = cut(edges.join(left, "a").join(right, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    final = steps.pop().toDF("node", "component")
    while steps:
        step = steps.pop()
        final = step.join(final.toDF("to", "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return final
