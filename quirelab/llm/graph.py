"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.session import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b. Returns (node, component) for every node of a link; component is the least node reachable.

    Every node takes the least of its neighbours and itself as its label, so that nodes of one label are connected through
    it; links between labels make a smaller graph, of which the same is asked. A round at least halves the nodes that are
    left, and a star is done in one. All steps are joins and aggregations that combine before they shuffle; joins are
    between written tables, so that Spark can split a node with very many links. Null ends make no link, repeated links
    and links of a node with itself do no harm, and no links give no rows.
    """
    graph = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    levels = []
    while True:
        both = graph.select(F.col("a").alias("node"), F.col("b").alias("other")).union(graph.select("b", "a"))
        labels = materialise(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("label")), "labels")
        levels.append(labels)
        left, right = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        across = graph.join(left, "a").join(right, "b").where("la <> lb")
        smaller = materialise(across.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), "links")
        discard(graph)
        graph = smaller
        if graph.isEmpty():
            break
    discard(graph)
    found = levels[-1].select("node", F.col("label").alias("component"))
    for level in reversed(levels[:-1]):
        upper = found.select(F.col("node").alias("label"), "component")
        found = level.join(upper, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    found = materialise(found, "components")
    for level in levels:
        discard(level)
    return found
