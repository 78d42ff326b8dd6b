"""Connected components of an edge list, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the least node of each component.

    Each round takes the least label among neighbours and then the label of that label. Minima
    are combined before each shuffle, so a node with very many neighbours doesn't weigh on one
    task. An empty edge list has no components.
    """
    both = table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = table(step.join(jump, "low", "left").select("node", F.coalesce("far", "low").alias("far"), "low", (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved")).select("node", F.least("low", "far").alias("label"), "moved"), "labels")
        moved = new.where("moved").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            drop(both)
            return labels.select("node", "label")


def star_components(stars: DataFrame) -> DataFrame:
    """(node, label) for the nodes of stars (node, head), of which a node has a bounded number.

    A node that is a head anywhere has itself among its heads. Each node keeps its least head, and its further heads
    are linked to that one: only distinct pairs of heads go through the rounds of ``components``,
    however many nodes share them.
    """
    own = table(stars.groupBy("node").agg(F.array_sort(F.collect_set("head")).alias("heads")), "stars")
    first = F.element_at("heads", 1)
    pairs = own.select(first.alias("a"), F.explode(F.slice("heads", 2, F.size("heads"))).alias("b")).distinct()
    labels = components(pairs).withColumnRenamed("node", "first")
    nodes = own.select("node", first.alias("first"))
    return nodes.join(labels, "first", "left").select("node", F.coalesce("label", "first").alias("label"))
