"""Connected components of a link table by contraction.

Each round points every node at the smallest of itself and its neighbours,
follows the pointers to their ends by doubling, and replaces links by links
between ends; links within one end vanish and at most half of the nodes stay,
so both the table and the number of rounds are small. Hot nodes only meet in joins that Spark can split and in partial
minima. Nodes are 16-byte digests (or any orderable key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _links(a, b, links: DataFrame) -> DataFrame:
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return stored(links.where("a <> b").distinct(), "cc-links")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``links`` (a, b)."""
    links, labels = _links("a", "b", links), None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = stored(ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "cc-step")
        moved = True
        while moved:  # to the end of the way down: twice as far each time
            further = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            step = stored(step.join(further, "label").select("node", F.col("label").alias("before"), F.col("further").alias("label")), "cc-step")
            moved = not step.where("label <> before").isEmpty()
            step = step.drop("before")
        if labels is None:
            labels = step
        else:
            labels = stored(labels.withColumnRenamed("label", "old").join(
                step.select(F.col("node").alias("old"), F.col("label").alias("new")), "old", "left").select(
                "node", F.coalesce("new", "old").alias("label")), "cc-labels")
        la, lb = (step.select(F.col("node").alias(s), F.col("label").alias("l" + s)) for s in "ab")
        links = _links("la", "lb", links.join(la, "a").join(lb, "b"))
        if links.isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of a graph after further ``links`` (a, b), by the components of its labels."""
    of = [labels.select(F.col("node").alias(s), F.col("label").alias("l" + s)) for s in "ab"]
    lifted = links.join(of[0], "a", "left").join(of[1], "b", "left").select(
        "a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    lifted = stored(lifted, "cc-lifted")
    merged = components(lifted.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    nodes = labels.unionByName(lifted.select(F.col("a").alias("node"), F.col("la").alias("label"))).unionByName(
        lifted.select(F.col("b").alias("node"), F.col("lb").alias("label"))).distinct()
    new = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return stored(nodes.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "cc-labels")
