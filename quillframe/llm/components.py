"""Connected components of links, without bringing them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillframe.llm.common import drop_stored, store


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b); component: its smallest node.

    Each round a node takes the smallest label among its neighbours' and its label's
    label; labels halve their distance to the smallest, so rounds grow with the
    logarithm of a component's width.  Rounds are stored tables, so lost executors
    repeat no earlier round.  Links are not null; repeated ones count once, a link of a node with
    itself makes it a node, and no links give no rows.  Other columns than a and b are ignored.
    """
    ends = store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", False)
    labels = store(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels", False)
    while not links.isEmpty():
        near = ends.join(labels, ends.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        took = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("then"))
        new = store(took.join(jump, "now", "left").select("node", "was", F.least("now", "then").alias("component")), "labels", False)
        old, labels = labels, new.select("node", "component")
        drop_stored(old)
        if new.where("was <> component").isEmpty():
            break
    drop_stored(ends)
    return labels
