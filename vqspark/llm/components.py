"""Connected components of a table of links, by hooking and pointer jumping in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node of its component.

    Every round hooks each node to the smallest label around it and then follows labels once; both sides are written
    to the shared folder, so that rounds don't pile up and survive lost executors. The number of rounds grows with the
    logarithm of a component's diameter, not with its size. Links of null nodes are dropped; no links give no rows.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        # A root takes the smallest label that any of its nodes has seen. Both sides of the join are shuffled tables, so
        # that Spark can split a root with many nodes.
        hooked = durable(hooked)
        roots = durable(hooked.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("up")))
        moved = hooked.join(roots, hooked.root == roots.r).select("node", "root", F.least("low", "up").alias("new"))
        step = durable(moved)
        follow = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        following = durable(step.join(follow, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")))
        labels = following.select("node", "root")
        if following.filter("old <> root").limit(1).count() == 0:
            return labels
