"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.batches import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of the links ``a, b``: root is the smallest node of its component.

    Each round every node takes the smallest root among its neighbours, hands it to the node that it
    took as root before, and then takes its root's root; so trees of roots meet and flatten, and the
    number of rounds grows with the logarithm of the longest path. Each round is written to the shared
    folder. All steps are joins on one row per node or grouped minima, which Spark pre-aggregates;
    a root that many nodes share is split by the skew-join rule.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"),
                                                              F.col("a").alias("b")))
                   .filter("a <> b").distinct(), "links")
    # Round 0: the smallest of a node and its neighbours.
    state = written(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = (both.join(state.withColumnsRenamed({"node": "b"}), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = state.join(near, "node")
        handed = step.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("handed"))
        taken = (step.join(handed, "node", "left")
                 .select("node", F.col("root").alias("before"),
                         F.least("root", "near", "handed").alias("root")))
        taken = written(taken, "taken")
        up = taken.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = written(taken.join(up, "root", "left")
                        .select("node", "before", F.coalesce("up", "root").alias("root")), "roots")
        if after.filter("root <> before").isEmpty():
            return after.select("node", "root")
        state = after.select("node", "root")
