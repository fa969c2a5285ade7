"""Connected components of an edge table, by repeated joins (no driver state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dealgrid.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): root is the smallest node that ``node`` reaches; nodes without an
    edge are left out.

    ``edges`` has columns (a, b).  Every round each node's larger neighbours, then its
    smaller ones, are linked to the smallest neighbour ("large star, small star"); the
    number of rounds grows with the logarithm of the component size and a hub is never
    collected: both steps are one partial aggregate and one join.  Each round is a
    written table.  Empty edges give an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), name)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # Large star: every larger neighbour moves to the node's minimum.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself move to the minimum.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(least.select("a", F.col("low").alias("b"))))
        new = written(small.where("a <> b").distinct(), name)
        # Stars only: no root is itself below another node.
        if new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").isEmpty():
            if new.groupBy("a").count().where("count > 1").isEmpty():
                return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                    new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = new
