"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial aggregation (smallest neighbour per node) and an
equi-join; nothing is collected and no step needs all edges of a node in one
task.  Each round is written to the shared folder, so a lost executor costs
at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelink.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect every node's larger (large star) or not larger (small star) neighbours to its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = (joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return out.filter("a <> b").distinct()


def component_roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that an edge touches; root is the smallest node reached.

    Nulls and loops are ignored; repeated edges change nothing; no edges give
    an empty table.
    """
    current = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                          .filter("a <> b").distinct(), "component-edges")
    state = None
    while True:
        # Equal before and after a round means that every edge is a star to the smallest node.
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
                           F.max("a").alias("any")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
        current = materialise(_star(_star(current, large=True), large=False), "component-edges")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
