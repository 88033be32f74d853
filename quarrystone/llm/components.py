"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to the smallest neighbour, first among the
larger ends, then among the smaller ones, until nothing changes. The number of
links never grows, a hub's links are joined to one minimum (a join that adaptive
execution can split), and rounds are about the logarithm of the longest path.
Each round's links are checkpointed, so the plan stays short and a lost executor
costs one round at most. Nothing but a count and a sum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import checkpointed


def _with_min(edges: DataFrame) -> DataFrame:
    """Links u-v with the smallest of u's neighbours and u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    return edges.join(least, edges["u"] == least["w"]).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_min(down)
    return starred.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for each node with a link.

    ``edges``: two long columns u and v without nulls. Repeated links and loops do no harm.
    """
    now = checkpointed(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFFFF))).alias("s")).first()
        if sign["n"] == 0 or (sign["n"], sign["s"]) == seen:
            break
        seen = (sign["n"], sign["s"])
        now = checkpointed(_small_star(_large_star(now)))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
