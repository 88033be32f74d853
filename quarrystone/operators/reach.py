"""What a graph's nodes reach, by a frontier that moves one edge a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import checkpointed


def reached(edges: DataFrame, seeds: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """``keys``, node, hops: every node that ``seeds`` (keys, node) lead to along ``edges`` (keys, src, dst), the seeds included.

    Each round joins the newest nodes with the edges and drops what was seen; a cycle
    ends by itself. Only the newest nodes are shuffled, and each round is checkpointed,
    so the plan does not grow with the depth. Nothing but an emptiness test comes to the driver.
    """
    frontier = checkpointed(seeds.select(*keys, "node").distinct().withColumn("hops", F.lit(0)))
    seen = frontier
    hop = 0
    while (rounds is None or hop < rounds) and not frontier.isEmpty():
        hop += 1
        step = frontier.withColumnRenamed("node", "src").join(edges.select(*keys, "src", "dst"), [*keys, "src"])
        fresh = step.select(*keys, F.col("dst").alias("node")).where(F.col("node").isNotNull()).distinct()
        frontier = checkpointed(fresh.join(seen, [*keys, "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = checkpointed(seen.unionByName(frontier)) if hop % 16 == 0 else seen.unionByName(frontier)
    return seen
