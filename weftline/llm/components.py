"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed

#: Minima of so many nodes are broadcast to their edges; beyond, the join is shuffled.
BROADCAST_NODES = 300_000
#: Edges of a task, about: a round over few edges has few tasks and no shuffle, whatever the session's number of partitions.
TASK_EDGES = 50_000


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) that isn't the least of its component.

    Each round links neighbours to the least node seen, first the larger
    neighbours of every node, then the smaller ones with the node itself, until
    nothing changes; the rounds grow with the logarithm of the longest path. A
    node's minimum is aggregated before it is joined back, so a hub's edges are
    never gathered in one task: they are partially aggregated, and the join is a
    broadcast for a counted small table or else one whose skewed keys Spark splits.
    Every round is written to the shared checkpoint folder, by tasks of about
    TASK_EDGES edges, as the rounds of a small graph would else cost many empty tasks.
    """
    now = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = tuple(seen)
        tasks = max(1, -(-seen[0] // TASK_EDGES))
        now = now.coalesce(tasks)
        small = seen[0] <= BROADCAST_NODES
        held = F.broadcast if small else checkpointed  # a stored table, so that Spark can split the partition of a hub
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(held(least), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = checkpointed(large).coalesce(tasks)
        # every edge now runs from a smaller a to a larger b: b's smaller neighbours and b itself link to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        minima = held(least)
        joined = large.join(minima, "b")
        small_star = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(minima.select(F.col("m"), F.col("b")))
        now = checkpointed(small_star.distinct())
