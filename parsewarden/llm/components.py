"""Connected components of an edge table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsewarden.llm.common import checkpointed


#: Edges from which a round takes more tasks than the session has cores.
EDGES_A_TASK = 100_000


def few(df: DataFrame, rows: int, a_task: int) -> DataFrame:
    """df in no more tasks than so many rows need: else each of the many small steps takes a task for each partition."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // a_task))


def components(edges: DataFrame, max_rounds: int = 100, rows: int | None = None) -> DataFrame:
    """node and component (smallest node reachable) of every node of edges (a, b: longs, either order).

    rows: as many edges at most, if that is known, so that the first step takes few tasks for few edges as the others do.

    Alternates two star steps until no edge changes: every node points its larger neighbours, then its smaller ones and
    itself, at the smallest of its neighbourhood. Smallest neighbours come from an aggregation that combines before its
    shuffle, and are joined back, so a node with very many links is spread by adaptive execution. Rounds grow with the
    logarithm of the longest path. Each round is checkpointed; one row with a count and a checksum tells whether edges
    have changed.
    """
    spark = edges.sparkSession
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = checkpointed(e if rows is None else few(e, rows, EDGES_A_TASK))
    nodes = e.select("u").union(e.select(F.col("v"))).distinct()
    before = state(e)
    for _ in range(max_rounds):
        # few edges in few tasks: else each exchange and each checkpoint of each round writes files for all partitions
        tasks = max(spark.sparkContext.defaultParallelism, before[0] // EDGES_A_TASK)
        e = e.coalesce(tasks)
        # large star: larger neighbours of u point at the smallest of u's neighbourhood
        both = e.union(e.select(F.col("v"), F.col("u"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        # small star: smaller neighbours of u, and u, point at the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        if (now := state(e)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    least = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(least, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", F.col("u")).alias("component")).coalesce(tasks)


def merged_components(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of what found (node, component) was made from and further edges (a, b).

    Edges are drawn between components first, so of a dense group only those that join something are left. Both are
    stored already.
    """
    count = edges.count()
    ids = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    found = checkpointed(few(found.select("node", "component").union(ids), found.count() + 2 * count, EDGES_A_TASK))
    end = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = edges.join(end("a"), "a").join(end("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    more = components(between, rows=count).select(F.col("node").alias("component"), F.col("component").alias("c"))
    return found.join(more, "component", "left").select("node", F.coalesce("c", "component").alias("component"))
