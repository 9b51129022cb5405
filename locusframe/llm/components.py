"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Work, join_hot


def components(edges: DataFrame, work: Work, name: str = "cc") -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes of edges (a, b).

    Alternates large stars (each node's larger neighbours link to its least neighbour) with small stars (its smaller ones do)
    until only stars are left: a number of rounds that grows with the logarithm of the graph. Each round is written as a table.
    A node with very many neighbours is reduced to its least neighbour before the shuffle, and the join that follows can be
    split by the adaptive planner. An empty table gives no rows; loops and repeated edges do nothing.
    """
    now = work.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    total, sign = now.count(), None
    for i in range(1, 200):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        least = work.put(least, f"{name}-least-{i}")
        large = join_hot(both, least, ["u"], "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # u > v holds now: each node and its smaller neighbours link to the least of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        seen = Observation()
        links = small.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        now = work.put(links, f"{name}-{i}")
        work.drop(f"{name}-{i - 1}", f"{name}-least-{i}")
        total = seen.get["n"]
        if seen.get == sign:
            break
        sign = seen.get
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
