"""Connected components by alternating star contractions (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from costplan.session import drop_written, written


def _least(pairs: DataFrame) -> DataFrame:
    """Each node u with the least of itself and its neighbours; combined on the map side."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); component is the least node of it.

    Nodes without an edge to another node don't appear: they are their own component. Rounds
    are few (they grow with the logarithm of the longest chain squared); each is written to the
    shared folder, so a lost executor costs one round. Null ends and self loops are ignored.
    """
    now = written(edges.select(F.col("u"), F.col("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        seen = Observation()
        state_of = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        new = written(_small_star(_large_star(now)).observe(seen, *state_of), "edges")
        state = (seen.get["n"], seen.get["h"])
        drop_written(now)
        now = new
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
    raise RuntimeError("the components did not settle")
