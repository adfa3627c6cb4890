"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.lineage import cut
from foliant.plans.skew import attach


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least vertex around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return attach(both.filter("v > u"), least, ["u"], "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = attach(down, least, ["u"], "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every row of ``vertices(vertex)``; the component is its least vertex.

    ``edges(u, v)`` may hold loops, repeats and both directions; edges with a null end or an end outside
    ``vertices`` join nothing new to the result. A vertex without edges is its own component; no vertices
    give no rows. Labels stay distributed: only a row count and a checksum reach the driver each round.
    Raises if the labels have not settled after ``max_rounds`` rounds (the method needs O(log² n)).
    """
    now = cut(edges.select("u", "v").dropna().filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    label = now.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.select("vertex").distinct().join(label, F.col("vertex") == F.col("u"), "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
