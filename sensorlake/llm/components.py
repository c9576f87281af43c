"""Connected components by alternating large-star and small-star steps, as joins on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import written


SHARES = 512  # a centre is crowded with more than this part of all edges; as an edge has two ends, there are at most 1,024 such centres
FEW = 64  # never crowded


def _met(pairs: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """u, v, m: pairs with the m of their u. Pairs of a crowded u get it where they are, so that no task gathers all neighbours of one centre."""
    most = max(FEW, edges // SHARES)
    crowded = least.where(F.col("n") > most).select("u", F.col("m").alias("of_crowded"))
    marked = pairs.join(F.broadcast(crowded), "u", "left")
    others = marked.where("of_crowded IS NULL").select("u", "v").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return marked.where("of_crowded IS NOT NULL").select("u", "v", F.col("of_crowded").alias("m")).unionByName(others.select("u", "v", "m"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _met(both.where("v > u"), least, edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    pairs = _met(down, least, edges)
    return pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _seen(e: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: each node has an edge to one smaller node at most, which has none itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    n, open_ = nodes.agg(F.sum("out"), F.max((F.col("out") + F.col("centre") > 1) & (F.col("out") > 0))).first()
    return n or 0, not open_


def components(edges: DataFrame, name: str = "components", most_steps: int = 60) -> DataFrame:
    """edges(u, v). node, component (the smallest node reachable) for every node that has an edge, but for the smallest ones themselves.
    Steps end when what is left are stars, which a further step would leave as they are."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    n, stars = _seen(e)
    for _ in range(most_steps):
        if stars:
            break
        e = written(_small_star(_large_star(e, n), n), name)
        n, stars = _seen(e)
    if not stars:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
