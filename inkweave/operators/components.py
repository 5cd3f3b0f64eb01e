"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.sources.shared import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: greater ones; small: smaller ones and itself) are linked to its smallest neighbour or itself."""
    if large:
        both = edges.union(edges.select("b", "a"))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    pairs = both.join(low, "a")
    if large:
        return pairs.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(id, component) for every id in links (two id columns); component is the smallest id reached. Self-links are left out.

    A hub with a third of all links is only ever joined to its own minimum, one row per link, so no group is collected.
    """
    a, b = links.columns[:2]
    edges = store(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most):
        edges = store(_star(_star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
