"""PageRank by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.sources.shared import store

_LIST = 1024


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damp: float = 0.85, still: float = 1e-15, cut: int = 10) -> DataFrame:
    """(id, rank): rank starts at 1/n; each round is (1 - damp)/n + damp * sum over in-edges of rank / out-degree.

    Edges run from src to dst only, and the rank of nodes without out-edges is lost, as in the measure this stands for. Every
    `cut` rounds lineage ends, and the rounds too once no rank moves by more than `still`: those left out would change none.
    Targets travel in lists of bounded length, so a round shuffles them packed and one row for each target after partial sums.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    slot = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out") / _LIST))
    links = edges.join(out, "src").groupBy("src", "out", slot.alias("slot")).agg(F.collect_list("dst").alias("to"))  # about _LIST in each
    links = store(links.drop("slot"), "links")
    every = store(nodes.select("id").distinct(), "nodes")
    rank = every.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        sent = links.join(rank.select(F.col("id").alias("src"), "rank"), "src").select(F.explode("to").alias("id"), (F.col("rank") / F.col("out")).alias("flow"), F.lit(None).cast("double").alias("was"))
        ends = k % cut == 0 or k == rounds
        own = (rank if ends else every.withColumn("rank", F.lit(None).cast("double"))).select("id", F.lit(0.0).alias("flow"), F.col("rank").alias("was"))
        rank = sent.union(own).groupBy("id").agg(F.sum("flow").alias("flow"), F.max("was").alias("was"), F.count_if(F.col("flow") == 0).alias("node"))
        rank = rank.where("node > 0").select("id", (F.lit((1 - damp) / n) + damp * F.col("flow")).alias("rank"), "was")  # targets that are no node have no rank
        if ends:
            rank = store(rank, "rank")
            moved = rank.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
            if moved is not None and moved <= still:
                break
        rank = rank.select("id", "rank")
    return rank.select("id", "rank")


def on_pairs(pairs: DataFrame, rank: DataFrame) -> DataFrame:
    """pairs with pagerank_sum and pagerank_diff; nodes without a rank count 0."""
    p = pairs.join(rank.toDF("u", "ru"), "u", "left").join(rank.toDF("v", "rv"), "v", "left").withColumns({"ru": F.coalesce("ru", F.lit(0.0)), "rv": F.coalesce("rv", F.lit(0.0))})
    return p.select(*pairs.columns, (F.col("ru") + F.col("rv")).alias("pagerank_sum"), F.abs(F.col("ru") - F.col("rv")).alias("pagerank_diff"), F.least("ru", "rv").alias("rank_min"), F.greatest("ru", "rv").alias("rank_max"))
