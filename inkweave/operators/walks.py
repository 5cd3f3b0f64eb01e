"""Random walks by hashed steps, and embeddings learnt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.sources.shared import store


def random_walks(nodes: DataFrame, adj: DataFrame, walks: int, length: int, seed: int = 0) -> DataFrame:
    """(walk, start, path): `walks` walks of up to `length` steps from every node; a step goes to a neighbour of hashed rank, so that a hub's neighbours are never gathered in one row."""
    # a hub's neighbours are ranked in slots, and slots by their counts
    slotted = adj.withColumn("slot", F.pmod(F.xxhash64("nbr"), F.lit(256)).cast("int"))
    sizes = slotted.groupBy("v", "slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("v").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(W.partitionBy("v", "slot").orderBy("nbr")) - 1
    ranked = slotted.withColumn("i", inner).join(sizes.withColumn("before", before).drop("n"), ["v", "slot"])
    ranked = store(ranked.select("v", "nbr", (F.col("i") + F.col("before")).alias("r")), "ranked")
    deg = ranked.groupBy("v").agg(F.count("*").alias("d"))
    at = nodes.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")).withColumns({"v": F.col("start"), "path": F.array("start")})
    for k in range(length):
        step = at.join(deg, "v", "left").withColumn("r", F.pmod(F.xxhash64("start", "walk", F.lit(k), F.lit(seed)), F.col("d")))
        at = step.join(ranked, ["v", "r"], "left").select("start", "walk", F.coalesce("nbr", "v").alias("v"), F.when(F.col("nbr").isNull(), F.col("path")).otherwise(F.concat("path", F.array("nbr"))).alias("path"))
        if k % 5 == 4:
            at = store(at, "walks")
    return at.select("walk", "start", "path")


def deepwalk(walks: DataFrame, size: int = 32, window: int = 8, seed: int = 0, rounds: int = 1) -> DataFrame:
    """(id, h): skip-gram vectors of the nodes on walks, keyed by id."""
    from pyspark.ml.feature import Word2Vec

    sentences = walks.select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(inputCol="path", outputCol="h", vectorSize=size, windowSize=window, minCount=0, seed=seed, maxIter=rounds, numPartitions=max(1, min(8, sentences.rdd.getNumPartitions()))).fit(sentences)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").cast("bigint").alias("id"), vector_to_array("vector").alias("h"))
