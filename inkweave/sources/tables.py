"""The data model over the tables as delivered: edges, nodes, node authors, labelled pairs and vectors, cleaned.

A row delivered again counts once; null and unresolved (-1) ends, self-loops and reversed repeats of an edge are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst), src < dst: the undirected simple graph."""
    e = table(spark, d, "edgelist").where("u >= 0 AND v >= 0 AND u <> v")
    return e.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, abstract): an empty text for null."""
    a = table(spark, d, "abstracts").where("id IS NOT NULL").select("id", "abstract").dropDuplicates(["id"])
    return a.select("id", F.coalesce("abstract", F.lit("")).alias("abstract"))


def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """(id, authors): one row for each paper that has a list."""
    return table(spark, d, "authors").where("id IS NOT NULL AND authors IS NOT NULL").select("id", "authors").dropDuplicates(["id"])


def node_author(spark: SparkSession, d: str) -> DataFrame:
    """(id, pos, author): names as typed, neither null nor empty, pos counted from 0 over the list as delivered."""
    return author_lists(spark, d).select("id", F.posexplode("authors").alias("pos", "author")).where("author IS NOT NULL AND author <> ''")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, split, u, v, y) with both ends."""
    p = table(spark, d, "pairs").where("pair_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL")
    return p.select("pair_id", "split", "u", "v", "y").dropDuplicates(["pair_id"])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, h): one vector of doubles for each paper that has one."""
    e = table(spark, d, "emb").where("id IS NOT NULL AND h IS NOT NULL").select("id", "h").dropDuplicates(["id"])
    return e.select("id", F.col("h").cast("array<double>").alias("h"))
