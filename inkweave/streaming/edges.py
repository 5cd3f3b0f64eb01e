"""Edges that arrive as files: an addition to the batch readers, for graphs that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "u BIGINT, v BIGINT, loaded_at TIMESTAMP"


def arriving(spark: SparkSession, folder: str, late: str = "90 days") -> DataFrame:
    """(src, dst, loaded_at): each undirected edge once within the watermark; null, unresolved and looping rows left out."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder).where("u >= 0 AND v >= 0 AND u <> v")
    e = rows.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "loaded_at")
    return e.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["src", "dst"])


def weekly(edges: DataFrame) -> DataFrame:
    """(week, edges): edges that arrived in each week."""
    return edges.groupBy(F.window("loaded_at", "7 days").alias("week")).agg(F.count("*").alias("edges"))
