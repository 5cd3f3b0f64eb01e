"""Readers of delimited graph, text and author files, JSON and Parquet bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_graph(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """`u,v` lines -> (src, dst), src <= dst: repeated and reversed lines collapse, self-loops stay, lines from # on are comments."""
    e = spark.read.schema("u BIGINT, v BIGINT").csv(path, sep=sep, comment="#")
    return e.where("u IS NOT NULL AND v IS NOT NULL").select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def _fields(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"\|--\|", -1)
    lines = spark.read.text(path).where("value <> ''").select("value", parts.alias("p"))
    bad = F.raise_error(F.concat(F.lit("not two fields: "), F.substring("value", 1, 80)))
    return lines.select(F.when(F.size("p") == 2, F.col("p")).otherwise(bad.cast("array<string>")).alias("p"))


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """`id|--|text` lines -> (id, abstract); a line without exactly two fields is an error."""
    return _fields(spark, path).select(F.col("p")[0].cast("bigint").alias("id"), F.col("p")[1].alias("abstract"))


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """`id|--|name,name` lines -> (id, authors); an empty list has one empty name, names are not trimmed."""
    return _fields(spark, path).select(F.col("p")[0].cast("bigint").alias("id"), F.split(F.col("p")[1], ",", -1).alias("authors"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """`u,v` lines of one file -> (pair_id, u, v); pair_id is the line's number from 0, which outputs are keyed by. Splits of the file are numbered by the counts of those before them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each split of the file
    uv = F.split("value", ",")
    out = lines.join(F.broadcast(sizes.select("block", "first", before.alias("before"))), "block")
    return out.select((F.col("at") - F.col("first") + F.col("before")).alias("pair_id"), F.trim(uv[0]).cast("bigint").alias("u"), F.trim(uv[1]).cast("bigint").alias("v"))


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated `id f1 ... fk label` lines -> (id, features, label), features scaled to sum 1 (0 stays 0)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(p.alias("p"))
    f = F.transform(F.slice("p", F.lit(2), F.size("p") - 2), lambda x: x.cast("double"))
    rows = rows.select(F.col("p")[0].cast("bigint").alias("id"), f.alias("f"), F.element_at("p", -1).alias("label"))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.transform("f", lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))).alias("features"), "label")


def read_cites(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated `cited citing` lines -> (src, dst) in both directions, each once."""
    p = F.split(F.trim("value"), r"\s+")
    e = spark.read.text(path).where("trim(value) <> ''").select(p[1].cast("bigint").alias("src"), p[0].cast("bigint").alias("dst"))
    return e.union(e.select("dst", "src")).distinct()


def indexed(content: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """content (id, features, label) with row, its number from 0 by id, and class, its label's from 0 by name; and cites between rows, those of unknown ids left out."""
    from pyspark.sql import Window as W

    from inkweave.operators.graph import numbered

    labels = content.select("label").distinct()
    labels = labels.withColumn("class", F.row_number().over(W.orderBy("label")) - 1)  # the classes, a handful
    rows = numbered(content, "id", "row").join(labels, "label")
    ids = rows.select("id", "row")
    links = cites.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return rows, links


def read_bundle(spark: SparkSession, *paths: str, split: str | None = None) -> DataFrame:
    """Parquet feature blocks, one split or all; a split prunes directories."""
    df = spark.read.parquet(*paths)
    return df.where(F.col("split") == split) if split else df


def read_json_arrays(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Files that each hold one JSON array, concatenated."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(paths)


def read_json_lines(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(paths)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id BIGINT, predicted DOUBLE").csv(path, header=True)


def random_graph(spark: SparkSession, n: int, edges: int, seed: int = 0) -> DataFrame:
    """(src, dst) of a random simple graph over n nodes."""
    r = spark.range(edges).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("a"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n)).alias("b"))
    return r.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def blobs(spark: SparkSession, clusters: int, dims: int, rows: int, seed: int = 0) -> DataFrame:
    """(id, cluster, features): Gaussian blobs around centres on a grid."""
    x = spark.range(rows).withColumn("cluster", F.col("id") % clusters)
    return x.select("id", "cluster", F.array(*[F.randn(seed + k) + 10 * F.pmod(F.xxhash64("cluster", F.lit(k)), F.lit(10)) for k in range(dims)]).alias("features"))


def circles(spark: SparkSession, sizes: tuple[int, ...] = (50, 400, 800), noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, cluster, features): noisy concentric circles, the k-th of radius k + 1."""
    total = sum(sizes)
    at, cluster = 0, F.lit(None).cast("int")
    for k, n in enumerate(sizes):
        cluster = F.when(F.col("id").between(at, at + n - 1), k).otherwise(cluster)
        at += n
    x = spark.range(total).withColumn("cluster", cluster).withColumn("angle", 2 * F.pi() * F.rand(seed))
    r = F.col("cluster") + 1.0
    return x.select("id", "cluster", F.array(r * F.cos("angle") + noise * F.randn(seed + 1), r * F.sin("angle") + noise * F.randn(seed + 2)).alias("features"))
