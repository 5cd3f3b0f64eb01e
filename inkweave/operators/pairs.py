"""Features of node pairs. Common neighbours are expanded once, from the end with fewer neighbours, for all measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators.graph import adjacency, degree


def with_degrees(pairs: DataFrame, deg: DataFrame) -> DataFrame:
    """pairs with du and dv, 0 for nodes without neighbours."""
    out = pairs.join(deg.toDF("u", "du"), "u", "left").join(deg.toDF("v", "dv"), "v", "left")
    return out.withColumns({"du": F.coalesce("du", F.lit(0)), "dv": F.coalesce("dv", F.lit(0))})


def common(pairs: DataFrame, adj: DataFrame, deg: DataFrame) -> DataFrame:
    """(u, v, cn, aa, ra, ra_inverse) of the distinct pairs with a common neighbour w: count, and sums of 1/ln d(w), d(w) and 1/d(w)."""
    p = with_degrees(pairs.select("u", "v").distinct(), deg).where("du > 0 AND dv > 0")
    low = F.col("du") <= F.col("dv")
    p = p.select("u", "v", F.when(low, F.col("u")).otherwise(F.col("v")).alias("lo"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("hi"))
    wedge = p.join(adj.select(F.col("v").alias("lo"), F.col("nbr").alias("w")), "lo")
    closed = wedge.join(adj.select(F.col("v").alias("hi"), F.col("nbr").alias("w")), ["hi", "w"], "left_semi")
    return closed.join(deg.toDF("w", "dw"), "w").groupBy("u", "v").agg(
        F.count("*").alias("cn"), F.sum(F.try_divide(F.lit(1.0), F.log("dw"))).alias("aa"), F.sum("dw").alias("ra"), F.sum(1 / F.col("dw")).alias("ra_inverse")
    )


def neighbourhood(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs with degree_sum, degree_diff, common_neighbors, jaccard, adamic_adar, resource_allocation (sum of degrees), resource_allocation_textbook (of their inverses), preferential_attachment and salton."""
    adj = adjacency(edges)
    deg = degree(adj)
    out = with_degrees(pairs, deg).join(common(pairs, adj, deg), ["u", "v"], "left")
    cn = F.coalesce("cn", F.lit(0))
    return out.select(
        *pairs.columns, "du", "dv",
        (F.col("du") + F.col("dv")).alias("degree_sum"), F.abs(F.col("du") - F.col("dv")).alias("degree_diff"), cn.alias("common_neighbors"),
        F.coalesce(F.try_divide(cn.cast("double"), F.col("du") + F.col("dv") - cn), F.lit(0.0)).alias("jaccard"),
        F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"), F.coalesce("ra", F.lit(0)).alias("resource_allocation"),
        F.coalesce("ra_inverse", F.lit(0.0)).alias("resource_allocation_textbook"), (F.col("du") * F.col("dv")).alias("preferential_attachment"),
        F.coalesce(F.try_divide(cn.cast("double"), F.sqrt((F.col("du") * F.col("dv")).cast("double"))), F.lit(0.0)).alias("salton"),
    )


def text_overlap(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """pairs with lu, lv (characters), tu, tv (distinct terms) and common_terms; terms: (id, chars, terms)."""
    a, b = terms.toDF("u", "lu", "a"), terms.toDF("v", "lv", "b")
    none = F.array().cast("array<string>")
    out = pairs.join(a, "u", "left").join(b, "v", "left").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    return out.select(*pairs.columns, F.coalesce("lu", F.lit(0)).alias("lu"), F.coalesce("lv", F.lit(0)).alias("lv"), F.size("a").alias("tu"), F.size("b").alias("tv"), F.size(F.array_intersect("a", "b")).alias("common_terms"))


def common_authors(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """pairs with common_authors, the number of distinct names both lists hold, null and empty ones left out; lists: (id, authors)."""
    lists = lists.select("id", F.filter("authors", lambda x: x.isNotNull() & (x != "")))
    out = pairs.join(lists.toDF("u", "a"), "u", "left").join(lists.toDF("v", "b"), "v", "left")
    return out.select(*pairs.columns, F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)).alias("common_authors"))


def sigmoid(c):
    return 1 / (1 + F.exp(-c.cast("double")))
