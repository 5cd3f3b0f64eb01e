"""The features of labelled pairs, as a registry over edges, nodes, authors, vectors and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import vectors as V
from inkweave.operators import authors as A
from inkweave.operators import embed, lists, papers, paths, rank
from inkweave.operators import pairs as P
from inkweave.operators import text as X
from inkweave.operators.lists import Lists
from inkweave.operators.papers import Papers
from inkweave.plans.registry import Registry
from inkweave.sources import tables as T
from inkweave.sources.shared import store

registry = Registry()
feature = registry.feature


@feature("neighbourhood", "pairs", "edges")
def _(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return P.neighbourhood(pairs, edges)


@feature("term_sets", "nodes")
def _(nodes: DataFrame) -> DataFrame:
    return X.term_sets(nodes)


@feature("text_overlap", "pairs", "term_sets")
def _(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    return P.text_overlap(pairs, terms)


@feature("pagerank", "nodes", "edges")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rank.pagerank(nodes, edges)


@feature("pagerank_pair", "pairs", "pagerank")
def _(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    return rank.on_pairs(pairs, ranks)


@feature("shortest_path", "pairs", "edges")
def _(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return paths.hops(pairs, edges)


@feature("common_authors", "pairs", "author_lists")
def _(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    return P.common_authors(pairs, lists)


@feature("baseline15", "neighbourhood", "text_overlap", "pagerank_pair", "shortest_path", "common_authors")
def _(hood: DataFrame, text: DataFrame, pr: DataFrame, sp: DataFrame, ca: DataFrame) -> DataFrame:
    """Fifteen columns of a pair: degrees, texts, path, neighbourhood, rank and authors."""
    key = ["pair_id"]
    out = hood.join(text.select("pair_id", "lu", "lv", "common_terms"), key).join(pr.select("pair_id", "pagerank_sum", "pagerank_diff"), key)
    out = out.join(ca.select("pair_id", "common_authors"), key).join(sp, ["u", "v"])
    return out.select(
        "pair_id", "split", "u", "v", "y", "degree_sum", "degree_diff", (F.col("lu") + F.col("lv")).alias("length_sum"), F.abs(F.col("lu") - F.col("lv")).alias("length_diff"), "common_terms",
        F.col("hops").alias("shortest_path"), "common_neighbors", "jaccard", "adamic_adar", "resource_allocation", P.sigmoid(F.col("preferential_attachment")).alias("preferential_attachment"), "salton",
        "pagerank_sum", "pagerank_diff", "common_authors",
    )


@feature("first_author", "node_author")
def _(na: DataFrame) -> DataFrame:
    return A.first_author(na)


@feature("papers", "edges", "node_author")
def _(edges: DataFrame, na: DataFrame) -> Papers | None:
    return papers.papers(edges, na)


@feature("author_links", "edges", "node_author", "papers")
def _(edges: DataFrame, na: DataFrame, p: Papers | None) -> Lists:
    return A.links_rows(edges, na) if p is None else papers.links(p)


@feature("author_strength", "edges", "node_author")
def _(edges: DataFrame, na: DataFrame) -> DataFrame:
    return store(A.strengths(edges, na), "strength")


@feature("author_pairs", "pairs", "first_author")
def _(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pair's first authors in place of its papers."""
    return store(pairs.select("pair_id", "split", "y", "u", "v").join(first.toDF("u", "au"), "u", "left").join(first.toDF("v", "av"), "v", "left").select("pair_id", "split", "y", F.col("au").alias("u"), F.col("av").alias("v")), "author_pairs")


@feature("author_pagerank", "author_links")
def _(graph: Lists) -> DataFrame:
    if graph.fit:
        return lists.pagerank(graph)
    x = rank.pagerank(graph.nodes.select(F.col("k").alias("id")), lists.rows(graph)).withColumnRenamed("id", "k")
    return x.join(graph.nodes, "k").select(F.col("node").alias("id"), "rank")


@feature("author_successors", "pairs", "edges", "node_author", "papers", "author_links")
def _(pairs: DataFrame, edges: DataFrame, na: DataFrame, p: Papers | None, graph: Lists) -> DataFrame:
    """Successors of the first authors in common and in all, and their Jaccard."""
    if p is not None and graph.fit:
        return papers.first_authors(pairs, p, lists.Sent(graph)).select("pair_id", "cn", "un", "jaccard")
    own = registry.build(["author_pairs"], {"pairs": pairs, "node_author": na})["author_pairs"]
    return A.successors(own, graph).select("pair_id", "cn", "un", "jaccard")


@feature("author_block11", "pairs", "edges", "node_author", "papers", "author_links")
def _(pairs: DataFrame, edges: DataFrame, na: DataFrame, p: Papers | None, graph: Lists) -> DataFrame:
    """All eleven features of the first authors: row by row where papers and links are sent."""
    if p is not None and graph.fit:
        sent = lists.Sent(graph)
        x = papers.first_authors(pairs, p, sent, True, lists.ranks(graph, sent), papers.strengths(p))
        return x.select("pair_id", "split", "y", "path", F.col("cn").alias("common"), F.col("du").alias("near_u"), F.col("dv").alias("near_v"), "jaccard", F.col("aa").alias("adamic_adar"), (F.col("du") * F.col("dv")).alias("attachment"), "rank_min", "rank_max", "weight_min", "weight_max")
    own = registry.build(["author_pairs", "author_pagerank", "author_strength"], {"pairs": pairs, "edges": edges, "node_author": na, "author_links": graph})
    x = A.pair_features(own["author_pairs"].select("pair_id", "u", "v"), graph, own["author_pagerank"], own["author_strength"])
    return x.join(pairs.select("pair_id", "split", "y"), "pair_id")


@feature("author_block6", "author_block11")
def _(x: DataFrame) -> DataFrame:
    """Path, overlap of successors, ranks and link strengths of the first authors."""
    return x.select("pair_id", "split", "y", F.col("path").alias("author_path"), F.col("jaccard").alias("author_jaccard"), "rank_min", "rank_max", "weight_min", "weight_max")


@feature("hadamard", "pairs", "vectors")
def _(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    return embed.on_pairs(pairs, vectors).select("pair_id", "split", "y", V.hadamard("hu", "hv").alias("features"))


def given(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"pairs": T.pairs(spark, d), "edges": T.edges(spark, d), "nodes": T.nodes(spark, d), "node_author": T.node_author(spark, d), "author_lists": T.author_lists(spark, d), "vectors": T.vectors(spark, d)}


def build(spark: SparkSession, d: str, name: str) -> DataFrame:
    return registry.build([name], given(spark, d))[name]
