"""Author index, weighted author graph, and the author block of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.operators import lists as L
from inkweave.operators import papers, paths
from inkweave.operators.graph import numbered
from inkweave.sources.shared import store

_PLACES = 256


def author_index(na: DataFrame) -> DataFrame:
    """(author_idx, name, freq): names numbered from 0 in their order; a name listed twice on a paper counts twice.

    The sort is distributed.
    """
    freq = na.groupBy(F.col("author").alias("name")).agg(F.count("*").alias("freq"))
    return numbered(freq, "name", "author_idx").select("author_idx", "name", "freq")


def coauthor_pairs(na: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(a, b, w): every two names of a paper in the order of listing, alpha each."""
    # long lists are cut into blocks of places, and every two blocks of a paper meet apart
    cut = na.withColumn("block", F.floor(F.col("pos") / _PLACES).cast("int"))
    top = F.max("block").over(W.partitionBy("id"))
    x = cut.withColumn("top", top).select("id", "block", F.explode(F.sequence(F.col("block"), F.col("top"))).alias("other"), F.col("pos").alias("p"), F.col("author").alias("a"))
    y = cut.select("id", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"), F.col("block").alias("other"), F.col("pos").alias("q"), F.col("author").alias("b"))
    return x.join(y, ["id", "block", "other"]).where("p < q").select("a", "b", F.lit(alpha).alias("w"))


def citation_pairs(edges: DataFrame, na: DataFrame, beta: float = 0.5) -> DataFrame:
    """(a, b, w): every author of an edge's source with every author of its target, beta each."""
    x = na.select(F.col("id").alias("src"), F.col("author").alias("a"))
    y = na.select(F.col("id").alias("dst"), F.col("author").alias("b"))
    return edges.join(x, "src").join(y, "dst").select("a", "b", F.lit(beta).alias("w"))


def author_graph(edges: DataFrame, na: DataFrame, alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """(a, b, weight) of ordered pairs of names; an author of two linked papers gets a loop. Partial sums are made before the shuffle."""
    return coauthor_pairs(na, alpha).union(citation_pairs(edges, na, beta)).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def author_links(edges: DataFrame, na: DataFrame) -> L.Lists:
    """The links of author_graph, without weights, as lists over all names. They are made where papers are sent; of more papers, names are numbered first, so a link travels as one number."""
    if (p := papers.papers(edges, na)) is not None:
        return papers.links(p)
    return links_rows(edges, na)


def links_rows(edges: DataFrame, na: DataFrame) -> L.Lists:
    """author_links with links shuffled."""
    nodes = L.number(na.select("author"))
    na = store(na.join(nodes.toDF("author", "k"), "author").select("id", "pos", F.col("k").alias("author")), "listed")
    x = coauthor_pairs(na).select("a", "b").union(citation_pairs(edges, na.select("id", "author").distinct()).select("a", "b"))
    return L.lists_of(nodes, x.select(L.code("a", "b")))


def strengths(edges: DataFrame, na: DataFrame, alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """(src, strength) as link_strength of author_graph has it, without the links: names after one on its papers, and names on the papers they cite."""
    size = na.groupBy("id").agg(F.count("*").alias("n"))
    cited = edges.join(size.toDF("dst", "n"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("cited"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "author"))).alias("listed")  # of one paper
    each = na.groupBy("id").agg(listed).select("id", F.size("listed").alias("n"), F.posexplode("listed").alias("at", "x")).select("id", "x.author", (F.col("n") - F.col("at") - 1).alias("later"))
    each = each.join(cited, "id", "left").groupBy(F.col("author").alias("src")).agg((alpha * F.sum("later") + beta * F.sum(F.coalesce("cited", F.lit(0)))).alias("strength"))
    return each.where("strength > 0")


def link_strength(graph: DataFrame) -> DataFrame:
    """(src, strength): sum of the weights of out-edges (src, dst, weight)."""
    return graph.groupBy("src").agg(F.sum("weight").alias("strength"))


def first_author(na: DataFrame) -> DataFrame:
    """(id, author): the one listed first."""
    return na.groupBy("id").agg(F.min_by("author", "pos").alias("author"))


def pair_features(pairs: DataFrame, g: L.Lists, ranks: DataFrame, strength: DataFrame) -> DataFrame:
    """pairs (pair_id, u, v) of authors with all eleven features: path, successors in common, of u and of v, their Jaccard, Adamic-Adar by 1 / ln(1 + d), preferential attachment, lesser and greater rank and link strength."""
    from inkweave.operators import rank

    x = rank.on_pairs(_successors(pairs, g).join(directed_hops(pairs, g), ["u", "v"], "left"), ranks)
    x = x.join(strength.toDF("u", "su"), "u", "left").join(strength.toDF("v", "sv"), "v", "left").fillna(0, ["su", "sv"])
    return x.select(
        "pair_id", F.coalesce("hops", F.lit(15)).alias("path"), F.col("cn").alias("common"), F.col("du").alias("near_u"), F.col("dv").alias("near_v"), "jaccard", F.col("aa").alias("adamic_adar"),
        (F.col("du") * F.col("dv")).alias("attachment"), "rank_min", "rank_max", F.least("su", "sv").alias("weight_min"), F.greatest("su", "sv").alias("weight_max"),
    )


def _overlap_rows(pairs: DataFrame, g: L.Lists) -> DataFrame:
    """lists.overlap with links as rows."""
    key, o = L.numbers(pairs, g), store(L.rows(g), "out")
    d = o.groupBy("src").agg(F.count("*").alias("d"))
    p = key.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    p = p.select("u", "v", F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("hi"))
    shared = p.join(o.toDF("lo", "w"), "lo").join(o.toDF("hi", "w"), ["hi", "w"], "left_semi").join(d.toDF("w", "dw"), "w", "left")
    return shared.groupBy("u", "v").agg(F.count("*").alias("cn"), F.sum(1 / F.log1p(1e-8 + F.coalesce("dw", F.lit(0)))).alias("aa"))


def _successors(pairs: DataFrame, g: L.Lists) -> DataFrame:
    d = store(L.sizes(g), "sizes")
    p = pairs.join(d.toDF("u", "du"), "u", "left").join(d.toDF("v", "dv"), "v", "left")
    p = p.join(L.overlap(pairs, g) if g.fit else _overlap_rows(pairs, g), ["u", "v"], "left").fillna(0, ["du", "dv", "cn", "aa"])
    un = F.col("du") + F.col("dv") - F.col("cn")
    return p.withColumn("un", un).withColumn("jaccard", F.col("cn") / (1e-8 + F.col("un")))


def successors(pairs: DataFrame, out: DataFrame | L.Lists) -> DataFrame:
    """pairs (pair_id, u, v) with cn, un and jaccard = cn / (1e-8 + un) over the targets of out (src, dst), distinct, or of its lists."""
    return _successors(pairs, out if isinstance(out, L.Lists) else L.pack(out)).select(*pairs.columns, "cn", "un", "jaccard")


def directed_hops(pairs: DataFrame, out: DataFrame | L.Lists, most: int | None = None, missing: int = 15) -> DataFrame:
    """(u, v, hops) of the distinct pairs along out (src, dst), or its lists: 0 for u = v; a link u -> v goes the way round by another successor when one leads to v in one step; `missing` where there is no path, or none of up to `most` steps."""
    g = out if isinstance(out, L.Lists) else L.pack(out)
    asked = store(pairs.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL").distinct(), "asked")
    found = L.hops(asked, g, most) if g.fit else _hops_rows(asked, g, most)
    return asked.join(found, ["u", "v"], "left").select("u", "v", F.when(F.col("u") == F.col("v"), 0).otherwise(F.coalesce("hops", F.lit(missing))).alias("hops"))


def _hops_rows(asked: DataFrame, g: L.Lists, most: int | None) -> DataFrame:
    """lists.hops with links as rows."""
    o = store(L.rows(g).where("src <> dst"), "out")
    fan = store(paths.fans(o), "fans")
    key = store(L.numbers(asked, g).where("a <> b"), "key")
    apart = key.select(F.col("a").alias("s"), F.col("b").alias("t"))
    direct = apart.join(o.toDF("s", "t"), ["s", "t"], "left_semi").toDF("a", "b")
    two = store(paths.between(apart, o, fan).toDF("a", "b"), "two")
    near = store(key.join(direct.withColumn("one", F.lit(1)), ["a", "b"], "left").join(two.withColumn("two", F.lit(2)), ["a", "b"], "left"), "near")
    far = paths.beyond(near.where("one IS NULL AND two IS NULL").select(F.col("a").alias("s"), F.col("b").alias("t")), o, fan, most).toDF("a", "b", "far")
    return near.join(far, ["a", "b"], "left").select("u", "v", F.coalesce("two", "one", "far").alias("hops"))
