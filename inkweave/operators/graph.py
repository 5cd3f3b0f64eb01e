"""Graph relations: adjacency, degrees, splits, sampled non-edges, message passing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.sources.shared import parallel, store


def hash31(*parts: Column | str, seed: str = "") -> Column:
    """A number below 2**32 from the first digits of an md5, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, nbr) in both directions; self-loops once."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("nbr")).union(edges.where("src <> dst").select("dst", "src"))


def degree(adj: DataFrame) -> DataFrame:
    """(v, d): distinct neighbours."""
    return adj.groupBy("v").agg(F.count("*").alias("d"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("d"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, max_id)."""
    return nodes.agg(F.count("*").alias("n_nodes"), F.max("id").alias("max_id")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


def split_edges(edges: DataFrame, share: int = 20, seed: str = "split") -> DataFrame:
    """edges with split `dev` for the given percentage, by a hash of the edge: each row decides for itself, without a sort."""
    return edges.withColumn("split", F.when(hash31("src", "dst", seed=seed) % 100 < share, "dev").otherwise("train"))


def naive_non_edges(nodes: DataFrame, each: int = 1, seed: str = "naive") -> DataFrame:
    """(u, v): for every node `each` hashed partners among ids below the largest; edges and u = v are not kept out."""
    top = nodes.agg((F.max("id") + 1).alias("n"))
    draws = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k")).crossJoin(F.broadcast(top))  # top is one row
    return draws.select(F.col("id").alias("u"), (hash31("id", "k", seed=seed) % F.col("n")).alias("v"))


def non_edges(nodes: DataFrame, edges: DataFrame, each: int = 10, seed: str = "neg") -> DataFrame:
    """(u, v), u < v: hashed pairs that are no edge, each once."""
    drawn = naive_non_edges(nodes, each, seed).where("u <> v").select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()
    return drawn.join(edges, ["src", "dst"], "left_anti").select(F.col("src").alias("u"), F.col("dst").alias("v"))


def exact_non_edges(nodes: DataFrame, edges: DataFrame, m: int, seed: str = "exact", more: int = 2) -> DataFrame:
    """(u, v), u < v: exactly m different hashed pairs that are no edge, or all that the draws gave where there are fewer. Draws are repeated `more` times over; the first m by a hash of the pair are taken."""
    n = max(1, nodes.count())
    drawn = non_edges(nodes, edges, max(1, -(-m * more // n)), seed).withColumn("h", F.xxhash64("u", "v"))
    return numbered(drawn, "h", "row").where(F.col("row") < m).select("u", "v")


def masked(nodes: DataFrame, edges: DataFrame, test: int = 200, dev: int = 200, seed: str = "mask") -> DataFrame:
    """(u, v, split, y): edges in test, dev or train by shares of 10 000, and for each split as many non-edges as it has edges, none of them in two splits."""
    at = hash31("src", "dst", seed=seed) % 10_000
    pos = edges.withColumn("split", F.when(at < test, "test").when(at < test + dev, "dev").otherwise("train"))
    n = {r["split"]: r["n"] for r in pos.groupBy("split").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    neg = numbered(exact_non_edges(nodes, edges, total, seed).withColumn("h", F.xxhash64("u", "v", F.lit(seed))), "h", "row")
    first, second = n.get("test", 0), n.get("test", 0) + n.get("dev", 0)
    split = F.when(F.col("row") < first, "test").when(F.col("row") < second, "dev").otherwise("train")
    return pos.select(F.col("src").alias("u"), F.col("dst").alias("v"), "split", F.lit(1).alias("y")).unionByName(neg.select("u", "v", split.alias("split"), F.lit(0).alias("y")))


def labelled(edges: DataFrame, negatives: DataFrame) -> DataFrame:
    """(u, v, y): edges with 1, negatives with 0."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("y")).unionByName(negatives.select("u", "v", F.lit(0).alias("y")))


def held_out(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those of gone, in either orientation."""
    both = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edges.join(both, ["src", "dst"], "left_anti")


def is_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs with linked: 1 if the pair is an edge in either orientation."""
    hit = edges.select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.lit(1).alias("hit"))
    keyed = pairs.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
    return keyed.join(hit, ["lo", "hi"], "left").withColumn("linked", F.coalesce("hit", F.lit(0))).drop("lo", "hi", "hit")


def induced(edges: DataFrame, lo: int, hi: int) -> DataFrame:
    """Edges with both ends in [lo, hi): pushed into the scan."""
    return edges.where(F.col("src").between(lo, hi - 1) & F.col("dst").between(lo, hi - 1))


def complement(nodes: DataFrame, edges: DataFrame, lo: int, hi: int) -> DataFrame:
    """All pairs of the ids in [lo, hi) that are no edge; for ranges of a bounded size."""
    if hi - lo > 10_000:
        raise ValueError("the complement of more than 10 000 nodes is not enumerated")
    ids = nodes.where(F.col("id").between(lo, hi - 1)).select("id")
    every = F.explode(F.sequence(F.col("id") + 1, F.lit(hi).cast("bigint"))).alias("v")
    pairs = ids.select(F.col("id").alias("u"), every).join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    return pairs.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti").select("u", "v")


def message_pass(edges: DataFrame, state: DataFrame, message: Column, reduce) -> DataFrame:
    """(id, m): for every node the reduced messages of its in-edges; message is a column over edges and the source's state."""
    sent = edges.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), message.alias("m"))
    return sent.groupBy("id").agg(reduce("m").alias("m"))


def gcn_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) of the symmetrically normalised adjacency with self-loops, both orientations."""
    loops = nodes.select(F.col("id").alias("v"), F.col("id").alias("nbr"))
    full = adjacency(edges).union(loops)
    d = full.groupBy("v").agg(F.count("*").cast("double").alias("d"))
    a = full.join(d, "v").join(d.toDF("nbr", "dn"), "nbr")
    return a.select(F.col("v").alias("src"), F.col("nbr").alias("dst"), (1 / F.sqrt(F.col("d") * F.col("dn"))).alias("w"))


def attention(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(src, dst, a): softmax of scores (src, dst, s) over the in-edges of dst, by two aggregates."""
    peak = scores.groupBy("dst").agg(F.max("s").alias("peak"))
    e = scores.join(peak, "dst").withColumn("e", F.exp(F.col("s") - F.col("peak")))
    total = e.groupBy("dst").agg(F.sum("e").alias("total"))
    return e.join(total, "dst").select("src", "dst", (F.col("e") / F.col("total")).alias("a"))


def last(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by order."""
    return df.orderBy(F.desc(order)).limit(n)


def tails(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n / 2 and the last n / 2 rows by order, without numbering the rest."""
    half = n // 2
    return df.orderBy(F.desc(order)).limit(half).unionAll(df.orderBy(order).limit(half))


def numbered(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """df with its position from 0 in the order of a column of any sortable type: ranges of the sorted column, cut by sampled quantiles, are numbered by their counts."""
    ranged = df.repartitionByRange(parallel(df.sparkSession), order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    ranged = store(ranged, "ranged").withColumns({"_part": F.shiftright("_at", 33), "_r": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return ranged.join(starts, "_part").withColumn(name, F.col("_r") + F.col("_before")).drop("_at", "_part", "_r", "_before")
