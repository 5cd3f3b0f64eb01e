"""Hops between the two ends of a pair, for the requested pairs only, and balls around nodes.

Two ends are two hops apart if the neighbours of one, the one with fewer, include a neighbour of the other: a hub is looked up
and not expanded. Beyond that, a level is grown from one end of a pair only, the one whose neighbours have fewer links in all,
once for each distinct node, and each of its nodes is tested in the same way against the other end. A level is grown only for
pairs that are still open; those left after four hops are few where there are hubs, and of them those in different components
are told apart before the search goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators import lists as L
from inkweave.operators.components import components
from inkweave.operators.graph import adjacency, degree, is_edge, numbered
from inkweave.operators.pairs import common
from inkweave.sources.shared import store

_NEAR = 4


def fans(out: DataFrame) -> DataFrame:
    """(node, leave, enter): the numbers of edges of out (src, dst) at every node."""
    both = out.select(F.col("src").alias("node"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(out.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("x").alias("leave"), F.sum("y").alias("enter"))


def between(pairs: DataFrame, out: DataFrame, fan: DataFrame) -> DataFrame:
    """The distinct pairs (s, t) with a node w such that s -> w -> t along out (src, dst), of which fan has the numbers."""
    p = pairs.select("s", "t").join(fan.selectExpr("node AS s", "leave AS x"), "s").join(fan.selectExpr("node AS t", "enter AS y"), "t").where("x > 0 AND y > 0")
    ahead = p.where("x <= y").select("s", "t").join(out.toDF("s", "w"), "s").join(out.toDF("w", "t"), ["w", "t"], "left_semi")
    back = p.where("x > y").select("s", "t").join(out.toDF("w", "t"), "t").join(out.toDF("s", "w"), ["s", "w"], "left_semi")
    return ahead.select("s", "t").union(back.select("s", "t")).distinct()


def beyond(pairs: DataFrame, out: DataFrame, fan: DataFrame, most: int | None = None) -> DataFrame:
    """(s, t, hops) of those distinct pairs (s, t), known to be more than two hops apart, that a path along out (src, dst) of up to `most` hops (of any length, if None) joins."""
    ahead = out.join(fan.selectExpr("node AS dst", "leave AS d"), "dst").groupBy(F.col("src").alias("s")).agg(F.sum("d").alias("x"))
    back = out.join(fan.selectExpr("node AS src", "enter AS d"), "src").groupBy(F.col("dst").alias("t")).agg(F.sum("d").alias("y"))
    # an end without a way out, or in, is reached by none
    open_ = pairs.select("s", "t").distinct().join(ahead, "s").join(back, "t").where("x > 0 AND y > 0").withColumn("fwd", F.col("x") <= F.col("y")).select("s", "t", "fwd")
    open_ = store(open_, "open")
    found, k = open_.select("s", "t", F.lit(0).alias("hops")).limit(0), 2
    starts = open_.select(F.when(F.col("fwd"), F.col("s")).otherwise(F.col("t")).alias("from"), "fwd").distinct()
    front = seen = store(starts.withColumn("w", F.col("from")), "front")
    ways, whole = out.select(F.lit(True).alias("fwd"), F.col("src").alias("w"), F.col("dst").alias("x")).union(out.select(F.lit(False), "dst", "src")), False
    while most is None or k < most:
        k += 1
        grown = front.join(ways, ["fwd", "w"]).select("from", "fwd", F.col("x").alias("w")).distinct()
        front = store(grown.join(seen, ["from", "fwd", "w"], "left_anti"), "front")
        asked = open_.withColumn("from", F.when(F.col("fwd"), F.col("s")).otherwise(F.col("t"))).join(front, ["from", "fwd"])
        asked = asked.select("s", "t", F.when(F.col("fwd"), F.col("w")).otherwise(F.col("s")).alias("a"), F.when(F.col("fwd"), F.col("t")).otherwise(F.col("w")).alias("b"))
        asked = store(asked, "asked")
        hit = store(asked.join(between(asked.selectExpr("a AS s", "b AS t").distinct(), out, fan).toDF("a", "b"), ["a", "b"], "left_semi").select("s", "t").distinct(), "hit")
        found = found.union(hit.withColumn("hops", F.lit(k)))
        # pairs whose level is empty are reached by none
        alive = front.select("from", "fwd").distinct()
        open_ = open_.join(hit, ["s", "t"], "left_anti").withColumn("from", F.when(F.col("fwd"), F.col("s")).otherwise(F.col("t")))
        open_ = store(open_.join(alive, ["from", "fwd"], "left_semi").select("s", "t", "fwd"), "open")
        if open_.isEmpty():
            break
        if k >= _NEAR and not whole:
            part, whole = components(out).toDF("node", "part"), True
            open_ = store(open_.join(part.toDF("s", "x"), "s").join(part.toDF("t", "y"), "t").where("x = y").select("s", "t", "fwd"), "open")
        still = open_.select(F.when(F.col("fwd"), F.col("s")).otherwise(F.col("t")).alias("from"), "fwd").distinct()
        front = front.join(still, ["from", "fwd"], "left_semi")
        seen = seen.union(front)
    return found


def hops(pairs: DataFrame, edges: DataFrame, missing: int = -1, most: int | None = None) -> DataFrame:
    """(u, v, hops) of the distinct pairs: 0 for u = v; linked ends give the way round: 2 with a common neighbour, else 3 if u has another neighbour, else 1; the exact number of hops otherwise, `missing` where there is no path or none of up to `most` hops."""
    edges = store(edges.select("src", "dst"), "edges")
    adj = adjacency(edges)
    deg = store(degree(adj), "degree")
    asked = store(is_edge(pairs.select("u", "v").distinct(), edges), "asked")
    cn = store(common(asked, adj, deg).select("u", "v"), "two")
    du = deg.toDF("u", "du")
    near = asked.join(cn.withColumn("two", F.lit(1)), ["u", "v"], "left").join(du, "u", "left")
    linked = near.where("linked = 1").select("u", "v", F.when(F.col("two") == 1, 2).when(F.col("du") > 1, 3).otherwise(1).alias("hops"))
    self_ = asked.where("u = v").select("u", "v", F.lit(0).alias("hops"))
    two = cn.where("u <> v").join(asked.where("linked = 1").select("u", "v"), ["u", "v"], "left_anti").select("u", "v", F.lit(2).alias("hops"))
    apart = store(asked.where("linked = 0 AND u <> v").select("u", "v").join(cn, ["u", "v"], "left_anti"), "apart")
    if apart.isEmpty():
        return linked.union(self_).union(two)
    far = store(beyond(apart.toDF("s", "t"), adj.toDF("src", "dst"), deg.selectExpr("v AS node", "d AS leave", "d AS enter"), most), "far").toDF("u", "v", "hops")
    rest = apart.join(far, ["u", "v"], "left").select("u", "v", F.coalesce("hops", F.lit(missing)).alias("hops"))
    return linked.union(self_).union(two).union(rest)


def ball(seeds: DataFrame, out: DataFrame, radius: int) -> DataFrame:
    """(key, node, level): nodes reached from seeds (key, node) along out (src, dst) in up to radius steps, with the first level."""
    out = store(out.select("src", "dst").distinct(), "out")
    reached = store(seeds.select("key", "node").distinct().withColumn("level", F.lit(0)), "ball")
    front = reached
    for k in range(1, radius + 1):
        step = front.select("key", F.col("node").alias("src")).join(out, "src").select("key", F.col("dst").alias("node")).distinct()
        front = store(step.join(reached, ["key", "node"], "left_anti").withColumn("level", F.lit(k)), "front")
        if front.isEmpty():
            break
        reached = reached.union(front)
    return reached


def ball_distance(pairs: DataFrame, members: DataFrame, out: DataFrame | L.Lists, levels: int = 16) -> DataFrame:
    """pairs with shared and distance = exp(-shared): nodes in both balls around the members (id, node) of the ends, along out (src, dst) or as lists with all members. A ball has its members as the first of up to `levels` levels; both are as wide as the narrower one goes.

    Equal sets of members have equal balls, which are grown once, and pairs of equal balls are compared once. Graphs, sets
    and pairs that can be sent are; beyond that, balls are rows.
    """
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = members.join(ids, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # the members of one id
    sets = store(sets.withColumn("key", F.sha2(F.to_json(F.struct("nodes")), 256)), "sets")
    g = out if isinstance(out, L.Lists) else L.pack(out, members.select("node"))
    each = sets.dropDuplicates(["key"])
    key = store(numbered(each.select("key"), "key", "x").select("key", F.col("x").cast("int").alias("x")), "keys")
    p = pairs.join(sets.select(F.col("id").alias("u"), F.col("key").alias("ku")), "u").join(sets.select(F.col("id").alias("v"), F.col("key").alias("kv")), "v")
    p = p.join(key.toDF("ku", "a"), "ku").join(key.toDF("kv", "b"), "kv")
    named = store(p.select("pair_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "named")
    asked = store(named.select("a", "b").distinct(), "asked")
    held = store(each.join(key, "key").select("x", F.explode("nodes").alias("node")).join(g.nodes, "node").select("x", "k"), "held")
    small = g.fit and held.count() + asked.count() <= L.MOST_LINKS
    n = L.shared_balls(g, held, asked, levels - 1) if small else _shared_rows(asked, held, L.rows(g), levels)
    named = named.join(n, ["a", "b"]).select("pair_id", "shared")
    out_ = pairs.join(named, "pair_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out_.withColumn("distance", F.exp(-F.col("shared").cast("double")))


def _shared_rows(asked: DataFrame, held: DataFrame, out: DataFrame, levels: int) -> DataFrame:
    """(a, b, shared) of pairs (a, b) of sets (x, k), with balls as rows."""
    b = store(ball(held.toDF("key", "node"), out, levels - 1), "balls")
    size = b.groupBy("key").agg(F.max("level").alias("depth"), F.count("*").alias("n"))
    asked = asked.join(size.toDF("a", "x", "na"), "a").join(size.toDF("b", "y", "nb"), "b").withColumn("most", F.least("x", "y"))
    # the smaller ball is looked up in the larger
    small = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b"))
    asked = asked.select("a", "b", "most", small.alias("lo"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("hi"))
    both = asked.join(b.toDF("lo", "node", "l"), "lo").where("l <= most").join(b.toDF("hi", "node", "m"), ["hi", "node"]).where("m <= most")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))
