"""Queries over the test tables, one for each operator of the library, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import text as TX
from inkweave.functions import vectors as V
from inkweave.operators import authors as A
from inkweave.operators import embed, ml, paths, rank, walks
from inkweave.operators import graph as G
from inkweave.operators import models as M
from inkweave.operators import neural as N
from inkweave.operators import pairs as P
from inkweave.operators import text as X
from inkweave.plans import features
from inkweave.sources import tables as T
from inkweave.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

# SQL of the data model, put before the queries that use it.
_CTE = {
    "e": "e AS (SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM edgelist WHERE u >= 0 AND v >= 0 AND u <> v)",
    "adj": "adj AS (SELECT src AS v, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e)",
    "deg": "deg AS (SELECT v, count(*) AS d FROM adj GROUP BY v)",
    "n": "n AS (SELECT id, coalesce(any_value(abstract), '') AS abstract FROM abstracts WHERE id IS NOT NULL GROUP BY id)",
    "al": "al AS (SELECT id, any_value(authors) AS authors FROM authors WHERE id IS NOT NULL AND authors IS NOT NULL GROUP BY id)",
    "na": "na AS (SELECT * FROM (SELECT id, unnest(authors) AS author, generate_subscripts(authors, 1) - 1 AS pos FROM al) WHERE author IS NOT NULL AND author <> '')",
    "p": "p AS (SELECT pair_id, any_value(split) AS split, any_value(u) AS u, any_value(v) AS v, any_value(y) AS y FROM pairs WHERE pair_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL GROUP BY pair_id)",
    "h": "h AS (SELECT id, any_value(h)::DOUBLE[] AS h FROM emb WHERE id IS NOT NULL AND h IS NOT NULL GROUP BY id)",
    "pd": "pd AS (SELECT p.*, coalesce(a.d, 0) AS du, coalesce(b.d, 0) AS dv FROM p LEFT JOIN deg a ON a.v = p.u LEFT JOIN deg b ON b.v = p.v)",
    "cn": "cn AS (SELECT q.u, q.v, count(*) AS cn, sum(CASE WHEN w.d > 1 THEN 1 / ln(w.d) END) AS aa, sum(w.d) AS ra, sum(1 / w.d) AS rai FROM (SELECT DISTINCT u, v FROM p) q JOIN adj a ON a.v = q.u JOIN adj b ON b.v = q.v AND b.nbr = a.nbr JOIN deg w ON w.v = a.nbr GROUP BY q.u, q.v)",
    "hood": "hood AS (SELECT pd.*, coalesce(cn.cn, 0) AS cn, coalesce(aa, 0) AS aa, coalesce(ra, 0) AS ra, coalesce(rai, 0) AS rai FROM pd LEFT JOIN cn ON cn.u = pd.u AND cn.v = pd.v)",
    "t": r"t AS (SELECT id, list_filter(regexp_split_to_array(abstract, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w, length(abstract) AS chars FROM n)",
    "tk": r"tk AS (SELECT id, unnest(regexp_extract_all(lower(abstract), '[\p{L}\p{N}]+')) AS word FROM n)",
    "f": "f AS (SELECT id, arg_min(author, pos) AS author FROM na GROUP BY id)",
    "ag": "ag AS (SELECT a, b, sum(w) AS weight FROM (SELECT x.author AS a, y.author AS b, 1.0::DOUBLE AS w FROM na x JOIN na y ON x.id = y.id AND x.pos < y.pos UNION ALL SELECT x.author, y.author, 0.5::DOUBLE FROM e JOIN na x ON x.id = e.src JOIN na y ON y.id = e.dst) GROUP BY a, b)",
    "ap": "ap AS (SELECT p.pair_id, p.split, p.y, fu.author AS u, fv.author AS v FROM p LEFT JOIN f fu ON fu.id = p.u LEFT JOIN f fv ON fv.id = p.v)",
    "hp": "hp AS (SELECT p.pair_id, a.h AS hu, b.h AS hv FROM p JOIN h a ON a.id = p.u JOIN h b ON b.id = p.v)",
    # a score in [0, 1] for the metrics: a hash of the pair leaning to its label
    "s": "s AS (SELECT pair_id, y, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((('0x' || substr(md5('score:' || pair_id), 1, 8))::BIGINT % 1001) / 1000.0::DOUBLE + y) / 2 + 0.03)) AS p FROM p WHERE y IN (0, 1))",
}


def _pagerank_sql(nodes: str, edges: str, rounds: int = 100) -> str:
    """CTEs r0 .. r<rounds> over nodes(id) and edges(src, dst)."""
    out = [f"c AS (SELECT count(*) AS c FROM {nodes})", f"o AS (SELECT src, count(*) AS o FROM {edges} GROUP BY src)", f"r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c AS r FROM {nodes}, c)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT q.id, 0.15::DOUBLE / c + 0.85::DOUBLE * coalesce(m, 0) AS r FROM {nodes} q CROSS JOIN c LEFT JOIN (SELECT g.dst AS id, sum(r / o) AS m FROM {edges} g JOIN r{k} ON r{k}.id = g.src JOIN o ON o.src = g.src GROUP BY g.dst) z ON z.id = q.id)")
    return ", ".join(out)


_RANK = _pagerank_sql("n", "e")


def _levels_sql(seed: str, ways: str, depth: int) -> str:
    """CTEs v0, the seeds (s, w), to v<depth>, the nodes first met at each distance along ways(src, dst), and ds(s, w, d) of them all."""
    out = [f"v0 AS ({seed})"]
    for k in range(1, depth + 1):
        met = " ".join(f"EXCEPT SELECT * FROM v{j}" for j in range(k))
        out.append(f"v{k} AS MATERIALIZED (SELECT DISTINCT q.s, x.dst AS w FROM v{k - 1} q JOIN {ways} x ON x.src = q.w {met})")
    return ", ".join([*out, "ds AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, w, {k} AS d FROM v{k}" for k in range(depth + 1)) + ")"])


_HOPS = (
    """asked AS (SELECT DISTINCT u, v FROM p),
lk AS (SELECT a.u, a.v, e.src IS NOT NULL AS linked, EXISTS (SELECT 1 FROM cn WHERE cn.u = a.u AND cn.v = a.v) AS two, coalesce(d, 0) AS du
    FROM asked a LEFT JOIN e ON e.src = least(a.u, a.v) AND e.dst = greatest(a.u, a.v) LEFT JOIN deg ON deg.v = a.u),
s0 AS (SELECT DISTINCT u AS s FROM asked), way AS (SELECT v AS src, nbr AS dst FROM adj), """
    + _levels_sql("SELECT s, s AS w FROM s0", "way", 8)
    + """, sp AS (SELECT lk.u, lk.v, CASE WHEN lk.u = lk.v THEN 0 WHEN linked AND two THEN 2 WHEN linked AND du > 1 THEN 3 WHEN linked THEN 1 ELSE coalesce(ds.d, -1) END AS hops
    FROM lk LEFT JOIN ds ON ds.s = lk.u AND ds.w = lk.v)"""
)
_ARANK = "an AS (SELECT DISTINCT author AS id FROM na), ae AS (SELECT a AS src, b AS dst FROM ag), " + _pagerank_sql("an", "ae")
_AHOPS = (
    """aa AS (SELECT DISTINCT u, v FROM ap WHERE u IS NOT NULL AND v IS NOT NULL), nl AS (SELECT a AS src, b AS dst FROM ag WHERE a <> b),
k1 AS (SELECT aa.u, aa.v FROM aa JOIN nl ON nl.src = aa.u AND nl.dst = aa.v),
k2 AS (SELECT DISTINCT aa.u, aa.v FROM aa JOIN nl x ON x.src = aa.u JOIN nl y ON y.src = x.dst AND y.dst = aa.v WHERE aa.u <> aa.v),
s0 AS (SELECT DISTINCT u AS s FROM aa), """
    + _levels_sql("SELECT s, s AS w FROM s0", "nl", 8)
    + """, ah AS (SELECT aa.u, aa.v, CASE WHEN aa.u = aa.v THEN 0 WHEN k2.u IS NOT NULL THEN 2 WHEN k1.u IS NOT NULL THEN 1 ELSE coalesce(ds.d, 15) END AS hops
    FROM aa LEFT JOIN k1 ON k1.u = aa.u AND k1.v = aa.v LEFT JOIN k2 ON k2.u = aa.u AND k2.v = aa.v LEFT JOIN ds ON ds.s = aa.u AND ds.w = aa.v)"""
)
_SUCC = """so AS (SELECT a AS src, count(*) AS d FROM ag GROUP BY a), sc AS (SELECT q.u, q.v, count(*) AS cn FROM (SELECT DISTINCT u, v FROM ap) q JOIN ag x ON x.a = q.u JOIN ag y ON y.a = q.v AND y.b = x.b GROUP BY q.u, q.v),
su AS (SELECT ap.pair_id, ap.u, ap.v, coalesce(sc.cn, 0) AS cn, coalesce(x.d, 0) + coalesce(y.d, 0) - coalesce(sc.cn, 0) AS un FROM ap LEFT JOIN sc ON sc.u = ap.u AND sc.v = ap.v LEFT JOIN so x ON x.src = ap.u LEFT JOIN so y ON y.src = ap.v)"""
_STR = "st AS (SELECT a AS src, sum(weight) AS strength FROM ag GROUP BY a)"
_OVER = "ov AS (SELECT p.*, coalesce(a.chars, 0) AS lu, coalesce(b.chars, 0) AS lv, coalesce(len(list_distinct(a.w)), 0) AS tu, coalesce(len(list_distinct(b.w)), 0) AS tv, coalesce(len(list_intersect(list_distinct(a.w), list_distinct(b.w))), 0) AS common_terms FROM p LEFT JOIN t a ON a.id = p.u LEFT JOIN t b ON b.id = p.v)"
_CA = "ca AS (SELECT p.*, coalesce(k, 0) AS common_authors FROM p LEFT JOIN (SELECT q.pair_id, count(*) AS k FROM p q JOIN (SELECT DISTINCT id, author FROM na) a ON a.id = q.u JOIN (SELECT DISTINCT id, author FROM na) b ON b.id = q.v AND a.author = b.author GROUP BY q.pair_id) z ON z.pair_id = p.pair_id)"


def _add(name: str, uses: str = "", sql: str = "", more: str = "") -> Callable[[Query], Query]:
    """Register a query; with SQL, after the CTEs named in uses and those spelled out in more."""

    def put(f: Query) -> Query:
        _queries[name] = f
        if sql:
            ctes = ", ".join([_CTE[k] for k in uses.split()] + ([more] if more else []))
            _sql[name] = (f"WITH {ctes} " if ctes else "") + sql
        return f

    return put


def _feature(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: features.build(s, d, name)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


# graph


@_add("graph_edges", "e", "SELECT * FROM e")
def _(s, d):
    return T.edges(s, d)


@_add("adjacency", "e adj", "SELECT * FROM adj")
def _(s, d):
    return G.adjacency(T.edges(s, d))


@_add("node_degree", "e adj deg", "SELECT * FROM deg")
def _(s, d):
    return G.degree(G.adjacency(T.edges(s, d)))


@_add("out_degree", "e", "SELECT src, count(*) AS d FROM e GROUP BY src")
def _(s, d):
    return G.out_degree(T.edges(s, d))


@_add("graph_stats", "e n", "SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT max(id) FROM n) AS max_id, (SELECT count(*) FROM e) AS n_edges")
def _(s, d):
    return G.graph_stats(T.nodes(s, d), T.edges(s, d))


_H = "(('0x' || substr(md5({}), 1, 8))::BIGINT)"


@_add("pair_split", "e", f"SELECT src, dst, CASE WHEN {_H.format("'split:' || src || ':' || dst")} % 100 < 20 THEN 'dev' ELSE 'train' END AS split FROM e")
def _(s, d):
    return G.split_edges(T.edges(s, d))


@_add("positive_pairs", "p", "SELECT pair_id, split, u, v FROM p WHERE y = 1")
def _(s, d):
    return T.pairs(s, d).where("y = 1").select("pair_id", "split", "u", "v")


_NEG = f"dr AS (SELECT id AS u, {_H.format("'{}:' || id || ':' || k")} % top AS v FROM (SELECT id, unnest(range(0, {{}})) AS k FROM n), (SELECT max(id) + 1 AS top FROM n)), "


@_add("negative_pairs", "e n", "SELECT u, v FROM ng", _NEG.format("neg", 10) + "ng AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM dr WHERE u <> v EXCEPT SELECT src, dst FROM e)")
def _(s, d):
    return G.non_edges(T.nodes(s, d), T.edges(s, d))


@_add("naive_negative_pairs", "n", "SELECT u, v FROM dr", _NEG.format("naive", 1)[:-2])
def _(s, d):
    return G.naive_non_edges(T.nodes(s, d))


@_add("labelled_pairs", "e n", "SELECT src AS u, dst AS v, 1 AS y FROM e UNION ALL SELECT u, v, 0 FROM ng", _NEG.format("neg", 10) + "ng AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM dr WHERE u <> v EXCEPT SELECT src, dst FROM e)")
def _(s, d):
    e = T.edges(s, d)
    return G.labelled(e, G.non_edges(T.nodes(s, d), e))


@_add("heldout_edges_except", "e p", "SELECT * FROM e EXCEPT SELECT least(u, v), greatest(u, v) FROM p WHERE split = 'dev'")
def _(s, d):
    return G.held_out(T.edges(s, d), T.pairs(s, d).where("split = 'dev'").selectExpr("u AS src", "v AS dst"))


@_add("edge_membership", "e p", "SELECT pair_id, u, v, (e.src IS NOT NULL)::INT AS linked FROM p LEFT JOIN e ON e.src = least(u, v) AND e.dst = greatest(u, v)")
def _(s, d):
    return G.is_edge(T.pairs(s, d).select("pair_id", "u", "v"), T.edges(s, d)).select("pair_id", "u", "v", "linked")


@_add("induced_subgraph", "e", "SELECT * FROM e WHERE src < 100 AND dst < 100")
def _(s, d):
    return G.induced(T.edges(s, d), 0, 100)


@_add("complement_pairs", "e n", "SELECT a.id AS u, b.id AS v FROM n a JOIN n b ON a.id < b.id AND a.id BETWEEN 0 AND 99 AND b.id BETWEEN 0 AND 99 EXCEPT SELECT src, dst FROM e")
def _(s, d):
    """The range of ids is the operator's argument."""
    return G.complement(T.nodes(s, d), T.edges(s, d), 0, 100)


@_add("self_loops", "", "SELECT DISTINCT u AS id FROM edgelist WHERE u = v AND u >= 0")
def _(s, d):
    return T.table(s, d, "edgelist").where("u = v AND u >= 0").select(F.col("u").alias("id")).distinct()


@_add("gcn_norm_edges", "e adj n", "SELECT f.v AS src, f.nbr AS dst, round(1 / sqrt(a.d::DOUBLE * b.d::DOUBLE), 6) AS w FROM f JOIN fd a ON a.v = f.v JOIN fd b ON b.v = f.nbr", "f AS (SELECT v, nbr FROM adj UNION ALL SELECT id, id FROM n), fd AS (SELECT v, count(*) AS d FROM f GROUP BY v)")
def _(s, d):
    return G.gcn_weights(T.nodes(s, d), T.edges(s, d)).select("src", "dst", _r("w"))


@_add("mean_neighbor_agg", "e adj h", "SELECT adj.v AS id, pos - 1 AS pos, round(avg(x), 6) AS m FROM adj JOIN (SELECT id, unnest(h) AS x, generate_subscripts(h, 1) AS pos FROM h) f ON f.id = adj.nbr GROUP BY adj.v, pos")
def _(s, d):
    x = N.mean_vectors(G.adjacency(T.edges(s, d)), T.vectors(s, d)).select("id", F.posexplode("m").alias("pos", "m"))
    return x.select("id", F.col("pos").cast("bigint").alias("pos"), _r("m"))


# given weights for the layers: small numbers by a rule, the same in SQL
def _w(rows: int, cols: int, seed: int) -> list[list[float]]:
    return [[((i * 7 + o * 13 + seed) % 11 - 5) / 50 for i in range(cols)] for o in range(rows)]


def _w_sql(seed: int) -> str:
    return f"((((i - 1) * 7 + o * 13 + {seed}) % 11 - 5) / 50.0::DOUBLE)"


_MEAN = "fl AS (SELECT id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM h), mn AS (SELECT adj.v AS id, i, avg(x) AS m FROM adj JOIN fl ON fl.id = adj.nbr GROUP BY adj.v, i), os AS (SELECT unnest(range(8)) AS o)"


@_add(
    "sage_layer", "e adj h",
    f"SELECT id, o AS pos, round(sum(x * {_w_sql(1)} + coalesce(m, 0) * {_w_sql(2)}), 6) AS z FROM (SELECT fl.id, fl.i, x, m FROM fl LEFT JOIN mn ON mn.id = fl.id AND mn.i = fl.i), os GROUP BY id, o", _MEAN,
)
def _(s, d):
    """A layer of mean aggregation with given weights."""
    x = N.sage_layer(T.vectors(s, d), T.edges(s, d), _w(8, 64, 1), _w(8, 64, 2))
    return x.select("id", F.posexplode("h").alias("pos", "z")).select("id", F.col("pos").cast("bigint").alias("pos"), _r("z"))


@_add(
    "gcn_layer", "e adj n h",
    f"SELECT f.v AS id, o AS pos, round(sum(y / sqrt(a.d::DOUBLE * b.d::DOUBLE)), 6) AS z FROM f JOIN fd a ON a.v = f.v JOIN fd b ON b.v = f.nbr JOIN hy ON hy.id = f.nbr GROUP BY f.v, o",
    _MEAN + f", f AS (SELECT v, nbr FROM adj UNION ALL SELECT id, id FROM n), fd AS (SELECT v, count(*) AS d FROM f GROUP BY v), hy AS (SELECT id, o, sum(x * {_w_sql(3)}) AS y FROM fl, os GROUP BY id, o)",
)
def _(s, d):
    """A step of graph convolution with given weights."""
    x = N.gcn_layer(T.nodes(s, d), T.edges(s, d), T.vectors(s, d), _w(8, 64, 3))
    return x.select("id", F.posexplode("h").alias("pos", "z")).select("id", F.col("pos").cast("bigint").alias("pos"), _r("z"))


@_add(
    "mlp_score", "p h hp",
    f"SELECT pair_id, round(sum(greatest(z, 0) * ((o * 3 + 4) % 7 - 3) / 10.0::DOUBLE), 6) AS score FROM (SELECT pair_id, o, sum(x * {_w_sql(4)}) AS z FROM (SELECT pair_id, unnest(list_concat(hu, hv)) AS x, generate_subscripts(list_concat(hu, hv), 1) AS i FROM hp), os GROUP BY pair_id, o) GROUP BY pair_id",
    "os AS (SELECT unnest(range(8)) AS o)",
)
def _(s, d):
    """A hidden layer over both vectors, then one output, with given weights."""
    out = [((o * 3 + 4) % 7 - 3) / 10 for o in range(8)]
    return embed.on_pairs(T.pairs(s, d), T.vectors(s, d)).select("pair_id", F.round(N.mlp_score("hu", "hv", _w(8, 128, 4), out), 6).alias("score"))


_UNIT = "un AS (SELECT id, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS h FROM h WHERE list_dot_product(h, h) > 0), ro AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS row FROM (SELECT p.pair_id, a.h AS q, b.h AS c FROM p JOIN un a ON a.id = p.u JOIN un b ON b.id = p.v WHERE p.y = 1)), ba AS (SELECT row // 16 AS batch, row % 16 AS pos, q, c FROM ro), sc AS (SELECT x.batch, x.pos, y.pos AS other, 10 * list_dot_product(x.q, y.c) AS s FROM ba x JOIN ba y ON x.batch = y.batch), il AS (SELECT batch, pos, ln(sum(exp(s - m))) + any_value(m) - max(CASE WHEN other = pos THEN s END) AS loss, (arg_min(other, (round(-s, 9), other)) = pos)::INT AS correct FROM (SELECT *, max(s) OVER (PARTITION BY batch, pos) AS m FROM sc) GROUP BY batch, pos)"


def _in_batch(s: SparkSession, d: str) -> DataFrame:
    unit = T.vectors(s, d).select("id", V.norm("h").alias("n"), "h").where("n > 0").select("id", F.transform("h", lambda x: x / F.col("n")).alias("h"))
    x = embed.on_pairs(T.pairs(s, d).where("y = 1"), unit).select("pair_id", F.col("hu").alias("q"), F.col("hv").alias("p"))
    return N.in_batch(N.batches(x, "pair_id", 16), 0.1)


@_add("in_batch_scores", "p h", "SELECT batch, pos, round(loss, 6) AS loss, correct FROM il", _UNIT)
def _(s, d):
    """Linked papers as query and passage, sixteen to a batch: the others of a batch are the negatives."""
    return _in_batch(s, d).select("batch", "pos", _r("loss"), "correct")


@_add("in_batch_loss", "p h", "SELECT round(avg(m), 6) AS loss, round(avg(c), 6) AS accuracy FROM (SELECT avg(loss) AS m, avg(correct) AS c FROM il GROUP BY batch)", _UNIT)
def _(s, d):
    x = _in_batch(s, d).groupBy("batch").agg(F.avg("loss").alias("m"), F.avg("correct").alias("c"))
    return x.agg(F.avg("m").alias("loss"), F.avg("c").alias("accuracy")).select(_r("loss"), _r("accuracy"))


@_add(
    "vgae_losses", "p h hp",
    """SELECT round(-0.5::DOUBLE * avg(k) / count(*), 6) AS kl, (SELECT round((sum(1 - y) * sum(CASE WHEN y = 1 THEN ln(1 + exp(-s)) END) / sum(y) + sum(CASE WHEN y = 0 THEN ln(1 + exp(s)) ELSE 0 END)) / count(*), 6)
    FROM (SELECT p.y, list_dot_product(hu[1:32], hv[1:32]) AS s FROM hp JOIN p ON p.pair_id = hp.pair_id WHERE p.y IN (0, 1))) AS reconstruction
FROM (SELECT list_sum(list_transform(range(1, 33), lambda i: 1 + 2 * h[i + 32] / 10 - h[i] * h[i] - exp(2 * h[i + 32] / 10))) AS k FROM h)""",
)
def _(s, d):
    """Half of a vector as the mean and half, scaled, as the log deviation of a hidden normal; pairs are decoded by the inner product."""
    h = T.vectors(s, d)
    kl = N.gaussian_divergence(h, F.slice("h", 1, 32), F.transform(F.slice("h", 33, 32), lambda x: x / 10))
    x = embed.on_pairs(T.pairs(s, d).where("y IN (0, 1)"), h).select("y", V.dot(F.slice("hu", 1, 32), F.slice("hv", 1, 32)).alias("s"))
    return kl.crossJoin(N.weighted_entropy(x, "s", "y")).select(_r("kl"), F.round("loss", 6).alias("reconstruction"))  # one row each


@_add("masked_edges")
def _(s, d):
    """Two per cent of the edges for test and for dev, and as many non-edges in each split."""
    return G.masked(T.nodes(s, d), T.edges(s, d))


@_add("exact_negatives")
def _(s, d):
    """As many non-edges as there are edges."""
    e = T.edges(s, d)
    return G.exact_non_edges(T.nodes(s, d), e, e.count())


@_add("tail_slice", "p", "SELECT pair_id FROM p ORDER BY pair_id DESC LIMIT 500")
def _(s, d):
    """The number of rows is the operator's argument."""
    return G.last(T.pairs(s, d).select("pair_id"), "pair_id", 500)


@_add("message_sum", "e adj deg", "SELECT e.dst AS id, sum(deg.d)::BIGINT AS m FROM e JOIN deg ON deg.v = e.src GROUP BY e.dst")
def _(s, d):
    e = T.edges(s, d)
    return G.message_pass(e, G.degree(G.adjacency(e)).toDF("id", "d"), F.col("d"), F.sum)


@_add("edge_attention", "e h", "SELECT src, dst, round(exp(s - max(s) OVER (PARTITION BY dst)) / sum(exp(s - m)) OVER (PARTITION BY dst), 6) AS a FROM (SELECT *, max(s) OVER (PARTITION BY dst) AS m FROM q)", "q AS (SELECT src, dst, list_dot_product(a.h, b.h) AS s FROM e JOIN h a ON a.id = src JOIN h b ON b.id = dst)")
def _(s, d):
    e = T.edges(s, d)
    x = embed.on_pairs(e.toDF("u", "v"), T.vectors(s, d)).select(F.col("u").alias("src"), F.col("v").alias("dst"), V.dot("hu", "hv").alias("s"))
    return G.attention(e, x).select("src", "dst", _r("a"))


@_add("row_number_ids", "p", "SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS row FROM p")
def _(s, d):
    return G.numbered(T.pairs(s, d).select("pair_id"), "pair_id")


@_add("balanced_slice", "p", "SELECT pair_id FROM (SELECT pair_id FROM p ORDER BY pair_id DESC LIMIT 500) UNION ALL SELECT pair_id FROM (SELECT pair_id FROM p ORDER BY pair_id LIMIT 500)")
def _(s, d):
    """The number of rows is the operator's argument."""
    return G.tails(T.pairs(s, d).select("pair_id"), "pair_id", 1000)


@_add("union_whole", "p", "SELECT pair_id, u, v, y FROM p WHERE split IN ('train', 'dev')")
def _(s, d):
    p = T.pairs(s, d)
    return p.where("split = 'train'").unionByName(p.where("split = 'dev'")).select("pair_id", "u", "v", "y")


# pair features


@_add("degree_features", "e adj deg p pd", "SELECT pair_id, du + dv AS degree_sum, abs(du - dv) AS degree_diff FROM pd")
def _(s, d):
    x = P.with_degrees(T.pairs(s, d), G.degree(G.adjacency(T.edges(s, d))))
    return x.select("pair_id", (F.col("du") + F.col("dv")).alias("degree_sum"), F.abs(F.col("du") - F.col("dv")).alias("degree_diff"))


def _hood(name: str, digits: int | None = None) -> Query:
    def q(s, d):
        x = P.neighbourhood(T.pairs(s, d), T.edges(s, d))
        return x.select("pair_id", _r(name, digits) if digits else F.col(name))

    return q


_HOOD = "e adj deg p pd cn hood"
for _name, _expr, _digits in (
    ("common_neighbors", "cn", None), ("jaccard", "round(CASE WHEN du + dv - cn > 0 THEN cn::DOUBLE / (du + dv - cn) ELSE 0 END, 6)", 6), ("adamic_adar", "round(aa::DOUBLE, 6)", 6), ("resource_allocation", "ra::BIGINT", None),
    ("resource_allocation_textbook", "round(rai::DOUBLE, 6)", 6), ("preferential_attachment", "du * dv", None), ("salton", "round(CASE WHEN du * dv > 0 THEN cn / sqrt((du * dv)::DOUBLE) ELSE 0 END, 6)", 6),
):
    _add(_name, _HOOD, f"SELECT pair_id, {_expr} AS {_name} FROM hood")(_hood(_name, _digits))


@_add("text_length_features", "n t p", "SELECT pair_id, lu + lv AS length_sum, abs(lu - lv) AS length_diff FROM ov", _OVER)
def _(s, d):
    x = P.text_overlap(T.pairs(s, d), X.term_sets(T.nodes(s, d)))
    return x.select("pair_id", (F.col("lu") + F.col("lv")).cast("bigint").alias("length_sum"), F.abs(F.col("lu") - F.col("lv")).cast("bigint").alias("length_diff"))


@_add("common_terms", "n t p", "SELECT pair_id, common_terms FROM ov", _OVER)
def _(s, d):
    return P.text_overlap(T.pairs(s, d), X.term_sets(T.nodes(s, d))).select("pair_id", F.col("common_terms").cast("bigint").alias("common_terms"))


@_add("unique_term_features", "n t p", "SELECT pair_id, tu + tv AS terms_sum, abs(tu - tv) AS terms_diff, common_terms FROM ov", _OVER)
def _(s, d):
    x = P.text_overlap(T.pairs(s, d), X.term_sets(T.nodes(s, d)))
    return x.select("pair_id", (F.col("tu") + F.col("tv")).cast("bigint").alias("terms_sum"), F.abs(F.col("tu") - F.col("tv")).cast("bigint").alias("terms_diff"), F.col("common_terms").cast("bigint").alias("common_terms"))


@_add("edge_generic", "e adj deg n t p pd", "SELECT pd.pair_id, du + dv AS f0, abs(du - dv) AS f1, lu + lv AS f2, abs(lu + lv) AS f3, common_terms AS f4 FROM pd JOIN ov ON ov.pair_id = pd.pair_id", _OVER)
def _(s, d):
    """Five features; the fourth repeats the third."""
    p = P.with_degrees(T.pairs(s, d), G.degree(G.adjacency(T.edges(s, d))))
    x = P.text_overlap(p, X.term_sets(T.nodes(s, d)))
    both = (F.col("lu") + F.col("lv")).cast("bigint")
    return x.select("pair_id", (F.col("du") + F.col("dv")).alias("f0"), F.abs(F.col("du") - F.col("dv")).alias("f1"), both.alias("f2"), F.abs(both).alias("f3"), F.col("common_terms").cast("bigint").alias("f4"))


@_add("baseline5", "e adj deg n t p pd", "SELECT pd.pair_id, du + dv AS degree_sum, abs(du - dv) AS degree_diff, tu + tv AS terms_sum, abs(tu - tv) AS terms_diff, common_terms FROM pd JOIN ov ON ov.pair_id = pd.pair_id", _OVER)
def _(s, d):
    p = P.with_degrees(T.pairs(s, d), G.degree(G.adjacency(T.edges(s, d))))
    x = P.text_overlap(p, X.term_sets(T.nodes(s, d)))
    return x.select("pair_id", (F.col("du") + F.col("dv")).alias("degree_sum"), F.abs(F.col("du") - F.col("dv")).alias("degree_diff"), (F.col("tu") + F.col("tv")).cast("bigint").alias("terms_sum"), F.abs(F.col("tu") - F.col("tv")).cast("bigint").alias("terms_diff"), F.col("common_terms").cast("bigint").alias("common_terms"))


@_add("common_authors", "al na p", "SELECT pair_id, common_authors FROM ca", _CA)
def _(s, d):
    return _feature("common_authors")(s, d).select("pair_id", F.col("common_authors").cast("bigint").alias("common_authors"))


@_add("pagerank", "e n", "SELECT id, round(r, 8) AS rank FROM r100", _RANK)
def _(s, d):
    return rank.pagerank(T.nodes(s, d), T.edges(s, d)).select("id", _r("rank", 8))


@_add("pagerank_symmetric", "e adj n", "SELECT id, round(r, 8) AS rank FROM r100", "se AS (SELECT v AS src, nbr AS dst FROM adj), " + _pagerank_sql("n", "se"))
def _(s, d):
    return rank.pagerank(T.nodes(s, d), G.adjacency(T.edges(s, d)).toDF("src", "dst")).select("id", _r("rank", 8))


@_add("pagerank_pair", "e n p", "SELECT pair_id, round(coalesce(a.r, 0) + coalesce(b.r, 0), 8) AS pagerank_sum, round(abs(coalesce(a.r, 0) - coalesce(b.r, 0)), 8) AS pagerank_diff FROM p LEFT JOIN r100 a ON a.id = p.u LEFT JOIN r100 b ON b.id = p.v", _RANK)
def _(s, d):
    return _feature("pagerank_pair")(s, d).select("pair_id", _r("pagerank_sum", 8), _r("pagerank_diff", 8))


@_add("shortest_path", "e adj deg p cn", "SELECT u, v, hops FROM sp", _HOPS)
def _(s, d):
    return paths.hops(T.pairs(s, d), T.edges(s, d))


@_add(
    "baseline15", "e adj deg n t p pd cn hood al na",
    "SELECT hood.pair_id, hood.split, hood.u, hood.v, hood.y, du + dv AS degree_sum, abs(du - dv) AS degree_diff, lu + lv AS length_sum, abs(lu - lv) AS length_diff, common_terms, hops AS shortest_path, cn AS common_neighbors, round(CASE WHEN du + dv - cn > 0 THEN cn::DOUBLE / (du + dv - cn) ELSE 0 END, 6) AS jaccard, round(aa::DOUBLE, 6) AS adamic_adar, ra::BIGINT AS resource_allocation, round(1 / (1 + exp(-(du * dv)::DOUBLE)), 6) AS preferential_attachment, round(CASE WHEN du * dv > 0 THEN cn / sqrt((du * dv)::DOUBLE) ELSE 0 END, 6) AS salton, round(coalesce(a.r, 0) + coalesce(b.r, 0), 8) AS pagerank_sum, round(abs(coalesce(a.r, 0) - coalesce(b.r, 0)), 8) AS pagerank_diff, common_authors FROM hood JOIN ov ON ov.pair_id = hood.pair_id JOIN ca ON ca.pair_id = hood.pair_id JOIN sp ON sp.u = hood.u AND sp.v = hood.v LEFT JOIN r100 a ON a.id = hood.u LEFT JOIN r100 b ON b.id = hood.v",
    ", ".join([_OVER, _CA, _HOPS, _RANK]),
)
def _(s, d):
    x = _feature("baseline15")(s, d)
    return x.select(*[_r(c, 8 if "rank" in c else 6) if t == "double" else F.col(c).cast("bigint").alias(c) if c in ("length_sum", "length_diff", "common_terms", "common_authors") else c for c, t in x.dtypes])


# authors


@_add("author_index", "al na", "SELECT row_number() OVER (ORDER BY name) - 1 AS author_idx, name, freq FROM (SELECT author AS name, count(*) AS freq FROM na GROUP BY author)")
def _(s, d):
    return A.author_index(T.node_author(s, d))


@_add("coauthor_edges", "al na", "SELECT x.author AS a, y.author AS b, count(*) AS n FROM na x JOIN na y ON x.id = y.id AND x.pos < y.pos GROUP BY x.author, y.author")
def _(s, d):
    return A.coauthor_pairs(T.node_author(s, d)).groupBy("a", "b").agg(F.count("*").alias("n"))


@_add("author_graph", "e al na ag", "SELECT a, b, weight FROM ag")
def _(s, d):
    return A.author_graph(T.edges(s, d), T.node_author(s, d))


@_add("author_link_strength", "e al na ag", "SELECT src, round(strength, 6) AS strength FROM st", _STR)
def _(s, d):
    return A.link_strength(A.author_graph(T.edges(s, d), T.node_author(s, d)).toDF("src", "dst", "weight")).select("src", _r("strength"))


@_add("first_author", "al na f", "SELECT id, author FROM f")
def _(s, d):
    return A.first_author(T.node_author(s, d))


@_add("author_pagerank", "e al na ag", "SELECT id, round(r, 8) AS rank FROM r100", _ARANK)
def _(s, d):
    return _feature("author_pagerank")(s, d).select("id", _r("rank", 8))


@_add("author_shortest_path", "e al na ag f p ap", "SELECT u, v, hops FROM ah", _AHOPS)
def _(s, d):
    b = features.registry.build(["author_pairs", "author_links"], features.given(s, d))
    return A.directed_hops(b["author_pairs"], b["author_links"])


@_add("author_jaccard", "e al na ag f p ap", "SELECT pair_id, cn, un, round(cn / (1e-8::DOUBLE + un), 6) AS jaccard FROM su", _SUCC)
def _(s, d):
    return _feature("author_successors")(s, d).select("pair_id", "cn", "un", _r("jaccard"))


@_add(
    "author_block6", "e al na ag f p ap",
    "SELECT ap.pair_id, ap.split, ap.y, coalesce(hops, 15) AS author_path, round(su.cn / (1e-8::DOUBLE + su.un), 6) AS author_jaccard, round(least(coalesce(x.r, 0), coalesce(z.r, 0)), 8) AS rank_min, round(greatest(coalesce(x.r, 0), coalesce(z.r, 0)), 8) AS rank_max, round(least(coalesce(s1.strength, 0), coalesce(s2.strength, 0)), 6) AS weight_min, round(greatest(coalesce(s1.strength, 0), coalesce(s2.strength, 0)), 6) AS weight_max FROM ap JOIN su ON su.pair_id = ap.pair_id LEFT JOIN ah ON ah.u = ap.u AND ah.v = ap.v LEFT JOIN r100 x ON x.id = ap.u LEFT JOIN r100 z ON z.id = ap.v LEFT JOIN st s1 ON s1.src = ap.u LEFT JOIN st s2 ON s2.src = ap.v",
    ", ".join([_SUCC, _AHOPS, _ARANK, _STR]),
)
def _(s, d):
    x = _feature("author_block6")(s, d)
    return x.select("pair_id", "split", "y", "author_path", _r("author_jaccard"), _r("rank_min", 8), _r("rank_max", 8), _r("weight_min"), _r("weight_max"))


_BALLS = (
    """m AS (SELECT DISTINCT id, author FROM na WHERE id IN (SELECT u FROM p UNION SELECT v FROM p)), way AS (SELECT a AS src, b AS dst FROM ag), """
    + _levels_sql("SELECT DISTINCT author AS s, author AS w FROM m", "way", 9)
    + """, pb AS MATERIALIZED (SELECT id AS s, w, min(d) AS d FROM m JOIN ds ON ds.s = m.author GROUP BY id, w),
dp AS (SELECT s, max(d) AS depth FROM pb GROUP BY s), q AS (SELECT pair_id, u, v, least(x.depth, y.depth) AS most FROM p JOIN dp x ON x.s = u JOIN dp y ON y.s = v),
sh AS (SELECT pair_id, count(*) AS shared FROM q JOIN pb x ON x.s = u AND x.d <= most JOIN pb y ON y.s = v AND y.w = x.w AND y.d <= most GROUP BY pair_id)"""
)


@_add("bfs_ball_distance", "e al na ag p", "SELECT p.pair_id, coalesce(shared, 0) AS shared, round(exp(-coalesce(shared, 0)::DOUBLE), 6) AS distance FROM p LEFT JOIN sh ON sh.pair_id = p.pair_id", _BALLS)
def _(s, d):
    """Balls of up to sixteen levels around the authors of both papers, in the author graph."""
    given = features.given(s, d)
    graph = features.registry.build(["author_links"], given)["author_links"]
    x = paths.ball_distance(T.pairs(s, d).select("pair_id", "u", "v"), given["node_author"].select("id", F.col("author").alias("node")), graph)
    return x.select("pair_id", "shared", _r("distance"))


# text


@_add("vocab_frequency", "n tk", "SELECT word, count(*) AS n, count(DISTINCT id) AS docs FROM tk GROUP BY word")
def _(s, d):
    return X.word_counts(T.nodes(s, d))


@_add("vocab_band", "n tk", "SELECT word, count(*) AS n FROM tk GROUP BY word HAVING count(*) > 50 AND count(*) < 5000")
def _(s, d):
    return X.vocabulary_band(X.word_counts(T.nodes(s, d)), 50, 5000)


_DT = "dt AS (SELECT id, word_idx, count(*) AS tf FROM tk JOIN cora_vocab c ON c.word = tk.word GROUP BY id, word_idx), dn AS (SELECT * FROM dt UNION ALL SELECT id, (SELECT count(*) FROM cora_vocab), 1 FROM n WHERE id NOT IN (SELECT id FROM dt))"


@_add("doc_term", "n tk", "SELECT id, word_idx, tf FROM dn", _DT)
def _(s, d):
    return X.doc_terms(T.nodes(s, d), T.table(s, d, "cora_vocab"))


@_add("tf_rownorm", "n tk", "SELECT id, word_idx, round(tf / sum(tf) OVER (PARTITION BY id)::DOUBLE, 6) AS share FROM dn", _DT)
def _(s, d):
    return X.row_normalised(X.doc_terms(T.nodes(s, d), T.table(s, d, "cora_vocab"))).select("id", "word_idx", _r("share"))


@_add("term_index", "n tk", "SELECT row_number() OVER (ORDER BY word) - 1 AS word_idx, word, n FROM (SELECT word, count(*) AS n FROM tk GROUP BY word)")
def _(s, d):
    return G.numbered(X.word_counts(T.nodes(s, d)).select("word", "n"), "word", "word_idx").select("word_idx", "word", "n")


@_add("stemmed_vocab")
def _(s, d):
    return X.stemmed_counts(X.word_counts(T.nodes(s, d)))


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# What the check in SQL takes for stop words among whole tokens (the engine takes the list that comes with Spark, whose other words have an apostrophe).
_STOP = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now could would cannot".split()


@_add(
    "admitted_tokens", "n",
    rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(abstract), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS word FROM n) WHERE regexp_full_match(word, '[0-9A-Za-z\x{{4000}}-\x{{10ffff}}]+') AND NOT regexp_full_match(word, '0|[1-9][0-9]{{0,3}}') AND word NOT IN ({_quoted(_STOP)}) GROUP BY word",
)
def _(s, d):
    words = T.nodes(s, d).select(F.explode(TX.word_runs("abstract")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(TX.admitted(F.col("word"), TX.stop_words()))


@_add("stemmed_vocabulary")
def _(s, d):
    """Stems, without stop words, inside the band, numbered."""
    return X.stemmed_vocabulary(T.nodes(s, d), 10, 100_000)


@_add("stemmed_doc_term")
def _(s, d):
    from inkweave.sources.shared import store

    return X.stemmed_doc_terms(T.nodes(s, d), store(X.stemmed_vocabulary(T.nodes(s, d), 10, 100_000), "vocabulary"))


@_add(
    "token_views", "e adj deg n p pd",
    """SELECT pd.pair_id, du AS u_deg, dv AS v_deg, abs(du - dv) AS deg_diff, coalesce(a.ids, z.ids) AS ids_u, coalesce(b.ids, z.ids) AS ids_v, coalesce(a.m, 0) AS tokens_u, coalesce(b.m, 0) AS tokens_v, y
FROM pd LEFT JOIN ids a ON a.id = pd.u LEFT JOIN ids b ON b.id = pd.v, z""",
    r"""z AS (SELECT array_to_string(list_transform(range(16), lambda i: 0), ' ') AS ids), l AS (SELECT id, regexp_extract_all(lower(abstract), '[\p{L}\p{N}]+') AS w FROM n),
x AS (SELECT l.id, t.pos, coalesce(c.word_idx + 2, 1) AS k FROM l, unnest(range(1, least(len(w), 16) + 1)) AS t(pos) LEFT JOIN cora_vocab c ON c.word = l.w[t.pos]),
ids AS (SELECT id, count(*) AS m, array_to_string(list_concat(list(k ORDER BY pos), list_transform(range(16 - count(*)), lambda i: 0)), ' ') AS ids FROM x GROUP BY id)""",
)
def _(s, d):
    """Pairs with degrees and both texts as sixteen token numbers, for an encoder of two texts."""
    p = P.with_degrees(T.pairs(s, d), G.degree(G.adjacency(T.edges(s, d))))
    t = X.token_ids(T.nodes(s, d), T.table(s, d, "cora_vocab"), 16)
    x = p.join(t.toDF("u", "iu", "mu"), "u", "left").join(t.toDF("v", "iv", "mv"), "v", "left")
    text = lambda c: F.coalesce(F.concat_ws(" ", F.transform(c, lambda i: i.cast("string"))), F.lit(" ".join(["0"] * 16)))
    some = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda a, i: a + i), F.lit(0)).cast("bigint")
    shown = lambda c: F.when(F.col(c).isNull(), F.lit(" ".join(["0"] * 16))).otherwise(text(c))
    return x.select("pair_id", F.col("du").alias("u_deg"), F.col("dv").alias("v_deg"), F.abs(F.col("du") - F.col("dv")).alias("deg_diff"), shown("iu").alias("ids_u"), shown("iv").alias("ids_v"), some("mu").alias("tokens_u"), some("mv").alias("tokens_v"), "y")


@_add("passage_views", "n al p", "SELECT p.pair_id, array_to_string(list_filter(a.authors, lambda x: x IS NOT NULL), ',') AS query, n.abstract AS context, p.y AS label FROM p LEFT JOIN al a ON a.id = p.u LEFT JOIN n ON n.id = p.v")
def _(s, d):
    al = T.author_lists(s, d).select(F.col("id").alias("u"), F.concat_ws(",", "authors").alias("query"))
    x = T.pairs(s, d).join(al, "u", "left").join(T.nodes(s, d).toDF("v", "context"), "v", "left")
    return x.select("pair_id", "query", "context", F.col("y").alias("label"))


# vectors


@_add("emb_hadamard", "p h hp", "SELECT pair_id, pos - 1 AS pos, round(x / (1e-8::DOUBLE + sqrt(list_dot_product(hu, hu)) * sqrt(list_dot_product(hv, hv))), 6) AS z FROM (SELECT *, unnest(list_transform(list_zip(hu, hv), lambda t: t[1] * t[2])) AS x, generate_subscripts(hu, 1) AS pos FROM hp)")
def _(s, d):
    x = _feature("hadamard")(s, d).select("pair_id", F.posexplode("features").alias("pos", "z"))
    return x.select("pair_id", F.col("pos").cast("bigint").alias("pos"), _r("z"))


def _vec(expr) -> Query:
    return lambda s, d: embed.on_pairs(T.pairs(s, d), T.vectors(s, d)).select("pair_id", *expr())


_NORMS = "sqrt(list_dot_product(hu, hu)) * sqrt(list_dot_product(hv, hv))"
_add("emb_cosine", "p h hp", f"SELECT pair_id, round(CASE WHEN {_NORMS} > 0 THEN list_dot_product(hu, hv) / ({_NORMS}) END, 6) AS cosine FROM hp")(_vec(lambda: [F.round(V.cosine("hu", "hv"), 6).alias("cosine")]))
_add("emb_cosine01", "p h hp", f"SELECT pair_id, round((CASE WHEN {_NORMS} > 0 THEN list_dot_product(hu, hv) / ({_NORMS}) END + 1) / 2, 6) AS score FROM hp")(_vec(lambda: [F.round((V.cosine("hu", "hv") + 1) / 2, 6).alias("score")]))
_add("dot_score", "p h hp", "SELECT pair_id, round(1 / (1 + exp(-list_dot_product(hu, hv))), 6) AS score FROM hp")(_vec(lambda: [F.round(P.sigmoid(V.dot("hu", "hv")), 6).alias("score")]))


def _flat(name: str, expr, sql: str) -> None:
    """Register a vector of each pair, a row for each position."""

    def q(s: SparkSession, d: str) -> DataFrame:
        x = embed.on_pairs(T.pairs(s, d), T.vectors(s, d)).select("pair_id", F.posexplode(expr()).alias("pos", "z"))
        return x.select("pair_id", F.col("pos").cast("bigint").alias("pos"), _r("z"))

    _add(name, "p h hp", f"SELECT pair_id, pos - 1 AS pos, round(z, 6) AS z FROM (SELECT pair_id, unnest({sql}) AS z, generate_subscripts({sql}, 1) AS pos FROM hp)")(q)


_flat("emb_concat", lambda: F.concat("hu", "hv"), "list_concat(hu, hv)")
_flat("emb_sum", lambda: V.plus("hu", "hv"), "list_transform(list_zip(hu, hv), lambda t: t[1] + t[2])")
_flat("emb_product", lambda: V.times("hu", "hv"), "list_transform(list_zip(hu, hv), lambda t: t[1] * t[2])")

_LAB = "lv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS h, label FROM embeddings)"


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("h"), "label")


@_add("knn_graph", "h", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT x.id AS a, y.id AS b, row_number() OVER (PARTITION BY x.id ORDER BY round(list_sum(list_transform(list_zip(x.h, y.h), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9), y.id) AS r FROM h x JOIN h y ON x.id <> y.id) WHERE r <= 8")
def _(s, d):
    return embed.knn_graph(T.vectors(s, d), 8)


@_add("gaussian_kernel", "", "SELECT x.id AS a, y.id AS b, round(exp(-list_sum(list_transform(list_zip(x.h, y.h), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) / 2), 6) AS k FROM lv x JOIN lv y ON x.id < y.id", _LAB)
def _(s, d):
    return embed.gaussian_kernel(_labelled(s, d).select("id", "h"), 1.0).select("a", "b", _r("k"))


@_add("most_similar_topk", "", "SELECT x.id, round(list_cosine_similarity(x.h, q.h), 6) AS similarity FROM lv x, lv q WHERE q.id = 1 AND x.id <> 1 ORDER BY round(list_cosine_similarity(x.h, q.h), 9) DESC, x.id LIMIT 10", _LAB)
def _(s, d):
    return embed.most_similar(_labelled(s, d).select("id", "h"), 1, 10).select("id", _r("similarity"))


@_add("label_centroids", "", "SELECT label AS cluster, pos - 1 AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(h) AS x, generate_subscripts(h, 1) AS pos FROM lv) GROUP BY label, pos", _LAB)
def _(s, d):
    e = _labelled(s, d)
    return ml.centroids(e.select("id", "h"), e.select("id", F.col("label").alias("cluster"))).select("cluster", F.col("pos").cast("bigint").alias("pos"), _r("x"))


@_add("label_counts", "", "SELECT count(DISTINCT label) AS classes FROM lv", _LAB)
def _(s, d):
    return _labelled(s, d).agg(F.countDistinct("label").alias("classes"))


@_add("label_onehot", "", "SELECT id, " + ", ".join(f"(label = {k})::INT AS c{k}" for k in range(10)) + " FROM lv", _LAB)
def _(s, d):
    return _labelled(s, d).select("id", *[(F.col("label") == k).cast("int").alias(f"c{k}") for k in range(10)])


# scores


def _scores(s: SparkSession, d: str) -> DataFrame:
    p = T.pairs(s, d).where("y IN (0, 1)")
    x = (G.hash31(F.col("pair_id").cast("string"), seed="score") % 1001) / F.lit(1000.0)
    return p.select("pair_id", "y", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + F.col("y")) / 2 + F.lit(0.03))).alias("p"))


@_add("metrics", "p s", "SELECT round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 6) AS log_loss, round(avg(((p > 0.5) = (y = 1))::INT), 6) AS accuracy, round(2.0::DOUBLE * sum((p > 0.5 AND y = 1)::INT) / (2 * sum((p > 0.5 AND y = 1)::INT) + sum(((p > 0.5) <> (y = 1))::INT)), 6) AS f1 FROM s")
def _(s, d):
    return ml.metrics(_scores(s, d)).select(_r("log_loss"), _r("accuracy"), _r("f1"))


@_add("roc_auc", "p s", "SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - any_value(np * (np + 1) / 2.0::DOUBLE)) / any_value((np * nn)::DOUBLE), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0::DOUBLE AS rk, sum((y = 1)::INT) OVER () AS np, sum((y <> 1)::INT) OVER () AS nn FROM (SELECT y, round(p, 6) AS sc FROM s))")
def _(s, d):
    return ml.roc_auc(_scores(s, d)).select(_r("auc"))


@_add("avg_precision", "p s", "SELECT round(sum(c / m * pos) / sum(pos)::DOUBLE, 6) AS ap FROM (SELECT sum(pos) OVER w::DOUBLE AS c, sum(n) OVER w AS m, pos FROM (SELECT round(1 - p, 6) AS sc, sum((y = 1)::INT) AS pos, count(*) AS n FROM s GROUP BY 1) WINDOW w AS (ORDER BY sc))")
def _(s, d):
    return ml.average_precision(_scores(s, d)).select(_r("ap"))


@_add("clip_scores", "p s", "SELECT pair_id, CASE WHEN p < 0.05 THEN 0 WHEN p > 0.9 THEN 1 ELSE round(p, 6) END::DOUBLE AS predicted FROM s")
def _(s, d):
    return _scores(s, d).select("pair_id", F.round(ml.clip_extremes(F.col("p")), 6).alias("predicted"))


@_add("score_histogram", "p s", "SELECT least(floor(p * 200), 199)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1")
def _(s, d):
    return ml.histogram(_scores(s, d))


@_add("soft_vote", "p s", "SELECT pair_id, round((p * 100 + (1 - p) * 87 + (p * p) * 88) / 275.0::DOUBLE, 6) AS by_sum, round((p * 100 + (1 - p) * 87 + (p * p) * 88) / 100.0::DOUBLE, 10) AS by_max, round((p + (1 - p) + p * p) / 3, 6) AS plain FROM s")
def _(s, d):
    p = F.col("p")
    votes, w = [p, 1 - p, p * p], [100.0, 87.0, 88.0]
    return _scores(s, d).select("pair_id", F.round(ml.soft_vote(votes, w), 6).alias("by_sum"), F.round(ml.soft_vote(votes, w, "max"), 10).alias("by_max"), F.round(ml.soft_vote(votes), 6).alias("plain"))


@_add("submission_bce", "p s", "SELECT round(avg(-(p * p * ln(greatest(p, 1e-15)) + (1 - p * p) * ln(greatest(1 - least(p, 1 - 1e-15), 1e-15)))), 6) AS bce FROM s")
def _(s, d):
    return ml.cross_entropy(_scores(s, d).withColumn("q", F.col("p") * F.col("p")), "p", "q").select(_r("bce"))


@_add("pair_losses", "p s", "SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS bce, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS bce_logits, round(avg((x - (2 * y - 1)) * (x - (2 * y - 1))), 6) AS mse, round(avg(((q > 0.5) = (y = 1))::INT), 6) AS accuracy FROM (SELECT y, p * 4 - 2 AS x, 1 / (1 + exp(-(p * 4 - 2))) AS q FROM s)")
def _(s, d):
    x = ml.pair_losses(_scores(s, d).withColumn("s", F.col("p") * 4 - 2))
    return x.select(*[_r(c) for c in x.columns])


@_add("submission", "p s", "SELECT pair_id AS id, round(p, 6) AS predicted FROM s")
def _(s, d):
    return writers.submission(_scores(s, d).withColumn("p", F.round("p", 6)), score="p")


@_add("pairs_checksum", "p", "SELECT count(*) AS rows, sum(('0x' || substr(md5(pair_id || ',' || u || ',' || v), 1, 8))::BIGINT)::BIGINT AS checksum FROM p")
def _(s, d):
    return writers.checksum(T.pairs(s, d), "pair_id", "u", "v")


# iterative and learnt: no SQL


@_add("random_walks")
def _(s, d):
    return walks.random_walks(T.nodes(s, d), G.adjacency(T.edges(s, d)), 2, 10).select("walk", "start", F.concat_ws(" ", "path").alias("path"))


@_add("deepwalk")
def _(s, d):
    w = walks.random_walks(T.nodes(s, d), G.adjacency(T.edges(s, d)), 2, 10)
    return walks.deepwalk(w, 16)


_BASE = ["degree_sum", "degree_diff", "length_sum", "length_diff", "common_terms", "shortest_path", "common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment", "salton", "pagerank_sum", "pagerank_diff", "common_authors"]


def _train_test(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from inkweave.sources.shared import store

    x = store(_feature("baseline15")(s, d), "baseline15")
    return ml.assemble(x.where("split = 'train' AND y IN (0, 1)"), _BASE), ml.assemble(x.where("split = 'dev' AND y IN (0, 1)"), _BASE)


@_add("lr_fit_predict")
def _(s, d):
    """Probabilities for the dev pairs by a model of the train pairs."""
    train, dev = _train_test(s, d)
    return ml.predict(ml.logistic(train, rounds=100), dev).select("pair_id", F.col("label").alias("y"), "p")


@_add("classifier_zoo")
def _(s, d):
    train, dev = _train_test(s, d)
    out = None
    for name, est in ml.zoo().items():
        m = ml.metrics(ml.predict(est.fit(train), dev), "p", "label").withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


@_add("kmeans")
def _(s, d):
    return ml.kmeans(T.vectors(s, d), 10)


@_add("spectral_pic")
def _(s, d):
    return ml.spectral(embed.knn_graph(T.vectors(s, d), 8).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")), 10)


@_add("pca")
def _(s, d):
    return ml.pca(T.vectors(s, d), 10)


@_add("document_vectors")
def _(s, d):
    return M.document_vectors(T.nodes(s, d), 16)


@_add("deepwalk_evaluation")
def _(s, d):
    """A model of links on both ends' walk vectors, learnt on train, measured on dev."""
    from inkweave.sources.shared import store

    w = walks.random_walks(T.nodes(s, d), G.adjacency(T.edges(s, d)), 2, 10)
    x = store(M.pair_features(T.pairs(s, d), walks.deepwalk(w, 16)), "pair_vectors")
    return M.evaluate(ml.logistic(x.where("split = 'train'"), rounds=50), x.where("split = 'dev'"))


@_add("author_block11", "e al na ag f p ap",
    "SELECT ap.pair_id, coalesce(hops, 15) AS path, su.cn AS common, coalesce(x1.d, 0) AS near_u, coalesce(x2.d, 0) AS near_v, round(su.cn / (1e-8::DOUBLE + su.un), 6) AS jaccard, round(coalesce(a11.aa, 0), 6) AS adamic_adar, coalesce(x1.d, 0) * coalesce(x2.d, 0) AS attachment, round(least(coalesce(x.r, 0), coalesce(z.r, 0)), 8) AS rank_min, round(greatest(coalesce(x.r, 0), coalesce(z.r, 0)), 8) AS rank_max, round(least(coalesce(s1.strength, 0), coalesce(s2.strength, 0)), 6) AS weight_min, round(greatest(coalesce(s1.strength, 0), coalesce(s2.strength, 0)), 6) AS weight_max FROM ap JOIN su ON su.pair_id = ap.pair_id LEFT JOIN ah ON ah.u = ap.u AND ah.v = ap.v LEFT JOIN so x1 ON x1.src = ap.u LEFT JOIN so x2 ON x2.src = ap.v LEFT JOIN a11 ON a11.u = ap.u AND a11.v = ap.v LEFT JOIN r100 x ON x.id = ap.u LEFT JOIN r100 z ON z.id = ap.v LEFT JOIN st s1 ON s1.src = ap.u LEFT JOIN st s2 ON s2.src = ap.v",
    ", ".join([_SUCC, _AHOPS, _ARANK, _STR, "a11 AS (SELECT q.u, q.v, sum(CASE WHEN so.d > 0 THEN 1 / ln(1 + 1e-8::DOUBLE + so.d) ELSE 1 / (1e-8::DOUBLE - 5e-17::DOUBLE) END) AS aa FROM (SELECT DISTINCT u, v FROM ap) q JOIN ag x ON x.a = q.u JOIN ag y ON y.a = q.v AND y.b = x.b LEFT JOIN so ON so.src = x.b GROUP BY q.u, q.v)"]),
)
def _(s, d):
    """All eleven features of the first authors."""
    x = _feature("author_block11")(s, d)
    return x.select("pair_id", "path", "common", "near_u", "near_v", _r("jaccard"), _r("adamic_adar"), "attachment", _r("rank_min", 8), _r("rank_max", 8), _r("weight_min"), _r("weight_max"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
