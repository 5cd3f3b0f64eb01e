"""A graph small enough for answers by hand: edges 0-1, 0-2, 1-2, 2-3 and 4-5."""

import math

import pytest

from inkweave.functions.text import stem
from inkweave.operators import authors, graph, paths, rank, text
from inkweave.operators import pairs as P
from inkweave.plans.registry import Registry
from inkweave.sources import readers, writers


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (4, 5)], "src bigint, dst bigint")


def test_neighbourhood(spark, edges):
    pairs = spark.createDataFrame([(0, 0, 1), (1, 0, 3), (2, 2, 3), (3, 4, 5), (4, 0, 4), (5, 0, 99)], "pair_id bigint, u bigint, v bigint")
    r = {x["pair_id"]: x for x in P.neighbourhood(pairs, edges).collect()}
    assert [r[k]["common_neighbors"] for k in range(6)] == [1, 1, 0, 0, 0, 0]
    assert r[0]["jaccard"] == pytest.approx(1 / 3) and r[1]["jaccard"] == pytest.approx(1 / 2)
    assert r[0]["adamic_adar"] == pytest.approx(1 / math.log(3)) and r[0]["resource_allocation"] == 3 and r[0]["resource_allocation_textbook"] == pytest.approx(1 / 3)
    assert [r[k]["preferential_attachment"] for k in range(6)] == [4, 2, 3, 1, 2, 0]
    assert r[1]["salton"] == pytest.approx(1 / math.sqrt(2)) and r[5]["salton"] == 0


def test_hops(spark, edges):
    asked = [(0, 1, 2), (0, 3, 2), (2, 3, 3), (3, 2, 1), (4, 5, 1), (0, 4, -1), (1, 1, 0)]
    pairs = spark.createDataFrame([(u, v) for u, v, _ in asked], "u bigint, v bigint")
    assert {tuple(x) for x in paths.hops(pairs, edges).select("u", "v", "hops").collect()} == set(asked)


def test_long_path(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(6)], "src bigint, dst bigint")
    pairs = spark.createDataFrame([(0, 3), (0, 4), (0, 5)], "u bigint, v bigint")
    assert {tuple(x) for x in paths.hops(pairs, line).select("u", "v", "hops").collect()} == {(0, 3, 3), (0, 4, 4), (0, 5, 5)}
    assert {x["hops"] for x in paths.hops(pairs, line, most=4).collect()} == {3, 4, -1}


def shortest(out, s, t):
    """Breadth first, by hand."""
    level, seen, k = {s}, {s}, 0
    while level and t not in level:
        level, k = {y for x in level for y in out.get(x, ())} - seen, k + 1
        seen |= level
    return k if t in level else None


def test_hops_of_any_length(spark):
    import random

    rng = random.Random(1)
    # a thin graph with long ways, a hub with leaves, and parts without a way between
    links = {(i, i + rng.randint(1, 3)) for i in range(0, 13)} | {(60, i) for i in range(61, 75)} | {(61, 75), (80, 81)}
    df = spark.createDataFrame(sorted(links), "src bigint, dst bigint")
    ends = sorted({(x := rng.choice([*range(16), *range(60, 64), 75, 80, 81, 99]), rng.choice([*range(16), 60, 61, 70, 81, x])) for _ in range(60)})
    pairs = spark.createDataFrame(ends, "u bigint, v bigint")
    both: dict = {}
    for a, b in links:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    got = {(x["u"], x["v"]): x["hops"] for x in paths.hops(pairs, df).collect()}
    for u, v in ends:
        k = shortest(both, u, v)
        want = 0 if u == v else -1 if k is None or u not in both else k if k > 1 else 2 if both[u] & both[v] else 3 if len(both[u]) > 1 else 1
        assert got[u, v] == want, (u, v)
    out: dict = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    looped = df.union(spark.createDataFrame([(3, 3), (60, 60)], "src bigint, dst bigint"))
    got = {(x["u"], x["v"]): x["hops"] for x in authors.directed_hops(pairs, looped).collect()}
    for u, v in ends:
        k = shortest(out, u, v)
        want = 15 if k is None else k if k != 1 else 2 if any(v in out.get(w, ()) for w in out[u] - {u, v}) else 1
        assert got[u, v] == want, (u, v)


def test_blank_authors_and_white_space(spark):
    lists = spark.createDataFrame([(0, ["A", "", None, "B", "B"]), (1, ["", None, "B", "A"]), (2, None)], "id bigint, authors array<string>")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "pair_id bigint, u bigint, v bigint")
    assert {x["pair_id"]: x["common_authors"] for x in P.common_authors(pairs, lists).collect()} == {0: 2, 1: 0}
    wide = "\u2003".join("ab") + "\u3000c\x0bd\x0ce\x85f\x1cg\u00a0h\u1680i\u2028j"
    nodes = spark.createDataFrame([(0, wide), (1, " ")], "id bigint, abstract string")
    got = {x["id"]: (x["chars"], x["terms"]) for x in text.term_sets(nodes).collect()}
    assert got == {0: (len(wide), wide.split()), 1: (1, [])}


def test_rank_loses_what_dangles(spark, edges):
    nodes = spark.range(6)
    r = {x["id"]: x["rank"] for x in rank.pagerank(nodes, edges, rounds=1).collect()}
    base = 0.15 / 6
    assert r[0] == pytest.approx(base) and r[1] == pytest.approx(base + 0.85 / 12) and r[2] == pytest.approx(base + 0.85 * (1 / 12 + 1 / 6)) and sum(r.values()) < 1


def test_author_graph(spark):
    na = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 0, "a")], "id bigint, pos int, author string")
    e = spark.createDataFrame([(0, 1)], "src bigint, dst bigint")
    w = {(x["a"], x["b"]): x["weight"] for x in authors.author_graph(e, na).collect()}
    assert w == {("a", "b"): 1, ("b", "a"): 1.5, ("a", "a"): 2.0}
    assert [tuple(x) for x in authors.author_index(na).orderBy("author_idx").collect()] == [(0, "a", 3), (1, "b", 1)]


def test_author_index_order(spark):
    names = ["b", "a", "ab", "aé", "Zoë", "", "aaaaab", "aaaaaa", "日本", "a b"]
    na = spark.createDataFrame([(i, 0, n) for i, n in enumerate(names)], "id bigint, pos int, author string")
    assert [x["name"] for x in authors.author_index(na).orderBy("author_idx").collect()] == sorted(names, key=lambda s: s.encode())


def test_ball(spark):
    out = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "src string, dst string")
    members = spark.createDataFrame([(0, "a"), (1, "x")], "id bigint, node string")
    pairs = spark.createDataFrame([(7, 0, 1), (8, 0, 9)], "pair_id bigint, u bigint, v bigint")
    got = {x["pair_id"]: x["shared"] for x in paths.ball_distance(pairs, members, out, 3).collect()}
    assert got == {7: 0, 8: 0}  # x goes one step, so a's ball is cut there and lacks c
    got = {x["pair_id"]: x["shared"] for x in paths.ball_distance(pairs, members, out.union(spark.createDataFrame([("c", "d")], "src string, dst string")), 3).collect()}
    assert got[7] == 1


def test_text(spark):
    nodes = spark.createDataFrame([(0, "Word word 2 naïve"), (1, ""), (2, "x " * 300)], "id bigint, abstract string")
    vocab = spark.createDataFrame([("word", 0), ("x", 1)], "word string, word_idx bigint")
    assert {tuple(x) for x in text.doc_terms(nodes, vocab).collect()} == {(0, 0, 2), (1, 2, 1), (2, 1, 300)}
    assert {x["word"] for x in text.word_counts(nodes).collect()} == {"word", "2", "naïve", "x"}


@pytest.mark.parametrize("word, stem_", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("electriciti", "electr"), ("adjustment", "adjust"), ("controll", "control"), ("sky", "sky"), ("happy", "happi"), ("at", "at")])
def test_stem(word, stem_):
    assert stem(word) == stem_


def test_registry():
    r = Registry()
    r.feature("b", "a")(lambda a: a + 1)
    r.feature("c", "b", "a")(lambda b, a: b * a)
    assert r.build(["c"], {"a": 3})["c"] == 12
    r.feature("d", "e")(lambda e: e)
    r.feature("e", "d")(lambda d: d)
    with pytest.raises(ValueError):
        r.build(["d"], {})
    with pytest.raises(KeyError):
        r.build(["zz"], {})


def test_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("0,1\n1,0\n# none\n2,2\n")
    assert {tuple(x) for x in readers.read_graph(spark, str(tmp_path / "e.txt")).collect()} == {(0, 1), (2, 2)}
    (tmp_path / "a.txt").write_text("0|--|A, B\n1|--|\n")
    assert {(x[0], tuple(x[1])) for x in readers.read_authors(spark, str(tmp_path / "a.txt")).collect()} == {(0, ("A", " B")), (1, ("",))}
    (tmp_path / "bad.txt").write_text("0|--|x|--|y\n")
    with pytest.raises(Exception, match="two fields"):
        readers.read_abstracts(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "t.txt").write_text("5,6\n7,8\n")
    cases = readers.read_cases(spark, str(tmp_path / "t.txt"))
    assert [tuple(x) for x in cases.orderBy("pair_id").collect()] == [(0, 5, 6), (1, 7, 8)]
    (tmp_path / "long.txt").write_text("".join(f"{i},{i + 1}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        long = readers.read_cases(spark, str(tmp_path / "long.txt"))
        assert long.count() == 20_000 and long.where("pair_id <> u").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    scored = cases.selectExpr("pair_id", "0.5D AS predicted")
    with pytest.raises(ValueError):
        writers.write_submission(scored, str(tmp_path / "s"), expected_rows=3)
    assert writers.write_submission(scored, str(tmp_path / "s"), expected_rows=2) == 2
    assert {tuple(x) for x in readers.read_submission(spark, str(tmp_path / "s")).collect()} == {(0, 0.5), (1, 0.5)}
    (tmp_path / "c.txt").write_text("3 1 0 1 x\n4 0 0 0 y\n")
    assert {(x[0], tuple(x[1]), x[2]) for x in readers.read_content(spark, str(tmp_path / "c.txt")).collect()} == {(3, (0.5, 0.0, 0.5), "x"), (4, (0.0, 0.0, 0.0), "y")}


def test_content_and_cites(spark, tmp_path):
    (tmp_path / "c.txt").write_text("30 1 0 x\n10 0 1 y\n20 1 1 x\n")
    (tmp_path / "l.txt").write_text("30\t10\n10 30\n20 99\n")
    rows, links = readers.indexed(readers.read_content(spark, str(tmp_path / "c.txt")), readers.read_cites(spark, str(tmp_path / "l.txt")))
    assert {(r["id"], r["row"], r["class"]) for r in rows.collect()} == {(10, 0, 1), (20, 1, 0), (30, 2, 0)}
    assert {tuple(r) for r in links.collect()} == {(0, 2), (2, 0)}


def test_fused_blocks(spark, tmp_path):
    pairs = spark.createDataFrame([(0, "train", 1, 2, 1), (1, "dev", 3, 4, 0)], "pair_id bigint, split string, u bigint, v bigint, y int")
    writers.write_features(pairs.selectExpr("pair_id", "u + v AS a"), str(tmp_path / "a"), "a", pairs)
    writers.write_features(pairs.selectExpr("pair_id", "u * v AS b"), str(tmp_path / "b"), "b", pairs)
    assert {(r["pair_id"], r["a"], r["b"]) for r in writers.fuse(pairs, str(tmp_path / "a"), str(tmp_path / "b")).collect()} == {(0, 3, 2), (1, 7, 12)}
    with pytest.raises(ValueError, match="other pairs"):
        writers.fuse(pairs.where("pair_id = 0"), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="two blocks"):
        writers.fuse(pairs, str(tmp_path / "a"), str(tmp_path / "a"))
    writers.write_pairs(pairs, str(tmp_path / "uv"))
    assert spark.read.parquet(str(tmp_path / "uv" / "pairs")).count() == 2 and spark.read.parquet(str(tmp_path / "uv" / "manifest")).count() == 2


def test_models_saved_and_found(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from inkweave.operators import models

    x = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array((F.col("id") % 2) + F.rand(1), F.rand(2))).alias("features"))
    path = str(tmp_path / "m")
    assert models.latest(spark, path) is None and models.best(spark, path) is None
    saved = models.train(x, x, path, steps=2, rounds=2)
    assert [s for s, _, _ in saved] == [1, 2] and models.latest(spark, path).split("step=")[1].startswith("000002")
    more = models.train(x, x, path, steps=4, rounds=2, keep=2)
    assert more[-1][0] == 4 and len(more) <= 3
    loss = models.evaluate(models.load(models.best(spark, path)), x).first()["log_loss"]
    assert loss == pytest.approx(min(v for _, v, _ in more), abs=1e-5)
    assert [s for s, _, _ in models.train(x, x, path, steps=1, rounds=2, reset=True)] == [1]


def test_negatives_and_masks(spark):
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40) if (i * j) % 7 == 1], "src bigint, dst bigint")
    have = {tuple(r) for r in edges.collect()}
    got = [tuple(r) for r in graph.exact_non_edges(spark.range(40), edges, 50).collect()]
    assert len(got) == len(set(got)) == 50 and not set(got) & have and all(u < v for u, v in got)
    rows = graph.masked(spark.range(40), edges, 1000, 1000).collect()
    for split in ("train", "dev", "test"):
        assert sum(r["split"] == split and r["y"] == 1 for r in rows) == sum(r["split"] == split and r["y"] == 0 for r in rows)
    assert len({(r["u"], r["v"]) for r in rows}) == len(rows) and {(r["u"], r["v"]) for r in rows if r["y"] == 1} == have


def test_activations_and_batch_means(spark):
    from pyspark.sql import functions as F

    from inkweave.operators import neural

    r = spark.createDataFrame([([-2.0, 0.0, 3.0],)], "x array<double>").select(neural.relu("x").alias("r"), neural.leaky_relu("x", 0.1).alias("l"), neural.elu("x").alias("e"), neural.argmax("x").alias("a"), neural.dense("x", [[1.0, 2.0, 3.0], [0.0, 0.0, 1.0]], [1.0, 0.0]).alias("d")).first()
    assert r["r"] == [0, 0, 3] and r["l"] == pytest.approx([-0.2, 0, 3]) and r["e"] == pytest.approx([math.exp(-2) - 1, 0, 3]) and r["a"] == 2 and r["d"] == [8, 3]
    x = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0)], "batch int, loss double")
    assert neural.batch_means(x).first()["loss"] == 5 and x.agg(F.avg("loss")).first()[0] == 4


def test_generators(spark):
    assert readers.circles(spark).count() == 1250
    assert readers.blobs(spark, 3, 2, 30).groupBy("cluster").count().count() == 3
    assert readers.random_graph(spark, 100, 500).where("src >= dst").count() == 0


def test_stream(spark, tmp_path):
    from inkweave.streaming.edges import arriving, weekly

    spark.sql("SELECT * FROM VALUES (1L, 2L, timestamp'2025-01-01'), (2L, 1L, timestamp'2025-01-02'), (3L, 3L, timestamp'2025-01-02'), (CAST(NULL AS BIGINT), 1L, timestamp'2025-01-02'), (4L, 5L, timestamp'2025-01-09') AS t(u, v, loaded_at)").write.parquet(str(tmp_path / "in"))
    q = arriving(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(x["src"], x["dst"]) for x in spark.table("arrived").collect()} == {(1, 2), (4, 5)}
    assert weekly(spark.table("arrived")).count() == 2


def test_stored_tables_are_removed(spark):
    import os

    from inkweave.sources import shared

    x = shared.store(spark.range(3), "numbers")
    where = x.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert x.count() == 3 and os.path.isdir(where)
    assert shared.clean(spark) >= 1 and not os.path.exists(where) and shared.clean(spark) == 0


def test_walks(spark, edges):
    from inkweave.operators.walks import random_walks

    adj = graph.adjacency(edges)
    links = {tuple(x) for x in adj.collect()}
    got = random_walks(spark.range(7), adj, 3, 6).collect()
    assert len(got) == 21 and all((a, b) in links for r in got for a, b in zip(r["path"], r["path"][1:]))
    assert all(len(r["path"]) == (1 if r["start"] == 6 else 7) and r["path"][0] == r["start"] for r in got)
    hub = spark.createDataFrame([(0, i) for i in range(1, 400)], "src bigint, dst bigint")
    seen = {r["path"][1] for r in random_walks(spark.createDataFrame([(0,)], "id bigint"), graph.adjacency(hub), 2000, 1).collect()}
    assert len(seen) > 380


def test_all_pairs_in_blocks(spark):
    import numpy as np

    from inkweave.operators import embed

    rng = np.random.default_rng(0)
    h = np.round(rng.standard_normal((300, 4)), 1)
    h[7] = h[8]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "id bigint, h array<double>")
    d = ((h[:, None] - h[None]) ** 2).sum(axis=2)
    embed_rows = embed._compared.__defaults__
    embed._compared.__defaults__ = (64,)
    try:
        near = {(r["id"], r["other"]) for r in embed.nearest(df, 3).collect()}
        kernel = {(r["a"], r["b"]): r["k"] for r in embed.gaussian_kernel(df, 1.0).collect()}
        assert embed.knn_graph(df.limit(0), 3).count() == 0
    finally:
        embed._compared.__defaults__ = embed_rows
    order = [sorted((x for x in range(300) if x != i), key=lambda x: (round(d[i, x], 9), x))[:3] for i in range(300)]
    assert near == {(i, j) for i in range(300) for j in order[i]}
    assert len(kernel) == 300 * 299 // 2 and all(abs(k - math.exp(-d[a, b] / 2)) < 1e-9 for (a, b), k in kernel.items())


def test_few_copies_of_vectors(spark):
    """30 000 vectors travel in a dozen blocks, not one for each 2 048, and a cell's tiles give the exact nearest."""
    import numpy as np

    from inkweave.operators import embed

    h = np.random.default_rng(3).normal(size=(30_000, 2)).round(2).astype(np.float32)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h.astype(float).tolist())], "id bigint, h array<double>")
    got: dict = {}
    for r in embed.nearest(df.withColumn("asks", df["id"] % 1500 == 0), 4).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert len(got) == 20
    for i, found in got.items():
        d = np.round(((h.astype(float) - h[i].astype(float)) ** 2).sum(axis=1), 9)
        d[i] = np.inf
        assert found == set(np.lexsort((np.arange(len(d)), d))[:4].tolist()), i
    assert embed._got(embed._sent(h[0].astype(float))).tolist() == h[0].tolist() and embed._got(embed._sent(np.array([0.1])))[0] == 0.1


def test_empty(spark, edges):
    none = edges.limit(0)
    pairs = spark.createDataFrame([(0, 0, 1)], "pair_id bigint, u bigint, v bigint")
    assert P.neighbourhood(pairs, none).collect()[0]["common_neighbors"] == 0
    assert paths.hops(pairs, none).collect()[0]["hops"] == -1
    assert rank.pagerank(spark.range(0), none).count() == 0
    assert graph.numbered(spark.range(0), "id").count() == 0
