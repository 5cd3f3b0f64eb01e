"""Packed lists give what plans over rows give, and send no link as a row."""

import random

import numpy as np
import pandas as pd
import pytest

from inkweave.operators import authors, lists, paths, rank


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(5)
    return sorted({(min(int(rng.expovariate(0.02)), 1499), rng.randrange(1500)) for _ in range(2500)} | {(3, 3), (7, 7)} | {(0, i) for i in range(900)})


@pytest.fixture(scope="module")
def packed(spark, drawn):
    out = spark.createDataFrame(drawn + drawn[:50], "src bigint, dst bigint")
    return out, lists.pack(out, spark.range(1500).toDF("node"))


def test_rows_and_sizes(packed, drawn):
    _, g = packed
    assert (g.n, g.links) == (1500, len(drawn)) and {tuple(r) for r in lists.rows(g).collect()} == set(drawn)
    assert {tuple(r) for r in lists.rows(lists.reverse(g)).collect()} == {(b, a) for a, b in drawn}
    assert {r["node"]: r["d"] for r in lists.sizes(g).collect()}[0] == sum(a == 0 for a, _ in drawn)


def test_paths(spark, packed, monkeypatch):
    """author_shortest_path answers from the lists of two ends, and gives the same with links as rows."""
    rng = random.Random(6)
    pairs = spark.createDataFrame(list({(rng.randrange(120), rng.randrange(1500)) for _ in range(800)}) + [(3, 3), (9000, 1)], "u bigint, v bigint")
    got = {tuple(r) for r in authors.directed_hops(pairs, packed[1]).collect()}
    monkeypatch.setattr(lists, "MOST_LINKS", 1)
    assert got == {tuple(r) for r in authors.directed_hops(pairs, packed[1]).collect()} and len({h for _, _, h in got}) > 4


@pytest.mark.parametrize("seed", range(8))
def test_far_pairs_are_settled_at_sight(monkeypatch, seed):
    """author_block6: a pair without a way between its ends, and most of three steps, are not grown through the graph."""
    rng = random.Random(seed)
    n, apart = [5, 30, 60, 240, 5, 12, 20, 40][seed], seed % 2
    links = {(x, y) for x, y in ((rng.randrange(n), rng.randrange(n)) for _ in range((12 if apart else 3) * n)) if not apart or x * 5 // n <= y * 5 // n}  # five parts that lead one way
    to = {x: {y for a, y in links if a == x} for x in range(n)}
    codes = np.array(sorted(x << 32 | y for x, y in links), np.int64)
    monkeypatch.setattr(lists, "_PIECE", [1 << 20, 3][seed // 4])
    monkeypatch.setattr(lists, "_BESIDE", [64, 2][seed // 4])
    x = lists.chunk(codes).iloc[0]
    out = lists.Read(n, [(x["ks"], x["sizes"], x["gaps"])])
    ways, grown, one_by_one = lists.Ways(out), [], lists.distance
    monkeypatch.setattr(lists, "distance", lambda *x: grown.append(x[:2]) or one_by_one(*x))
    a, b = (np.array(c) for c in zip(*((x, y) for x in range(n) for y in range(n))))
    got = lists.steps(a, b, ways, None)
    want = np.zeros((n, n), int)
    for x in range(n):
        front, seen, k = {x}, {x}, 0
        while front:
            front, k = {z for y in front for z in to[y]} - seen, k + 1
            seen |= front
            want[x, list(front)] = k
        want[x, list({z for y in to[x] - {x} for z in to[y] - {x, y}})] = 2
    assert got.tolist() == want.ravel().tolist()
    if n == 240:
        far = (want.ravel() == 0) & (a != b)
        assert far.sum() > 1000 and 0 < (want == 3).sum() and sum(want[p] == 0 for p in grown) < 0.05 * far.sum()
    cn, aa = lists.meets(a, b, out, out, np.arange(n) + 0.5)
    assert cn.tolist() == [len(to[x] & to[y]) for x, y in zip(a, b)] and np.allclose(aa, [sum(z + 0.5 for z in to[x] & to[y]) for x, y in zip(a, b)])


def test_overlaps(spark, packed, monkeypatch):
    """author_jaccard is answered from packed lists."""
    rng = random.Random(7)
    pairs = spark.createDataFrame([(i, rng.randrange(60), rng.randrange(120)) for i in range(500)] + [(900, None, 1)], "pair_id bigint, u bigint, v bigint")
    key = lambda: sorted((r["pair_id"], r["cn"], r["un"], round(r["jaccard"], 9), f"{r['aa']:.9e}") for r in authors._successors(pairs, packed[1]).collect())
    got = key()
    monkeypatch.setattr(lists, "MOST_LINKS", 1)
    assert got == key() and sum(x[1] for x in got) > 500


def test_rank_and_strength(spark, packed):
    """ranks and link strengths of author_block6 and author_block11 without rows of links."""
    out, g = packed
    one = {r["id"]: r["rank"] for r in lists.pagerank(g).collect()}
    two = {r["id"]: r["rank"] for r in rank.pagerank(spark.range(1500), out.distinct()).collect()}
    assert len(one) == 1500 and np.allclose([one[i] for i in range(1500)], [two[i] for i in range(1500)], rtol=1e-9, atol=0)
    na = spark.createDataFrame([(0, 0, "a"), (0, 2, "b"), (0, 3, "a"), (1, 0, "a"), (2, 0, "c"), (2, 1, "c"), (2, 5, "b")], "id bigint, pos int, author string")
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src bigint, dst bigint")
    slow = authors.link_strength(authors.author_graph(e, na).toDF("src", "dst", "weight"))
    assert {tuple(r) for r in authors.strengths(e, na).collect()} == {tuple(r) for r in slow.collect()}
    links = authors.author_links(e, na)
    name = {r["k"]: r["node"] for r in links.nodes.collect()}
    assert {(name[r["src"]], name[r["dst"]]) for r in lists.rows(links).collect()} == {(r["a"], r["b"]) for r in authors.author_graph(e, na).collect()}


def test_balls(spark, packed, monkeypatch):
    """F8: bfs_ball_distance counts balls by bits, over more nodes than are grown at once."""
    rng = random.Random(8)
    members = spark.createDataFrame([(i, rng.randrange(1500)) for i in range(90) for _ in range(rng.randrange(1, 4))], "id bigint, node bigint")
    pairs = spark.createDataFrame([(i, rng.randrange(90), rng.randrange(95)) for i in range(300)], "pair_id bigint, u bigint, v bigint")
    for levels in (1, 3, 16):
        key = lambda: sorted((r["pair_id"], r["shared"]) for r in paths.ball_distance(pairs, members, packed[1], levels).collect())
        got = key()
        with monkeypatch.context() as m:
            m.setattr(lists, "MOST_LINKS", 1)
            assert got == key()
    assert sum(n > 0 for _, n in got) > 5


def test_spectral_is_power_iteration_clustering(spark, monkeypatch):
    # the same clusters as those of the estimator, whose shuffled graph of every round is not made
    import pyspark.ml.clustering as C

    from inkweave.operators import ml

    rng = np.random.default_rng(5)
    at = lambda g: np.exp(-((g[:, None] - g[None, :]) ** 2))
    x = at(np.r_[rng.normal(0, 1, 15), rng.normal(8, 1, 40)])
    rows = [(int(i) * 7, int(j) * 7, float(x[i, j])) for i in range(55) for j in range(i) if x[i, j] > 1e-4] + [(0, 0, 1.0)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, w double")

    def parts(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["cluster"], set()).add(r["id"])
        return sorted(map(sorted, out.values()))

    want = parts(C.PowerIterationClustering(k=2, maxIter=20, weightCol="w", initMode="degree").assignClusters(edges))
    monkeypatch.setattr(C, "PowerIterationClustering", None)
    assert parts(ml.spectral(edges, 2)) == want and len(want) == 2


def test_blocks_are_shuffled_once(spark):
    # blocks of vectors travel to their cells once, not once more to be counted; blocks left empty by the hash are no cells
    from inkweave.operators import embed

    rng = np.random.default_rng(6)
    h = rng.standard_normal((9, 4))
    vectors = spark.createDataFrame([(i, h[i].tolist(), True) for i in range(9)], "id bigint, h array<double>, asks boolean")
    pairs = lambda ia, a, qa, ib, b, qb, same: pd.DataFrame([(x, y) for x in ia for y in ib if not same or x < y], columns=["a", "b"])
    got = embed._compared(vectors, "a bigint, b bigint", pairs, rows=1)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert sorted(tuple(sorted(r)) for r in got.collect()) == [(i, j) for i in range(9) for j in range(i + 1, 9)]
