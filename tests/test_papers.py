"""What is answered from papers that are sent whole is what plans over rows give, and shuffles no link and no pair."""

import random

import pytest

from inkweave.operators import authors, lists, papers
from inkweave.plans import features


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(11)
    listed = {i * 3: [f"n{min(int(rng.expovariate(0.03)), 139)}" for _ in range(rng.randrange(1, 5))] for i in range(160)}
    listed[6], listed[9] = ["n1", "n1", "n2", "n1"], ["alone"]
    na = spark.createDataFrame([(i, 2 * k, n) for i, x in listed.items() for k, n in enumerate(x)], "id bigint, pos int, author string")
    ids = [i for i in listed if i != 9] + [1000, 1001]  # papers without authors
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(150)) if a != b}
    pairs = [(i, rng.choice(["train", None]), rng.choice([9, *ids]), rng.choice([9, *ids]), rng.choice([0, 1, None])) for i in range(400)] + [(900, "dev", 6, 6, 1), (901, "dev", 1000, 6, 1), (902, "dev", 5000, 1000, 1)]
    return spark.createDataFrame(sorted(edges), "src bigint, dst bigint"), na, spark.createDataFrame(pairs, "pair_id bigint, split string, u bigint, v bigint, y int")


def test_links_are_made_where_papers_are(drawn, monkeypatch):
    """author_jaccard: the links of authors are not shuffled, in whatever pieces they are made."""
    edges, na, _ = drawn
    named = lambda g: (lambda name: {(name[r["src"]], name[r["dst"]]) for r in lists.rows(g).collect()})({r["k"]: r["node"] for r in g.nodes.collect()})
    want, n = named(authors.links_rows(edges, na)), na.select("author").distinct().count()
    monkeypatch.setattr(lists, "packed", None)
    for piece in (1 << 20, 7):
        monkeypatch.setattr(papers, "_PIECE", piece)
        g = authors.author_links(edges, na)
        assert named(g) == want == {(r["a"], r["b"]) for r in authors.author_graph(edges, na).collect()} and (g.n, g.links) == (n, len(want))


def _rows(df):
    return sorted(tuple(f"{x:.9e}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("name", ["author_successors", "author_block11", "author_block6"])
def test_pairs_are_answered_in_place(drawn, monkeypatch, name):
    """author_jaccard, author_block11 and author_block6 are answered row by row; where papers, or links too, are not sent, rows give the same."""
    edges, na, pairs = drawn
    given = {"pairs": pairs, "edges": edges, "node_author": na}
    x = features.registry.build([name], given)[name]
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    want = _rows(x)
    assert len(want) == 403
    monkeypatch.setattr(papers, "MOST", 10)
    assert _rows(features.registry.build([name], given)[name].select(*x.columns)) == want
    monkeypatch.setattr(lists, "MOST_LINKS", 1)
    assert _rows(features.registry.build([name], given)[name].select(*x.columns)) == want


def test_block6_packs_links_once(drawn, monkeypatch):
    """author_block6: no link is shuffled to be read backwards, and the lists are sent once for ranks and pairs."""
    edges, na, pairs = drawn
    monkeypatch.setattr(lists, "packed", None)
    sent, send = [], lists.Sent.__init__
    monkeypatch.setattr(lists.Sent, "__init__", lambda self, g: sent.append(g) or send(self, g))
    got = features.registry.build(["author_block6"], {"pairs": pairs, "edges": edges, "node_author": na})["author_block6"]
    assert got.count() == 403 and len(sent) == 1


def test_no_papers(spark, drawn):
    _, na, pairs = drawn
    given = {"pairs": pairs, "edges": spark.createDataFrame([], "src bigint, dst bigint"), "node_author": na.where("false")}
    got = features.registry.build(["author_block11"], given)["author_block11"].collect()
    assert len(got) == 403 and {(r["path"], r["common"], r["rank_max"], r["weight_max"]) for r in got} == {(15, 0, 0.0, 0.0)}
