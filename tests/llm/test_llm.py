"""The operators of inkweave.llm against plain versions of themselves, and on awkward rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SMALL, connect, same

from inkweave.llm import crosssplit, groups, leakage, lookalike, names, neardup, neighbours, packing, queries, terms, together
from inkweave.llm.words import words

WORDS = [f"w{i}" for i in range(60)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, edits):
    w = t.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    same(queries.queries()[name](spark, SMALL).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


# texts


def family(seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = text(rng, rng.randint(3, 60))
        rows += [edited(rng, base, rng.randint(0, 3)) for _ in range(rng.randint(1, 4))]
    rows += [rows[0], rows[0].upper(), "", None, "two words", "a b c", "A, b; C!"]
    return list(enumerate(rows))


def sets_of(rows, n):
    out = {}
    for i, t in rows:
        w = words(t)
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if s:
            out[i] = s
    return out


def plain_near(rows, n=3, t=0.5):
    s = sets_of(rows, n)
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


def frame(spark, rows, extra="x"):
    return spark.createDataFrame([(i, t, extra, 1, None) for i, t in rows], "id bigint, abstract string, key string, rep int, size string")


def test_near_duplicates(spark):
    rows = family()
    got = neardup.near_duplicates(frame(spark, [*rows, *rows[:5], (None, "a b c d")]), n=3, t=0.5).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == plain_near(rows)


def test_near_duplicates_star(spark):
    rows = [(i, "one two three four") for i in range(9)] + [(9, "one two three four five")]
    got = {tuple(x) for x in neardup.near_duplicates(frame(spark, rows), expand=4).collect()}
    assert got == {(0, i) for i in range(1, 10)}


def test_near_duplicates_many_copies(spark):
    rows = [(i, "one two three four") for i in range(70)] + [(i, "one two three four five") for i in range(70, 73)]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    want = {(i, j) for j in range(73) for i in range(j)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_near_duplicates_long(spark):
    rng = random.Random(3)
    w = [str(rng.randrange(10**9)) for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-40])), (3, " ".join(reversed(w)))]
    assert [tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()] == [(1, 2)]


def test_groups(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i"), (4, "z y x w v u"), (5, "z")]
    got = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in neardup.groups(frame(spark, rows), n=5, t=0.8).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1), 4: (4, 4, 0)}


def compared(sets, t):
    """Pairs that compare passes among sets of 64-bit numbers, in order of size, those of one width against those of each."""
    sets = sorted(sets, key=len)
    size, sign = np.array([len(x) for x in sets], dtype=np.int32), [neardup.signature(x) for x in sets]
    wide = np.array([len(x) for x in sign])
    found = set()
    for v in np.unique(wide):
        for w in np.unique(wide[wide >= v]):
            a, b = np.flatnonzero(wide == v), np.flatnonzero(wide == w)
            i, j = neardup.compare(size[a], np.stack([sign[x] for x in a]), size[b], np.stack([sign[x] for x in b]), t, v == w)
            found |= set(zip(a[i].tolist(), b[j].tolist()))
    return sets, found


@pytest.mark.parametrize("seed", range(3))
def test_compare_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
        made += [np.unique(base), np.unique(base[: max(1, int(len(base) * rng.uniform(0.4, 1)))])]
    sets, found = compared(made, 0.5)
    like = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if like(sets[a], sets[b]) >= 0.5} <= found


@pytest.mark.parametrize("size", [1, 10, 100, 1_000, 1_400, 2_000, 5_000, 50_000])
@pytest.mark.parametrize("t", [0.5, 0.8])
def test_compare_tells_sets_of_any_size_apart(size, t):
    rng = np.random.default_rng(size)
    few = 30 if size <= 5_000 else 8
    base = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(few)]
    kept = int(np.ceil(size * t))  # a part that is as much like the whole as asked for
    sets, found = compared([*base, *[np.unique(rng.permutation(x)[:kept]) for x in base]], t)
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(np.intersect1d(sets[a], sets[b])) >= t * len(np.union1d(sets[a], sets[b]))}
    assert len(true) >= few and true <= found
    assert len(found - true) <= 0.01 * len(sets) ** 2 / 2


def test_near_duplicates_in_many_strips(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(30):
        base = " ".join(str(rng.randrange(10**6)) for _ in range(rng.choice([5, 40, 90, 300, 700, 1500])))
        rows += [base, base + " " + " ".join(str(rng.randrange(10**6)) for _ in range(len(base.split()) // 3))]
    rows = list(enumerate(rows))
    reps = neardup.signatures(frame(spark, rows), "id", "abstract", 3).select("id", "size", "bits")
    got = {tuple(x) for x in neardup.candidates(reps, 0.5, strip_rows=7).collect()}
    assert plain_near(rows) <= got and len(got) < 40


def test_near_duplicates_by_rare_shingles(spark, monkeypatch):
    # beyond WHOLE classes no two strips are compared; the pairs are the same
    from inkweave.llm import rare

    rng = random.Random(4)
    rows = list(family(11))
    for k in range(60):
        base = [str(rng.randrange(40 if k % 2 else 10**6)) for _ in range(rng.choice([3, 4, 6, 12, 40, 300, 900]))]
        rows += [(1000 + 2 * k, " ".join(base)), (1001 + 2 * k, " ".join(base[: -(-2 * len(base) // 3)] + [str(rng.randrange(10**6)) for _ in range(len(base) // 8)]))]
    want = {tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "WHOLE", 0)
    monkeypatch.setattr(rare, "_PAIRS", 50)
    monkeypatch.setattr(neardup, "candidates", None)
    assert {tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()} == want == plain_near(rows)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 540)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in {x for e in edges if e[0] != e[1] for x in e}}
    got = dict(tuple(r) for r in groups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == want


def test_terms(spark):
    rows = family(2)
    got = {(r["n"], r["term"]): (r["occurrences"], r["records"]) for r in terms.counts(frame(spark, [*rows, *rows[:7]]), depth=3, shard_chars=500).collect()}
    occ, rec, held = Counter(), Counter(), 0
    for _, t in rows:
        w = words(t)
        held += bool(w)
        for n in (1, 2, 3):
            g = [(n, " ".join(w[k : k + n])) for k in range(len(w) - n + 1)]
            occ.update(g)
            rec.update(set(g))
    assert got.pop((0, "")) == (0, held)
    assert got == {k: (occ[k], rec[k]) for k in occ}


def test_terms_marks(spark):
    rows = [(i, "common rare" if i == 0 else "common mid mid") for i in range(10)]
    got = {r["term"]: r["mark"] for r in terms.marked(frame(spark, rows)).collect()}
    assert got == {"common": "common", "rare": "rare", "mid": "common"}
    assert terms.marked(frame(spark, [])).count() == 0


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    tok = rng.integers(0, 4, 300)
    tok[rng.integers(0, 300, 20)] = -1
    for k, rank in enumerate(terms.suffix_ranks(tok, 5), 1):
        grams = [tuple(tok[i : i + k]) for i in range(300)]
        for _ in range(500):
            a, b = rng.integers(0, 300, 2)
            if -1 not in grams[a] and -1 not in grams[b] and len(grams[a]) == len(grams[b]) == k:
                assert (rank[a] == rank[b]) == (grams[a] == grams[b]) and (rank[a] < rank[b]) == (grams[a] < grams[b])


# pairs of papers


def test_overlaps(spark):
    rng = random.Random(3)
    rows = family(3)
    near = defaultdict(set)
    for a, b in plain_near(rows):
        near[a].add(b)
        near[b].add(a)
    ids = [i for i, _ in rows] + [900, 901]
    pairs = [(k, rng.choice(["train", "train", "dev", "test"]), rng.choice(ids), rng.choice(ids), rng.choice([None, "s"])) for k in range(400)] + [(1000, "dev", None, 3, "s"), (1001, None, 1, 2, "s"), (None, "train", 1, 2, "s")]
    want = set()
    for i, si, u, v, _ in pairs:
        for j, sj, x, y, _ in pairs:
            if None not in (i, j, u, v, x, y) and si == "train" and sj in ("dev", "test"):
                ok = lambda a, b: a == b or b in near[a]
                if ok(u, x) and ok(v, y) or ok(u, y) and ok(v, x):
                    want.add((i, j))
    df = spark.createDataFrame([(*p, 0, "r") for p in [*pairs, *pairs[:50]]], "pair_id bigint, split string, u bigint, v bigint, source string, y int, rep string")
    texts = spark.createDataFrame(rows, "id bigint, text string")
    got = [(r["train_id"], r["eval_id"]) for r in crosssplit.overlaps(df, texts).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = {(r["train_id"], r["eval_id"]) for r in crosssplit.overlaps(df, texts.limit(0)).collect()}
    assert few <= want and few


def test_overlaps_shards(spark, monkeypatch):
    rows = family(4)
    texts = spark.createDataFrame(rows, "id bigint, text string")
    ids = texts.select("id")
    members, one, _ = crosssplit.text_links(texts, ids, ids)
    _, many, _ = crosssplit.text_links(texts, ids, ids, shard_patterns=20, shard_chars=400)
    as_set = lambda d: {(r["id_a"], r["id_b"]) for r in d.collect()}
    first = {r["rep"] for r in members.collect()}
    want = {(a, b) for a, b in plain_near(rows) if a in first and b in first}
    assert as_set(one) == as_set(many) == want | {(b, a) for a, b in want} and want


def test_overlaps_keep_no_sets(spark):
    # no hashes of whole texts are stored, but for those of texts that share their rare passages
    from inkweave.sources import shared

    rows = family(6)
    texts = spark.createDataFrame([*rows, *((5000 + i, f"q{i} r{i} s{i} t{i} u{i}") for i in range(30))], "id bigint, text string")
    written = len(shared._written)
    crosssplit.text_links(texts, texts.select("id"), texts.select("id"))
    tables = [spark.read.parquet(p) for _, p in shared._written[written:]]
    sets = [x for x in tables if "sh" in x.columns]
    assert len(sets) == 1 and sets[0].where("id >= 5000").count() == 0 < sets[0].count()


@pytest.mark.parametrize("seed", [1, 2])
def test_rarest_keeps_enough_of_both(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(2, 60, 1 << 10).astype(np.uint16)
    for _ in range(2000):
        base = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 40)))
        other = np.union1d(rng.permutation(base)[: rng.integers(1, len(base) + 1)], rng.integers(-(2**62), 2**62, rng.integers(0, 6)))
        if len(np.intersect1d(base, other)) >= 0.5 * len(np.union1d(base, other)):
            both = np.intersect1d(crosssplit.rarest(base, counts, 0.5), crosssplit.rarest(other, counts, 0.5))
            assert len(both) >= min(3, -(-len(base) // 2), -(-len(other) // 2))


def test_coverage(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g x y"), (3, "A b, c d e f g h!"), (4, "k l m n"), (5, "k l"), (6, None), (7, "a b c d e f g h")]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    pairs = spark.createDataFrame([(1, "train", 1, 4), (2, "dev", 2, 4), (3, "test", 3, 5), (4, "dev", 6, 1)], "pair_id bigint, split string, u bigint, v bigint").selectExpr("*", "'s' AS source")
    got = {r["id"]: (r["copied"], r["words"], r["covered"]) for r in crosssplit.coverage(pairs, texts).collect()}
    # 1 and 4 are training papers themselves, but have no other such paper's text
    assert got == {2: (False, 9, 7), 3: (True, 8, 8), 4: (False, 4, 0), 1: (False, 8, 0)}
    assert crosssplit.coverage(pairs, texts.limit(0)).count() == 0


def test_report(spark):
    texts = spark.createDataFrame([(1, "a b c")], "id bigint, text string")
    df = spark.createDataFrame([(1, "train", 1, 2, "x"), (2, "dev", 2, 1, "x"), (3, "dev", 5, 6, None), (4, "test", None, 1, "x")], "pair_id bigint, split string, u bigint, v bigint, source string")
    got = {(r["split"], r["source"]): (r["rows"], r["overlapping"], r["pairs"]) for r in crosssplit.report(df, texts).collect()}
    assert got == {("dev", "x"): (1, 1, 1), ("dev", None): (1, 0, 0), ("test", "x"): (1, 0, 0)}


# vectors


def cosines(rows):
    ids = [i for i, _ in rows]
    h = np.array([v for _, v in rows], dtype=float)
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    return ids, np.round(h @ h.T, 6)


def true_nearest(rows, k, asks):
    """(id, other) and the similarity of the k-th of each id."""
    ids, s = cosines(rows)
    np.fill_diagonal(s, -2)
    return {int(ids[i]): np.sort(s[i])[-k] for i in range(len(ids)) if asks(int(ids[i]))}


@pytest.mark.parametrize("spread", [0.3, 2.0])
def test_neighbours_recall(spark, spread):
    # clustered vectors, and nearly uniform ones, whose nearest are hardly nearer than the rest
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + spread * rng.standard_normal(32)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, h array<double>")
    kth = true_nearest(rows, 5, lambda i: i % 20 == 0)
    for exact in (False, True):
        got = neighbours.neighbours(df, asks="id % 20 = 0", exact=exact).collect()
        assert len(got) == 5 * len(kth)
        met = np.mean([r["similarity"] >= kth[r["id"]] - 1e-6 for r in got])
        assert met == 1 if exact else met >= 0.9


def test_neighbours_widths(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(10 + i, [1.0, float(i), 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, h array<double>")
    got = {(r["id"], r["other"]) for r in neighbours.neighbours(df, k=4).collect()}
    assert all((a < 10) == (b < 10) for a, b in got) and {a for a, _ in got} == {i for i, _ in rows} and len(got) == 6 * 4 + 5 * 4


def test_footrule():
    rng = np.random.default_rng(0)
    a, b = (np.stack([rng.permutation(30)[:8] for _ in range(40)]) for _ in range(2))
    at = lambda p, x: p.tolist().index(x) if x in p else len(p)
    for p, q, s in zip(a, b, neighbours.similarity(a, b)):
        assert sum(abs(at(p, x) - at(q, x)) for x in set(p) | set(q)) == 8 * 9 - 2 * s


def test_neighbours_awkward(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [1.0, 0.01]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, h, "c", 1) for i, h in rows], "id bigint, h array<double>, v string, key int")
    got = {tuple(r) for r in neighbours.similar_pairs(df).collect()}
    assert got == {(1, 2), (1, 7), (2, 7)}
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def test_neighbours_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(100, [1.0, 2.0, 3.1])], "id bigint, h array<double>")
    got = {(r["id"], r["other"]) for r in neighbours.neighbours(df, k=3).collect()}
    assert got == {(i, j) for i in [*range(50), 100] for j in [x for x in range(5) if x != i][:3]}


def test_neighbours_waves(spark, monkeypatch):
    # files in several waves, long ones in blocks; what is far is given up early, what the index was made of is removed
    from inkweave.sources import shared

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16))
    df = spark.createDataFrame([(i, (centres[i % 60] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(900)], "id bigint, h array<double>")
    near = lambda **how: {(r["id"], r["other"], r["rank"]) for r in neighbours.neighbours(df, **how).where("similarity >= 0.9").collect()}
    whole = near()
    monkeypatch.setattr(neighbours, "_WAVE", 1 << 10)
    monkeypatch.setattr(neighbours, "_block", lambda _: 20)
    written = len(shared._written)
    assert len(whole) > 500 and near(above=0.9) == whole
    held = [p.rpartition("/")[2].split("-")[0] for _, p in shared._written[written:]]
    assert held.count("near") > 2 and not {"vectors", "indexed"} & set(held)


def test_term_vectors(spark):
    dt = spark.createDataFrame([(1, 0, 2), (1, 0, 2), (1, 2, 300), (2, 3, 1), (3, None, 1)], "id bigint, word_idx bigint, tf int")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "word string, word_idx bigint")
    assert [(r["id"], r["h"]) for r in neighbours.term_vectors(dt, vocab).collect()] == [(1, [2.0, 0.0, 300.0])]


# baskets


def test_together(spark):
    rng = random.Random(7)
    lists = {i: [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))] for i in range(200)}
    rows = [(i, [*x, None, ""]) for i, x in lists.items()] + [(0, [*lists[0], None, ""]), (500, None), (501, []), (None, ["a", "b"])]
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], "id bigint, authors array<string>, basket int, items string")
    got = {(r["a"], r["b"]): (r["n"], r["n_a"], r["n_b"], r["baskets"]) for r in together.together(together.baskets(df), 2).collect()}
    sets = [set(x) for x in lists.values() if x]
    f = Counter(k for s in sets for k in s)
    n = Counter((a, b) for s in sets for a in s for b in s if a < b)
    assert got == {k: (c, f[k[0]], f[k[1]], len(sets)) for k, c in n.items() if c >= 2}
    assert together.together(together.baskets(df.limit(0)), 2).count() == 0


def test_long_basket(spark):
    sets = spark.createDataFrame([(1, [f"{i:04d}" for i in range(600)]), (2, ["0001", "0300"])], "basket bigint, items array<string>")
    got = together.pair_counts(sets).collect()
    assert len(got) == 600 * 599 // 2 and [tuple(r) for r in got if r["n"] > 1] == [("0001", "0300", 2)]


def test_null_keeps_margins():
    f, m, s, n = np.array([1, 5, 40]), np.array([50, 20, 2]), np.array([1, 2, 5]), np.array([70, 40, 16])
    assert (f * m).sum() == (s * n).sum()
    null = together.Null(f, m, s, n)
    p = np.stack([null.row(x) for x in f])
    assert np.allclose((p * n).sum(axis=1), f, rtol=1e-4) and np.allclose((p * m[:, None]).sum(axis=0), s, rtol=1e-4)


@pytest.mark.parametrize("c", [0, 1, 3, 6, 12, 60, 90])
def test_tail(c):
    q, n = np.array([0.01, 0.2, 0.5]), np.array([100, 30, 80])
    pmf = np.ones(1)
    for p, k in zip(q, n):
        for _ in range(k):
            pmf = np.convolve(pmf, [1 - p, p])
    assert together.tail(q, n, c) == pytest.approx(pmf[c:].sum(), rel=0.02, abs=1e-12)


# names


def test_names(spark):
    rows = [
        (0, "Robert A. Vabrabraston", 9, "Graph Lab, Skovic University"), (1, "VABRABRASTON, Bob", 1, "University of Skovic"), (2, "R. Vabrabraston", 1, "Skovic Univ."), (3, "Robert A.  Vabrabaston", 1, None),
        (4, "Rebecca Vabrabraston", 5, "Skovic Univ."), (5, "Robert B. Vabrabraston", 5, "Skovic Univ."), (6, "Open Lattice Collaboration", 50, None), (7, "The Open Lattice Collab.", 2, None), (8, "Collaboration, Open Lattice", 1, " "),
        (9, "Jürgen Müller", 8, "Alpha Univ."), (10, "Jurgen Muller", 1, "Alpha Univ."), (11, "Jurgen Muller Jr.", 1, "Nowhere Univ."), (12, None, 3, None), (13, "  ", 3, None), (14, "Dr. Robert Vabrabraston", 1, "Skovic Univ."),
    ]
    more = [(100 + i, f"{g} Lone{c}ov", 3, None) for i, (g, c) in enumerate((g, c) for g in ("Robert", "Rebecca", "Jurgen") for c in "abcd")]
    index = spark.createDataFrame([(*r, "x") for r in rows + more], "author_idx bigint, name string, freq bigint, affiliation string, person string")
    authors = spark.createDataFrame([(1, ["Robert A. Vabrabraston", "Open Lattice Collaboration", None]), (2, None)], "id bigint, authors array<string>")
    nick = spark.createDataFrame([("Robert", "Bob"), (None, "X")], "given string, nick string")
    got = {tuple(r) for r in names.variants(index, authors, nick).collect()}
    by = defaultdict(set)
    for a, b in got:
        by[a].add(b)
    assert {1, 3} <= by[0] and by[6] == {7, 8} and 10 in by[9]
    # R. may stand for either given name
    assert not any(4 in p and set(p) & {0, 1, 3, 5, 14} for p in got) and (0, 5) not in got and (9, 11) not in got and not any(12 in p or 13 in p for p in got)
    assert names.variants(index.limit(0), authors, nick).count() == 0


def test_hot_block(spark):
    """A block of 2 100 spellings: an initial at the same place, a surname typo and a place one typo apart are still met."""
    cols = "author_idx bigint, freq bigint, suffix string, place string, given string, typed string, how string, middles array<string>, surname string"
    rows = [(i, 1, "", f"town{i}", f"j{i}", f"j{i}", "full", [], "smithson") for i in range(2100)]
    rows += [(9000, 1, "", "town7", "j", "j", "initial", [], "smithson"), (9001, 1, "", "", "j8", "j8", "full", [], "smithsn"), (9002, 1, "", "twn9", "j9", "j9", "full", [], "smithson")]
    got = {tuple(r) for r in names._candidates(spark.createDataFrame(rows, cols)).where("y >= 9000 OR y = 5").collect()}
    assert {(7, 9000), (8, 9001), (9, 9002)} <= got and len(got) == 5 + 2100 + 2101 + 2102


def test_long_lists_are_evidence(spark, monkeypatch):
    monkeypatch.setattr(names, "_LISTED", 40)
    n = 250
    index = spark.createDataFrame([(i, f"name {i}") for i in range(n)] + [(n, "apart")], "author_idx bigint, name string")
    read = index.selectExpr("author_idx", "CASE WHEN author_idx < 2 THEN 'own' ELSE concat('s', author_idx) END AS surname")
    lists = spark.createDataFrame([(0, ["name 0", *[f"name {i}" for i in range(2, n)]]), (1, ["name 1", "name 7", "name 8"]), (2, ["apart"])], "id bigint, authors array<string>")
    got = names._shared(spark.createDataFrame([(0, 1), (0, n)], "x bigint, y bigint"), lists, index, read).collect()
    assert [(r["x"], r["y"]) for r in got] == [(0, 1)] and got[0]["shared"] > 0


def test_many_spellings(spark, monkeypatch):
    who = spark.createDataFrame([(i, 0) for i in range(1001)], "author_idx bigint, person bigint")
    monkeypatch.setattr(names, "people", lambda *_: who)
    assert names.variants(None, None, None).distinct().count() == 500_500


def test_within(spark):
    rows = [("a", i) for i in range(23)] + [("b", 1), ("c", 4), ("c", 2)]
    got = groups.within(spark.createDataFrame(rows, "key string, id bigint"), "key", "id", most=5).collect()
    want = {("a", i, j) for j in range(23) for i in range(j)} | {("c", 2, 4)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_near():
    assert names.near("abcd", "abdc") and names.near("abcd", "abcdd") and names.near("abcd", "abd") and not names.near("abcd", "badc")


# documents


def test_tails_agree():
    rng = np.random.default_rng(2)
    for _ in range(20):
        q, n = rng.uniform(0.001, 0.2, 6), rng.integers(50, 800, 6)
        mean = float((q * n).sum())
        for c in {int(mean * k) + 1 for k in (1.02, 1.1, 1.3)}:
            if c > 400:
                continue
            pmf = np.ones(1)
            for p, k in zip(q, n):
                own = np.array([1.0])
                for _ in range(int(k)):
                    own = np.convolve(own, [1 - p, p])
                pmf = np.convolve(pmf, own)
            true = pmf[c:].sum()
            if true > 1e-10:
                assert together.tail(q, n, c) == pytest.approx(true, rel=1e-5)
                assert together.tail(q, n, c, exact=0) == pytest.approx(true, rel=5e-3)


def test_null_in_blocks():
    args = [np.array(x) for x in ([1, 2, 5, 9], [40, 20, 6, 1], [1, 2, 3, 6], [20, 25, 10, 4])]
    one, many = together.Null(*args), together.Null(*args, block=1)
    assert all(np.allclose(one.row(f), many.row(f)) for f in args[0])


def test_lookalike_classes(spark):
    docs = [(5, "caf\u00e9"), (3, "cafe\u0301"), (9, "cafe\u0301"), (1, "cafe"), (2, ""), (4, None), (None, "caf\u00e9"), (5, "caf\u00e9")]
    got = {tuple(r) for r in lookalike.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(5, 3, 5, 2), (3, 3, 3, 2), (9, 3, 3, 2)}


def test_leaks_numbers_with_separators(spark):
    w = [f"word{i}" for i in range(7)] + ["4,108"] + [f"more{i}" for i in range(7)]
    passage = " ".join(["ahead", *w, "behind"])
    docs = [(1, " ".join(w)), (2, " ".join(w).replace("4,108", "4108")), (3, " ".join(w).replace("4,108", "4\u2009108")), (4, " ".join(w).replace("4,108", "4109")), (5, " ".join(w[1:-1]).replace("4,108", "4108"))]
    evals = spark.createDataFrame([(9, passage)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["run"] for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), evals).collect()}
    assert got == {(1, 9): 16, (2, 9): 16, (3, 9): 16}


def test_plan():
    rng = random.Random(0)
    for _ in range(200):
        cap = rng.choice([5, 37, 100])
        sizes = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        plan = packing.Plan(cap, sizes)
        used, seen = Counter(), defaultdict(set)
        for s, r, n, first in plan.runs:
            for k in range(n):
                assert r + k not in seen[s]
                seen[s].add(r + k)
                used[first + k] += s
        assert all(seen[s] == set(range(n)) for s, n in sizes.items()) and max(used.values()) <= cap and len(used) == plan.containers
        gaps = []
        for s in sorted(sizes, reverse=True):
            for _ in range(sizes[s]):
                fit = [i for i, g in enumerate(gaps) if g >= s]
                if fit:
                    gaps[min(fit, key=lambda i: gaps[i])] -= s
                else:
                    gaps.append(cap - s)
        assert len(gaps) == plan.containers


def test_pack(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 7, 10, 20, 21, 55, 7]) for i in range(300)}
    items = spark.createDataFrame(list(sizes.items()), "id bigint, tokens bigint")
    rows = packing.pack(items, {1: 20, 2: 1000}).collect()
    for k, cap in ((1, 20), (2, 1000)):
        mine = [r for r in rows if r["capacity_id"] == k]
        used, whole = Counter(), Counter()
        for r in mine:
            whole[r["id"]] += r["tokens"]
            if r["container"] >= 0:
                used[r["container"]] += r["tokens"]
            assert (r["container"] < 0) == (r["tokens"] == 0)
            if sizes[r["id"]] <= cap:
                assert r["piece"] == 0 and r["tokens"] == sizes[r["id"]]
        assert whole == Counter(sizes) and set(whole) == set(sizes) and max(used.values()) <= cap and len(used) == max(used) + 1
    assert packing.pack(items.limit(0), {1: 20}).count() == 0 and packing.pack(items, {}).count() == 0


def test_packed_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 3000)], "doc_id bigint, text string")
    caps = spark.createDataFrame([(1, 256), (2, None)], "capacity_id int, max_tokens int")
    rows = packing.packed_texts(docs, caps).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4} and sum(r["tokens"] for r in rows if r["doc_id"] == 4) in range(3000, 3003)
    assert packing.fill(packing.packed_texts(docs, caps), caps).collect()[0]["fullest"] == 256


def test_leaks(spark):
    rng = random.Random(9)
    passages = [(i, text(rng, rng.randint(5, 60))) for i in range(20)] + [(98, None), (99, "")]
    docs = []
    for k in range(150):
        p = rng.choice(passages[:20])[1].split()
        a = rng.randrange(len(p))
        cut = p[a : a + rng.randint(5, 40)]
        docs.append((k, " ".join([text(rng, rng.randint(0, 30)), " ".join(cut).upper().replace(" ", ",  "), text(rng, rng.randint(0, 30))])))
    docs += [(1000, None), (1001, ""), (1002, passages[0][1] * 200), docs[0]]
    want = set()
    for d, t in docs:
        w = words(t)
        have = {tuple(w[i : i + 15]) for i in range(len(w) - 14)}
        for e, q in passages:
            v = words(q)
            if any(tuple(v[i : i + 15]) in have for i in range(len(v) - 14)):
                want.add((d, e))
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id bigint, text string, item bigint, ids string")
    ev = spark.createDataFrame([(i, t, "dev", "s") for i, t in passages], "item_id bigint, text string, split string, source string")
    got = leakage.leaks(df, ev).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and all(r["run"] >= 15 for r in got)
    assert leakage.report(df, ev).count() == 22
    assert leakage.leaks(df, ev.limit(0)).count() == 0 and leakage.leaks(df.limit(0), ev).count() == 0


def test_paraphrases(spark):
    rng = random.Random(11)
    passages = [(i, " ".join(f"p{i}x{k}" for k in range(40))) for i in range(10)]
    docs = []
    for i, t in passages:
        w = t.split()
        for k in (7, 19, 31):
            w[k] = "edited"
        docs.append((i, text(rng, 30) + " " + " ".join(w) + " " + text(rng, 20)))
    docs += [(50, text(rng, 100)), (51, passages[0][1][:60]), (52, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame([(i, t, "dev", "s") for i, t in passages], "item_id bigint, text string, split string, source string")
    got = {(r["doc_id"], r["item_id"]): r["common"] for r in leakage.paraphrases(df, ev).collect()}
    assert got == {(i, i): 37 for i in range(10)}
    assert leakage.paraphrases(df, ev.limit(0)).count() == 0


def paraphrased(spark, docs, passages):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    ev = spark.createDataFrame([(i, t, "dev", "s") for i, t in enumerate(passages)], "item_id bigint, text string, split string, source string")
    return {(r["doc_id"], r["item_id"]): r["common"] for r in leakage.paraphrases(df, ev).collect()}


def test_paraphrases_out_of_place(spark):
    rng = random.Random(12)
    passages = [" ".join(f"p{i}x{k}" for k in range(64)) for i in range(4)]
    docs, want = [], {}
    for i, t in enumerate(passages):
        w = t.split()
        for kept, x in [(64, [y for k, v in enumerate(w) for y in ((v, "new") if k % 3 == 2 else (v,))]), (48, [v for k, v in enumerate(w) if k % 4 < 3]), (32, [v if k % 2 else "new" for k, v in enumerate(w)])]:
            want[len(docs), i] = kept
            docs.append(" ".join([text(rng, rng.randint(0, 90)), *x, text(rng, 40)]))
    docs += [" ".join(v if k % 2 and k > 1 else "new" for k, v in enumerate(passages[0].split()))]  # 31 of 64
    assert paraphrased(spark, docs, passages) == want


def test_paraphrases_twice(spark):
    rng = random.Random(13)
    passages = [" ".join(f"p{i}x{k}" for k in range(64)) for i in range(3)] + [" ".join(f"long{k}" for k in range(300))]
    docs, want = [], {}
    for gap in (150, 275, 400, 600):
        w = [passages[1].split() for _ in range(2)]
        for x, n in zip(w, (9, 3)):
            for k in rng.sample(range(64), n):
                x[k] = "edited"
        want[len(docs), 1] = 61
        docs.append(" ".join([text(rng, gap), *w[0], text(rng, gap), *w[1], text(rng, 30)]))
    want[len(docs), 3] = 300
    docs.append(" ".join([text(rng, 2500), passages[3]]))
    docs.append(passages[0][: len(passages[0]) // 3] + text(rng, 500) + passages[0][len(passages[0]) // 3 : len(passages[0]) // 2])  # too far apart
    assert paraphrased(spark, docs, passages) == want


def test_subsequences_of_many():
    rng = np.random.default_rng(8)
    a = [rng.integers(-1, 9, n) for n in (1, 40, 64, 65, 150, 0)]
    b = [rng.integers(-2, 12, n) for n in (0, 3, 70, 200)]
    i, j = (x.ravel() for x in np.meshgrid(range(6), range(4)))
    got = leakage.subsequences(a, b, i, j)
    most = leakage.shared(a, b)
    for x, y, n in zip(i, j, got):
        row = [0] * (len(b[y]) + 1)
        for v in a[x]:
            new = [0]
            for k, u in enumerate(b[y]):
                new.append(row[k] + 1 if u == v >= 0 else max(row[k + 1], new[-1]))
            row = new
        assert n == row[-1] <= most[y, x]


@pytest.mark.parametrize("seed", range(5))
def test_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-1, 6, 30), rng.integers(-1, 6, 45)
    d = np.zeros((31, 46), int)
    for i in range(30):
        for j in range(45):
            d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] >= 0 else max(d[i, j + 1], d[i + 1, j])
    assert leakage.subsequence(a, b) == d[30, 45]


ALIKE = [
    ("code", "ϲоdе"), ("fine flow", "ﬁne ﬂow"), ("Kelly IBM", "Кellу ΙΒΜ"), ("ABc12", "ＡＢｃ１２"), ("résumé", "résu­mé"), ("a b", "a b"), ("well-known", "well‐known"), ("Ω Å", "Ω Å"),
    ("результат", "pезультaт"), ("x​y", "xy"), ("dog", "ԁоɡ"),
]
APART = [("Code", "code"), ("resume", "résumé"), ("é", "è"), ("10²", "102"), ("a b", "a  b"), ("a b", "a\nb"), ("1", "l"), ("O", "0"), ("σ", "ο"), ("б", "6"), ("corn", "com")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(spark, a, b):
    f = lookalike.Former(lookalike.tables(spark))
    assert f(a)[0] == f(b)[0] and f(f(a)[0])[0] == f(a)[0]


@pytest.mark.parametrize("a, b", APART)
def test_apart(spark, a, b):
    f = lookalike.Former(lookalike.tables(spark))
    assert f(a)[0] != f(b)[0]


def test_scripts(spark):
    f = lookalike.Former(lookalike.tables(spark))
    assert f("ϲode")[1] == 1 and f("code")[1:] == (0, 0) and f("со")[2] == 1 and f("результат") == ("результат", 0, 0)


def test_lookalikes(spark):
    docs = [(i, t) for i, pair in enumerate(ALIKE) for t in pair]
    docs = [(k, t) for k, (_, t) in enumerate(docs)] + [(100, None), (101, ""), (102, ALIKE[0][0]), (103, "x" * 100_000), (104, "х" * 100_000)]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in [*docs, docs[0]]], "doc_id bigint, text string, form string, stored int")
    got = {tuple(r) for r in lookalike.lookalikes(df).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(ALIKE))} | {(1, 102), (103, 104)}
    out = {r["doc_id"]: r["form"] for r in lookalike.consistent(df).collect()}
    assert out[100] is None and out[101] == "" and out[1] == "code"
    assert lookalike.lookalikes(df.limit(0)).count() == 0
