"""Problem 2: items that appear together, and how far above chance.

Pair counts are exact. Chance is the maximum-entropy null of the item-basket table that keeps, on average, every item's
frequency and every basket's size: an item i is in a basket j with probability x_i y_j / (1 + x_i y_j). Items of one
frequency share x and baskets of one size share y, so the null is fitted on the driver over distinct frequencies and
sizes. The number of common baskets of two items is then a sum of independent trials with one probability per basket
size (Poisson-binomial); its upper tail is summed for counts up to 400 and taken from the saddle point beyond; the tails are turned into
false-discovery rates over all pairs of items (Benjamini and Hochberg).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.sources.shared import parallel, store

_BLOCK = 256
_EXACT = 400  # counts up to which a tail is summed; the saddle point beyond is within a thousandth of it


def baskets(df: DataFrame, id_col: str = "id", items: str = "authors") -> DataFrame:
    """(basket, items): the sorted distinct items, neither null nor empty, of every basket that has one. A basket delivered in several rows is their union; null ids are left out."""
    one = df.where(F.col(id_col).isNotNull() & (F.size(items) > 0)).select(F.col(id_col).alias("basket"), F.col(items).alias("items"))
    kept = F.filter(F.array_distinct("items"), lambda x: x.isNotNull() & (x != ""))
    one = one.select("basket", kept.alias("items")).where(F.size("items") > 0).distinct()
    return one.groupBy("basket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # one basket


def pair_counts(sets: DataFrame) -> DataFrame:
    """(a, b, n), a < b, for sets (basket, items sorted): baskets that hold both. Long baskets are cut into blocks, and pairs of blocks spread over tasks."""
    m = F.ceil(F.size("items") / _BLOCK).cast("int")
    cut = sets.where(F.size("items") > 1).select("basket", F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.slice("items", k * _BLOCK + 1, _BLOCK)).alias("blocks"))
    short = cut.where(F.size("blocks") == 1).select(F.lit(True).alias("same"), F.col("blocks")[0].alias("l"), F.col("blocks")[0].alias("r"))
    long = cut.where(F.size("blocks") > 1).select("basket", "blocks", F.posexplode("blocks").alias("i", "l"))
    long = long.select("basket", "i", "l", F.posexplode("blocks").alias("j", "r")).where("j >= i").repartition(parallel(sets.sparkSession), "basket", "i", "j")
    both = short.union(long.select(F.expr("i = j"), "l", "r"))
    pairs = both.select("same", F.explode("l").alias("a"), "r").select("same", "a", F.explode("r").alias("b")).where("NOT same OR a < b")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


class Null:
    """Probabilities that an item of a frequency class is in a basket of a size class: x y / (1 + x y), of which only the two rows of factors are kept and sent.

    Distinct frequencies are at most the root of twice the entries of the table, so their factors stay small: some 11 MB
    for a million million entries. The sums of the fit go over a bounded block of frequencies at a time.
    """

    def __init__(self, item_freq: np.ndarray, item_n: np.ndarray, size: np.ndarray, size_n: np.ndarray, rounds: int = 2000, tol: float = 1e-8, block: int = 4096):
        f, m, s, n = (np.asarray(a, dtype=np.float64) for a in (item_freq, item_n, size, size_n))
        total = max((f * m).sum(), 1.0)
        x, y = f / sqrt(total), s / sqrt(total)
        for _ in range(rounds):
            x_new, below = np.empty_like(x), np.zeros_like(y)
            for at in range(0, len(f), block):
                k = slice(at, at + block)
                x_new[k] = f[k] / np.maximum((n * y / (1 + np.outer(x[k], y))).sum(axis=1), 1e-300)
                below += ((m[k] * x_new[k])[:, None] / (1 + np.outer(x_new[k], y))).sum(axis=0)
            y_new = s / np.maximum(below, 1e-300)
            moved = max(np.abs(x_new / x - 1).max(initial=0), np.abs(y_new / y - 1).max(initial=0))
            x, y = np.minimum(x_new, 1e12), np.minimum(y_new, 1e12)
            if moved < tol:
                break
        self.freq, self.size_n, self.x, self.y = f, n, np.where(f >= n.sum(), np.inf, x), y  # inf: in every basket

    def row(self, f: int) -> np.ndarray:
        x = self.x[min(int(np.searchsorted(self.freq, f)), len(self.freq) - 1)]
        return np.ones_like(self.y) if np.isinf(x) else x * self.y / (1 + x * self.y)


def tail(q: np.ndarray, n: np.ndarray, c: int, exact: int = _EXACT) -> float:
    """P(X >= c) for X a sum of n[s] trials of probability q[s]: summed for counts up to `exact`, by the saddle point beyond."""
    q, n = q[q > 0], n[q > 0]
    mean = float((n * q).sum())
    if c <= 0:
        return 1.0
    if c > n.sum():
        return 0.0
    if c <= exact and mean <= exact:
        top = int(2 * max(c, mean)) + 60
        pmf = np.zeros(top + 1)
        pmf[0] = 1.0
        for p, k in zip(q, n.astype(np.int64)):
            if p >= 1:
                pmf = np.concatenate([np.zeros(min(k, top + 1)), pmf])[: top + 1]
                continue
            own = np.zeros(top + 1)
            own[0] = np.exp(k * np.log1p(-p))
            for i in range(1, min(k, top) + 1):
                own[i] = own[i - 1] * (k - i + 1) / i * p / (1 - p)
            pmf = np.convolve(pmf, own)[: top + 1]
        return float(min(1.0, pmf[c:].sum())) if mean < c else float(max(0.0, 1 - pmf[:c].sum()))
    # Lugannani and Rice with the correction for whole numbers
    lo, hi = -50.0, 50.0
    for _ in range(200):
        t = (lo + hi) / 2
        e = q * np.exp(t)
        if (n * e / (1 - q + e)).sum() < c:
            lo = t
        else:
            hi = t
    e = q * np.exp(t)
    r = e / (1 - q + e)
    k0 = float((n * np.log(1 - q + e)).sum())
    var = float((n * r * (1 - r)).sum())
    if abs(t) < 1e-6 or var <= 0:
        sd = sqrt(max(float((n * q * (1 - q)).sum()), 1e-12))
        return 0.5 * erfc((c - 0.5 - mean) / sd / sqrt(2))
    w = np.sign(t) * sqrt(max(2 * (t * c - k0), 0.0))
    u = (1 - np.exp(-t)) * sqrt(var)
    value = 0.5 * erfc(w / sqrt(2)) + np.exp(-w * w / 2) / sqrt(2 * np.pi) * (1 / u - 1 / w)
    return float(min(1.0, max(value, 0.0)))


def _discovery(tails: DataFrame, tests: int) -> DataFrame:
    """tails (p, n) with q, the false-discovery rate over `tests` tests: cumulative counts within steps of p, and over the few thousand steps."""
    p = tails.groupBy("p").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.log10(F.greatest("p", F.lit(1e-320))) * 20).cast("int"))
    p = store(p, "tails")
    within = W.partitionBy("step").orderBy("p")
    steps = p.groupBy("step").agg(F.sum("n").alias("all"))
    steps = steps.withColumn("before", F.coalesce(F.sum("all").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most 6 420 steps
    ranked = p.join(F.broadcast(steps.select("step", "before")), "step").withColumn("raw", F.col("p") * tests / (F.sum("n").over(within) + F.col("before")))
    ranked = store(ranked, "ranked")
    later = ranked.groupBy("step").agg(F.min("raw").alias("least")).withColumn("later", F.min("least").over(W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, -1))).select("step", "later")
    down = F.min("raw").over(W.partitionBy("step").orderBy(F.desc("p")))
    return ranked.join(F.broadcast(later), "step").select("p", F.least(F.lit(1.0), down, "later").alias("q"))


def together(sets: DataFrame, fewest: int = 5) -> DataFrame:
    """(a, b, n, n_a, n_b, baskets, expected, p, q) of every two items a < b that share at least `fewest` baskets of sets (basket, items).

    expected, p and q come from the null over all items and baskets; n * baskets / (n_a * n_b) is the plain lift. Items in
    fewer baskets than `fewest` can be in no such pair and are left out of the pairing, not of the null. q is the
    false-discovery rate among all pairs of items, ranked among the pairs listed, so it is never too small.
    """
    spark = sets.sparkSession
    each = sets.select("basket", F.size("items").alias("size"), F.explode("items").alias("item"))
    freq = store(each.groupBy("item").agg(F.count("*").alias("f")), "frequencies")
    sizes = sets.groupBy(F.size("items").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()  # distinct sizes
    freqs = freq.groupBy("f").agg(F.count("*").alias("m")).orderBy("f").collect()  # distinct frequencies
    total = sum(r["n"] for r in sizes)
    schema = "a {0}, b {0}, n bigint, n_a bigint, n_b bigint, baskets bigint, expected double, p double, q double".format(sets.schema["items"].dataType.elementType.simpleString())
    if not total:
        return spark.createDataFrame([], schema)
    null = Null(np.array([r["f"] for r in freqs]), np.array([r["m"] for r in freqs]), np.array([r["size"] for r in sizes]), np.array([r["n"] for r in sizes]))
    usual = each.join(freq.where(F.col("f") >= fewest).select("item"), "item", "left_semi")
    kept = usual.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))  # one basket
    pairs = pair_counts(kept).where(F.col("n") >= fewest)
    pairs = pairs.join(freq.toDF("a", "n_a"), "a").join(freq.toDF("b", "n_b"), "b")
    pairs = store(pairs, "pairs")
    kinds = pairs.groupBy(F.least("n_a", "n_b").alias("f"), F.greatest("n_a", "n_b").alias("g"), "n").agg(F.count("*").alias("pairs"))

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ex, ps = [], []
            for f, g, c in zip(b["f"], b["g"], b["n"]):
                q = null.row(f) * null.row(g)
                ex.append(float((null.size_n * q).sum()))
                ps.append(tail(q, null.size_n, int(c)))
            yield b.assign(expected=ex, p=ps)

    kinds = store(kinds.repartition(parallel(spark), "f", "g", "n").mapInPandas(tested, "f bigint, g bigint, n bigint, pairs bigint, expected double, p double"), "tests")
    rate = _discovery(kinds.select("p", F.col("pairs").alias("n")), comb(sum(r["m"] for r in freqs), 2))
    out = pairs.withColumns({"f": F.least("n_a", "n_b"), "g": F.greatest("n_a", "n_b")}).join(kinds.drop("pairs"), ["f", "g", "n"]).join(rate, "p")
    return out.select("a", "b", "n", "n_a", "n_b", F.lit(total).cast("bigint").alias("baskets"), "expected", "p", "q")


def names_together(authors: DataFrame, index: DataFrame, fewest: int = 5) -> DataFrame:
    """together for the names of authors (id, authors), as numbers of index (author_idx, name): author_idx_a < author_idx_b."""
    found = together(store(baskets(authors), "baskets"), fewest)
    names = index.where("name IS NOT NULL").select("author_idx", "name")
    # numbers need not be in the order of the names
    out = found.join(names.toDF("x", "a"), "a").join(names.toDF("y", "b"), "b")
    swap = F.col("x") > F.col("y")
    return out.select(F.least("x", "y").alias("author_idx_a"), F.greatest("x", "y").alias("author_idx_b"), "n", F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "baskets", "expected", "p", "q")
