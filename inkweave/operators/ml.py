"""Metrics and blending as aggregates; estimators from pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.operators import lists
from inkweave.sources.shared import store

EPS = 1e-15
_LINKS = 16_000_000  # edges that one task holds for spectral(): 16 bytes each, and as much again while they arrive
_PIECE = 1 << 20


def metrics(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(log_loss, accuracy, f1) of probabilities against labels 0 and 1; probabilities are clipped to [1e-15, 1 - 1e-15], decisions are p > 0.5."""
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    yes, real = F.col(p) > 0.5, F.col(y) == 1
    return scored.agg(
        F.avg(-F.when(real, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg((yes == real).cast("double")).alias("accuracy"),
        F.try_divide(2.0 * F.sum((yes & real).cast("int")), 2.0 * F.sum((yes & real).cast("int")) + F.sum((yes != real).cast("int"))).alias("f1"),
    )


def roc_auc(scored: DataFrame, p: str = "p", y: str = "y", digits: int = 6) -> DataFrame:
    """(auc) by rank sums over the counts per score rounded to `digits`, ties counting half; the running sum is over scores, in two levels."""
    s = scored.groupBy(F.round(p, digits).alias("s")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.sum((F.col(y) != 1).cast("bigint")).alias("neg"))
    s = _running(s, "s", ["neg"])
    return s.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def _running(df: DataFrame, order: str, cols: list[str], steps: int = 1000) -> DataFrame:
    """df with <col>_before: sums over rows with a smaller value of order, a share in [0, 1], through at most steps + 1 groups."""
    g = df.withColumn("g", F.floor(F.col(order) * steps))
    tot = g.groupBy("g").agg(*[F.sum(c).alias(f"{c}_g") for c in cols])
    w = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    base = tot.select("g", *[F.coalesce(F.sum(f"{c}_g").over(w), F.lit(0)).alias(f"{c}_base") for c in cols])
    inner = W.partitionBy("g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = g.join(F.broadcast(base), "g")
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"{c}_base")).alias(f"{c}_before") for c in cols])


def average_precision(scored: DataFrame, p: str = "p", y: str = "y", digits: int = 6) -> DataFrame:
    """(ap): precision at each distinct score, weighted by the gain in recall."""
    s = scored.groupBy(F.round(1 - F.col(p), digits).alias("s")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    s = _running(s, "s", ["pos", "n"])
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return s.agg(F.try_divide(F.sum(precision * F.col("pos")), F.sum("pos").cast("double")).alias("ap"))


def cross_entropy(both: DataFrame, p: str, q: str) -> DataFrame:
    """(bce) of two scores of the same rows, p predicted and q given."""
    c = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    return both.agg(F.avg(-(F.col(q) * F.log(c) + (1 - F.col(q)) * F.log(1 - c))).alias("bce"))


def clip_extremes(p: Column, low: float = 0.05, high: float = 0.9) -> Column:
    return F.when(p < low, 0.0).when(p > high, 1.0).otherwise(p)


def soft_vote(scores: list[Column], weights: list[float] | None = None, by: str = "sum") -> Column:
    """Weighted mean of scores; by="max" divides weights by the largest instead of their sum, which can exceed 1."""
    w = weights or [1.0] * len(scores)
    scale = sum(w) if by == "sum" else max(w) if weights else float(len(w))
    total = F.lit(0.0)
    for s, x in zip(scores, w):
        total = total + s * F.lit(float(x))
    return total / F.lit(float(scale))


def histogram(scored: DataFrame, p: str = "p", bins: int = 200) -> DataFrame:
    """(bin, n): equal widths over [0, 1], the last closed."""
    return scored.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def pair_losses(scored: DataFrame, s: str = "s", y: str = "y") -> DataFrame:
    """(bce, bce_logits, mse, accuracy) of raw scores s: cross entropy of their sigmoid, the same from logits, squared error against labels of -1 and 1, and decisions at sigmoid > 0.5."""
    sig = 1 / (1 + F.exp(-F.col(s)))
    q = F.least(F.greatest(sig, F.lit(EPS)), F.lit(1 - EPS))
    yv = F.col(y).cast("double")
    return scored.agg(
        F.avg(-(yv * F.log(q) + (1 - yv) * F.log(1 - q))).alias("bce"), F.avg(F.greatest(F.col(s), F.lit(0.0)) - F.col(s) * yv + F.log1p(F.exp(-F.abs(s)))).alias("bce_logits"),
        F.avg(F.pow(F.col(s) - (2 * yv - 1), 2)).alias("mse"), F.avg(((sig > 0.5) == (yv == 1)).cast("double")).alias("accuracy"),
    )


def assemble(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    keep = [c for c in df.columns if c not in features]
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df).select(*keep, "features").withColumnRenamed(label, "label")


def logistic(train: DataFrame, c: float = 1.0, tol: float = 1e-5, rounds: int = 1000):
    """Logistic regression with the penalty of 1/c times half the squared weights on the summed loss."""
    from pyspark.ml.classification import LogisticRegression

    n = max(1, train.count())
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=tol, maxIter=rounds).fit(train)


def zoo() -> dict:
    """Further classifiers with default settings; neighbours, boosting by reweighting, discriminant analysis and kernels have no distributed estimator here."""
    from pyspark.ml import classification as C

    return {
        "random_forest": C.RandomForestClassifier(numTrees=20, seed=0), "gbt": C.GBTClassifier(maxIter=10, seed=0), "decision_tree": C.DecisionTreeClassifier(seed=0),
        "gaussian_nb": C.NaiveBayes(modelType="gaussian"), "linear_svc": C.LinearSVC(maxIter=20), "logistic": C.LogisticRegression(),
    }


def predict(model, df: DataFrame) -> DataFrame:
    """df with p: the probability of 1, or the sigmoid of the margin where a model has no probabilities."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn("p", vector_to_array("probability")[1])
    return out.withColumn("p", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def kmeans(vectors: DataFrame, k: int, init: str = "k-means||", seed: int = 0) -> DataFrame:
    """(id, cluster); init is `random` or `k-means||`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.select("id", array_to_vector("h").alias("features"))
    return KMeans(k=k, initMode=init, seed=seed).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def centroids(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, pos, x): mean of each position."""
    return vectors.join(clusters, "id").select("cluster", F.posexplode("h").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))


def spectral(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """(id, cluster) by power iteration on the normalised affinity of weighted edges (src, dst, w).

    As PowerIterationClustering from degrees does it, and by it beyond _LINKS edges, which shuffles and keeps the graph anew in
    every round; up to that the edges are sent once, to one task that does all rounds.
    """
    from pyspark.ml.clustering import KMeans, PowerIterationClustering
    from pyspark.ml.functions import array_to_vector

    links = store(edges.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")), "affinity")
    n = links.count()
    if not 0 < n <= _LINKS:
        return PowerIterationClustering(k=k, maxIter=rounds, weightCol="w", initMode="degree").assignClusters(links)
    nodes = lists.number(links.select("src").union(links.select("dst")))
    coded = links.join(nodes.toDF("src", "a"), "src").join(nodes.toDF("dst", "b"), "dst").select("a", "b", "w")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(x["a"].to_numpy(np.int32), x["b"].to_numpy(np.int32), x["w"].to_numpy(np.float64)) for x in batches]
        if not parts:
            return
        a, b, w = (np.concatenate(x) for x in zip(*parts))
        del parts
        if (w < 0).any():
            raise ValueError("an affinity is negative")
        size, step = 1 + int(max(a.max(), b.max())), max(_PIECE, len(a) // 8)

        def spread(x: np.ndarray) -> np.ndarray:
            out = np.zeros(size)
            for i in range(0, len(a), step):
                p, q, y = a[i : i + step], b[i : i + step], w[i : i + step]
                out += np.bincount(p, y * x[q], size) + np.bincount(q, y * x[p], size)
            return out

        d = spread(np.ones(size))
        v, d = d / d.sum(), np.maximum(d, np.finfo(float).eps)
        still, before, change = max(1e-5 / size, 1e-8), np.inf, np.inf
        for _ in range(rounds):
            if change <= still:
                break
            new = spread(v) / d
            new /= np.abs(new).sum()
            moved = np.abs(new - v).sum()
            v, change, before = new, abs(moved - before), moved
        yield pd.DataFrame({"k": np.arange(size, dtype=np.int32), "x": v})

    found = coded.repartition(1).mapInPandas(run, "k int, x double")
    v = store(nodes.join(found, "k").select(F.col("node").alias("id"), "x"), "spectrum").select("id", array_to_vector(F.array("x")).alias("features"))
    return KMeans(k=k, seed=0).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def pca(vectors: DataFrame, k: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector("h").alias("features"))
    return PCA(k=k, inputCol="features", outputCol="z").fit(v).transform(v).select("id", vector_to_array("z").alias("z"))
