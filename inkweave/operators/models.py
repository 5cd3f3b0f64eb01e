"""Link models: fitted step by step, saved with their validation loss, found again by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.operators import ml

_NAME = re.compile(r"step=(\d+)-loss=([0-9.]+)$")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def checkpoints(spark: SparkSession, path: str) -> list[tuple[int, float, str]]:
    """(step, loss, path) of the models saved below path, by step."""
    fs, p = _files(spark, path)
    found = [str(s.getPath()) for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(m[1]), float(m[2]), f) for f in found if (m := _NAME.search(f)))


def latest(spark: SparkSession, path: str) -> str | None:
    """The model of the last step."""
    saved = checkpoints(spark, path)
    return saved[-1][2] if saved else None


def best(spark: SparkSession, path: str) -> str | None:
    """The model of the least loss, the earlier one of two."""
    saved = checkpoints(spark, path)
    return min(saved, key=lambda x: (x[1], x[0]))[2] if saved else None


def save(model, path: str, step: int, loss: float) -> str:
    to = f"{path}/step={step:06d}-loss={loss:.6f}"
    model.write().overwrite().save(to)
    return to


def load(path: str):
    """A logistic regression or a perceptron, whichever was saved."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, _context())


def _context():
    return SparkSession.getActiveSession()


def train(train: DataFrame, dev: DataFrame, path: str, steps: int = 3, rounds: int = 10, keep: int = 3, reset: bool = False) -> list[tuple[int, float, str]]:
    """Logistic regression on (features, label), fitted in `steps` of ever more rounds; the log loss on dev goes into the name of what is saved, and the `keep` best remain.

    A run goes on after the last step saved below path, unless reset.
    """
    spark = train.sparkSession
    fs, p = _files(spark, path)
    if reset and fs.exists(p):
        fs.delete(p, True)
    done = checkpoints(spark, path)
    for step in range(done[-1][0] + 1 if done else 1, steps + 1):
        model = ml.logistic(train, rounds=rounds * step)
        loss = ml.metrics(ml.predict(model, dev), "p", "label").first()["log_loss"]
        save(model, path, step, loss)
        for _, _, old in sorted(checkpoints(spark, path), key=lambda x: (x[1], x[0]))[keep:]:
            if old != latest(spark, path):
                fs.delete(_files(spark, old)[1], True)
    return checkpoints(spark, path)


def evaluate(model, rows: DataFrame) -> DataFrame:
    """(log_loss, accuracy, f1) on rows (features, label)."""
    return ml.metrics(ml.predict(model, rows), "p", "label")


def document_vectors(nodes: DataFrame, size: int = 32, fewest: int = 2, seed: int = 0) -> DataFrame:
    """(id, h): vectors of texts as the mean of skip-gram vectors of their words learnt from all texts."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from inkweave.functions.text import tokens

    x = nodes.select("id", tokens("abstract").alias("t"))
    model = Word2Vec(inputCol="t", outputCol="h", vectorSize=size, minCount=fewest, seed=seed, maxIter=1).fit(x)
    return model.transform(x).select("id", vector_to_array("h").alias("h"))


def pair_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair_id, split, features, label) of labelled pairs whose ends have a vector: both vectors, one behind the other."""
    from pyspark.ml.functions import array_to_vector

    from inkweave.operators.embed import on_pairs

    x = on_pairs(pairs.where("y IN (0, 1)"), vectors)
    return x.select("pair_id", "split", array_to_vector(F.concat("hu", "hv")).alias("features"), F.col("y").cast("double").alias("label"))
