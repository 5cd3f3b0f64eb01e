"""Layers with given weights over arrays of doubles, as column expressions and aggregates, and the losses that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import vectors as V
from inkweave.operators.graph import adjacency, gcn_weights


def relu(x: Column | str) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(x: Column | str, slope: float = 0.01) -> Column:
    return F.transform(x, lambda v: F.when(v > 0, v).otherwise(v * slope))


def elu(x: Column | str) -> Column:
    return F.transform(x, lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dense(x: Column | str, weight: list[list[float]], bias: list[float] | None = None) -> Column:
    """weight (a row for each output) times x, plus bias."""
    rows = [V.dot(x, F.array(*[F.lit(float(w)) for w in row])) for row in weight]
    return F.array(*[r + F.lit(float(b)) for r, b in zip(rows, bias or [0.0] * len(rows))])


def argmax(x: Column | str) -> Column:
    """Position from 0 of the first largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def mean_vectors(adj: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, m): mean over neighbours of their vectors (id, h), added up as vectors before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    sent = adj.join(vectors.select(F.col("id").alias("nbr"), array_to_vector("h").alias("x")), "nbr")
    return sent.groupBy(F.col("v").alias("id")).agg(Summarizer.mean(F.col("x")).alias("m")).select("id", vector_to_array("m").alias("m"))


def sage_layer(vectors: DataFrame, edges: DataFrame, own: list[list[float]], near: list[list[float]], bias: list[float] | None = None) -> DataFrame:
    """(id, h): own weights times a node's vector plus near weights times the mean of its neighbours' (zeros without one)."""
    m = mean_vectors(adjacency(edges), vectors)
    both = vectors.join(m, "id", "left").withColumn("m", F.coalesce("m", F.transform("h", lambda _: F.lit(0.0))))
    return both.select("id", V.plus(dense("h", own, bias), dense("m", near)).alias("h"))


def gcn_layer(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, weight: list[list[float]]) -> DataFrame:
    """(id, h): weight times the sum over neighbours and the node itself of their vectors in the symmetrically normalised adjacency; nodes without a vector send none."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    small = vectors.select(F.col("id").alias("dst"), dense("h", weight).alias("h"))  # fewer numbers travel
    sent = gcn_weights(nodes, edges).join(small, "dst").select("src", array_to_vector(F.transform("h", lambda x: x * F.col("w"))).alias("x"))
    return sent.groupBy(F.col("src").alias("id")).agg(Summarizer.sum(F.col("x")).alias("h")).select("id", vector_to_array("h").alias("h"))


def mlp_score(hu: Column | str, hv: Column | str, hidden: list[list[float]], out: list[float]) -> Column:
    """out times relu of the hidden layer over both vectors, one behind the other: a score without a sigmoid."""
    return V.dot(relu(dense(F.concat(hu, hv), hidden)), F.array(*[F.lit(float(w)) for w in out]))


def in_batch(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(batch, pos, loss, correct) of rows (batch, pos, q, p): every query's dot products with all passages of its batch, the softmax loss of its own, and whether its own is the first of the highest. A batch is of bounded size by its making."""
    c = rows.select("batch", F.col("pos").alias("other"), "p")
    s = rows.select("batch", "pos", "q").join(c, "batch").select("batch", "pos", "other", (V.dot("q", "p") / temperature).alias("s"))
    g = s.groupBy("batch", "pos").agg(F.max("s").alias("peak"), F.max(F.when(F.col("pos") == F.col("other"), F.col("s"))).alias("own"), F.min_by("other", F.struct(F.round(-F.col("s"), 9), "other")).alias("best"))
    total = s.join(g, ["batch", "pos"]).groupBy("batch", "pos").agg(F.sum(F.exp(F.col("s") - F.col("peak"))).alias("total"))
    return g.join(total, ["batch", "pos"]).select("batch", "pos", (F.log("total") + F.col("peak") - F.col("own")).alias("loss"), (F.col("best") == F.col("pos")).cast("int").alias("correct"))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with batch and pos: rows in the order of a whole-number column, `size` to a batch."""
    from inkweave.operators.graph import numbered

    x = numbered(df, order, "row")
    return x.withColumns({"batch": F.floor(F.col("row") / size).cast("bigint"), "pos": (F.col("row") % size).cast("bigint")}).drop("row")


def gaussian_divergence(states: DataFrame, mean: Column | str, log_scale: Column | str) -> DataFrame:
    """(kl): divergence from the standard normal of the states' normals, summed over positions, the mean over states over their number."""
    each = F.aggregate(F.zip_with(mean, log_scale, lambda m, s: 1 + 2 * s - m * m - F.exp(2 * s)), F.lit(0.0), lambda a, x: a + x)
    return states.agg((-0.5 * F.avg(each) / F.count("*")).alias("kl"))


def weighted_entropy(scored: DataFrame, logit: Column | str, y: Column | str) -> DataFrame:
    """(loss): cross entropy of logits, positives weighing as much as negatives in all (by their numbers)."""
    x, y = F.col(logit) if isinstance(logit, str) else logit, (F.col(y) if isinstance(y, str) else y).cast("double")
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    s = scored.agg(F.sum(y * soft(-x)).alias("pos"), F.sum((1 - y) * soft(x)).alias("neg"), F.sum(y).alias("k"), F.count("*").alias("n"))
    return s.select(((F.try_divide((F.col("n") - F.col("k")) * F.col("pos"), F.col("k")) + F.col("neg")) / F.col("n")).alias("loss"))


def batch_means(losses: DataFrame, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """(loss): the mean over batches of their mean loss."""
    return losses.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"))
