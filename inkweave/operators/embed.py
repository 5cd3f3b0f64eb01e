"""Pairs of vectors, and exact comparison of all vectors in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.functions.vectors import cosine
from inkweave.sources.shared import parallel

_ROWS = 2048
_WIDE = 65_536  # vectors of a block of nearest(): a cell holds two and compares them _ROWS by _ROWS
_COPIES = 12


def on_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs whose ends both have a vector, with hu and hv."""
    return pairs.join(vectors.toDF("u", "hu"), "u").join(vectors.toDF("v", "hv"), "v")


def _sent(h: np.ndarray) -> bytes:
    """The numbers with a first byte: 4 where 32 bits hold them all without loss, else 8."""
    with np.errstate(over="ignore"):
        short = h.astype(np.float32)
    return b"\x04" + short.tobytes() if np.array_equal(short, h) else b"\x08" + h.tobytes()


def _got(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float32 if b[0] == 4 else np.float64, offset=1).astype(np.float64)


def _compared(vectors: DataFrame, schema: str, cell: Callable[..., pd.DataFrame], rows: int = _ROWS, *, wide: bool = False) -> DataFrame:
    """Rows of cell(ids, h, asks, ids, h, asks, same) over every two blocks of vectors (id, h, asks), the two of them once.

    Blocks of about `rows` vectors travel as one row to each cell they are in, so n / rows copies of the vectors are shuffled and
    work is quadratic, in cells of bounded size. All vectors have one length. wide: blocks grow with n, up to _WIDE, so that
    there are about _COPIES; numbers that fit in 32 bits travel so.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if wide:
        rows = min(_WIDE, max(rows, -(-n // _COPIES)))
    blocks = max(1, -(-n // rows))

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        h = np.array([np.asarray(x, dtype=np.float64) for x in b["h"]])
        return pd.DataFrame({"block": [key[0]], "ids": [b["id"].to_numpy(np.int64).tobytes()], "h": [_sent(h)], "asks": [b["asks"].to_numpy(bool).tobytes()]})

    packed = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "h", "asks").groupBy("block").applyInPandas(pack, "block bigint, ids binary, h binary, asks binary")
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "ids", "h", "asks")

    def run(c: pd.DataFrame) -> pd.DataFrame:
        # the cell (lo, hi) is missing one side where a hash leaves a block empty: that is no pair of blocks
        if len(c) == 1 and c["lo"].iloc[0] != c["hi"].iloc[0]:
            return pd.DataFrame({x.split()[0]: [] for x in schema.split(",")})
        side = []
        for r in c.sort_values("block").itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            side.append((ids, _got(r.h).reshape(len(ids), -1), np.frombuffer(r.asks, bool)))
        return cell(*side[0], *side[-1], len(side) == 1)

    return sent.repartition(max(parallel(spark), min(blocks * (blocks + 1) // 2, 8192)), "lo", "hi").groupBy("lo", "hi").applyInPandas(run, schema)


def _asking(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "h", "asks" if "asks" in vectors.columns else F.lit(True).alias("asks"))


def nearest(vectors: DataFrame, k: int, by: str = "distance") -> DataFrame:
    """(id, other, similarity): the k nearest of every vector (id, h) that asks (all, without a column asks), exactly: by squared Euclidean distance (similarity is its negative) or by the dot product (`cosine`, for unit vectors); to 9 digits, ties by id."""

    def best(a: np.ndarray, ids: np.ndarray, others: np.ndarray, asks: np.ndarray) -> pd.DataFrame:
        i = np.flatnonzero(asks)
        s = np.round(a[i], 9)
        s[ids[i][:, None] == others[None, :]] = -np.inf
        out = np.sort(-s, axis=1)[:, min(k, s.shape[1]) - 1]
        r, c = np.nonzero((-s <= out[:, None]) & np.isfinite(s))
        o = np.lexsort((others[c], -s[r, c], r))
        r, c = r[o], c[o]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[keep], c[keep]
        return pd.DataFrame({"id": ids[i[r]], "other": others[c], "similarity": a[i[r], c]})

    def tile(ia, a, qa, ib, b, qb, same) -> list[pd.DataFrame]:
        s = a @ b.T
        if by != "cosine":
            s = 2 * s - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)[None, :]
        return [best(s, ia, ib, qa)] + ([] if same else [best(s.T, ib, ia, qb)])

    def kept(held: list[pd.DataFrame]) -> pd.DataFrame:
        """The k best of each id."""
        x = pd.concat(held)
        o = np.lexsort((x["other"], -np.round(x["similarity"], 9), x["id"]))
        x = x.iloc[o]
        i = x["id"].to_numpy()
        return x[np.arange(len(i)) - np.searchsorted(i, i) < k]

    def cell(ia, a, qa, ib, b, qb, same) -> pd.DataFrame:
        held: list[pd.DataFrame] = []
        for i in range(0, len(ia), _ROWS):
            for j in range(i if same else 0, len(ib), _ROWS):
                x, y = slice(i, i + _ROWS), slice(j, j + _ROWS)
                held += tile(ia[x], a[x], qa[x], ib[y], b[y], qb[y], same and i == j)
            held = [kept(held)]  # one row of tiles at most is held beside the best so far
        return held[0]

    found = _compared(_asking(vectors), "id bigint, other bigint, similarity double", cell, wide=True)
    w = W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other")  # k from each block
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: one is among the k nearest (Euclidean, ties by id) of the other; exact, in blocks."""
    return nearest(vectors, k).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def gaussian_kernel(vectors: DataFrame, sigma: float) -> DataFrame:
    """(a, b, k), a < b: exp(-d^2 / 2 sigma^2) of all pairs, in blocks; the result is quadratic by its nature."""

    def cell(ia, a, _qa, ib, b, _qb, same) -> pd.DataFrame:
        d = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)
        i, j = np.triu_indices(len(ia), 1) if same else (x.ravel() for x in np.indices(d.shape))
        return pd.DataFrame({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j]), "k": np.exp(-d[i, j] / (2 * sigma * sigma))})

    return _compared(_asking(vectors), "a bigint, b bigint, k double", cell)


def most_similar(vectors: DataFrame, to: int, n: int) -> DataFrame:
    """(id, similarity) of the n vectors of highest cosine to one; one scan, a bounded heap in each task."""
    one = vectors.where(F.col("id") == to).select(F.col("h").alias("q"))
    scored = vectors.where(F.col("id") != to).crossJoin(F.broadcast(one)).select("id", cosine("h", "q").alias("similarity"))  # one row
    return scored.where("similarity IS NOT NULL").orderBy(F.desc(F.round("similarity", 9)), "id").limit(n)
