"""What two similar sets are sure to share of their rarest members, and which pairs of sets share enough of it.

Two sets with a similarity of at least t share at least t of either, and at least a = t / (1 + t) of their sizes together.
Ordered by rarity and cut down to their rarest members, as many as exceed the rest by m, what is left of both still shares
m. The k-th that two sets share stands so early in both that a - k members are not before it, or their similarity is lower: so
most pairs that share a member by chance are not even listed. No pair of that similarity is lost by either.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.words import Hasher, shingles, words
from inkweave.sources.shared import store

NEEDED = 3
_SLICES = 16
_PAIRS = 1 << 22
MOST_BITS = 26  # of a place in the sketch: 64 million counters of two bytes on each executor


def read(texts: DataFrame, n: int, signature: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, text_hash, key, size, bits) of texts (id, text), and a sketch, in one pass: digest and number of the distinct runs of n words, and their signature.

    Null ids, null texts and texts of fewer than n words have no row. The sketch has counts, up to 65 535, of the shingles by
    the last bits of each: those of several may meet in one counter, so none is counted too low.
    """
    spark = texts.sparkSession
    raw = texts.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_hash"))
    chars = raw.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(chars / 6 + 1)) + 1)))  # of a place
    cut, lots = (1 << bits) // _SLICES, max(1, round(raw.rdd.getNumPartitions() ** 0.5))
    empty = {x: None for x in ("id", "text_hash", "key", "size", "bits", "slice", "lot", "m")}

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        hasher, m = Hasher(), np.zeros(1 << bits, np.uint16)
        for b in batches:
            out, held = [], []
            for i, x, t in zip(b["id"], b["text_hash"], b["text"]):
                sh = np.unique(shingles(hasher(words(t)), n))
                if len(sh):
                    out.append((i, x, hashlib.blake2b(sh.tobytes(), digest_size=16).digest(), len(sh), signature(sh).tobytes() if signature else None))
                    held.append(sh.view(np.int64))
            if out:
                at, k = np.unique(np.concatenate(held) & ((1 << bits) - 1), return_counts=True)
                m[at] = np.minimum(m[at] + k, 65_535)
                yield pd.DataFrame(out, columns=["id", "text_hash", "key", "size", "bits"]).assign(slice=None, lot=None, m=None)
        if m.any():
            lot = TaskContext.get().partitionId() % lots
            yield pd.DataFrame([empty | {"slice": i, "lot": lot, "m": zlib.compress(m[i * cut : (i + 1) * cut].tobytes(), 1)} for i in range(_SLICES)])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cut, np.uint32)
        for x in g["m"]:
            total = np.minimum(total + np.frombuffer(zlib.decompress(x), np.uint16), 65_535)
        return pd.DataFrame({"slice": g["slice"].iloc[:1], "lot": 0, "m": [zlib.compress(total.astype(np.uint16).tobytes(), 1)]})

    schema = "slice int, lot int, m binary"
    both = store(raw.mapInPandas(local, f"id bigint, text_hash bigint, key binary, size int, bits binary, {schema}"), "read")
    got = both.where("m IS NOT NULL").select("slice", "lot", "m").groupBy("slice", "lot").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema).collect()
    out = np.zeros(1 << bits, np.uint16)
    for r in got:
        out[r["slice"] * cut : (r["slice"] + 1) * cut] = np.frombuffer(zlib.decompress(r["m"]), np.uint16)
    return both.where("id IS NOT NULL").select("id", "text_hash", "key", "size", "bits"), out


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts (id, text) of ids (id, text_hash, and further columns), each once: a text is shuffled once."""
    raw = texts.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")
    return ids.join(raw, "id").where(F.xxhash64("text") == F.col("text_hash")).dropDuplicates(["id"]).drop("text_hash")


def with_sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, sh) of texts (id, text): the hashes of the distinct runs of n words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "sh": [np.unique(shingles(hasher(words(t)), n)).view(np.int64) for t in b["text"]]})

    return texts.select("id", "text").mapInPandas(run, "id bigint, sh array<bigint>")


_read: dict[str, np.ndarray] = {}


class Sent:
    """A sketch on its way to the executors, packed; unpacked once in each Python worker."""

    def __init__(self, spark: SparkSession, counts: np.ndarray):
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(zlib.compress(counts.tobytes(), 1))

    def read(self) -> np.ndarray:
        if self.key not in _read:
            _read.clear()
            _read[self.key] = np.frombuffer(zlib.decompress(self.sent.value), np.uint16)
        return _read[self.key]


def placed(sh: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct shingles of a text the rarest, of which a text of a similarity of at least t must share some, and their places in the order of rarity; those counted once left out."""
    least = int(np.ceil(len(sh) * t - 1e-9))
    c = counts[sh & (len(counts) - 1)]
    first = np.lexsort((sh, c))[: len(sh) - least + min(NEEDED, least)]
    place = np.flatnonzero(c[first] > 1)
    return sh[first[place]], place


def rarest(sh: np.ndarray, counts: np.ndarray, t: float) -> np.ndarray:
    return placed(sh, counts, t)[0]


def needed(size_a: np.ndarray, size_b: np.ndarray, t: float) -> np.ndarray:
    """What the rarest of two sets share at least."""
    least = np.minimum(np.ceil(size_a * t - 1e-9), np.ceil(size_b * t - 1e-9))
    return np.minimum(NEEDED, least).astype(np.int64)


def met(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], t: float) -> pd.DataFrame:
    """(id_a, id_b, shared, need) over the members that rows of a and of b (member, id, size, place) have in common: how many two different sets share that stand early enough, and what they must share in all.

    A bounded number of pairs is listed at once, and what is left of them counted.
    """
    o = np.argsort(a[0], kind="stable")
    key, ia, sa, pa = (x[o] for x in a)
    _, ib, sb, pb = b
    lo = np.searchsorted(key, b[0], side="left")
    count = np.searchsorted(key, b[0], side="right") - lo
    held: list[pd.DataFrame] = []
    kept = 0
    ends = np.cumsum(count)

    def summed() -> pd.DataFrame:
        return pd.concat(held).groupby(["id_a", "id_b"], as_index=False, sort=False).agg({"shared": "sum", "need": "first"})

    r, skip = 0, 0  # row of b, and how many of its partners have been listed
    while r < len(ib):
        upto = int(np.searchsorted(ends, (ends[r - 1] if r else 0) + skip + _PAIRS, side="right"))
        if upto > r:
            j = np.repeat(np.arange(r, upto), count[r:upto])
            i = np.arange(len(j)) - np.repeat(ends[r:upto] - count[r:upto] - (ends[r - 1] if r else 0), count[r:upto]) + lo[j]
            i, j = i[skip:], j[skip:]
            r, skip = upto, 0
        else:
            n = min(_PAIRS, int(count[r]) - skip)
            i, j = np.arange(lo[r] + skip, lo[r] + skip + n), np.full(n, r)
            skip += n
            if skip == count[r]:
                r, skip = r + 1, 0
        x, y = sa[i].astype(np.float64), sb[j].astype(np.float64)
        need = needed(x, y, t)
        ok = (ia[i] != ib[j]) & (x >= t * y - 1e-9) & (y >= t * x - 1e-9)
        ok &= np.minimum(x - pa[i], y - pb[j]) >= np.ceil((x + y) * (t / (1 + t)) - 1e-9) - (need - 1)
        if ok.any():
            one = pd.DataFrame({"id_a": ia[i[ok]], "id_b": ib[j[ok]], "shared": 1, "need": need[ok]})
            held.append(one)
            kept += len(one)
            if kept > 2 * _PAIRS:
                held = [summed()]
                kept = len(held[0])
    if not held:
        return pd.DataFrame({x: np.empty(0, np.int64) for x in ("id_a", "id_b", "shared", "need")})
    return summed()
