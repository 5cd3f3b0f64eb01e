"""Problem 5: occurrences and record counts of every term and n-gram, from suffix arrays.

Records are spread over shards by a hash of their id, so a record lies whole in one shard. Each shard concatenates the
term numbers of its records, with a stop after each, and sorts its suffixes by doubling. Equal prefixes of length k then
lie side by side: the common prefixes of neighbours cut the array into intervals, one per k-gram, whose length is the
number of occurrences. With the suffixes of an interval in order of position, hence of record, the number of records is
that length less the neighbours of one record. Both counts add up over shards, so what is shuffled is one row per
k-gram and shard, however often a hot term occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.words import words
from inkweave.sources.shared import store


def suffix_ranks(tokens: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each k = 1..depth, the rank of every suffix by its first k tokens. A stop is -1 and equals no other stop."""
    m = len(tokens)
    stops = tokens < 0
    base = tokens.astype(np.int64).copy()
    base[stops] = base.max(initial=0) + 1 + np.arange(stops.sum())
    ranks = [np.unique(base, return_inverse=True)[1].astype(np.int64)]
    for k in range(2, depth + 1):
        # the first k tokens are the first h and, from one place further, the first k - h; both are ranked already
        h = 1 << ((k - 1).bit_length() - 1)
        head, tail = ranks[h - 1], ranks[k - h - 1]
        second = np.full(m, -1, dtype=np.int64)
        second[: m - h] = tail[h:]
        ranks.append(np.unique(head * (m + 2) + second + 1, return_inverse=True)[1].astype(np.int64))
    return ranks


def intervals(tokens: np.ndarray, record: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, a position of each k-gram, occurrences, records) for k = 1..depth; k-grams across a stop are left out."""
    m = len(tokens)
    if not m:
        return
    left = np.zeros(m, dtype=np.int64)  # tokens before the next stop
    at = np.flatnonzero(tokens < 0)
    nxt = np.concatenate([at, [m]])[np.searchsorted(at, np.arange(m))]
    left = nxt - np.arange(m)
    for k, rank in enumerate(suffix_ranks(tokens, depth), 1):
        sa = np.argsort(rank, kind="stable")
        sa = sa[left[sa] >= k]
        if not len(sa):
            return
        r = rank[sa]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))  # where the common prefix with the one before is shorter than k
        same = np.concatenate([[False], (r[1:] == r[:-1]) & (record[sa[1:]] == record[sa[:-1]])])
        occurrences = np.diff(np.concatenate([starts, [len(sa)]]))
        yield k, sa[starts], occurrences, occurrences - np.add.reduceat(same.astype(np.int64), starts)


def _shard(b: pd.DataFrame, depth: int) -> pd.DataFrame:
    numbers: dict[str, int] = {}
    tokens: list[int] = []
    lengths: list[int] = []
    for t in b["text"]:
        w = words(t)
        tokens.extend([numbers.setdefault(x, len(numbers)) for x in w])
        tokens.append(-1)
        lengths.append(len(w) + 1)
    held = sum(x > 1 for x in lengths)
    tok = np.array(tokens, dtype=np.int64)
    rec = np.repeat(np.arange(len(lengths)), lengths)
    names = np.array(list(numbers), dtype=object)
    out = [pd.DataFrame({"n": [0], "term": [""], "occurrences": [0], "records": [held]})]
    for k, first, occ, df in intervals(tok, rec, depth):
        terms = names[tok[first]]
        for i in range(1, k):
            terms = terms + " " + names[tok[first + i]]
        out.append(pd.DataFrame({"n": k, "term": terms, "occurrences": occ, "records": df}))
    return pd.concat(out)


def counts(df: DataFrame, id_col: str = "id", text: str = "abstract", depth: int = 1, shard_chars: int = 6_000_000) -> DataFrame:
    """(n, term, occurrences, records) of every n-gram of up to depth terms; the row n = 0, term '' has the number of records with at least one term.

    Each id counts once; null ids don't count, null and empty texts hold no term. An id delivered with several texts counts with one of them.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    shards = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars))
    spread = rows.repartition(shards, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [x for x in batches if len(x)]
        if whole:
            # rows of one id always meet in one partition
            yield _shard(pd.concat(whole).drop_duplicates("id"), depth)

    return spread.mapInPandas(run, "n int, term string, occurrences bigint, records bigint").groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(df: DataFrame, id_col: str = "id", text: str = "abstract", depth: int = 1, fewest: int = 4, share: tuple[int, int] = (1, 5)) -> DataFrame:
    """counts with mark: `rare` below `fewest` occurrences, `common` in more than share of the records with a term, else null."""
    all_counts = store(counts(df, id_col, text, depth), "terms")
    total = all_counts.where("n = 0").select(F.col("records").alias("total"))
    mark = F.when(F.col("occurrences") < fewest, "rare").when(F.col("records") * share[1] > F.col("total") * share[0], "common")
    return all_counts.where("n > 0").crossJoin(F.broadcast(total)).withColumn("mark", mark)  # total has one row


def vocabulary(df: DataFrame, vocab: DataFrame, id_col: str = "id", text: str = "abstract") -> DataFrame:
    """(word, word_idx, occurrences, records, mark) of every row of vocab; 0 and `rare` for words that never occur."""
    found = marked(df, id_col, text).where("n = 1").select(F.col("term").alias("word"), "occurrences", "records", "mark")
    out = vocab.select(F.lower("word").alias("word"), "word_idx").join(found, "word", "left")
    return out.select("word", "word_idx", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"), F.when(F.col("occurrences").isNull(), "rare").otherwise(F.col("mark")).alias("mark"))
