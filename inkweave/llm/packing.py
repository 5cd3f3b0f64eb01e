"""Problem 7: filling containers of fixed capacity with whole items.

Bulk-synchronous best fit. Items are sorted by size and ranked within a size, both distributed; open containers are
kept by the gap they have left and numbered within a gap. In a round the largest items that are still unplaced sweep the
gaps for the successor of their size, the smallest gap that holds them; the rank of an item within its size is matched
with the number of a container within its gap, so no two items claim one container; what finds no gap opens new
containers; gaps are updated and the next round begins. Sizes and gaps are whole numbers no greater than the capacity,
so a sweep works on counts per size and gap, never more than capacity + 1 of either, whatever the number of items, and
each match is a run of consecutive ranks. Items meet the plan once, by a range lookup of (size, rank).

An item larger than the capacity fills containers of its own; only its last piece, smaller than the capacity, is packed
with others.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.sources.shared import parallel, store

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) for every row with an id; tokenizer is the path of a public byte-level vocabulary of ranks. Null and empty texts have 0 tokens."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(os.path.realpath(tokenizer), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [len(enc.encode_ordinary(x)) if x else 0 for x in b["text"]]})

    return rows.mapInPandas(run, "id bigint, tokens bigint")


class Plan:
    """Runs (size, first rank, length, first container): item k of a size goes to container first + k - rank, for k in the run.

    One superstep per size, from the largest: its items sweep the gaps upwards from their own size, each gap taking as
    many of them as it holds, and those that are left open new containers. That is what best fit does with the items one
    by one in falling order.
    """

    def __init__(self, capacity: int, sizes: dict[int, int]):
        self.runs: list[tuple[int, int, int, int]] = []
        self.containers = 0
        gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, length)
        order: list[int] = []
        for s in sorted((int(s) for s, n in sizes.items() if 0 < s <= capacity and n), reverse=True):
            left, rank = int(sizes[s]), 0
            while left:
                i = bisect.bisect_left(order, s)
                if i < len(order):
                    g = order[i]
                    first, n = gaps[g].pop()
                    if not gaps[g]:
                        del gaps[g], order[i]
                else:
                    g, first, n = capacity, self.containers, -(-left // (capacity // s))
                    self.containers += n
                # n containers with gap g: they are filled in turn, g // s items in each; the last ones may stay unused or get fewer
                each = g // s
                filled = min(n, left // each)
                for level in range(each if filled else 0):
                    self.runs.append((s, rank + level * filled, filled, first))
                rank, left = rank + each * filled, left - each * filled
                parts = [(g - each * s, first, filled)]
                if filled < n:
                    if left:  # fewer than one container holds
                        self.runs.extend((s, rank + k, 1, first + filled) for k in range(left))
                        parts.append((g - left * s, first + filled, 1))
                        rank, left, filled = rank + left, 0, filled + 1
                    parts.append((g, first + filled, n - filled))
                for gap, at, m in parts:
                    if gap and m:
                        if gap not in gaps:
                            gaps[gap] = []
                            bisect.insort(order, gap)
                        gaps[gap].append((at, m))


def pack(items: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(capacity_id, container, id, piece, tokens) of every item (id, tokens) for every capacity (id -> tokens).

    An item of no more than the capacity has one row, piece 0. A larger one has a row for each container it fills and one
    for the rest. Items of 0 tokens take no room and lie in container -1. Ids are taken as distinct.
    """
    spark = items.sparkSession
    caps = spark.createDataFrame([(int(k), int(c)) for k, c in capacities.items() if c and c > 0], "capacity_id int, capacity bigint")
    if not capacities or not caps.take(1):
        return spark.createDataFrame([], "capacity_id int, container bigint, id bigint, piece bigint, tokens bigint")
    each = items.crossJoin(F.broadcast(caps))  # a handful of capacities
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    full = each.where("tokens > capacity").select("capacity_id", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
    rest = each.select("capacity_id", "id", F.when(F.col("tokens") > F.col("capacity"), whole).otherwise(0).cast("bigint").alias("piece"), F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")).alias("size"), (F.col("tokens") > F.col("capacity")).alias("over"))
    rest = rest.where(~F.col("over") | (F.col("size") > 0))
    slots = max(parallel(spark) * 4, items.count() // 100_000)  # a size that a third of all items have is ranked in as many tasks
    rest = rest.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int"))
    rest = store(rest, "sizes")
    # ranks within a size without gathering the size: counts per size and slot, then a running sum over slots
    per = rest.where("size > 0").groupBy("capacity_id", "size", "slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("capacity_id", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    per = store(per.withColumn("before", F.coalesce(before, F.lit(0))), "slots")
    counts = per.groupBy("capacity_id", "size").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows for each capacity
    runs, base = [], {}
    for k, c in capacities.items():
        plan = Plan(int(c), {r["size"]: r["n"] for r in counts if r["capacity_id"] == k})
        base[k] = plan.containers
        runs.extend((int(k), *r) for r in plan.runs)
    ranked = rest.where("size > 0").withColumn("r", F.row_number().over(W.partitionBy("capacity_id", "size", "slot").orderBy("id", "piece")) - 1)
    ranked = ranked.join(per.select("capacity_id", "size", "slot", "before"), ["capacity_id", "size", "slot"]).withColumn("r", F.col("r") + F.col("before"))
    # the runs of one size lie in order of rank: one sorted list per size, searched by rank
    table = pd.DataFrame(runs, columns=["capacity_id", "size", "rank", "n", "first"]).sort_values(["capacity_id", "size", "rank"])
    lists = table.groupby(["capacity_id", "size"]).agg({"rank": list, "first": list}).reset_index()
    schema = "capacity_id int, container bigint, id bigint, piece bigint, tokens bigint"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = {(k, s): (np.asarray(r), np.asarray(f)) for k, s, r, f in plan_rows.value}
        for b in batches:
            out = np.empty(len(b), dtype=np.int64)
            for (k, s), at in b.groupby(["capacity_id", "size"]).indices.items():
                ranks, firsts = look[k, s]
                r = b["r"].to_numpy()[at]
                i = np.searchsorted(ranks, r, side="right") - 1
                out[at] = firsts[i] + r - ranks[i]
            yield pd.DataFrame({"capacity_id": b["capacity_id"], "container": out, "id": b["id"], "piece": b["piece"], "tokens": b["size"]})

    plan_rows = spark.sparkContext.broadcast([(int(a), int(b), np.array(c), np.array(f)) for a, b, c, f in lists.itertuples(index=False)])
    placed = ranked.select("capacity_id", "size", "id", "piece", "r").mapInPandas(place, schema)
    none = rest.where("size = 0").select("capacity_id", F.lit(-1).cast("bigint").alias("container"), "id", "piece", F.col("size").alias("tokens"))
    # full containers are numbered after the packed ones, in order of slot and item
    starts = spark.createDataFrame([(int(k), int(v)) for k, v in base.items()], "capacity_id int, base bigint")
    full = full.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int"))
    n_full = full.groupBy("capacity_id", "slot").agg(F.count("*").alias("n"))
    n_full = n_full.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("capacity_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    r_full = F.row_number().over(W.partitionBy("capacity_id", "slot").orderBy("id", "piece")) - 1
    full = full.withColumn("r", r_full).join(F.broadcast(n_full.select("capacity_id", "slot", "before")), ["capacity_id", "slot"]).join(F.broadcast(starts), "capacity_id")
    full = full.select("capacity_id", (F.col("base") + F.col("before") + F.col("r")).alias("container"), "id", "piece", F.col("capacity").alias("tokens"))
    return placed.unionByName(none).unionByName(full)


def packed_texts(docs: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack for the texts of docs (doc_id, text) and the rows of capacities (capacity_id, max_tokens), a table of a few rows."""
    caps = {r["capacity_id"]: r["max_tokens"] for r in capacities.where("capacity_id IS NOT NULL AND max_tokens > 0").limit(1000).collect()}
    counts = store(token_counts(docs, tokenizer=tokenizer), "tokens")
    return pack(counts, caps).withColumnRenamed("id", "doc_id")


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: items, containers, tokens and the share of room that is left over."""
    used = packed.where("container >= 0").groupBy("capacity_id", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    total = used.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    caps = capacities.select("capacity_id", "max_tokens").dropDuplicates(["capacity_id"])  # a few rows
    return total.join(F.broadcast(caps), "capacity_id").withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("max_tokens")))
