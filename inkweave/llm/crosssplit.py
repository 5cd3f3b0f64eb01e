"""Problem 4: evaluation records that also appear, exactly or almost, in the training split.

The passages of an evaluation text are its runs of three words. They are sharded into Aho-Corasick automata, which scan the
training texts; the matched intervals are merged into the coverage of each evaluation text. Two sets with a similarity of
at least t share at least t of either, so if each is cut down to its rarest passages, as many as exceed the rest by m, what
is left of them still shares m (see rare): no link is lost by patterns and scans of those alone. Rarity follows counts in a
sketch of bounded size, which never counts too few; a passage counted once stands in no other text and stays out. What has m
matches is verified on the whole sets, which are made anew from the texts of what passes.

Texts with equal sets form one class and are scanned once. A pair of papers is then looked up by the classes of its ends
and of what they are linked to. Only the rare passages of a text travel, each once, to the shard it belongs to, so what is
sent does not grow with the number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm import rare
from inkweave.llm.neardup import _members, verified
from inkweave.llm.rare import rarest  # noqa: F401
from inkweave.llm.words import Hasher, shingles, words
from inkweave.sources.shared import parallel, store, tidy

_CHARS = 24  # of a passage, about

def _found(reps: DataFrame, sketch: np.ndarray, n: int, t: float, shards: int) -> DataFrame:
    """(id_a, id_b) of evaluation and training texts of reps (id, size, text, evaluated, trained) that share as many of their rare passages as a similarity of t asks for.

    Of a text only its rare passages are sent, each to the one shard it belongs to, and there the automaton of those of the
    evaluation texts scans those of the training texts.
    """
    sent = rare.Sent(reps.sparkSession, sketch)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, counts = Hasher(), sent.read()
        for b in batches:
            held: dict[int, list] = {}
            for i, size, text, e, tr in zip(b["id"], b["size"], b["text"], b["evaluated"], b["trained"]):
                w = words(text)
                sh, first = np.unique(shingles(hasher(w), n), return_index=True)
                sh = sh.view(np.int64)
                o = np.argsort(sh, kind="stable")  # in the order of signed numbers
                h, place = rare.placed(sh, counts, t)
                begin = first[o][np.searchsorted(sh[o], h)]
                for k, p, x in zip((h % shards).tolist(), place.tolist(), begin.tolist()):
                    held.setdefault(k, []).append((i, size, e + 2 * tr, p, f" {' '.join(w[x : x + n])} "))
            if held:
                rows = [(k, *(np.array([r[c] for r in v], d).tobytes() for c, d in enumerate((np.int64, np.int32, np.uint8, np.int32))), "\n".join(r[4] for r in v)) for k, v in held.items()]
                yield pd.DataFrame(rows, columns=["shard", "ids", "sizes", "roles", "places", "passages"])

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        ids, size, role, place = (np.frombuffer(b"".join(g[c]), d) for c, d in (("ids", np.int64), ("sizes", np.int32), ("roles", np.uint8), ("places", np.int32)))
        passages = "\n".join(g["passages"]).split("\n")
        auto, member, number = ahocorasick.Automaton(), np.full(len(ids), -1), {}
        asked = np.flatnonzero(role & 1)
        for i in asked.tolist():
            member[i] = k = number.setdefault(passages[i], len(number))
            if k == len(number) - 1:
                auto.add_word(passages[i], k)
        trained = np.flatnonzero(role & 2)
        if not len(asked) or not len(trained):
            return pd.DataFrame({x: np.empty(0, np.int64) for x in ("id_a", "id_b", "shared", "need")})
        auto.make_automaton()
        mine = [passages[i] for i in trained.tolist()]
        ends = np.cumsum([len(x) + 1 for x in mine]) - 2  # where the last sign of each stands
        hits = np.array(list(auto.iter("\n".join(mine))), np.int64).reshape(-1, 2)  # a passage holds no other of as many words
        at = trained[np.searchsorted(ends, hits[:, 0])]
        return rare.met((member[asked], ids[asked], size[asked], place[asked]), (hits[:, 1], ids[at], size[at], place[at]), t)

    rows = reps.mapInPandas(routed, "shard int, ids binary, sizes binary, roles binary, places binary, passages string")
    pairs = rows.repartition(shards, "shard").groupBy("shard").applyInPandas(scan, "id_a bigint, id_b bigint, shared bigint, need bigint")
    return pairs.groupBy("id_a", "id_b").agg(F.sum("shared").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("id_a", "id_b")


def text_links(texts: DataFrame, evaluated: DataFrame, trained: DataFrame, n: int = 3, t: float = 0.5, shard_patterns: int = 400_000, shard_chars: int = 48_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (rep, id, copies), links (id_a evaluation class, id_b training class, similarity) and representatives (id, size, text, evaluated, trained) of texts (id, text).

    evaluated and trained have a column id. Equal classes are not linked to themselves.
    """
    spark = texts.sparkSession
    recs, sketch = rare.read(texts, n)
    recs = store(recs.groupBy("id").agg(F.min(F.struct("text_hash", "key", "size")).alias("r")).select("id", "r.*"), "texts")  # of two texts under one id, one is taken
    members = store(_members(recs), "members")
    of = lambda ids: members.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("rep").alias("id")).distinct()
    roles = of(evaluated).withColumn("e", F.lit(True)).join(of(trained).withColumn("t", F.lit(True)), "id", "full")
    roles = roles.select("id", F.coalesce("e", F.lit(False)).alias("evaluated"), F.coalesce("t", F.lit(False)).alias("trained"))
    reps = store(rare.texts_of(texts, recs.join(roles, "id").select("id", "text_hash", "size", "evaluated", "trained")), "reps")
    tidy(spark)
    total = (reps.agg(F.sum("size")).first()[0] or 0) * (1 - t)
    shards = int(min(8192, max(parallel(spark), -(-total // shard_patterns), -(-total * _CHARS // shard_chars))))
    found = store(_found(reps, sketch, n, t, shards), "found")
    tidy(spark)
    used = found.select(F.col("id_a").alias("id")).union(found.select("id_b")).distinct()
    sets = store(rare.with_sets(reps.join(used, "id", "left_semi"), n), "sets")
    links = store(verified(found, sets, t), "links")
    tidy(spark)
    return members, links, reps


def overlaps(pairs: DataFrame, texts: DataFrame, n: int = 3, t: float = 0.5) -> DataFrame:
    """(train_id, eval_id, split, source): every dev or test row of pairs with every train row whose ends agree in either order.

    Ends agree if they are the same id or ids linked by the similarity of their texts. Rows with a null pair_id or end are
    no case; a pair_id delivered again counts once; split, source and y of the evaluation row are passed on, null as null.
    """
    rows = pairs.where("pair_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND split IN ('train', 'dev', 'test')").select("pair_id", "split", "u", "v", "source").dropDuplicates(["pair_id"])
    rows = store(rows, "pairs")
    ends = lambda df: df.select(F.col("u").alias("id")).union(df.select("v")).distinct()
    members, links, _ = text_links(texts, ends(rows.where("split <> 'train'")), ends(rows.where("split = 'train'")), n, t)
    rep = members.select("id", "rep")
    keyed = rows.join(rep.select(F.col("id").alias("u"), F.col("rep").alias("ru")), "u", "left").join(rep.select(F.col("id").alias("v"), F.col("rep").alias("rv")), "v", "left")
    keyed = store(keyed.select("pair_id", "split", "source", F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b")), "keyed")
    # each class with itself and the classes it is linked to
    ev = keyed.where("split <> 'train'")
    own = ev.select(F.col("a").alias("x")).union(ev.select("b")).distinct().select("x", F.col("x").alias("y"))
    near = own.union(links.select("id_a", "id_b"))
    wide = ev.join(near.toDF("a", "a2"), "a").join(near.toDF("b", "b2"), "b")
    wide = wide.select(F.col("pair_id").alias("eval_id"), "split", "source", F.least("a2", "b2").alias("lo"), F.greatest("a2", "b2").alias("hi")).distinct()
    train = keyed.where("split = 'train'").select(F.col("pair_id").alias("train_id"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return train.join(wide, ["lo", "hi"]).select("train_id", "eval_id", "split", "source").distinct()


def report(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Per split and source: evaluation rows, those that overlap the training split, and the pairs of rows that do."""
    rows = pairs.where("pair_id IS NOT NULL AND split IN ('dev', 'test')").select("pair_id", "split", "source").dropDuplicates(["pair_id"])
    hit = overlaps(pairs, texts).groupBy(F.col("eval_id").alias("pair_id")).agg(F.count("*").alias("pairs"))
    return rows.join(hit, "pair_id", "left").groupBy("split", "source").agg(F.count("*").alias("rows"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def coverage(pairs: DataFrame, texts: DataFrame, n: int = 3, t: float = 0.5) -> DataFrame:
    """(id, copied, words, covered) of every paper at an end of a dev or test row whose text has n words: its number of words, and how many of them lie in runs of n words that also stand in a training paper's text linked to it by similarity; all, and copied, where another training paper's text has an equal set."""
    rows = store(pairs.where("pair_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND split IN ('train', 'dev', 'test')").select("split", "u", "v"), "ends")
    ends = lambda df: df.select(F.col("u").alias("id")).union(df.select("v")).distinct()
    asked, trained = ends(rows.where("split <> 'train'")), ends(rows.where("split = 'train'"))
    members, links, reps = text_links(texts, asked, trained, n, t)
    linked = links.select(F.col("id_a").alias("id")).union(links.select("id_b")).distinct()
    sets = rare.with_sets(reps.join(linked, "id", "left_semi"), n)
    both = links.select("id_a", "id_b").join(sets.toDF("id_a", "sa"), "id_a").join(sets.toDF("id_b", "sb"), "id_b")
    shared = both.select("id_a", F.explode(F.array_intersect("sa", "sb")).alias("h")).distinct().groupBy("id_a").agg(F.collect_list("h").alias("h"))  # of one text at most
    own = reps.where("evaluated").select("id", "text").join(shared.withColumnRenamed("id_a", "id"), "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            out = []
            for i, text, h in zip(b["id"], b["text"], b["h"]):
                w = words(text)
                begin = np.isin(shingles(hasher(w), n).view(np.int64), h) if h is not None else np.zeros(0, bool)
                inside = np.zeros(len(w), bool)
                for k in range(n):
                    inside[k : k + len(begin)] |= begin
                out.append((i, len(w), int(inside.sum())))
            if out:
                yield pd.DataFrame(out, columns=["rep", "words", "covered"])

    merged = own.mapInPandas(run, "rep bigint, words bigint, covered bigint")
    in_train = members.join(trained.withColumn("trained", F.lit(1)), "id", "left").withColumn("trained", F.coalesce("trained", F.lit(0)))
    others = in_train.groupBy("rep").agg(F.sum("trained").alias("all"))
    each = in_train.join(asked, "id", "left_semi").join(others, "rep").withColumn("copied", F.col("all") - F.col("trained") > 0).join(merged, "rep")
    return each.select("id", "copied", "words", F.when(F.col("copied"), F.col("words")).otherwise(F.col("covered")).alias("covered"))
