"""Problem 6: near-duplicate records, by tiled exact comparison of bit signatures.

A text's set of word shingles toggles one bit per shingle in a signature, so the Hamming distance of two signatures
never exceeds the size of the sets' symmetric difference, and a Jaccard similarity of at least t bounds that by
(a + b)(1 - t)/(1 + t). Records are sorted by population (number of shingles) and cut into strips; every cell of two
strips is compared tile by tile with numpy exclusive-or and bit counts, tile pairs whose populations differ beyond the
radius being skipped. Nothing within the bound is lost; what passes is verified on the sets themselves.

Records with equal sets form a class, which is compared once. A signature has some three bits or more for each shingle,
however many there are, so unrelated sets of any size are told apart; a strip holds records of one width, and where two
widths meet the wider is folded (halves combined by exclusive-or, which keeps the bound).

That work grows with the square of the number of distinct classes, about 10 ns a pair and core, so beyond WHOLE classes the
signatures are compared only of those pairs that share as many of their rarest shingles as the similarity asks for (see
rare): every other pair is known to be unlike. What is kept in between are signatures and pairs; sets are made anew from
the texts of what passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm import rare
from inkweave.llm.groups import slotted, within
from inkweave.llm.words import Hasher, shingles, words
from inkweave.sources.shared import parallel, store, tidy

_TILE_A, _TILE_B = 128, 2048
_STRIP_BYTES = 32 << 20
MOST_STRIPS = 1_000_000
WHOLE = 8_192  # classes up to which all pairs of tiles are compared
_SHARD = 1_000_000


def _width(size: int) -> int:
    """64-bit words such that unrelated sets of this size are told apart."""
    w = 4
    while w * 64 < 3.2 * size:
        w *= 2
    return w


def signature(sh: np.ndarray) -> np.ndarray:
    """The 64-bit words of the signature of distinct 64-bit shingles."""
    bits = 64 * _width(len(sh))
    return np.packbits((np.bincount((sh >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def signatures(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(id, key, size, sh, bits): digest, number and hashes of the distinct shingles of n words, and the signature.

    Texts of fewer than n words, null texts and null ids have no row. An id delivered again with the same text has equal rows.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            out: dict[str, list] = {"id": [], "key": [], "size": [], "sh": [], "bits": []}
            for i, t in zip(b["id"], b["text"]):
                sh = np.unique(shingles(hasher(words(t)), n))
                if len(sh) == 0:
                    continue
                raw = sh.tobytes()
                out["id"].append(i)
                out["key"].append(hashlib.blake2b(raw, digest_size=16).digest())
                out["size"].append(len(sh))
                out["sh"].append(sh.view(np.int64))
                out["bits"].append(signature(sh).tobytes())
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, "id bigint, key binary, size int, sh array<bigint>, bits binary")


def fold(bits: np.ndarray, to: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) folded to `to` words."""
    while bits.shape[1] > to:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def compare(a_size: np.ndarray, a_bits: np.ndarray, b_size: np.ndarray, b_bits: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with signature distance within the bound of similarity t; both sides sorted by size. same: j > i only."""
    ratio = (1 - t) / (1 + t)
    full = min(a_bits.shape[1], b_bits.shape[1])
    levels = [w for w in (full // 8, full // 4, full // 2, full) if w >= min(4, full)]
    counter = np.int16 if 64 * full < 1 << 15 else np.int32
    folded = {w: (np.ascontiguousarray(fold(a_bits, w).T), np.ascontiguousarray(fold(b_bits, w).T)) for w in levels}
    found_i, found_j = [], []
    for i0 in range(0, len(a_size), _TILE_A):
        sa = a_size[i0 : i0 + _TILE_A]
        for j0 in range((i0 // _TILE_B) * _TILE_B if same else 0, len(b_size), _TILE_B):
            sb = b_size[j0 : j0 + _TILE_B]
            if sb[0] * t > sa[-1] or sa[0] * t > sb[-1]:
                continue
            bound = np.minimum((sa[:, None].astype(np.int64) + sb[None, :]) * ratio + 1e-9, 64 * full).astype(counter)  # no distance is beyond the width
            keep = None
            for w in levels:
                va, vb = folded[w]
                if keep is None or len(keep[0]) > sa.size * sb.size // 50:
                    d = np.zeros((len(sa), len(sb)), counter)
                    for k in range(w):
                        d += np.bitwise_count(va[k, i0 : i0 + _TILE_A, None] ^ vb[k, None, j0 : j0 + _TILE_B])
                    keep = np.nonzero(d <= bound)
                else:
                    p, q = keep
                    d = np.bitwise_count(va[:, i0 + p] ^ vb[:, j0 + q]).sum(axis=0, dtype=np.int32)
                    ok = d <= bound[p, q]
                    keep = p[ok], q[ok]
                if len(keep[0]) == 0:
                    break
            p, q = keep[0] + i0, keep[1] + j0
            ok = (np.minimum(a_size[p], b_size[q]) >= t * np.maximum(a_size[p], b_size[q]) - 1e-9) & ((q > p) if same else True)
            found_i.append(p[ok])
            found_j.append(q[ok])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _strips(reps: DataFrame, parts: int, rows: int) -> DataFrame:
    """One row per strip: up to `rows` records of similar population and one width of signature, sorted."""

    def packed(part: int, k: int, width: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        c = pd.concat(held)
        return pd.DataFrame({"part": [part], "k": [k], "width": [width], "least": [int(c["size"].iloc[0])], "most": [int(c["size"].iloc[-1])], "ids": [c["id"].to_numpy(np.int64).tobytes()], "sizes": [c["size"].to_numpy(np.int32).tobytes()], "bits": [b"".join(c["bits"])]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, held, n, width = TaskContext.get().partitionId(), 0, [], 0, 0
        for b in batches:
            at = 0
            wide = b["bits"].map(len).to_numpy() // 8
            while at < len(b):
                top = max(1, min(rows, _STRIP_BYTES // (8 * int(wide[at]))))
                if n and (n >= top or wide[at] != width):
                    yield packed(part, k, width, held)
                    k, held, n = k + 1, [], 0
                width = int(wide[at])
                upto = min(at + top - n, int(np.searchsorted(wide, width, side="right")))
                held.append(b.iloc[at:upto])
                n, at = n + upto - at, upto
        if n:
            yield packed(part, k, width, held)

    schema = "part int, k int, width int, least int, most int, ids binary, sizes binary, bits binary"
    return reps.repartitionByRange(parts, "size", "id").sortWithinPartitions("size", "id").mapInPandas(run, schema)


def candidates(reps: DataFrame, t: float, strip_rows: int = 6_000) -> DataFrame:
    """(id_a, id_b) of records of reps (id, size, bits) whose signatures lie within the bound of similarity t."""
    spark = reps.sparkSession
    n = reps.count()
    schema = "id_a bigint, id_b bigint"
    if n == 0:
        return spark.createDataFrame([], schema)
    rows = min(32_768, max(strip_rows, n // 40))
    strips = store(_strips(reps, max(1, -(-n // rows)), rows), "strips")
    meta = strips.select("part", "k", "least", "most").orderBy("part", "k").limit(MOST_STRIPS + 1).toPandas()  # one row per strip
    if len(meta) > MOST_STRIPS:
        raise ValueError(f"more than {MOST_STRIPS} strips are too many to be compared in pairs")
    # strips are in order of population, so those that one meets are neighbours of it
    place = np.arange(len(meta))
    upto = np.searchsorted(meta["least"].to_numpy() * t, meta["most"].to_numpy(), side="right") - 1
    from_ = np.searchsorted(np.maximum.accumulate(meta["most"].to_numpy()), meta["least"].to_numpy() * t, side="left")
    grid = spark.createDataFrame(meta[["part", "k"]].assign(strip=place, lo=np.minimum(from_, place), hi=np.maximum(upto, place)))
    tasks = int((np.maximum(upto, place) - place + 1).sum())

    def run(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("strip")
        side = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.sizes, np.int32), np.frombuffer(r.bits, np.uint64).reshape(len(r.ids) // 8, -1)) for r in c.itertuples()]
        a, b = side[0], side[-1]
        i, j = compare(a[1], a[2], b[1], b[2], t, len(side) == 1) if len(side) > 1 or c["own"].iloc[0] else (np.empty(0, int), np.empty(0, int))
        return pd.DataFrame({"id_a": np.minimum(a[0][i], b[0][j]), "id_b": np.maximum(a[0][i], b[0][j])})

    # cell (a, b), a <= b: a strip is sent to those with the strips after it and before it; each cell is one task of its own size
    sent = strips.join(F.broadcast(grid), ["part", "k"])  # at most MOST_STRIPS rows of numbers
    sent = sent.withColumn("other", F.explode(F.sequence("lo", "hi"))).select(F.least("strip", "other").alias("a"), F.greatest("strip", "other").alias("b"), "strip", (F.col("strip") == F.col("other")).alias("own"), "ids", "sizes", "bits")
    return sent.repartition(min(tasks, 4096), "a", "b").groupBy("a", "b").applyInPandas(run, schema)


def verified(found: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Pairs of found (id_a, id_b) whose sets of sets (id, sh) have a similarity of at least t, with it."""
    used = found.selectExpr("id_a AS id").union(found.selectExpr("id_b AS id")).distinct()
    sets = sets.join(used, "id", "left_semi").select("id", "sh")
    a = sets.select(F.col("id").alias("id_a"), F.col("sh").alias("sh_a"))
    b = sets.select(F.col("id").alias("id_b"), F.col("sh").alias("sh_b"))
    both = found.join(a, "id_a").join(b, "id_b").withColumn("common", F.size(F.array_intersect("sh_a", "sh_b")))
    sim = F.col("common") / (F.size("sh_a") + F.size("sh_b") - F.col("common"))
    return both.withColumn("similarity", sim.cast("double")).where(F.col("similarity") >= t).select("id_a", "id_b", "similarity")


def _close(rows: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """Pairs (id_a, id_b) of rows whose signatures of reps (id, size, bits) lie within the bound of similarity t."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, c = b["bits_a"].map(len).to_numpy(), b["bits_b"].map(len).to_numpy()
            bound, ok = (b["size_a"].to_numpy(np.int64) + b["size_b"].to_numpy()) * ((1 - t) / (1 + t)) + 1e-9, np.zeros(len(b), bool)
            for wide, narrow in np.unique(np.stack([a, c], 1), axis=0):
                at = np.flatnonzero((a == wide) & (c == narrow))
                x, y = (np.frombuffer(b"".join(b[s].iloc[at]), np.uint64).reshape(len(at), -1) for s in ("bits_a", "bits_b"))
                least = min(x.shape[1], y.shape[1])
                ok[at] = np.bitwise_count(fold(x, least) ^ fold(y, least)).sum(axis=1, dtype=np.int64) <= bound[at]
            yield b.loc[ok, ["id_a", "id_b"]]

    end = lambda e: reps.select(F.col("id").alias(f"id_{e}"), F.col("size").alias(f"size_{e}"), F.col("bits").alias(f"bits_{e}"))
    return rows.join(end("a"), "id_a").join(end("b"), "id_b").mapInPandas(run, "id_a bigint, id_b bigint")


def met(texts: DataFrame, sketch: np.ndarray, n: int, t: float, total: int) -> DataFrame:
    """(id_a, id_b) of texts (id, text), total shingles in all, that share as many of their rarest shingles as a similarity of t asks for."""
    spark = texts.sparkSession
    sent = rare.Sent(spark, sketch)
    shards = int(min(8192, max(parallel(spark), -(-total // _SHARD))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, counts = Hasher(), sent.read()
        for b in batches:
            got = [rare.placed(np.unique(shingles(hasher(words(x)), n)).view(np.int64), counts, t) for x in b["text"]]
            h = np.concatenate([g[0] for g in got]) if len(got) else np.empty(0, np.int64)
            if not len(h):
                continue
            k = [len(g[0]) for g in got]
            at = h % shards
            o = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[o], np.arange(shards + 1))
            ids, size = np.repeat(b["id"].to_numpy(np.int64), k)[o], np.repeat(b["size"].to_numpy(np.int32), k)[o]
            h, place = h[o], np.concatenate([g[1] for g in got]).astype(np.int32)[o]
            own = np.flatnonzero(np.diff(ends))
            part = lambda x: [x[ends[i] : ends[i + 1]].tobytes() for i in own]
            yield pd.DataFrame({"shard": own, "h": part(h), "ids": part(ids), "sizes": part(size), "places": part(place)})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        side = tuple(np.frombuffer(b"".join(g[c]), d) for c, d in (("h", np.int64), ("ids", np.int64), ("sizes", np.int32), ("places", np.int32)))
        found = rare.met(side, side, t)
        return found[found["id_a"] < found["id_b"]]

    rows = texts.select("id", "size", "text").mapInPandas(cut, "shard int, h binary, ids binary, sizes binary, places binary")
    pairs = rows.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "id_a bigint, id_b bigint, shared bigint, need bigint")
    return pairs.groupBy("id_a", "id_b").agg(F.sum("shared").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("id_a", "id_b")


def classes(df: DataFrame, id_col: str, text: str, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """Members (rep, id, copies) of every class of equal shingle sets, and the links (id_a, id_b, similarity) between representatives."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    recs, counts = rare.read(texts, n, signature)
    members = store(_members(recs), "members")
    heads = members.where("id = rep").select("id")
    reps = store(recs.join(heads, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("text_hash", "size", "bits"), "text_hash").alias("r")).select("id", "r.*"), "reps")
    tidy(spark)
    found, total = reps.agg(F.count("*"), F.sum("size")).first()
    if found <= WHOLE:
        pairs = candidates(reps, t)
    else:
        pairs = _close(store(met(rare.texts_of(texts, reps.select("id", "text_hash", "size")), counts, n, t, total), "met"), reps, t)
    pairs = store(pairs, "candidates")
    tidy(spark)
    used = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct()
    sets = store(rare.with_sets(rare.texts_of(texts, reps.select("id", "text_hash").join(used, "id", "left_semi")), n), "sets")
    tidy(spark)
    links = store(verified(pairs, sets, t), "links")
    return members, links


def _members(recs: DataFrame) -> DataFrame:
    """(rep, id, copies): rep is the smallest id of the class, by an aggregate that combines before the shuffle."""
    ids = recs.select("id", "key").distinct()
    heads = ids.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return ids.join(heads, "key").select("rep", "id", "copies")


def near_duplicates(df: DataFrame, id_col: str = "id", text: str = "abstract", n: int = 3, t: float = 0.5, expand: int | None = None) -> DataFrame:
    """Linked pairs (id_a, id_b), id_a < id_b, of different ids with similarity of at least t.

    Classes of equal sets are expanded into all their pairs, and all members carry the links to other classes; large classes in
    parts that meet pairwise. Where `expand` is given, a class of more than that many records is given as links from its
    representative to each member, and only the representative carries links to other classes. Null ids, null texts and
    texts of fewer than n words are in no pair.
    """
    members, links = classes(df, id_col, text, n, t)
    few = F.lit(True) if expand is None else F.col("copies") <= expand
    shown = slotted(members.where(few | (F.col("id") == F.col("rep"))).select("rep", "id"), "rep", "id")
    slots = shown.groupBy("rep").agg(F.first("slots").alias("slots"))
    part = lambda end: slots.select(F.col("rep").alias(end), F.explode(F.expr("sequence(0, slots - 1)")).alias(f"slot_{end}"))
    held = lambda end, name: shown.select(F.col("rep").alias(end), F.col("slot").alias(f"slot_{end}"), F.col("id").alias(name))
    cells = links.join(part("id_a"), "id_a").join(part("id_b"), "id_b")
    across = cells.join(held("id_a", "x"), ["id_a", "slot_id_a"]).join(held("id_b", "y"), ["id_b", "slot_id_b"]).select("x", "y")
    inner = within(members.where("copies > 1").where(few).select("rep", "id"), "rep", "id").select("a", "b")
    star = members.where(~few & (F.col("id") != F.col("rep"))).selectExpr("rep AS x", "id AS y")
    return across.union(inner).union(star).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(df: DataFrame, id_col: str = "id", text: str = "abstract", n: int = 5, t: float = 0.8) -> DataFrame:
    """One row per id with enough words: class_id (smallest id with an equal set), group_id (smallest id of the linked component) and links of its class to other classes."""
    from inkweave.llm.groups import components

    members, links = classes(df, id_col, text, n, t)
    comp = components(links.select("id_a", "id_b"))
    ends = links.select(F.col("id_a").alias("rep")).union(links.select("id_b")).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(ends, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
