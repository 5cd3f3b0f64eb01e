"""Problem 8: documents that hold passages of evaluation texts, by latent semantic retrieval.

Texts are brought to their consistent form (lookalike), and cut into words. Every document is covered by aligned windows
of `span` words, every evaluation passage by the windows at all its offsets, so a run of 2 * span - 1 words that both
share contains a document window equal to a passage window. As punctuation and spacing don't matter, numbers typed with
separators (4,108) are also read as one word, on both sides. Windows are TF-IDF vectors over the words of the evaluation
texts, which are few and do not grow; document frequencies and a randomised SVD are computed from the windows of all
documents, as sums over partitions. Both kinds of window are projected into the latent space; passage windows are
gathered in cells around centres, a document window is compared with those of the cells nearest to it, and pairs of high
cosine are candidates. Around each the longest common run of words is measured.
Edited passages (`paraphrases`) are sought without retrieval, by the words each document has in common with each passage.

Everything sent to the executors belongs to the evaluation side or is a matrix of its words by `rank`; its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.lookalike import Former, tables
from inkweave.llm.words import words
from inkweave.sources.shared import store

MOST_PASSAGE_WORDS = 5_000_000
_GAP = 64


class Passages(NamedTuple):
    """The evaluation side: word numbers, and all passages in one row of numbers, with gaps of -2 between; a passage whose numbers have separators is there in both readings."""

    vocab: dict[str, int]
    tokens: np.ndarray
    item: np.ndarray  # row of the passage at each place
    items: list
    weight: np.ndarray  # words as typed that each place stands for


def _merged(found: list[str]) -> tuple[list[str], list[int]]:
    """words with those of three digits joined to the number before them, and how many words each stands for."""
    out: list[str] = []
    weight: list[int] = []
    for w in found:
        if len(w) == 3 and w.isdecimal() and out and out[-1].isdecimal():
            out[-1] += w
            weight[-1] += 1
        else:
            out.append(w)
            weight.append(1)
    return out, weight


def _passages(evals: DataFrame, form: Former, readings: int = 1) -> Passages:
    rows = evals.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").dropDuplicates(["item_id"])
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 6 * MOST_PASSAGE_WORDS:
        raise ValueError(f"evaluation texts of {size} characters are too many to hold on every executor; run them in parts")
    vocab: dict[str, int] = {}
    tokens, item, weight, items = [np.full(_GAP, -2, dtype=np.int32)], [np.full(_GAP, -1, dtype=np.int32)], [np.zeros(_GAP, np.int64)], []
    for item_id, text in sorted((r["item_id"], r["text"]) for r in rows.collect()):
        typed = words(form(text)[0])
        joined, counts = _merged(typed)
        for ws, n in [(typed, [1] * len(typed)), (joined, counts)][: readings if len(joined) < len(typed) else 1]:
            ids = np.array([vocab.setdefault(w, len(vocab)) for w in ws], dtype=np.int32)
            tokens += [ids, np.full(_GAP, -2, dtype=np.int32)]
            item += [np.full(len(ids), len(items), dtype=np.int32), np.full(_GAP, -1, dtype=np.int32)]
            weight += [np.array(n, np.int64), np.zeros(_GAP, np.int64)]
        items.append(item_id)
    return Passages(vocab, np.concatenate(tokens), np.concatenate(item), items, np.concatenate(weight))


def _encoded(docs: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """(doc_id, reading, ids): the word numbers of every document as 32-bit integers, -1 for words that are in no passage; as reading 1 those of documents whose joined numbers differ and are in a passage."""
    t = tables(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form, get = Former(t), known.value.get
        for b in batches:
            out = []
            for i, x in zip(b["doc_id"], b["text"]):
                typed = words(form(x)[0])
                out.append((i, 0, np.array([get(w, -1) for w in typed], dtype=np.int32).tobytes()))
                joined, weight = _merged(typed)
                if any(n > 1 and w in known.value for w, n in zip(joined, weight)) or len(joined) < len(typed) and any(w in known.value for w in joined if len(w) > 3 and w.isdecimal()):
                    out.append((i, 1, np.array([get(w, -1) for w in joined], dtype=np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "reading", "ids"])

    return rows.mapInPandas(run, "doc_id bigint, reading int, ids binary")


def _windows(ids: pd.Series, span: int) -> np.ndarray:
    """All aligned windows of a batch of documents, one row each; the last words of a document that fill no window are left out."""
    out = [np.frombuffer(x, dtype=np.int32) for x in ids]
    return np.concatenate([x[: len(x) // span * span] for x in out] or [np.empty(0, np.int32)]).reshape(-1, span)


def _matrix_sum(df: DataFrame, part, rows: int, cols: int) -> np.ndarray:
    """Sum over partitions of part(batches) (rows x cols, float64): slices are added up in two rounds, each of as many parts as the root of the partitions."""
    slices, lots = min(16, rows), max(1, round(df.rdd.getNumPartitions() ** 0.5))
    cut = np.linspace(0, rows, slices + 1).astype(int)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        m = part(batches)
        yield pd.DataFrame({"slice": range(slices), "lot": TaskContext.get().partitionId() % lots, "m": [np.ascontiguousarray(m[a:b]).tobytes() for a, b in zip(cut, cut[1:])]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.float64) for x in g["m"]], axis=0)
        return pd.DataFrame({"slice": g["slice"].iloc[:1], "lot": 0, "m": [total.tobytes()]})

    schema = "slice int, lot int, m binary"
    summed = df.mapInPandas(local, schema).groupBy("slice", "lot").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    got = {r["slice"]: np.frombuffer(r["m"], dtype=np.float64) for r in summed.collect()}
    return np.concatenate([got[i] for i in range(slices)]).reshape(rows, cols) if got else np.zeros((rows, cols))


def _weights(w: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the words of each window, of unit length over the window; unknown words (-1) weigh as much as the rarest."""
    x = np.append(idf, idf.max(initial=1.0))[w]
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(w: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Windows in the latent space; basis has a last row of zeros for unknown words."""
    x = _weights(w, idf).astype(np.float32)
    z = x[:, :1] * basis[w[:, 0]]
    for k in range(1, w.shape[1]):
        z += x[:, k : k + 1] * basis[w[:, k]]
    return z


def _unit(z: np.ndarray) -> np.ndarray:
    n = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return z / np.maximum(n, 1e-12)


class Space(NamedTuple):
    idf: np.ndarray
    basis: np.ndarray  # words x rank


def fit(encoded: DataFrame, n_words: int, span: int = 8, rank: int = 32, extra: int = 8, seed: int = 7) -> Space:
    """Document frequencies and a randomised SVD of the TF-IDF matrix of all document windows, in three passes over word numbers."""

    def df_part(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros((n_words + 1, 1))
        for b in batches:
            for x in b["ids"]:
                u = np.unique(np.frombuffer(x, dtype=np.int32))
                out[u[u >= 0], 0] += 1
            out[n_words, 0] += len(b)
        return out

    df = _matrix_sum(encoded, df_part, n_words + 1, 1)[:, 0]
    idf = np.log((1 + df[n_words]) / (1 + df[:n_words])) + 1
    k = min(rank + extra, n_words)
    omega = np.random.default_rng(seed).standard_normal((n_words, k)).astype(np.float32)

    def batches_of(batches: Iterator[pd.DataFrame], m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            w = _windows(b["ids"], span)
            w = w[(w >= 0).any(axis=1)]
            for at in range(0, len(w), 50_000):
                c = w[at : at + 50_000]
                yield c, _weights(c, idf), _project(c, idf, m)

    def range_part(m: np.ndarray):
        m = np.vstack([m, np.zeros((1, m.shape[1]), np.float32)])

        def part(batches: Iterator[pd.DataFrame]) -> np.ndarray:
            out = np.zeros((n_words + 1, m.shape[1]))
            for w, x, z in batches_of(batches, m):
                # transposed product: windows are added to their words, in order of the word
                flat = w.ravel() % (n_words + 1)
                order = np.argsort(flat, kind="stable")
                rows = z[order // span] * x.ravel()[order, None].astype(np.float32)
                starts = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
                out[flat[order][starts]] += np.add.reduceat(rows, starts, axis=0)
            return out[:n_words]

        return part

    def gram_part(m: np.ndarray):
        m = np.vstack([m, np.zeros((1, m.shape[1]), np.float32)])

        def part(batches: Iterator[pd.DataFrame]) -> np.ndarray:
            out = np.zeros((m.shape[1], m.shape[1]))
            for _, _, z in batches_of(batches, m):
                out += z.T @ z
            return out

        return part

    q = np.linalg.qr(_matrix_sum(encoded, range_part(omega), n_words, k))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(_matrix_sum(encoded, gram_part(q), k, k))
    basis = (q @ vectors[:, np.argsort(-values)[: min(rank, k)]]).astype(np.float32)
    return Space(idf, np.vstack([basis, np.zeros((1, basis.shape[1]), np.float32)]))


class Index(NamedTuple):
    centres: np.ndarray
    order: np.ndarray  # passage windows by cell
    starts: np.ndarray
    places: np.ndarray  # place in Passages.tokens of each passage window
    latent: np.ndarray


def index(p: Passages, space: Space, span: int, cells: int = 256, rounds: int = 6) -> Index:
    """The windows at all offsets of the passages, in cells around centres (k-means on the driver: the passages are few)."""
    places = np.flatnonzero(p.item >= 0)
    places = places[places + span <= len(p.tokens)]
    places = places[p.item[places + span - 1] == p.item[places]]
    if not len(places):
        return Index(np.zeros((1, space.basis.shape[1]), np.float32), places, np.zeros(2, np.int64), places, np.zeros((0, space.basis.shape[1]), np.float32))
    w = p.tokens[places[:, None] + np.arange(span)]
    z = _unit(_project(w, space.idf, space.basis))
    rng = np.random.default_rng(3)
    c = z[rng.permutation(len(z))[: min(cells, len(z))]].copy()
    for _ in range(rounds):
        near = np.argmax(z @ c.T, axis=1)
        for k in range(z.shape[1]):
            c[:, k] = np.bincount(near, weights=z[:, k], minlength=len(c))
        c = _unit(c).astype(np.float32)
    near = np.argmax(z @ c.T, axis=1)
    order = np.argsort(near, kind="stable")
    return Index(c, order, np.searchsorted(near[order], np.arange(len(c) + 1)), places, z)


def _candidates(z: np.ndarray, ix: Index, least: float, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, passage window, cosine) of at least `least` among the passage windows of the nearest cells."""
    sims = z @ ix.centres.T
    near = np.argpartition(-sims, probes - 1, axis=1)[:, :probes] if sims.shape[1] > probes else np.tile(np.arange(sims.shape[1]), (len(z), 1))
    flat = near.ravel()
    by = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[by], np.arange(len(ix.centres) + 1))
    rows, cols, cos = [], [], []
    for c in np.flatnonzero(np.diff(bounds)):
        members = ix.order[ix.starts[c] : ix.starts[c + 1]]
        if not len(members):
            continue
        own = by[bounds[c] : bounds[c + 1]] // near.shape[1]
        s = z[own] @ ix.latent[members].T
        i, j = np.nonzero(s >= least)
        rows.append(own[i])
        cols.append(members[j])
        cos.append(s[i, j])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(cos)


def _runs(doc: np.ndarray, at: np.ndarray, tokens: np.ndarray, place: np.ndarray, span: int, before: np.ndarray) -> np.ndarray:
    """Words (before: those ahead of each place of tokens) of the run of equal numbers through each pair of windows; 0 where the windows themselves differ. Stops and unknown words equal nothing."""
    steps = np.arange(span)
    same = (doc[at[:, None] + steps] == tokens[place[:, None] + steps]).all(axis=1)
    ends = []
    for sign, start in ((1, span), (-1, -1)):
        live, k, more = np.flatnonzero(same), 0, np.zeros(len(at), np.int64)
        while len(live):
            ok = doc[at[live] + start + sign * k] == tokens[place[live] + start + sign * k]
            live = live[ok]
            more[live] += 1
            k += 1
        ends.append(more)
    return np.where(same, before[place + span + ends[0]] - before[place - ends[1]], 0)


def _local(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Rows with the words of a numbered from 0, and their number; all other words leave the rows of b, -1 stands for them in a."""
    flat, held = np.concatenate(a), np.concatenate([np.empty(0, np.int32), *b])
    known = np.unique(flat[flat >= 0])
    top = int(known.max(initial=-1)) + 1
    to = np.full(top + 1, -1, np.int64)  # the last for all other words
    to[known] = np.arange(len(known))
    number = lambda x: to[np.where((x < 0) | (x > top), top, x)]
    rows = number(held)
    ends = np.cumsum([len(x) for x in b])
    kept = np.concatenate([[0], np.cumsum(rows >= 0)])[np.concatenate([[0], ends]).astype(int)]
    rows = rows[rows >= 0]
    return np.split(number(flat), np.cumsum([len(x) for x in a])[:-1]), [rows[x:y] for x, y in zip(kept, kept[1:])], len(known)


def subsequences(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of the rows a[i] and b[j] of each pair; negative numbers equal nothing.

    A row of a is a string of bits, one a place; a word of b moves them all (Hyyro), and all pairs at once.
    """
    a, b, n = _local(a, b)
    sizes, parts = np.array([len(x) for x in a]), max(1, -(-max(len(x) for x in a) // 64))
    row, at = np.repeat(np.arange(len(a)), sizes), np.concatenate([np.arange(len(x)) for x in a])
    word = np.concatenate(a)
    bit = np.uint64(1) << (at % 64).astype(np.uint64)
    places, inside = np.zeros((parts, len(a) * max(n, 1)), np.uint64), np.zeros((parts, len(a)), np.uint64)
    np.bitwise_or.at(inside, (at // 64, row), bit)
    np.bitwise_or.at(places, ((at // 64)[word >= 0], (row * max(n, 1) + word)[word >= 0]), bit[word >= 0])
    length = np.array([len(x) for x in b], np.int64)
    order = np.argsort(-length[j], kind="stable")
    i, j = np.asarray(i)[order], np.asarray(j)[order]
    start, flat = (np.cumsum(length) - length)[j], np.concatenate([np.empty(0, np.int64), *b])
    live = np.searchsorted(-length[j], -np.arange(length.max(initial=0)), side="left")
    still = inside[:, i]  # places at which no longer subsequence ends than before them
    for t, m in enumerate(live.tolist()):
        cell = i[:m] * max(n, 1) + flat[start[:m] + t]
        carry = None
        for k in range(parts):
            v = still[k, :m]
            hit = v & places[k, cell]
            up = v + hit
            over = up < v
            if carry is not None:
                up += carry
                over |= up < carry
            carry = over.astype(np.uint64)
            still[k, :m] = up | (v ^ hit)
    out = np.empty(len(i), np.int64)
    out[order] = sizes[i] - np.bitwise_count(still & inside[:, i]).sum(axis=0, dtype=np.int64)
    return out


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Words that each of b (rows) has in common with each of a (columns) in any order: no fewer than in order."""
    a, b, n = _local(a, b)
    have = np.zeros((n, len(a)), np.int32)
    for k, x in enumerate(a):
        np.add.at(have[:, k], x[x >= 0], 1)
    seg, width = np.repeat(np.arange(len(b)), [len(x) for x in b]), max(n, 1)
    key, times = np.unique(seg * width + np.concatenate([np.empty(0, np.int64), *b]), return_counts=True)
    word, times = key % width, times.astype(np.int32)[:, None]
    cut = np.searchsorted(key // width, np.arange(len(b) + 1))
    out = np.zeros((len(b), len(a)), np.int64)
    for r, (lo, hi) in enumerate(zip(cut, cut[1:])):
        np.minimum(have[word[lo:hi]], times[lo:hi]).sum(axis=0, out=out[r])
    return out


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; negative numbers equal nothing."""
    return int(subsequences([a], [b], np.zeros(1, np.int64), np.zeros(1, np.int64))[0])


class _Search(NamedTuple):
    encoded: DataFrame
    items: np.ndarray
    sent: object  # broadcast: tokens, item, items, space, index, words ahead of each place
    span: int


def _prepared(docs: DataFrame, evals: DataFrame, run_words: int, rank: int) -> _Search | None:
    """Documents as word numbers, and the latent index of the passages on every executor; None without a passage."""
    spark = docs.sparkSession
    span = run_words // 2  # two words less than a run may have, for numbers that are joined
    p = _passages(evals, Former(tables(spark)), readings=2)
    if not p.vocab:
        return None
    encoded = store(_encoded(docs, p.vocab), "encoded")
    space = fit(encoded.where("reading = 0"), len(p.vocab), span, rank)
    items = np.array(p.items, dtype=np.int64)
    return _Search(encoded, items, spark.sparkContext.broadcast((p.tokens, p.item, items, space, index(p, space, span), np.concatenate([[0], np.cumsum(p.weight)]))), span)


def _hits(batches: Iterator[pd.DataFrame], sent: tuple, span: int, cosine: float, probes: int) -> Iterator[tuple]:
    """For each batch: its ids, the words of its documents in one row, and of each candidate pair of windows the document, the places on both sides and the cosine."""
    _, _, _, space, ix, _ = sent
    gap = np.full(1, -4, dtype=np.int32)
    for b in batches:
        parts, starts, owner, pos = [gap], [], [], 1
        for k, x in enumerate(b["ids"]):
            ids = np.frombuffer(x, dtype=np.int32)
            at = np.arange(0, len(ids) // span * span, span)
            starts.append(at + pos)
            owner.append(np.full(len(at), k))
            parts += [np.where(ids < 0, -3, ids), gap]
            pos += len(ids) + 1
        if not starts:
            continue
        doc, at, own = np.concatenate(parts), np.concatenate(starts), np.concatenate(owner)
        for lo in range(0, len(at), 20_000):
            a, o = at[lo : lo + 20_000], own[lo : lo + 20_000]
            w = doc[a[:, None] + np.arange(span)]
            some = np.flatnonzero((w >= 0).sum(axis=1) * 2 > span)
            if len(some):
                z = _unit(_project(np.where(w[some] < 0, -1, w[some]), space.idf, space.basis))
                i, j, cos = _candidates(z, ix, cosine, probes)
                yield b["doc_id"].to_numpy(), doc, o[some[i]], a[some[i]], ix.places[j], cos


def leaks(docs: DataFrame, evals: DataFrame, run_words: int = 15, rank: int = 32, cosine: float = 0.97, probes: int = 2) -> DataFrame:
    """(doc_id, item_id, run, cosine): documents that hold at least run_words consecutive words of a passage, with the longest run found and the best cosine.

    Words are compared in their consistent form without case; 4,108 and 4108 are the same. Null or empty texts and passages of fewer than run_words
    words are in no row; ids delivered again count once.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item bigint, run int, cosine float"
    search = _prepared(docs, evals, run_words, rank)
    if search is None:
        return spark.createDataFrame([], schema.replace("item ", "item_id "))
    sent, span = search.sent, search.span

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, item, items, _, _, before = sent.value
        for ids, doc, own, at, place, cos in _hits(batches, sent.value, span, cosine, probes):
            length = _runs(doc, at, tokens, place, span, before)
            ok = length >= run_words
            if ok.any():
                yield pd.DataFrame({"doc_id": ids[own[ok]], "item": items[item[place[ok]]], "run": length[ok], "cosine": cos[ok]}).groupby(["doc_id", "item"], as_index=False).max()

    best = search.encoded.mapInPandas(run, schema).groupBy("doc_id", "item").agg(F.max("run").alias("run"), F.max("cosine").alias("cosine"))
    return best.withColumnRenamed("item", "item_id")


def _lots(sizes: np.ndarray, least: int, bits: int = 8192) -> list[np.ndarray]:
    """Rows of the passages of at least that many words, in lots of similar length and a bounded number of words."""
    scale = np.ceil(2 * np.log2(np.maximum(sizes, 1))).astype(int)
    out = []
    for s in np.unique(scale[sizes >= least]):
        mine = np.flatnonzero((scale == s) & (sizes >= least))
        group = np.cumsum(sizes[mine]) // bits
        out += [mine[group == g] for g in np.unique(group)]
    return out


def _stretches(n: int, most: int) -> range:
    """Begins of stretches of 3 * most words, of which one holds any given stretch of 2 * most words of a text of n words."""
    return range(0, max(0, n - 2 * most) + 1, most)


def edits(docs: list[np.ndarray], texts: list[np.ndarray], lots: list[np.ndarray], share: float, run_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of docs, row of texts, words in common, in order) of the stretches of docs that have enough of them."""
    for lot in lots:
        size = np.array([len(texts[q]) for q in lot])
        need, most = np.maximum(run_words, share * size), int(size.max())
        # every stretch of a passage's own length that begins here lies within these
        wide = [(o, at) for o, x in enumerate(docs) for at in _stretches(len(x), most)]
        own, rows = [texts[q] for q in lot], [docs[o][at : at + 4 * most] for o, at in wide]
        r, k = np.nonzero(shared(own, rows) >= need)
        if not len(r):
            continue
        enough = subsequences(own, rows, k, r) >= need[k]
        asked = set()
        for (o, at), k_ in ((wide[x], y) for x, y in zip(r[enough].tolist(), k[enough].tolist())):
            begins = _stretches(len(docs[o]), most)
            asked.update((o, k_, x) for x in _stretches(len(docs[o]), int(size[k_])) if at <= x and (at == begins[-1] or x < at + most))
        if not asked:
            continue
        o, k, begin = (np.array(x) for x in zip(*sorted(asked)))
        n = subsequences(own, [docs[x][y : y + 3 * size[z]] for x, z, y in zip(o, k, begin)], k, np.arange(len(k)))
        ok = n >= need[k]
        yield o[ok], lot[k[ok]], n[ok]


def paraphrases(docs: DataFrame, evals: DataFrame, share: float = 0.5, run_words: int = 15) -> DataFrame:
    """(doc_id, item_id, common, share): documents that hold a passage in part or edited, by the longest common subsequence of words.

    Listed is every document that has, within a stretch of twice the words of the passage, at least run_words words and the given
    share of the passage in common with it, in order. Compared are stretches of three times the passage's words that begin at
    multiples of its length, so one of them holds any such stretch; common is the most found in one. Nothing is left out:
    stretches are passed over only if they share too few words with the passage in any order. Null or empty texts are in no row.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item bigint, common int, share double"
    p = _passages(evals, Former(tables(spark)))
    if not p.vocab:
        return spark.createDataFrame([], schema.replace("item ", "item_id "))
    encoded = store(_encoded(docs, p.vocab).where("reading = 0"), "encoded")
    held = np.flatnonzero(p.item >= 0)
    size = np.bincount(p.item[held], minlength=len(p.items))
    texts = np.split(p.tokens[held], np.cumsum(size)[:-1])
    sent = spark.sparkContext.broadcast((np.array(p.items, dtype=np.int64), texts, _lots(size, run_words)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, texts, lots = sent.value
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                ids = part["doc_id"].to_numpy()
                for o, q, n in edits([np.frombuffer(x, dtype=np.int32) for x in part["ids"]], texts, lots, share, run_words):
                    yield pd.DataFrame({"doc_id": ids[o], "item": items[q], "common": n, "share": n / [len(texts[x]) for x in q]})

    best = encoded.mapInPandas(run, schema).groupBy("doc_id", "item").agg(F.max("common").alias("common"), F.max("share").alias("share"))
    return best.withColumnRenamed("item", "item_id")


def report(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """Per evaluation item: split, source, documents that hold part of it and the longest run of its words in any."""
    found = leaks(docs, evals).groupBy("item_id").agg(F.count("*").alias("docs"), F.max("run").alias("longest"))
    return evals.where("item_id IS NOT NULL").select("item_id", "split", "source").dropDuplicates(["item_id"]).join(found, "item_id", "left").select("item_id", "split", "source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("longest", F.lit(0)).alias("longest"))
