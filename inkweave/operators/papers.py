"""Papers with their authors and citations as numbers, small enough to be sent whole, and what is answered from them for pairs of papers.

A listing and a citation take four bytes each, so up to MOST of both go to every executor. Author links are made there
from them, a range of authors in a task, and pairs are answered row by row: no link and no pair is shuffled.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators import lists as L
from inkweave.sources.shared import drop, parallel, store

MOST = 16_000_000  # listings, and citations: 256 MB on the driver while they are sorted
_PIECE = 1 << 20
_ROWS = 1 << 16


class Arrays(NamedTuple):
    """Sorted ids of papers; the numbers of their authors as listed; the numbers of the papers that each cites, sorted, each once."""

    ids: np.ndarray
    start: np.ndarray  # one more than papers, as of cited
    author: np.ndarray
    cited: np.ndarray
    to: np.ndarray

    def number(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of papers by id, -1 for those without authors."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def first(self, k: np.ndarray) -> np.ndarray:
        """Numbers of the authors listed first, -1 for paper -1."""
        return np.where(k < 0, -1, self.author[self.start[np.maximum(k, 0)]] if len(self.ids) else -1)

    def later(self) -> np.ndarray:
        """For each listing, how many follow it on its paper."""
        return np.repeat(self.start[1:], np.diff(self.start)) - np.arange(len(self.author)) - 1

    def reached(self) -> np.ndarray:
        """For each paper, the listings of all papers it cites."""
        total = np.r_[0, np.cumsum(np.diff(self.start)[self.to])]
        return total[self.cited[1:]] - total[self.cited[:-1]]


class Papers(NamedTuple):
    """Authors (node, k) and the arrays over their numbers."""

    nodes: DataFrame
    n: int
    held: Arrays


def span(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _fetched(df: DataFrame, pick: Callable[[pa.RecordBatch], list[np.ndarray]], kinds: list) -> list[np.ndarray]:
    """The arrays that pick makes of all batches of df, sent to the driver packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.ascontiguousarray(c.astype(k)) for c, k in zip(pick(b), kinds)]
            data = [zlib.compress(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes(), 1) for c in x]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x[0])], pa.int64())} | {f"c{i}": pa.array([d], pa.binary()) for i, d in enumerate(data)})

    got = df.mapInArrow(run, "n bigint, " + ", ".join(f"c{i} binary" for i in range(len(kinds)))).collect()

    def whole(i: int, kind) -> np.ndarray:
        parts = [np.ascontiguousarray(np.frombuffer(zlib.decompress(r[i + 1]), np.uint8).reshape(-1, r[0]).T).view(kind).ravel() for r in got if r[0]]
        return np.concatenate(parts) if parts else np.empty(0, kind)

    return [whole(i, k) for i, k in enumerate(kinds)]


def column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def papers(edges: DataFrame, na: DataFrame) -> Papers | None:
    """Papers of na (id, pos, author) and the edges (src, dst) between them; None where these are too many to be sent."""
    spark = na.sparkSession
    na = store(na.select("id", "pos", "author"), "listed")
    if na.count() > MOST:
        return None
    nodes = L.number(na.select("author"))
    listing, pos, k = _fetched(na.join(nodes.toDF("author", "k"), "author").select("id", "pos", "k"), lambda b: [column(b, c) for c in ("id", "pos", "k")], [np.int64, np.int32, np.int32])
    drop(na)
    order = np.lexsort((pos, listing))
    ids, start = np.unique(listing[order], return_index=True)
    start, author = np.r_[start, len(order)].astype(np.int64), k[order]
    sent = spark.sparkContext.broadcast(Arrays(ids, start[:1], author[:0], start[:1], author[:0]))

    def linked(b: pa.RecordBatch) -> list[np.ndarray]:
        x, y = (sent.value.number(column(b, c)) for c in ("src", "dst"))
        both = (x >= 0) & (y >= 0)
        return [x[both], y[both]]

    edges = store(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "cites")
    if edges.count() > MOST:
        return None
    x, y = _fetched(edges, linked, [np.int32, np.int32])
    drop(edges)
    sent.destroy()
    codes = L.distinct(x.astype(np.int64) << 32 | y)
    cited = np.searchsorted(codes >> 32, np.arange(len(ids) + 1))
    return Papers(nodes, nodes.count(), Arrays(ids, start, author, cited, (codes & ((1 << 32) - 1)).astype(np.int32)))


_inverse: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def links(p: Papers) -> L.Lists:
    """The links of authors.author_graph as lists: each task takes ranges of authors, and makes theirs from all they list after themselves and cite."""
    held, spark = p.held, p.nodes.sparkSession
    cost = np.zeros(p.n + 1)
    size = np.diff(held.start)
    cost[1:] = np.cumsum(np.bincount(held.author, held.later() + np.repeat(held.reached(), size), p.n))
    cuts = np.unique(np.r_[np.searchsorted(cost, np.arange(0, cost[-1] + 1, _PIECE), side="right") - 1, p.n])
    sent, key, n = spark.sparkContext.broadcast((held, cuts)), uuid.uuid4().hex, p.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, cut = sent.value
        if key not in _inverse:
            _inverse.clear()
            _inverse[key] = np.argsort(h.author, kind="stable"), np.searchsorted(np.sort(h.author), np.arange(n + 1))
        order, begin = _inverse[key]
        paper = np.repeat(np.arange(len(h.ids)), np.diff(h.start))
        size = np.diff(h.start)
        for b in batches:
            for i in b["id"]:
                at = order[begin[cut[i]] : begin[cut[i + 1]]]  # listings of these authors
                a, of = h.author[at].astype(np.int64) << 32, paper[at]
                later = h.start[of + 1] - at - 1
                cites = h.cited[of + 1] - h.cited[of]
                to = h.to[span(h.cited[of], cites)]
                one = np.repeat(a, later) | h.author[span(at + 1, later)]
                two = np.repeat(np.repeat(a, cites), size[to]) | h.author[span(h.start[to], size[to])]
                if len(c := L.distinct(np.r_[one, two])):
                    yield L.chunk(c)

    pieces = len(cuts) - 1
    tasks = max(1, min(pieces, parallel(spark)))
    out = store(spark.range(pieces).repartition(tasks).mapInPandas(run, L.SCHEMA), "lists")
    sent.destroy()
    return L.of_chunks(p.nodes, out)


def strengths(p: Papers, alpha: float = 1.0, beta: float = 0.5) -> np.ndarray:
    """By author's number, the sum of the weights of its links in authors.author_graph."""
    h, size = p.held, np.diff(p.held.start)
    return alpha * np.bincount(h.author, h.later(), p.n) + beta * np.bincount(h.author, np.repeat(h.reached(), size), p.n)


def first_authors(pairs: DataFrame, p: Papers, graph: L.Sent, path: bool = False, ranks: np.ndarray | None = None, strength: np.ndarray | None = None) -> DataFrame:
    """pairs (u, v) of papers with du, dv, cn, un, jaccard and aa of their first authors, as in authors.pair_features; path if asked for; rank_min, rank_max, weight_min, weight_max by what is given. A missing author has no links, rank or strength and no path."""
    spark = pairs.sparkSession
    held = p.held._replace(author=p.held.author[p.held.start[:-1]], start=np.arange(len(p.held.start)), cited=np.empty(0), to=np.empty(0))
    sent = spark.sparkContext.broadcast((held, ranks, strength))
    names = [("du", "bigint"), ("dv", "bigint"), ("cn", "bigint"), ("un", "bigint"), ("jaccard", "double"), ("aa", "double")]
    names += [("path", "int")] * path + [(x, "double") for x in ("rank_min", "rank_max") if ranks is not None] + [(x, "double") for x in ("weight_min", "weight_max") if strength is not None]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, rank, power = sent.value
        out, ways = graph.read(), graph.ways() if path else None
        weight = 1 / np.log1p(1e-8 + out.size)
        for rows in grouped(batches):
            a, b = (h.first(h.number(column(rows, c))) for c in ("u", "v"))
            both = np.flatnonzero((a >= 0) & (b >= 0))
            code, at = np.unique(a[both].astype(np.int64) << 32 | b[both], return_inverse=True)
            x, y = (code >> 32).astype(np.int64), code & ((1 << 32) - 1)
            cn, aa, d = np.zeros(len(a), np.int64), np.zeros(len(a)), np.append(out.size, 0)
            n, total = L.meets(x, y, out, out, weight)
            cn[both], aa[both] = n[at], total[at]
            du, dv = d[a], d[b]  # -1 is the last
            new = [du, dv, cn, du + dv - cn, cn / (1e-8 + (du + dv - cn)), aa]
            if path:
                hop = np.full(len(a), 15, np.int32)
                steps = L.steps(x, y, ways, None)
                hop[both] = np.where(x == y, 0, np.where(steps > 0, steps, 15))[at]
                new.append(hop)
            for z in (rank, power):
                if z is not None:
                    z = np.append(z, 0.0)
                    new += [np.minimum(z[a], z[b]), np.maximum(z[a], z[b])]
            fields = [*rows.schema, *(pa.field(c, kinds[t]) for c, t in names)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(v, f.type) for v, f in zip(new, fields[-len(names) :]))], schema=pa.schema(fields))

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", " + ", ".join(f"{c} {t}" for c, t in names))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to a bounded number of rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
