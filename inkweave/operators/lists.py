"""Directed graphs as sorted lists of numbers, packed some hundred thousand links to a row, and what is read from them.

Nodes are numbered from 0. A packed link takes about two bytes, so a graph of up to MOST_LINKS links is sent whole to the
executors, where a pair is answered from the lists of its two ends: no link is shuffled for it, and the longer list is only
marked. Larger graphs are not sent; the callers keep plans over rows for them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators.graph import numbered
from inkweave.sources.shared import parallel, store

MOST_LINKS = 64_000_000  # links of a graph that is sent: some 130 MB packed, 256 MB in a Python worker
_CHUNK = 1 << 18
_PIECE = 1 << 20
_BESIDE = 64  # lists that are marked at once
_LANES = 1024  # nodes towards which balls are grown at once
_LOW = (1 << 32) - 1
SCHEMA = "ks binary, sizes binary, gaps binary"


class Lists(NamedTuple):
    """Nodes (node, k), their number n, the number of distinct links, and the packed lists of each node's targets."""

    nodes: DataFrame
    n: int
    links: int
    out: DataFrame

    @property
    def fit(self) -> bool:
        return self.links <= MOST_LINKS


def distinct(codes: np.ndarray) -> np.ndarray:
    """codes sorted in place, each once; np.unique hashes them, which takes many times as long."""
    codes.sort()
    return codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes


def chunk(codes: np.ndarray) -> pd.DataFrame:
    """One row of the distinct links of sorted codes."""
    a, to = (codes >> 32).astype(np.int32), (codes & _LOW).astype(np.int32)
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    gaps = np.diff(to, prepend=np.int32(0))
    gaps[at] = to[at]
    planes = gaps.astype(np.int32).view(np.uint8).reshape(-1, 4).T
    return pd.DataFrame({"ks": [a[at].tobytes()], "sizes": [np.diff(at, append=len(a)).astype(np.int32).tobytes()], "gaps": [zlib.compress(planes.tobytes(), 1)]})


def _unpacked(ks: bytes, sizes: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes of their lists, the lists one after another) of one row."""
    k, size = np.frombuffer(ks, np.int32), np.frombuffer(sizes, np.int32)
    gap = np.ascontiguousarray(np.frombuffer(zlib.decompress(gaps), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    total = np.cumsum(gap, dtype=np.int64)
    at = np.cumsum(size) - size
    return k, size, (total - np.repeat(total[at] - gap[at], size)).astype(np.int32)


def packed(codes: DataFrame) -> DataFrame:
    """Packed lists of links (code), code = source << 32 | target; a link given again counts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty(0, np.int64)
        for b in batches:
            c = np.concatenate([held, b["code"].to_numpy(np.int64)])
            held = c[np.r_[True, c[1:] != c[:-1]]] if len(c) else c
            if len(held) >= _CHUNK:
                cut = int(np.searchsorted(held, held[-1] >> 32 << 32))  # a list is never cut
                if cut:
                    yield chunk(held[:cut])
                    held = held[cut:]
        if len(held):
            yield chunk(held)

    return store(codes.repartition(parallel(codes.sparkSession), F.shiftright("code", 32)).sortWithinPartitions("code").mapInPandas(run, SCHEMA), "lists")


def code(a: str, b: str):
    return F.shiftleft(F.col(a).cast("bigint"), 32).bitwiseOR(F.col(b).cast("bigint")).alias("code")


def lists_of(nodes: DataFrame, codes: DataFrame) -> Lists:
    """Lists over nodes (node, k), numbered from 0, and links (code)."""
    return of_chunks(nodes, packed(codes))


def of_chunks(nodes: DataFrame, out: DataFrame) -> Lists:
    """Lists over nodes (node, k) of chunks that are stored."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [sum(int(np.frombuffer(x, np.int32).sum()) for x in b["sizes"])]})

    links = out.select("sizes").mapInPandas(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    return Lists(nodes, nodes.count(), links, out)


def number(ids: DataFrame) -> DataFrame:
    """(node, k) of the distinct values of a column."""
    return store(numbered(ids.toDF("node").where("node IS NOT NULL").distinct(), "node", "k").select("node", F.col("k").cast("int").alias("k")), "numbers")


def pack(out: DataFrame, more: DataFrame | None = None) -> Lists:
    """Lists of links (src, dst); nodes are their ends and those of more (one column)."""
    out = out.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    ends = out.select("src").union(out.select("dst"))
    nodes = number(ends if more is None else ends.union(more))
    x = out.join(nodes.toDF("src", "a"), "src").join(nodes.toDF("dst", "b"), "dst")
    return lists_of(nodes, x.select(code("a", "b")))


def rows(g: Lists) -> DataFrame:
    """(src, dst): the links of g by number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in zip(b["ks"], b["sizes"], b["gaps"]):
                k, size, to = _unpacked(*x)
                yield pd.DataFrame({"src": np.repeat(k, size), "dst": to})

    return g.out.mapInPandas(run, "src int, dst int")


def reverse(g: Lists) -> Lists:
    """The lists of each node's sources."""
    return Lists(g.nodes, g.n, g.links, packed(rows(g).select(code("dst", "src"))))


class Read:
    """Lists unpacked in a Python worker."""

    def __init__(self, n: int, chunks: list[tuple[bytes, bytes, bytes]]):
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.to = np.empty(sum(int(np.frombuffer(s, np.int32).sum()) for _, s, _ in chunks), np.int32)
        at = 0
        for x in chunks:
            k, size, to = _unpacked(*x)
            self.start[k], self.size[k] = at + np.cumsum(size) - size, size
            self.to[at : at + len(to)] = to
            at += len(to)

    def of(self, k: int) -> np.ndarray:
        return self.to[self.start[k] : self.start[k] + self.size[k]]

    def all(self, ks: np.ndarray) -> np.ndarray:
        """The lists of ks one after another."""
        size = self.size[ks]
        if len(ks) == 1:
            return self.of(ks[0])
        before = np.cumsum(size) - size
        return self.to[np.repeat(self.start[ks] - before, size) + np.arange(size.sum())]

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, their lists one after another, where each begins) of all nodes with lists, a bounded number of links at once."""
        order = np.argsort(self.start, kind="stable")
        order = order[self.size[order] > 0]
        ends, lo = np.cumsum(self.size[order]), 0
        while lo < len(order):
            at = ends[lo] - self.size[order[lo]]
            hi = max(lo + 1, int(np.searchsorted(ends, at + _PIECE, side="right")))
            own = order[lo:hi]
            yield own, self.to[at : ends[hi - 1]], ends[lo:hi] - self.size[own] - at
            lo = hi

    def has(self, ks: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether the sorted list of each of ks has the node of x at its place."""
        if not len(self.to):
            return np.zeros(len(ks), bool)
        lo, end = self.start[ks], self.start[ks] + self.size[ks]
        hi, last = end, len(self.to) - 1
        while (live := lo < hi).any():
            mid = (lo + hi) >> 1
            less = live & (self.to[np.minimum(mid, last)] < x)
            lo, hi = np.where(less, mid + 1, lo), np.where(live & ~less, mid, hi)
        return (lo < end) & (self.to[np.minimum(lo, last)] == x)

    def turned(self) -> Read:
        """The lists of each node's sources, in no order within a list."""
        back = Read(len(self.size), [])
        back.size = np.bincount(self.to, minlength=len(self.size))
        back.start, back.to = np.cumsum(back.size) - back.size, np.empty(len(self.to), np.int32)
        free = back.start.copy()
        for own, to, _ in self.pieces():
            code = to.astype(np.int64) << 32 | np.repeat(own, self.size[own])
            code.sort()
            to = code >> 32
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            size, k = np.diff(first, append=len(to)), to[first]
            back.to[np.repeat(free[k] - first, size) + np.arange(len(to))] = code & _LOW
            free[k] += size
        return back


class Ways:
    """Lists both ways, and what settles most pairs further than two steps apart by one look at each end.

    Of 64 marked nodes it is known which a node reaches and which reach it: who reaches another reaches all marks that this
    one does, and is reached by no mark that doesn't reach this one. Of the 64 nodes with most ways through them it is known
    which lie on a way of three steps.
    """

    def __init__(self, out: Read):
        self.out, self.back = out, out.turned()
        n, back = len(out.size), self.back
        self.seen = np.zeros(n, bool), np.zeros(n, bool)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        self.reaching, self.next_of, self.next_to = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        marks = np.r_[np.argsort(-np.minimum(out.size, back.size), kind="stable")[:32], np.linspace(0, n - 1, min(n, 32)).astype(np.int64)]
        np.bitwise_or.at(self.reaching, marks, bits[: len(marks)])
        self.reached = self.reaching.copy()
        for lists, r in ((back, self.reaching), (out, self.reached)):
            more = True
            while more:
                more = False
                for own, to, begin in lists.pieces():
                    new = r[own] | np.bitwise_or.reduceat(r[to], begin)
                    more |= bool((new != r[own]).any())
                    r[own] = new
        for bit, hub in zip(bits, np.argsort(-(out.size.astype(np.float64) * back.size), kind="stable")[:64]):
            self.next_of[out.of(hub)] |= bit
            self.next_to[back.of(hub)] |= bit
        self.two_of, self.two_to = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for lists, one, two in ((back, self.next_of, self.two_of), (out, self.next_to, self.two_to)):
            for own, to, begin in lists.pieces():
                two[own] = np.bitwise_or.reduceat(one[to], begin)

    def none(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs known to have no way from a to b."""
        return (self.out.size[a] == 0) | (self.back.size[b] == 0) | (self.reached[b] & ~self.reached[a] != 0) | (self.reaching[a] & ~self.reaching[b] != 0)

    def three(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs known to have one of three steps."""
        return (self.next_to[a] & self.two_of[b] | self.two_to[a] & self.next_of[b]) != 0


_ways: dict[str, Ways] = {}
_read: dict[str, Read] = {}


class Sent:
    """Lists on their way to the executors; unpacked once in each Python worker."""

    def __init__(self, g: Lists):
        if not g.fit:
            raise ValueError(f"a graph of {g.links} links is not sent")
        rows = g.out.collect()
        self.n, self.sent = g.n, g.nodes.sparkSession.sparkContext.broadcast([tuple(map(bytes, rows.pop())) for _ in range(len(rows))])  # held once
        self.key = uuid.uuid4().hex

    def read(self) -> Read:
        if self.key not in _read:
            _read.clear()
            _ways.clear()
            _read[self.key] = Read(self.n, self.sent.value)
            if getattr(self.sent, "_path", None):
                del self.sent._value  # is in the file, if asked for again
        return _read[self.key]

    def ways(self) -> Ways:
        if self.key not in _ways:
            _ways.clear()
            _ways[self.key] = Ways(self.read())
        return _ways[self.key]


def meets(u: np.ndarray, v: np.ndarray, left: Read, right: Read, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of numbers how many nodes stand both in left's list of u and in right's of v, and the sum of their weights: the longer list is marked once, many side by side, and the shorter ones are looked up in it."""
    n, total, nodes = np.zeros(len(u), np.int64), np.zeros(len(u)), len(left.size)
    beside = max(1, min(_BESIDE, (1 << 24) // max(1, nodes)))
    mark = np.zeros(beside * nodes, bool)
    for marked, long, walked, short, mine in ((right, v, left, u, left.size[u] <= right.size[v]), (left, u, right, v, left.size[u] > right.size[v])):
        at = np.flatnonzero(mine & (walked.size[short] > 0))
        at = at[np.argsort(long[at], kind="stable")]
        if not len(at):
            continue
        begins = np.flatnonzero(np.r_[True, long[at][1:] != long[at][:-1]])
        ks, ends = long[at[begins]], np.r_[begins[1:], len(at)]
        filled, entries, i = np.cumsum(marked.size[ks]), np.cumsum(walked.size[short[at]]), 0
        while i < len(ks):
            j = max(i + 1, min(i + beside, int(np.searchsorted(filled, (filled[i - 1] if i else 0) + _PIECE, side="right"))))
            own = marked.all(ks[i:j]) + np.repeat(np.arange(j - i) * nodes, marked.size[ks[i:j]])
            mark[own] = True
            lo, hi, place = begins[i], ends[j - 1], np.repeat(np.arange(j - i) * nodes, ends[i:j] - begins[i:j])
            while lo < hi:  # a bounded number of entries at once
                upto = min(hi, max(lo + 1, int(np.searchsorted(entries, (entries[lo - 1] if lo else 0) + _PIECE, side="right"))))
                x, side = at[lo:upto], place[lo - begins[i] : upto - begins[i]]
                sizes, to = walked.size[short[x]], walked.all(short[x])
                hit, begin = mark[to + np.repeat(side, sizes)], np.cumsum(sizes) - sizes
                n[x] = np.add.reduceat(hit, begin, dtype=np.int64)
                if weight is not None:
                    total[x] = np.add.reduceat(np.where(hit, weight[to], 0.0), begin)
                lo = upto
            mark[own] = False
            i = j
    return n, total


def _beyond(lists: Read, front: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The nodes in the lists of front that are not marked as seen, which they then are; a bounded number of links at once."""
    ends, parts, lo = np.cumsum(lists.size[front]), [], 0
    while lo < len(front):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PIECE, side="right")))
        new = lists.all(front[lo:hi])
        new = distinct(new[~seen[new]])
        seen[new] = True
        parts.append(new)
        lo = hi
    return np.concatenate(parts)


def distance(u: int, v: int, ways: Ways, most: int | None) -> int | None:
    """Steps from u to another node v, grown from the end whose next level is cheaper; None if there is no path of up to `most`."""
    sides, fronts, touched, steps, seen = (ways.out, ways.back), [np.array([u]), np.array([v])], [[np.array([u])], [np.array([v])]], 0, ways.seen
    seen[0][u] = seen[1][v] = True
    try:
        while most is None or steps < most:
            cost = [int(s.size[f].sum()) for s, f in zip(sides, fronts)]
            if not min(cost):
                return None  # an end without a way on
            i = int(cost[1] < cost[0])
            new = _beyond(sides[i], fronts[i], seen[i])
            if not len(new):
                return None
            touched[i].append(new)
            fronts[i], steps = new, steps + 1
            if seen[1 - i][new].any():
                return steps
        return None
    finally:
        for mark, them in zip(seen, touched):
            for x in them:
                mark[x] = False


def steps(a: np.ndarray, b: np.ndarray, ways: Ways, most: int | None) -> np.ndarray:
    """hops() of pairs of numbers; 0 for equal ends and where there is no path. Only pairs of which nothing is known at sight are grown one by one."""
    out, hop = ways.out, np.zeros(len(a), np.int64)
    apart = np.flatnonzero(a != b)
    x, y = a[apart], b[apart]
    n, _ = meets(x, y, out, ways.back)
    one = out.has(x, y)
    third = n - (one & out.has(x, x)) - (one & out.has(y, y)) > 0  # a loop at an end is no third node
    hop[apart] = np.where(third, 2, one)
    rest = apart[(hop[apart] == 0) & ~ways.none(x, y)]
    if most is None or most > 2:
        hop[rest[ways.three(a[rest], b[rest])]] = 3
        for i in rest[hop[rest] == 0]:
            hop[i] = distance(a[i], b[i], ways, most) or 0
    return hop


def numbers(pairs: DataFrame, g: Lists) -> DataFrame:
    """(u, v, a, b): the distinct pairs whose ends are nodes, with their numbers."""
    key = pairs.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL").distinct()
    return key.join(g.nodes.toDF("u", "a"), "u").join(g.nodes.toDF("v", "b"), "v")


def _answered(pairs: DataFrame, g: Lists, run, schema: str) -> DataFrame:
    keyed = store(numbers(pairs, g).repartition(parallel(pairs.sparkSession), "a"), "asked")
    return keyed.join(store(keyed.select("a", "b").mapInPandas(run, f"a int, b int, {schema}"), "answers"), ["a", "b"]).drop("a", "b")


def overlap(pairs: DataFrame, g: Lists) -> DataFrame:
    """(u, v, cn, aa): targets that both ends of the distinct pairs have, and the sum of 1 / ln(1 + 1e-8 + d) over their numbers d of targets."""
    sent = Sent(g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = sent.read()
        weight = 1 / np.log1p(1e-8 + out.size)
        for b in batches:
            n, total = meets(b["a"].to_numpy(), b["b"].to_numpy(), out, out, weight)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "cn": n, "aa": total})

    return _answered(pairs, g, run, "cn bigint, aa double").where("cn > 0")


def sizes(g: Lists) -> DataFrame:
    """(node, d): nodes with targets, and how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, s in zip(b["ks"], b["sizes"]):
                yield pd.DataFrame({"k": np.frombuffer(k, np.int32), "d": np.frombuffer(s, np.int32)})

    return g.out.select("ks", "sizes").mapInPandas(run, "k int, d bigint").join(g.nodes, "k").select("node", "d")


def hops(pairs: DataFrame, g: Lists, most: int | None = None) -> DataFrame:
    """(u, v, hops) of the distinct pairs of different nodes with a path along g of up to `most` steps (of any length, if None): 2 rather than 1 where a third node lies between linked ends."""
    sent = Sent(g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = sent.ways()
        for x in batches:
            a, b = x["a"].to_numpy(), x["b"].to_numpy()
            hop = steps(a, b, ways, most)
            yield pd.DataFrame({"a": a, "b": b, "hops": hop})[hop > 0]

    return _answered(pairs, g, run, "hops int")


def pagerank(g: Lists, rounds: int = 100, damp: float = 0.85, still: float = 1e-15, cut: int = 10) -> DataFrame:
    """(id, rank) of rank.pagerank over all nodes of g, in one task: a round reads each link once."""
    if g.n == 0:
        return g.nodes.select(F.col("node").alias("id"), F.lit(0.0).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (np.frombuffer(r) for b in batches for r in b["ranks"]):
            yield pd.DataFrame({"k": np.arange(len(r), dtype=np.int32), "rank": r})

    return store(g.nodes.join(_ranked(g, Sent(g), rounds, damp, still, cut).mapInPandas(run, "k int, rank double"), "k").select(F.col("node").alias("id"), "rank"), "rank")


def ranks(g: Lists, sent: Sent) -> np.ndarray:
    """The ranks of pagerank by number, from g as it is sent."""
    return np.frombuffer(_ranked(g, sent).first()[0]) if g.n else np.empty(0)


def _ranked(g: Lists, sent: Sent, rounds: int = 100, damp: float = 0.85, still: float = 1e-15, cut: int = 10) -> DataFrame:
    """(ranks), one row with the ranks of all nodes of g as doubles."""
    n = g.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            pass
        out = sent.read()
        nodes = np.argsort(out.start, kind="stable")
        nodes = nodes[out.size[nodes] > 0]  # in the order of their lists
        ends = np.cumsum(out.size[nodes])
        cuts = [0]
        while cuts[-1] < len(nodes):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, (ends[cuts[-1] - 1] if cuts[-1] else 0) + 4 * _PIECE, side="right"))))
        rank = np.full(n, 1.0 / n)
        for k in range(1, rounds + 1):
            flow, got = rank[nodes] / out.size[nodes], np.zeros(n)
            for lo, hi in zip(cuts, cuts[1:]):
                got += np.bincount(out.to[ends[lo] - out.size[nodes[lo]] : ends[hi - 1]], np.repeat(flow[lo:hi], out.size[nodes[lo:hi]]), n)
            was, rank = rank, (1 - damp) / n + damp * got
            if k % cut == 0 and np.abs(rank - was).max() <= still:
                break
        yield pd.DataFrame({"ranks": [rank.tobytes()]})

    return g.nodes.sparkSession.range(1).repartition(1).mapInPandas(run, "ranks binary")


def _wider(out: Read, order: np.ndarray, begin: np.ndarray, r: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lanes r (rows of 64-bit words) of every node with those of its targets added, and the nodes that gained some. Only targets that changed are read; order and begin are the nodes with targets and where their lists start."""
    hit = changed[out.to]
    count = np.add.reduceat(hit, begin, dtype=np.int64)
    to, wide, gained = out.to[hit], r.copy(), np.zeros(len(changed), bool)
    own = np.flatnonzero(count)
    ends = np.cumsum(count[own])
    lo = 0
    while lo < len(own):
        at = ends[lo] - count[own[lo]]
        hi = max(lo + 1, int(np.searchsorted(ends, at + (1 << 16), side="right")))
        x = order[own[lo:hi]]
        new = np.bitwise_or.reduceat(r[to[at : ends[hi - 1]]], ends[lo:hi] - count[own[lo:hi]] - at, axis=0) | r[x]
        gained[x] = (new != r[x]).any(axis=1)
        wide[x] = new
        lo = hi
    return wide, gained


class _Heart:
    """What lanes end as in a graph most of whose links touch one strong component: whoever reaches it reaches all that it reaches. Lists are put in the order of their targets' sizes, since large ones fill lanes first."""

    def __init__(self, out: Read):
        n, size = len(out.size), out.size
        self.out, self.ins = out, np.bincount(out.to, minlength=n)
        hub = int(np.argmax(size * self.ins))
        self.ahead, self.back, front, k = np.zeros(n, bool), np.zeros(n, bool), np.array([hub]), 0
        self.order = np.argsort(out.start, kind="stable")
        self.order = self.order[size[self.order] > 0]
        self.begin = out.start[self.order]
        self.ahead[hub] = self.back[hub] = True
        while len(front):
            new = np.zeros(n, bool)
            new[out.all(front)] = True
            new &= ~self.ahead
            self.ahead |= new
            front = np.flatnonzero(new)
        while len(self.order) and (c := int(self.back.sum())) != k:
            k = c
            self.back[self.order] |= np.logical_or.reduceat(self.back[out.to], self.begin)
        core = self.ahead & self.back
        rest, links = [], 0
        for lo in range(0, len(self.order), 1 << 14):
            x = self.order[lo : lo + (1 << 14)]
            at, to = self.begin[lo], out.to[self.begin[lo] : self.begin[lo] + size[x].sum()]
            keep = ~np.repeat(core[x], size[x]) & ~core[to]
            rest.append((np.repeat(x, size[x])[keep], to[keep]))
            links += int(keep.sum())
            key = np.repeat(np.arange(len(x)), size[x]) << 32 | ((1 << 31) - size[to])
            out.to[at : at + len(to)] = to[np.argsort(key, kind="stable")]
        self.known = 2 * links <= len(out.to)
        if self.known:
            self.rest = Read(n, [])
            if links:
                a, self.rest.to = (np.concatenate(c) for c in zip(*rest))
                self.rest.size = np.bincount(a, minlength=n)
                at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                self.rest.start[a[at]] = at
                self.rest_order, self.rest_begin = a[at], at

    def final(self, r: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The lanes of every node once nothing changes any more; r: those of nodes, each its own. A way that misses the component has no node of it."""
        out, changed = r.copy(), np.zeros(len(r), bool)
        changed[nodes] = True
        while len(self.rest.to) and changed.any():
            out, changed = _wider(self.rest, self.rest_order, self.rest_begin, out, changed)
        if len(hit := nodes[self.ahead[nodes]]):
            out[self.back] |= np.bitwise_or.reduce(r[hit], axis=0)
        return out

    def filled(self, r: np.ndarray, final: np.ndarray, act: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_wider() for the nodes act, all that are not final: of each so many targets are read as fill its lanes."""
        out, wide, left, c, w = self.out, r.copy(), act, 0, 4
        while len(left):
            some, piece = np.minimum(out.size[left] - c, w), max(1, (1 << 16) // w)
            on = []
            for lo in range(0, len(left), piece):
                x, q = left[lo : lo + piece], some[lo : lo + piece]
                b = np.cumsum(q) - q
                new = np.bitwise_or.reduceat(r[out.to[np.repeat(out.start[x] + c - b, q) + np.arange(q.sum())]], b, axis=0) | wide[x]
                wide[x] = new
                on.append(x[(out.size[x] > c + w) & (new != final[x]).any(axis=1)])
            left, c, w = np.concatenate(on), c + w, min(4 * w, 1024)
        gained = np.zeros(len(r), bool)
        gained[act] = (wide[act] != r[act]).any(axis=1)
        return wide, gained


_hearts: dict[str, _Heart] = {}


def shared_balls(g: Lists, sets: DataFrame, pairs: DataFrame, radius: int) -> DataFrame:
    """(a, b, shared) of the distinct pairs (a, b) of sets (x, k), x numbered from 0: nodes within reach of both in as many steps as the narrower of their balls goes, up to `radius`.

    Balls are grown backwards from _LANES nodes at once, a bit for each, until nothing changes, and none is stored: of a
    block of nodes only the counts of each pair at each width are kept. A node whose lanes are full, by what its component
    reaches, reads no further target, so little but the step before that reads all links; without a component that most
    links touch, all steps do, and work grows with nodes x links / 64. Sets, of which each has a member, and pairs are
    sent as numbers.
    """
    spark = g.nodes.sparkSession
    m = sets.orderBy("x").toPandas()
    p = pairs.select("a", "b").toPandas()
    start = np.flatnonzero(np.r_[True, np.diff(m["x"]) != 0]) if len(m) else np.empty(0, int)
    graph, sent = Sent(g), spark.sparkContext.broadcast((m["k"].to_numpy(np.int32), start, p["a"].to_numpy(np.int32), p["b"].to_numpy(np.int32)))
    step = 1 << 16

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, (member, begin_of, pa, pb) = graph.read(), sent.value
        n = len(out.size)
        if graph.key not in _hearts:
            _hearts.clear()
            _hearts[graph.key] = _Heart(out)
        heart = _hearts[graph.key]
        order, begin = heart.order, heart.begin
        depth, counts = np.zeros(len(begin_of), np.uint8), [np.zeros(len(pa), np.int32)]
        for lane in (c for b in batches for c in b["block"]):
            nodes = np.arange(lane * _LANES, min(n, (lane + 1) * _LANES))
            r = np.zeros((n, _LANES // 64), np.uint64)
            i = nodes - nodes[0]
            r[nodes, i // 64] = np.uint64(1) << (i % 64).astype(np.uint64)
            changed = np.zeros(n, bool)
            changed[nodes] = True
            reach = np.bitwise_or.reduceat(r[member], begin_of, axis=0)
            final = heart.final(r, nodes) if heart.known else None
            moved, now, k = reach.any(axis=1), np.zeros(len(pa), np.int32), 0
            while True:
                ask = np.flatnonzero(moved[pa] | moved[pb])
                for at in range(0, len(ask), step):
                    x = ask[at : at + step]
                    now[x] = np.bitwise_count(reach[pa[x]] & reach[pb[x]]).sum(axis=1, dtype=np.int32)
                if k == len(counts):
                    counts.append(counts[-1] - last)
                counts[k] += now
                if k == radius or not len(order):
                    break
                last = now.copy()
                act = np.flatnonzero((r != final).any(axis=1)) if heart.known else order
                if heart.known and 2 * int(heart.ins[changed].sum()) > int(out.size[act].sum()):
                    r, changed = heart.filled(r, final, act)
                else:
                    r, changed = _wider(out, order, begin, r, changed)
                if not changed.any():
                    break
                wide = np.bitwise_or.reduceat(r[member], begin_of, axis=0)
                moved = (wide != reach).any(axis=1)
                reach, k = wide, k + 1
                depth[moved] = np.maximum(depth[moved], k)
            for j in range(k + 1, len(counts)):
                counts[j] += now
        for at in range(0, len(depth), step):
            yield pd.DataFrame({"what": ["depth"], "slice": [at // step], "k": [0], "levels": [0], "data": [zlib.compress(depth[at : at + step].tobytes(), 1)]})
        for k, c in enumerate(counts):
            for at in range(0, len(c), step):
                yield pd.DataFrame({"what": ["count"], "slice": [at // step], "k": [k], "levels": [len(counts)], "data": [zlib.compress(c[at : at + step].tobytes(), 1)]})

    blocks = -(-g.n // _LANES)
    tasks = max(1, min(blocks, parallel(spark)))
    dealt = spark.range(0, tasks, 1, tasks).select(F.explode(F.sequence(F.col("id"), F.lit(max(0, blocks - 1)).cast("bigint"), F.lit(tasks).cast("bigint"))).alias("block"))
    grown = store(dealt.mapInPandas(grow, "what string, slice int, k int, levels int, data binary"), "grown")

    def deepest(x: pd.DataFrame) -> pd.DataFrame:
        top = np.maximum.reduce([np.frombuffer(zlib.decompress(d), np.uint8) for d in x["data"]])
        return pd.DataFrame({"slice": x["slice"].iloc[:1], "data": [top.tobytes()]})

    deep = grown.where("what = 'depth'").groupBy("slice").applyInPandas(deepest, "slice int, data binary").orderBy("slice").collect()
    depths = spark.sparkContext.broadcast(np.frombuffer(b"".join(bytes(r["data"]) for r in deep), np.uint8))

    def total(x: pd.DataFrame) -> pd.DataFrame:
        at = int(x["slice"].iloc[0]) * step
        _, _, pa, pb = sent.value
        a, b = pa[at : at + step], pb[at : at + step]
        most, out = np.minimum(depths.value[a], depths.value[b]), np.zeros(len(a), np.int64)
        for k, levels, d in zip(x["k"], x["levels"], x["data"]):
            own = most == k if k < levels - 1 else most >= k  # what a task has grown no wider stays as it is
            out[own] += np.frombuffer(zlib.decompress(d), np.int32)[own]
        return pd.DataFrame({"a": a, "b": b, "shared": out})

    return grown.where("what = 'count'").groupBy("slice").applyInPandas(total, "a int, b int, shared bigint")
