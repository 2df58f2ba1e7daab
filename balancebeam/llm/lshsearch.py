"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing, candidates of all tables reranked exactly.

A vector of norm up to M becomes a unit vector (v / M and one more coordinate), a query is scaled to length one, so the largest inner product is the smallest distance. Vectors are held in
classes of similar norm, each with its own M, so a single long vector spoils nothing. A table hashes by Gaussian projections, cut into slots of twice their spread. A query visits the
buckets of a table in the order of their estimated success: the chance that a neighbour's projections, spread about the query's, fall into their slots. How many buckets it visits is fitted on a
bounded sample of queries (SAMPLE, with their true neighbours) so that TARGET of the true neighbours lie in a visited bucket. Every row is indexed in every table.

Buckets are dealt to shards; one with more rows than a shard is dealt as chunks, all of which its queries visit. A task holds one shard and lets the queries stream past it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balancebeam.llm.embdedup import clean
from balancebeam.llm.topk import matrix

TABLES = 4
BUCKET = 64  # rows of a bucket aimed at
SLOTS = 5  # of a projection that a query considers
CELLS = 1 << 21  # numbers held by a shard
CROWDED = 1 << 16  # at most as many crowded buckets to a table
SAMPLE, SPREAD = 100, 4096  # queries and vectors of the samples
TARGET = 0.95
SLICE = 128  # queries compared at a time
PAIRS = 1 << 16


def norms(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, norms and norm classes (the nearest powers of two)."""
    v = v.astype(np.float64)
    top = np.abs(v).max(axis=1, keepdims=True)
    w = v / top
    length = np.sqrt(np.square(w).sum(1))
    return w / length[:, None], top[:, 0] * length, np.floor(np.log2(top[:, 0]) + np.log2(length) + 0.5).astype(np.int64)


def below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-np.square(x) / 2)
    return 0.5 + 0.5 * np.sign(x) * y


def mix(*parts) -> np.ndarray:
    """A 64-bit hash of integers; equal keys of different buckets would only add candidates."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = h ^ np.asarray(p).astype(np.int64).view(np.uint64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


@dataclass
class Space:
    """The tables over vectors of one length and norm class."""

    top: float  # largest norm
    directions: np.ndarray  # (tables, dims + 1, projections)
    middle: np.ndarray  # (tables, projections)
    width: np.ndarray
    offset: np.ndarray
    slope: float = 0.5  # a neighbour's projection lies about slope times the query's
    spread: float = 0.9
    probes: int = 8
    whole: bool = False  # visit every bucket

    def codes(self, unit: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket codes of indexed vectors."""
        s = np.clip(np.floor((self.centred(unit, norm) + self.offset) / self.width), -8, 7).astype(np.int64) + 8
        return (s << (4 * np.arange(s.shape[2]))).sum(2)

    def centred(self, unit: np.ndarray, norm: np.ndarray | None) -> np.ndarray:
        """(rows, tables, projections); without norms: of queries."""
        share = np.ones(len(unit)) if norm is None else np.minimum(norm / self.top, 1)
        rest = np.zeros(len(unit)) if norm is None else np.sqrt(np.maximum(0, 1 - share * share))
        x = np.hstack((unit * share[:, None], rest[:, None]))
        return np.einsum("nd,tdm->ntm", x, self.directions, optimize=True) - self.middle

    def order(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """(queries, tables, up to ``probes``) codes of the buckets a query visits, most likely first."""
        n, (tables, _, m) = len(unit), self.directions.shape
        at = (self.slope * self.centred(unit, None) + self.offset) / self.width
        slot = np.floor(at)[..., None] + (np.arange(SLOTS) - SLOTS // 2)
        sd = (self.spread / self.width)[None, :, :, None]
        chance = np.log(np.maximum(below((slot + 1 - at[..., None]) / sd) - below((slot - at[..., None]) / sd), 1e-12))
        code = np.clip(slot, -8, 7).astype(np.int64) + 8
        best, codes = np.zeros((n, tables, 1)), np.zeros((n, tables, 1), np.int64)
        for i in range(m):  # the best of the whole begin with the best of each beginning
            best = (best[..., None] + chance[:, :, i, None, :]).reshape(n, tables, -1)
            codes = (codes[..., None] + (code[:, :, i, None, :] << (4 * i))).reshape(n, tables, -1)
            if best.shape[2] > probes:
                keep = np.argpartition(-best, probes - 1, axis=2)[..., :probes]
                best, codes = np.take_along_axis(best, keep, 2), np.take_along_axis(codes, keep, 2)
        return np.take_along_axis(codes, np.argsort(-best, axis=2, kind="stable"), 2)


def new_space(dims: int, count: int, top: float, sample: np.ndarray, norm: np.ndarray, seed: int = 11) -> Space:
    """Directions keep the distribution of independent Gaussians one by one; those of a table are orthogonal as far as the dimensions go."""
    m = min(12, max(0, round(math.log2(max(1, count) / BUCKET) / 1.2)))
    g = np.random.default_rng([seed, dims])
    size, need = dims + 1, TABLES * m
    parts = [np.linalg.qr(g.normal(size=(size, size)))[0] * np.linalg.norm(g.normal(size=(size, size)), axis=0) for _ in range(-(-max(1, need) // size))]
    directions = np.ascontiguousarray(np.hstack(parts)[:, :need].reshape(size, TABLES, m).transpose(1, 0, 2))
    space = Space(top, directions, np.zeros((TABLES, m)), np.ones((TABLES, m)), g.uniform(size=(TABLES, m)))
    if len(sample) and m:
        x = space.centred(sample, norm)
        space.middle, spread = x.mean(0), x.std(0)
        space.width = np.where(spread > 1e-9, 2 * spread, 1.0)
    space.offset = space.offset * space.width
    return space


def calibrate(space: Space, queries: np.ndarray, near: np.ndarray, unit: np.ndarray, norm: np.ndarray, target: float) -> None:
    """Set the probes so that ``target`` of the true neighbours (unit, norm; near: their query) are met in some table."""
    if not len(near) or not space.directions.shape[2]:
        return
    a, b = space.centred(queries, None)[near], space.centred(unit, norm)
    space.slope = float((a * b).sum() / max(np.square(a).sum(), 1e-12))
    space.spread = max(1e-3, float(np.sqrt(np.square(b - space.slope * a).mean())))
    codes, every = space.codes(unit, norm), SLOTS ** space.directions.shape[2]
    probes = 8
    while True:
        probes = min(probes * 2, every)
        visited = space.order(queries, probes)
        same = visited[near] == codes[..., None]
        rank = np.where(same.any(2), same.argmax(2), every).min(1)
        if (rank < every).mean() >= target:
            space.probes = max(8, int(np.sort(rank)[math.ceil(target * len(rank)) - 1]) + 1)
            return
        if probes == every:
            space.probes, space.whole = every, True
            return


def batches_by_length(b: pa.RecordBatch, column: str = "v") -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.diff(b.column(column).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
    for d in np.unique(dims).tolist():
        yield d, b.filter(pa.array(dims == d))


def fit(vectors: DataFrame, queries: DataFrame, k: int, target: float = TARGET) -> tuple[dict[tuple[int, int], Space], dict[int, int]]:
    """The spaces by (length, norm class), fitted on bounded samples, and the number of vectors of each length."""

    def sizes(batches):
        for b in batches:
            for d, part in batches_by_length(b):
                _, norm, c = norms(matrix(pa.chunked_array([part.column("v")])))
                kinds, of = np.unique(c, return_inverse=True)
                top = np.zeros(len(kinds))
                np.maximum.at(top, of, norm)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), d, np.int32)), pa.array(kinds), pa.array(np.bincount(of)), pa.array(top)], names=["d", "c", "n", "top"])

    # lengths and norm classes (at most 2200 powers of two) are few
    spaces = vectors.mapInArrow(sizes, "d int, c long, n long, top double").groupBy("d", "c").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    count = {d: sum(s.n for s in spaces if s.d == d) for d in {s.d for s in spaces}}
    pick = lambda rows, n, seed: rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n // seed))) == 0).limit(2 * seed)
    sample = [r for b in pick(vectors, sum(count.values()), SPREAD).toArrow().to_batches() for r in batches_by_length(b)]
    asked = [r for b in pick(queries, queries.count(), SAMPLE).toArrow().to_batches() for r in batches_by_length(b)]
    out = {}
    for s in spaces:
        got = [norms(matrix(pa.chunked_array([b.column("v")]))) for d, b in sample if d == s.d]
        unit, norm = (np.concatenate([g[i][g[2] == s.c] for g in got]) if got else np.zeros((0, s.d) if i == 0 else 0) for i in (0, 1))
        out[s.d, s.c] = new_space(s.d, s.n, s.top, unit, norm)
    for d in count:
        mine = [b for e, b in asked if e == d]
        if not mine:
            continue
        ids = np.concatenate([b.column("id").to_numpy() for b in mine])
        q = np.concatenate([matrix(pa.chunked_array([b.column("v")])) for b in mine]).astype(np.float64)
        true = truth(vectors, ids, q, k).toArrow()
        if not true.num_rows:
            continue
        near, (unit, norm, c) = true.column("q").to_numpy(), norms(matrix(true.column("v")))
        for (e, kind), space in out.items():
            if e == d:
                calibrate(space, norms(q)[0], near[c == kind], unit[c == kind], norm[c == kind], target)
    return out, count


def truth(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(q, id, score, v): the k best of all vectors for a few queries, by brute force; a task keeps k rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, score, rows = np.zeros(0, np.int64), np.zeros(0), None
        for b in batches:
            for d, part in batches_by_length(b):
                if d != q.shape[1]:
                    continue
                s = q @ matrix(pa.chunked_array([part.column("v")])).astype(np.float64).T
                s[ids[:, None] == part.column("id").to_numpy()[None]] = -math.inf
                at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
                who, score = np.concatenate((who, i)), np.concatenate((score, s[i, j]))
                more = pa.Table.from_batches([part]).take(pa.array(j))
                rows = pa.concat_tables([rows, more]) if rows is not None else more
                order = np.lexsort((-score, who))
                place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
                keep = order[(place < k) & (score[order] > -math.inf)]
                who, score, rows = who[keep], score[keep], rows.take(pa.array(keep)).combine_chunks()
        if rows is not None and len(who):
            for part in pa.table({"q": pa.array(who), "id": rows.column("id"), "score": pa.array(score), "v": rows.column("v")}).to_batches():
                yield part

    kind = vectors.schema["v"].dataType.simpleString()
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = vectors.mapInArrow(run, f"q long, id long, score double, v {kind}")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


class Dealer:
    """Where buckets lie: keys and shards."""

    def __init__(self, spaces: dict[tuple[int, int], Space], count: dict[int, int], crowded: dict[tuple, int]):
        self.spaces, self.crowded = spaces, crowded
        self.shards = {d: max(1, math.ceil(n / shard_rows(d))) for d, n in count.items()}

    def shard(self, d: int, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.int64), 1) % np.uint64(self.shards[d])).astype(np.int32)

    def index(self, b: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
        unit, norm, c = norms(matrix(pa.chunked_array([b.column("v")])))
        for kind in np.unique(c).tolist():
            mine = np.flatnonzero(c == kind)
            codes, part = self.spaces[d, kind].codes(unit[mine], norm[mine]), b.take(pa.array(mine))
            salt = mix(part.column("id").to_numpy(), 7, np.frombuffer(unit[mine][:, 0].tobytes(), np.int64))
            for t in range(TABLES):
                chunks = np.fromiter((self.crowded.get((d, kind, t, x), 1) for x in codes[:, t].tolist()), np.uint64, len(mine))
                keys = mix(kind, t, codes[:, t], (salt % chunks).astype(np.int64))
                yield placed(d, t, self.shard(d, keys), 0, part, pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32)), pa.array(keys.view(np.int64))))

    def ask(self, b: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
        unit = norms(matrix(pa.chunked_array([b.column("v")])))[0]
        mine = [(kind, s) for (e, kind), s in self.spaces.items() if e == d]
        for t in range(TABLES):
            who, keys = [], []
            for kind, space in mine:
                if space.whole:
                    continue
                codes = space.order(unit, space.probes)[:, t]
                q = np.repeat(np.arange(len(unit)), codes.shape[1])
                chunks = np.fromiter((self.crowded.get((d, kind, t, x), 1) for x in codes.ravel().tolist()), np.int64, codes.size) if self.crowded else np.ones(codes.size, np.int64)
                part = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                who.append(np.repeat(q, chunks))
                keys.append(mix(kind, t, np.repeat(codes.ravel(), chunks), part))
            if any(s.whole for _, s in mine):  # no keys: the whole shard
                every = np.tile(np.arange(self.shards[d], dtype=np.int32), len(unit))
                q = np.repeat(np.arange(len(unit)), self.shards[d])
                yield placed(d, t, every, 1, b.take(pa.array(q)), pa.array([[]] * len(q), pa.list_(pa.int64())))
                continue
            who, keys = np.concatenate(who), np.concatenate(keys)
            shard = self.shard(d, keys)
            order = np.lexsort((shard, who))
            who, keys, shard = who[order], keys[order], shard[order]
            start = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (shard[1:] != shard[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(who)].astype(np.int32)), pa.array(keys.view(np.int64)))
            yield placed(d, t, shard[start], 1, b.take(pa.array(who[start])), lists)


def shard_rows(d: int) -> int:
    return max(256, CELLS // max(1, d))


def placed(d: int, table: int, shard: np.ndarray, kind: int, rows: pa.RecordBatch, keys: pa.Array) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(shard, pa.int32()), pa.array(np.full(n, kind, np.int32)), rows.column("id"), rows.column("v"), keys],
                                      names=["d", "t", "shard", "kind", "id", "v", "keys"])


class Shard:
    """Vectors by bucket key."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, v: np.ndarray):
        order = np.lexsort((*v.T[::-1], ids, keys))
        keys, ids, v = keys[order], ids[order], v[order]
        new = np.ones(len(ids), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]).any(1)  # rows that repeat count once
        keys, self.ids, self.v = keys[new], ids[new], v[new].astype(np.float64)
        self.keys, self.starts = np.unique(keys, return_index=True)
        self.ends = np.append(self.starts[1:], len(keys))
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted = self.ids[self.by_id]
        self.repeats = int(np.unique(self.sorted, return_counts=True)[1].max(initial=1))  # vectors of one id
        self.longest = float(np.sqrt(np.square(self.v).sum(1)).max(initial=0))

    def search(self, q_ids: np.ndarray, q: np.ndarray, who: np.ndarray, keys: np.ndarray, whole: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score), the k best ids of each query among the vectors under its keys."""
        scores = np.full((len(q), len(self.ids)), -math.inf)
        at = np.searchsorted(self.keys, keys)
        here = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        at, who = at[here], who[here]
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        for x, y in zip(first, np.r_[first[1:], len(at)]):
            s, e, rows = self.starts[at[x]], self.ends[at[x]], who[x:y]
            scores[rows, s:e] = q[rows] @ self.v[s:e].T
        if whole.any():
            scores[whole] = q[whole] @ self.v.T
        lo, hi = np.searchsorted(self.sorted, q_ids), np.searchsorted(self.sorted, q_ids, side="right")
        for r in np.flatnonzero(lo < hi):
            scores[r, self.by_id[lo[r] : hi[r]]] = -math.inf
        most = min(k * self.repeats, scores.shape[1])
        floor = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
        slack = 1e-9 * np.sqrt(np.square(q).sum(1)) * self.longest
        i, j = np.nonzero((scores >= (floor - slack)[:, None]) & (scores > -math.inf))
        exact = np.concatenate([(q[i[p : p + PAIRS]] * self.v[j[p : p + PAIRS]]).sum(1) for p in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)
        ids = self.ids[j]
        order = np.lexsort((-exact, ids, i))
        i, ids, exact = i[order], ids[order], exact[order]
        one = np.r_[True, (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])] if len(i) else np.zeros(0, bool)
        i, ids, exact = i[one], ids[one], exact[one]
        order = np.lexsort((ids, -exact, i))
        i, ids, exact = i[order], ids[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], ids[keep], exact[keep]


def visit(k: int):
    """Of rows sorted by (d, t, shard, kind): hold the vectors of a shard, then let its queries pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, shard = None, [], None
        for b in batches:
            tag = np.stack([b.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((tag[1:] != tag[:-1]).any(1)) + 1).tolist(), len(tag)] if len(tag) else [0]
            for x, y in zip(cuts, cuts[1:]):
                part = b.slice(x, y - x)
                if place != tuple(tag[x, :3]):
                    place, parts, shard = tuple(tag[x, :3]), [], None
                ids, v, keys = part.column(4).to_numpy(), matrix(pa.chunked_array([part.column(5)])), pa.chunked_array([part.column(6)]).combine_chunks()
                flat, sizes = keys.flatten().to_numpy().view(np.uint64), np.diff(keys.offsets.to_numpy())
                if tag[x, 3] == 0:
                    parts.append((flat, ids, v))
                    continue
                if shard is None and parts:
                    shard = Shard(*(np.concatenate(p) for p in zip(*parts)))
                    parts = []
                if shard is None:
                    continue
                at = np.r_[0, np.cumsum(sizes)]
                for s in range(0, len(ids), SLICE):
                    e = min(len(ids), s + SLICE)
                    i, found, score = shard.search(ids[s:e], v[s:e].astype(np.float64), np.repeat(np.arange(e - s), sizes[s:e]), flat[at[s] : at[e]], sizes[s:e] == 0, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][i]), pa.array(found), pa.array(score)], names=["query_id", "id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every``, the k largest inner products found among the rows with another id, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part. Only vectors of one length meet. Fewer candidates give fewer rows. An id
    with several vectors counts with its best pair. Other columns are not read. About ``target`` of the true neighbours are found; scores are exact.
    """
    good = clean(vectors, id_col, vec_col)[0].select(F.col("id").cast("long").alias("id"), "v")
    queries = good.where(F.pmod("id", F.lit(every)) == 0)
    spaces, count = fit(good, queries, k, target)

    def buckets(batches):
        for b in batches:
            for d, part in batches_by_length(b):
                unit, norm, c = norms(matrix(pa.chunked_array([part.column("v")])))
                for kind in np.unique(c).tolist():
                    codes = spaces[d, kind].codes(unit[c == kind], norm[c == kind])
                    for t in range(TABLES):
                        x, n = np.unique(codes[:, t], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), y, np.int64)) for y in (d, kind, t)] + [pa.array(x), pa.array(n)], names=["d", "c", "t", "code", "n"])

    limit = {d: max(shard_rows(d), n // CROWDED) for d, n in count.items()}
    sizes = good.mapInArrow(buckets, "d long, c long, t long, code long, n long").groupBy("d", "c", "t", "code").agg(F.sum("n").alias("n"))
    most = F.coalesce(*[F.when(F.col("d") == d, F.lit(x)) for d, x in limit.items()]) if limit else F.lit(0)
    # at most CROWDED rows for each length and table
    crowded = {(r.d, r.c, r.t, r.code): -(-r.n // limit[r.d]) for r in sizes.where(F.col("n") > most).collect()}
    dealer = Dealer(spaces, count, crowded)

    def place(batches):
        for b in batches:
            for d, part in batches_by_length(b):
                yield from dealer.index(part, d)

    def ask(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                for d, part in batches_by_length(b.slice(s, 1024)):
                    yield from dealer.ask(part, d)

    schema = f"d int, t int, shard int, kind int, id long, v {good.schema['v'].dataType.simpleString()}, keys array<long>"
    rows = good.mapInArrow(place, schema).unionAll(queries.mapInArrow(ask, schema))
    found = rows.repartition("d", "t", "shard").sortWithinPartitions("d", "t", "shard", "kind").mapInArrow(visit(k), "query_id long, id long, score double")
    merged = found.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return merged.select("query_id", F.row_number().over(w).alias("rank"), "id", "score").where(F.col("rank") <= k)
