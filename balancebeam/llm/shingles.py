"""Near-duplicates by the Jaccard similarity of word shingles: the SimHash trie and MinHash bands give candidates, whole sets decide.

The trie (``simhash``) links the sets' fingerprints that differ in a few bits: closest copies, however the bands fall. A pair of 0.8 may differ in 16 bits, so the bands find the others. A candidate of theirs shares one of BANDS bands of ROWS minima. A pair of similarity t is missed with a chance of (1 - t ** ROWS) ** BANDS, 4e-7 at 0.8 and less above; pairs of 0.5 become candidates
with a chance of 27 %, of 0.4 with 5 %. Sketches of SKETCH minima are compared first: a pair goes on unless they agree in a share that lies seven standard deviations below the similarity asked
for. A pair is lost only if both sources or the sketches miss it. The sets of a band are compared with the smallest of them first (links in proportion to the rows); what these links join is one group.
Bands that several groups share are searched inside tasks: sketches join their sets to clusters, then the whole sets of a cluster are compared, each shipped once per pair of bounded chunks.
Both give forests, never rows of pairs. Sets are made again from the texts once, for the documents that share a band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancebeam.llm import simhash
from balancebeam.llm.common import Forest, components, cut, release_memory

SEED = 42
ROWS, BANDS = 8, 80
SKETCH = 192  # minima whose low 16 bits are kept
BITS = 24  # of the table that says which sets are read again
BITMAP = 1 << 15  # bits of one bitmap of it
CHUNK = 1024  # sketches, and
WEIGHT = 1 << 18  # shingles, of one chunk of a band or a cluster; two chunks meet in a task
COLUMNS = 4096  # shingles counted at once

_A, _B = (np.random.default_rng(SEED + k).integers(0, 1 << 32, ROWS * BANDS, np.uint32) for k in (0, 1))
_A |= np.uint32(1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. A-Z is lower-cased, words end at ASCII white space; fewer words than a shingle: the whole sequence is the shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - words + 1)
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[min(words, len(w)) - 1 :].tolist())), np.uint64, n))


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of each of ROWS * BANDS hash functions over the set."""
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 128):
        y = x[k : k + 128, None] ^ _B
        y *= _A
        np.minimum(low, y.min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's minima."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.reshape(BANDS, ROWS).T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def sketch(low: np.ndarray) -> np.ndarray:
    return low[:SKETCH].astype("<u2")


def least_agreement(similarity: float) -> float:
    """Share of equal minima below which a pair of this similarity lies with a chance of less than 1e-9."""
    return similarity - 7 * math.sqrt(similarity * (1 - similarity) / SKETCH)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def set_hash(s: np.ndarray) -> int:
    """Of the whole set, as a signed long."""
    h = xxhash.xxh64_intdigest(s.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, h) sorted by both: (token, h, lo) for each set of a token that several sets share, lo its smallest."""
    token = lo = last = None
    alone = True  # the smallest set of the present token has not been given out
    for b in batches:
        t, h = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(t):
            continue
        start = np.r_[t[0] != token, t[1:] != t[:-1]]
        fresh = start | np.r_[h[0] != last, h[1:] != h[:-1]]  # rows that repeat a set leave
        first = np.maximum.accumulate(np.where(start, np.arange(len(t)), 0))
        low = h[first]
        if not start[0]:
            low[first == 0] = lo
        more = fresh & (h != low)
        opens = np.flatnonzero(more)
        opens = opens[np.unique(first[opens], return_index=True)[1]]  # the first other set of each token
        if not start[0] and not alone:
            opens = opens[first[opens] != 0] if len(opens) else opens
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((t[more], t[opens]), (h[more], low[opens]), (low[more], low[opens]))], names=["token", "h", "lo"])
        held = more[first == first[-1]].any()
        alone = not (held or (first[-1] == 0 and not start[0] and not alone))
        token, lo, last = t[-1], low[-1], h[-1]


def _print(s: np.ndarray) -> int:
    """The SimHash fingerprint of the whole set, as a signed long."""
    fp = simhash.majority(s.astype(">u8").tobytes()) if len(s) else 0
    return fp - (1 << 64) if fp >> 63 else fp


def _simhash_links(table: DataFrame, budget: int) -> DataFrame:
    """(a, b), a < b: the sets of equal fingerprints with the smallest of them, and the smallest sets of fingerprints that the trie joins within ``budget`` bits."""
    sets = table.where("n > 0").select("h", "fp").distinct()
    first = cut(sets.groupBy("fp").agg(F.min("h").alias("lo")))
    same = sets.join(first, "fp").where("h <> lo").select(F.col("lo").alias("a"), F.col("h").alias("b"))
    end = lambda c: first.select(F.col("fp").alias(c), F.col("lo").alias(f"lo_{c}"))
    linked = simhash.trie_edges(first.select("fp"), budget).join(end("a"), "a").join(end("b"), "b")
    return cut(same.unionAll(linked.select(F.least("lo_a", "lo_b").alias("a"), F.greatest("lo_a", "lo_b").alias("b"))).distinct())


def _likely(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches admit."""
    least = math.floor(least_agreement(similarity) * SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, SKETCH) for c in b.columns[2:4])
            yield b.select([0, 1]).filter(pa.array((x == y).sum(1) >= least, pa.bool_()))

    left, right = (table.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(h, s): the sets that ``named`` (h) names, made again from the texts, one row each."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)  # 2 MB, an OR of bitmaps built in the tasks
    at = F.pmod("h", F.lit(1 << BITS))
    for r in named.select(F.floor(at / BITMAP).alias("k"), F.pmod(at, F.lit(BITMAP)).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        part = np.frombuffer(bytes(r.m), np.uint8)
        bits[r.k * BITMAP // 8 : r.k * BITMAP // 8 + len(part)] = part

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            for k in range(0, b.num_rows, 200):
                h, sets = [], []
                for t in b.column(0).slice(k, 200):
                    s = shingle_set(t.as_py(), words)
                    key = set_hash(s)
                    place = key & ((1 << BITS) - 1)
                    if bits[place >> 3] >> (place & 7) & 1:
                        h.append(key)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(sets, pa.binary())], names=["h", "s"])

    found = texts.mapInArrow(read, "h long, s binary").join(named.select("h").distinct(), "h", "left_semi")
    return cut(found.dropDuplicates(["h"]))


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(b.column(2), b.column(3))], pa.bool_()))

    left, right = (sets.select(F.col("h").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, which the partition is sorted by, without those columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)])
        at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        rest = b.select(list(range(keys, b.num_columns)))
        if held and (k[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(at, at[1:]):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(rest.slice(i, j - i))
        last = k[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _meetings(rows: DataFrame, key: str, weight: Column, limit: int) -> DataFrame:
    """``rows`` dealt to chunks of their key by a hash, each row once per pair of chunks (i, j): a partition holds whole pairs, sorted by key, i, j and h."""
    total = rows.groupBy(key).agg(F.ceil(F.sum(weight) / limit).cast("int").alias("chunks"))
    dealt = rows.join(total, key).withColumn("k", F.pmod(F.xxhash64(F.lit(SEED), "h"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: (x != F.col("k")) | (F.col("chunks") == 1))
    met = dealt.withColumn("o", F.explode(others)).select(F.col(key).alias("key"), F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), *[c for c in rows.columns if c != key])
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "h")


def _reach(x: np.ndarray, n: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Connected components (a number per row) of the sketches x that sizes and agreement admit: what a row reaches leaves those that later rows are compared with."""
    name, left, k = np.full(len(x), -1), np.arange(len(x)), 0
    while len(left):
        queue, left = [int(left[0])], left[1:]
        name[queue[0]] = k
        while queue and len(left):
            q = queue.pop()
            near = (x[left] == x[q]).sum(1) >= least
            near &= np.minimum(n[left], n[q]) >= similarity * np.maximum(n[left], n[q]) - 1e-6
            if near.any():
                name[left[near]] = k
                queue += left[near].tolist()
                left = left[~near]
        k += 1
    return name


def _clusters(members: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """(h, c, lo): the sets of the members (token, h, c) whose sketches lead to a set of another group c of their token; lo is the smallest group so reached."""
    least = math.floor(least_agreement(similarity) * SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            h, c, n = (t.column(i).to_numpy() for i in range(3))
            x = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u2").reshape(-1, SKETCH)
            name = _reach(x, n, least, similarity)
            low, high = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), np.iinfo(np.int64).min)
            np.minimum.at(low, name, c)
            np.maximum.at(high, name, c)
            mixed = (low != high)[name]
            if mixed.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[mixed]) for v in (h, c, low[name])], names=["h", "c", "lo"])

    met = _meetings(members.join(table, "h").select("token", "h", "c", "n", "sketch"), "token", F.lit(1), CHUNK)
    return met.mapInArrow(run, "h long, c long, lo long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of the sets."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1  # a shingle of one set is in no intersection
    row, at = row[many[at] > 1], place[at[many[at] > 1]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, (k, k + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[i:j], at[i:j] - k] = 1
        out += m @ m.T
    return out


def _forests(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between whole sets of the members (cluster, h, c) that join all groups c which similar sets of a cluster join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            h, group = t.column(0).to_numpy(), np.unique(t.column(1).to_numpy(), return_inverse=True)[1]
            s = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(3)]
            n, both = np.array([len(x) for x in s]), shared_counts(s)
            near = (both >= similarity * (n[:, None] + n - both) - 1e-9) & (group[:, None] < group)
            forest, a, b = Forest(int(group.max()) + 1), [], []
            for i, j in np.argwhere(near).tolist():
                if forest.root[group[i]] != forest.root[group[j]]:
                    forest.link(group[i : i + 1], group[j : j + 1])
                    a.append(h[i])
                    b.append(h[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = _meetings(members.join(sets, "h").withColumn("n", F.length("s") / 8).select("cluster", "h", "c", "n", "s"), "cluster", F.col("n"), WEIGHT)
    return met.mapInArrow(run, "a long, b long")


def _found(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str, budget: int) -> DataFrame:
    """(id, text_hash, root, component_id), a row per row of ``docs``; root names the component without fail."""
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(text_col).alias("t"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                low = [minima(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in low], pa.binary()),
                     pa.array([bands(x).view(np.int64) if len(s) else [] for x, s in zip(low, sets)], pa.list_(pa.int64()))], names=["id", "text_hash", "h", "fp", "n", "sketch", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("text_hash"))
    table = cut(rows.mapInArrow(read, f"id {kind}, text_hash long, h long, fp long, n long, sketch binary, bands array<long>"))
    tokens = table.select(F.explode("bands").alias("token"), "h").repartition("token").sortWithinPartitions("token", "h")
    shared = cut(tokens.mapInArrow(_stars, "token long, h long, lo long"))
    closest = _simhash_links(table, budget)
    named = cut(shared.select("h").unionAll(closest.select("a")).unionAll(closest.select("b")).distinct())
    # a sketch for each set that shares a band or a link of the trie; equal sets have equal sketches
    sketches = cut(table.select("h", "n", "sketch").join(named, "h", "left_semi").groupBy("h").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    sets = _sets(texts, named, words)
    star = cut(shared.where("lo <> h").select(F.col("lo").alias("a"), F.col("h").alias("b")).unionAll(closest).distinct())
    near = cut(_links(cut(_likely(star, sketches, similarity)), sets, similarity))
    group = cut(components(near))
    grouped = shared.select("token", "h").join(group.select(F.col("node").alias("h"), "root"), "h", "left").select("token", "h", F.coalesce("root", "h").alias("c"))
    mixed = grouped.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    reached = cut(_clusters(grouped.join(mixed, "token"), sketches, similarity))
    comp = group
    if not reached.isEmpty():  # else no link is added to the groups
        cluster = components(reached.select(F.col("c").alias("a"), F.col("lo").alias("b"))).select(F.col("node").alias("c"), F.col("root").alias("cluster"))
        more = _forests(reached.select("h", "c").distinct().join(cluster, "c").select("cluster", "h", "c"), sets, similarity)
        comp = cut(components(near.unionAll(more)))

    distinct = table.groupBy("h").agg(F.min("id").alias("first_id"))
    linked = distinct.join(comp.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("root"), "first_id")
    names = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = linked.join(names, "root").select("h", "root", "component_id")
    return table.select("id", "text_hash", "h").join(final, "h").select("id", "text_hash", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", budget: int = 2) -> DataFrame:
    """One row per row of ``docs``: id and component_id, the smallest id reachable by pairs whose sets of shingles have at least this Jaccard similarity.

    Rows without any word are copies of each other. A null id takes part; it never names a component unless the component has no other id. Equal sets are one node.
    """
    return _found(docs, words, similarity, id_col, text_col, budget).select("id", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, budget: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near-duplicates: the row with the smallest id.

    Texts that share an id are rows of their own: where they are no near-duplicates each stays, where they are, that of the smaller hash. Of rows equal in id and text any one stays.
    """
    key, mark = _unused(docs, "key"), _unused(docs, "mark")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    first = _found(docs, words, similarity, id_col, text_col, budget).where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("text_hash").alias(mark), F.first("id").alias("id"))
    keep = first.select(name(F.col("id")).alias(key), mark).distinct()
    kept = docs.withColumns({key: name(F.col(id_col)), mark: F.xxhash64(text_col)}).join(keep, [key, mark], "left_semi")
    return kept.dropDuplicates([key, mark]).select(*docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name
