"""Ranked lexical search as an exact dual-tree search.

Documents are ordered by their rarest terms, so that documents which share them lie together; runs of that order are the leaves of document trees, items ordered alike those of an item tree.
A node holds the maximum of each coordinate (a term's weighted count in an item, its impact in a document) over all below it, so the inner product of two nodes bounds every score of
their pairs. A node pair goes down only where the bound reaches the weakest k-th score of its items. One pass scores each item only in the leaf of best bound of every tree; what it finds is
a lower bound of each item's k-th score, with which the full pass starts, so whole trees leave at their roots. Nothing is approximate: a pair that is dropped cannot be among the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balancebeam.llm.common import cut

ITEMS, TERMS = 256, 1 << 15  # items and words of one block of items
TREE, LEAF, FAN, ITEM_LEAF = 4096, 64, 8, 8  # documents of a tree and of a leaf, children of a node, items of a leaf
LAST = np.iinfo(np.int64).max  # stands for a null id, after all others

_SPLIT = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def _ints(columns, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column one after the other, and their number by row."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in columns]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.fromiter(map(len, parts), np.int64, len(parts))


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) of the documents with a word: n counts all words; terms (int32, ascending) and tf (int32) are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            ids, n, terms, tf = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = words(text.as_py())
                if not w:
                    continue
                found: dict = {}
                for t in map(get, w):
                    if t is not None:
                        found[t] = found.get(t, 0) + 1
                at = sorted(found)
                ids.append(i)
                n.append(len(w))
                terms.append(np.array(at, np.int32).tobytes())
                tf.append(np.array([found[t] for t in at], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], names=["id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, n long, terms binary, tf binary")


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; a row for each term and partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_ints(b.column(0), np.int32)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in table.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Of each term: (1e9 tf) div (1000 tf + 12 m), m from the document's length (given for each term)."""
    long = 25 * n.astype(object) * n_docs if len(n) and 25 * int(n.max()) * n_docs >= 1 << 62 else 25 * n * n_docs
    m = (75 + long // n_words).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def ordered(table: DataFrame, weight: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """(sig, id, terms, impact) of documents that can score, range-partitioned and sorted by their two rarest terms (then id, so a group of copies spans partitions)."""
    rarity = np.empty(len(weight), np.int64)
    rarity[np.lexsort((np.arange(len(weight)), -weight))] = np.arange(len(weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, terms, impact, keep = b.column(1).to_numpy(), [], [], [], []
            for k, (t, f) in enumerate(zip(b.column(2), b.column(3))):
                t, f = np.frombuffer(t.as_buffer(), np.int32), np.frombuffer(f.as_buffer(), np.int32)
                live = weight[t] > 0
                t, f = t[live], f[live].astype(np.int64)
                if not len(t):
                    continue
                r = np.sort(rarity[t])[:2]
                keep.append(k)
                sig.append(int(r[0]) << 32 | int(r[-1]))
                terms.append(t.tobytes())
                impact.append(impacts(f, np.full(len(f), n[k]), n_docs, n_words).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), b.column(0).take(pa.array(keep, pa.int64())), pa.array(terms, pa.binary()), pa.array(impact, pa.binary())], names=["sig", "id", "terms", "impact"])

    rows = table.mapInArrow(run, "sig long, id long, terms binary, impact binary")
    return cut(cut(rows).repartitionByRange("sig", "id").sortWithinPartitions("sig", "id"))


def maxima(rows: np.ndarray, size: int) -> np.ndarray:
    """Coordinate maxima over each run of ``size`` rows."""
    return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)


class Items:
    """The item tree: leaves of ITEM_LEAF items in the order of their rarest terms, a root above them, with coordinate maxima."""

    def __init__(self, counts: list[dict[int, int]], weight: np.ndarray):
        most = max((sum(c.values()) for c in counts), default=0) * 1_000_000 * int(weight.max(initial=0))
        self.kind = np.float64 if most < 1 << 53 else np.int64  # products of doubles are exact below 2 ** 53
        rows = np.zeros((len(counts), len(weight)), self.kind)
        for k, c in enumerate(counts):
            for t, n in c.items():
                rows[k, t] = n * int(weight[t])
        self.order = np.array(sorted(range(len(counts)), key=lambda k: sorted(counts[k], key=lambda t: (-weight[t], t))[:4]), np.int64)
        self.rows = rows[self.order]
        self.levels = [maxima(self.rows, ITEM_LEAF)]
        while len(self.levels[-1]) > 1:
            self.levels.append(maxima(self.levels[-1], FAN))


class Best:
    """The k best (score, id) of each item so far, and the score below which a document cannot enter."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.astype(np.int64), k
        self.item, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        item, ids, score = np.concatenate((self.item, item)), np.concatenate((self.id, ids)), np.concatenate((self.score, score))
        at = np.lexsort((ids, -score, item))
        item, ids, score = item[at], ids[at], score[at]
        start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)]))
        keep = rank < self.k
        self.item, self.id, self.score = item[keep], ids[keep], score[keep]
        full = np.flatnonzero(rank[keep] == self.k - 1)
        self.floor[self.item[full]] = np.maximum(self.floor[self.item[full]], self.score[full])


def search_tree(items: Items, best: Best, ids: np.ndarray, terms: np.ndarray, impact: np.ndarray, sizes: np.ndarray, greedy: bool) -> None:
    """Add to ``best`` what the documents of one tree (terms and impacts one after the other) can add. greedy: only the leaf of best bound of each leaf of items."""
    starts = np.r_[0, np.cumsum(sizes)]
    leaves = -(-len(ids) // LEAF)
    leaf_of = np.repeat(np.arange(len(ids)) // LEAF, sizes)
    bottom = np.zeros((leaves, items.rows.shape[1]), items.kind)
    np.maximum.at(bottom, (leaf_of, terms), impact.astype(items.kind))
    levels = [bottom]
    while len(levels[-1]) > 1:
        levels.append(maxima(levels[-1], FAN))

    def floor(level: int) -> np.ndarray:
        out = np.minimum.reduceat(best.floor[items.order], np.arange(0, len(items.order), ITEM_LEAF))
        for _ in range(level):
            out = np.minimum.reduceat(out, np.arange(0, len(out), FAN))
        return out

    if greedy:
        bound = items.levels[0] @ levels[0].T
        pairs = np.zeros(bound.shape, bool)
        pairs[np.arange(len(bound)), bound.argmax(1)] = bound.max(1) > 0
    else:
        a, b = len(items.levels) - 1, len(levels) - 1
        bound = items.levels[a] @ levels[b].T
        pairs = bound >= floor(a)[:, None]
        while (a or b) and pairs.any():  # both sides of a node pair go down together
            if a:
                a -= 1
                pairs = np.repeat(pairs, FAN, axis=0)[: len(items.levels[a])]
            if b:
                b -= 1
                pairs = np.repeat(pairs, FAN, axis=1)[:, : len(levels[b])]
            rows, columns = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
            bound = np.zeros(pairs.shape, items.kind)
            bound[np.ix_(rows, columns)] = items.levels[a][rows] @ levels[b][columns].T
            pairs &= bound >= floor(a)[:, None]
    for leaf in sorted(np.flatnonzero(pairs.any(0)).tolist(), key=lambda x: -bound[:, x].max()):
        chosen = np.flatnonzero(pairs[:, leaf] & (bound[:, leaf] >= floor(0)))
        if not len(chosen):
            continue
        rows = (chosen[:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
        rows = rows[rows < len(items.rows)]
        x, y = leaf * LEAF, min(len(ids), (leaf + 1) * LEAF)
        t, v = terms[starts[x] : starts[y]], impact[starts[x] : starts[y]]
        columns, at = np.unique(t, return_inverse=True)
        dense = np.zeros((y - x, len(columns)), items.kind)
        dense[np.repeat(np.arange(y - x), sizes[x:y]), at] = v
        score = (items.rows[np.ix_(rows, columns)] @ dense.T).astype(np.int64)
        item = items.order[rows]
        i, j = np.nonzero((score >= np.maximum(best.floor[item], 1)[:, None]))
        if len(i):
            best.add(item[i], ids[x:y][j], score[i, j])


def _found(table: DataFrame, item_ids: list, counts: list[dict[int, int]], weight: np.ndarray, floor: np.ndarray, k: int, greedy: bool) -> DataFrame:
    """(item, item_id, id, score): the k best of each task's documents, those that cannot be among the k best of all left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = Items(counts, weight), Best(floor, k)
        for b in batches:
            for s in range(0, b.num_rows, TREE):
                part = b.slice(s, TREE)
                ids = part.column(0).fill_null(LAST).to_numpy()
                terms, sizes = _ints(part.column(1), np.int32)
                search_tree(items, best, ids, terms, _ints(part.column(2), np.int32)[0].astype(np.int64), sizes, greedy)
        null = pa.array(best.id == LAST)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int32()), pa.array([item_ids[i] for i in best.item], pa.int64()), pa.compute.if_else(null, pa.scalar(None, pa.int64()), pa.array(best.id)), pa.array(best.score)],
            names=["item", "item_id", "id", "score"])

    return table.select("id", "terms", "impact").mapInArrow(run, "item int, item_id long, id long, score long")


def _block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """The result of one block of items; None if no document holds a word of theirs."""
    vocabulary: dict[bytes, int] = {}
    counts: list[dict[int, int]] = []
    for _, text in items:
        c: dict[int, int] = {}
        for w in words(text):
            t = vocabulary.setdefault(w, len(vocabulary))
            c[t] = c.get(t, 0) + 1
        counts.append(c)
    table = cut(counted(docs, vocabulary, id_col, text_col))
    n_docs, n_words = table.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not vocabulary:
        return None
    weight = weights(frequencies(table, len(vocabulary)), n_docs)
    trees, ids = ordered(table, weight, n_docs, n_words), [i for i, _ in items]
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = lambda floor, greedy: _found(trees, ids, counts, weight, floor, k, greedy).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    floor = np.zeros(len(items), np.int64)
    for r in ranked(floor, True).where(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r.score
    return ranked(floor, False).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, ties by ascending doc_id (null last).

    Items are taken in blocks of bounded size, each of which meets all documents. Documents without a word count nowhere; every row is a document of its own, also one that repeats an id. Rows
    that repeat an item's id and text are one item; texts that share an id are ranked each by itself. An item without words, or of a null id and no text, has no rows. Columns beside id
    and text are not read.
    """
    spark = docs.sparkSession
    wanted = cut(items.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct())
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.regexp_count("t", F.lit(r"\w+"))), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS), math.ceil(size / TERMS))
    out = None
    for b in range(blocks):
        rows = sorted(((r.i, r.t) for r in wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()), key=repr)
        found = _block(docs, rows, k, id_col, text_col) if rows else None
        out = found if out is None else out.unionAll(found) if found is not None else out
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
