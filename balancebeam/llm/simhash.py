"""SimHash near-duplicates: fingerprints of word shingles and a binary trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancebeam.llm.common import Forest, components, cut

SEED = 42
FRONTIER = 500_000  # node pairs expanded at a time


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: a bit is set where over half of the shingles' hashes have it. A-Z is lower-cased, words end at ASCII white space.

    Fewer words than a shingle: the whole sequence is the shingle. No word (null, empty, blanks): 0.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_digest
    if len(w) <= words:
        h = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())])
    return majority(h)


def majority(digests: bytes) -> int:
    """64 bits: a bit is set where over half of the 64-bit hashes have it, which stand one after another, big-endian."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    lanes, total = bits.view(np.uint64), np.zeros(64, np.int64)
    for i in range(0, len(lanes), 255):  # eight counters to a word: 255 rows cannot overflow one
        total += lanes[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(total * 2 > len(lanes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Other columns of ``docs`` are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def trie_links(a: np.ndarray, depth: int, budget: int, home: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted distinct fingerprints ``a`` within ``budget`` bits, one of them (at least) below the trie node ``home`` of ``depth``.

    A node is a range of ``a`` with a common prefix. Node pairs go down together; a pair whose differing bits exceed the budget is dropped with everything below
    it. Two single leaves are compared at once. Pairs wait on a stack in bounded chunks, so memory does not follow the number of pairs.
    """
    prefix = (a >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(a), np.int64)
    nodes, lo = np.unique(prefix, return_index=True)
    hi = np.append(lo[1:], len(a))
    differ = np.bitwise_count(nodes ^ home).astype(np.int64)
    own = np.flatnonzero(nodes == home)
    if not len(own):
        return
    near = np.flatnonzero((differ <= budget) & (nodes >= home))
    h = int(own[0])
    stack = [(depth, np.full(len(near), lo[h]), np.full(len(near), hi[h]), lo[near], hi[near], differ[near])]
    while stack:
        d, l1, h1, l2, h2, bits = stack.pop()
        if len(l1) > FRONTIER:
            stack.append((d, l1[FRONTIER:], h1[FRONTIER:], l2[FRONTIER:], h2[FRONTIER:], bits[FRONTIER:]))
            l1, h1, l2, h2, bits = (x[:FRONTIER] for x in (l1, h1, l2, h2, bits))
        leaf = (h1 - l1 == 1) & (h2 - l2 == 1)
        if leaf.any():
            i, j = l1[leaf], l2[leaf]
            hit = (np.bitwise_count(a[i] ^ a[j]) <= budget) & (i != j)
            if hit.any():
                yield i[hit], j[hit]
            l1, h1, l2, h2, bits = (x[~leaf] for x in (l1, h1, l2, h2, bits))
        if not len(l1):
            continue
        ones = np.concatenate(([0], np.cumsum((a >> np.uint64(63 - d)) & np.uint64(1)))).astype(np.int64)
        m1, m2, same = h1 - (ones[h1] - ones[l1]), h2 - (ones[h2] - ones[l2]), l1 == l2
        parts = []
        for x1, y1, x2, y2, more, ok in ((l1, m1, l2, m2, 0, None), (m1, h1, m2, h2, 0, None), (l1, m1, m2, h2, 1, None), (m1, h1, l2, m2, 1, ~same)):
            keep = (x1 < y1) & (x2 < y2) & (bits + more <= budget)
            keep = keep if ok is None else keep & ok
            parts.append((x1[keep], y1[keep], x2[keep], y2[keep], bits[keep] + more))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


def link_edges(distinct: DataFrame, budget: int, depth: int) -> DataFrame:
    """(a, b) edges that span the components of the distinct fingerprints in column fp.

    The top ``depth`` levels are descended by Spark: a fingerprint goes to its own trie node and to each smaller node that differs from it in at most ``budget``
    bits of the prefix. A task descends the rest for its node and emits a local spanning forest, at most one edge per fingerprint it holds.
    """
    masks = [m for m in range(1 << depth) if m.bit_count() <= budget]
    own = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    spread = distinct.select("fp", own.alias("own")).select(
        "fp", F.explode(F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("own"))), lambda n: n <= F.col("own"))).alias("node"))

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a = np.unique(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        forest = Forest(len(a))
        for i, j in trie_links(a, depth, budget, key[0].as_py()):
            forest.link(i, j)
        v, r = forest.edges()
        return pa.table({"a": a[v].view(np.int64), "b": a[r].view(np.int64)})

    return spread.groupBy("node").applyInArrow(join, "a long, b long")


def trie_edges(distinct: DataFrame, budget: int = 2, node_rows: int = 4096) -> DataFrame:
    """``link_edges`` as deep in Spark as leaves about ``node_rows`` fingerprints to a node; results do not depend on it."""
    return link_edges(distinct, budget, max(0, min(24, math.ceil(math.log2(max(1, distinct.count()) / node_rows)))))


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text", node_rows: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long) and component_id, the smallest id reachable by links of at most ``budget`` differing bits.

    Equal fingerprints are one trie leaf, so a group of copies of any size costs one leaf; its rows are aggregated map-side before any shuffle. Rows without text
    link with each other through fingerprint 0. A null id is kept and takes part; it never names a component unless the component has no other id.
    ``node_rows`` sets how deep Spark descends before tasks take over; results do not depend on it.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("first_id")))
    comp = cut(components(trie_edges(distinct, budget, node_rows)))
    linked = comp.join(distinct, comp.node == distinct.fp).select("fp", "root", "first_id")
    names = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(names, "root").select("fp", "component_id")
    final = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return fps.join(final, "fp").select("id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near-duplicates: the row with the smallest id (of rows that repeat it, one).

    Rows without any word are copies of each other. Only ids and fingerprints are shuffled to find the groups; the texts join once, with the kept ids.
    """
    return keep_ids(docs, near_duplicates(docs, words, budget, id_col, text_col), id_col)


def keep_ids(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` that name their component in ``found`` (id, component_id); of rows that repeat an id, one."""
    keep = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(_key(F.col("id")).alias("__key")).distinct()
    kept = docs.withColumn("__key", _key(F.col(id_col))).join(keep, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")  # the join has dealt and sorted by it


def _key(c):
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
