"""Exact top-k search by inner product: columnar branch and bound over blocks of candidates.

Vectors lie vertically: one row per dimension. A block of candidates is read dimension block by dimension block; after each, the mass of the dimensions not yet read
bounds what a candidate can still gain (Cauchy-Schwarz), and candidates that cannot reach the query's present k-th score leave the block. Blocks are dealt by a hash of
the id. Queries are blocks too, so a task holds one block of each, and neither side is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM_BLOCK = 16
CANDIDATES = 2048  # rows in a block of candidates
QUERIES = 4096  # rows in a block of queries
INNER = 512  # columns compared at a time: the scores of earlier ones prune later ones


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, dim_block: int = DIM_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, id, score) of each query's k best of the block, its own id left out; ties to the smaller id. Integer scores are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if most < 2**52 else object  # sums stay exact in doubles, else Python integers
    order = np.lexsort((c_ids, -np.square(c.astype(float)).sum(1)))
    c_ids, columns, q = c_ids[order], np.ascontiguousarray(c[order].T.astype(kind)), q.astype(kind)
    d, n = columns.shape
    cuts = [*range(0, d, dim_block), d]
    c_rest = np.array([np.sqrt(np.square(columns[s:].astype(float)).sum(0)) for s in cuts])
    q_rest = np.array([np.sqrt(np.square(q[:, s:].astype(float)).sum(1)) for s in cuts])
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, kind), np.zeros(0, np.int64))] * len(q)
    for at in range(0, n, INNER):
        part = columns[:, at : at + INNER]
        first = q[:, : cuts[1]] @ part[: cuts[1]]
        for r in range(len(q)):
            score, ids = best[r]
            floor = float(score[-1]) if len(score) == k else -math.inf
            live, got = np.flatnonzero(c_ids[at : at + INNER] != q_ids[r]), first[r]
            got = got[live]
            for b in range(1, len(cuts) - 1):
                slack = q_rest[b, r] * c_rest[b, at + live] * (1 + 1e-9) + 1e-6
                keep = got.astype(float) + slack >= floor
                live, got = live[keep], got[keep]
                if not len(live):
                    break
                got = got + q[r, cuts[b] : cuts[b + 1]] @ part[cuts[b] : cuts[b + 1], live]
            if len(live):
                score, ids = np.concatenate((score, got)), np.concatenate((ids, c_ids[at + live]))
                top = np.lexsort((ids, -score))[:k]
                best[r] = score[top], ids[top]
    sizes = [len(s) for s, _ in best]
    return np.repeat(q_ids, sizes), np.concatenate([i for _, i in best]) if best else np.zeros(0, np.int64), np.concatenate([s for s, _ in best]) if best else np.zeros(0)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, v = table.column("id").to_numpy(), matrix(table.column("v"))
    order = np.lexsort((*v.T[::-1], ids))
    ids, v = ids[order], v[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]).any(1)
    return ids[new], v[new]


def clean_integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) as long. Ids and vectors that are null, empty vectors and those with a null or non-finite component are left out."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(False))).select("id", whole.alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score) over integer vectors (id, v): each query's k best of all rows with another id and as many dimensions.

    Fewer candidates give fewer rows. Rows that repeat an id and its vector count once. Empty tables give no rows. The number of blocks follows the row counts; a block
    of queries meets every block of candidates once, and each meeting leaves at most k rows a query.
    """
    q_blocks = max(1, math.ceil(queries.count() / QUERIES))
    c_blocks = max(1, math.ceil(vectors.count() / CANDIDATES))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    left = queries.select(block(q_blocks, 3).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"), F.size("v").alias("d"), "id", "v")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), block(c_blocks, 5).alias("c"), F.size("v").alias("d"), "id", "v")

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        a, b, s = search_block(*_distinct(q), *_distinct(c), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array([int(x) for x in s], pa.int64())})

    found = left.groupBy("q", "c", "d").cogroup(right.groupBy("q", "c", "d")).applyInArrow(meet, "query_id long, id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.select("query_id", "id", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
