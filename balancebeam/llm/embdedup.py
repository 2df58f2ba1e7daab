"""Embedding near-duplicates: a subspace pigeonhole join over rotated vectors.

Unit vectors with cosine >= t are within squared distance 2 (1 - t). A rotation (random signs and a Walsh-Hadamard transform) spreads the mass evenly, and the rotated
vector is split into blocks; a linked pair is within its proportional share of the squared distance in at least one block. Each block is range-joined on a grid over
its first coordinates: a vector goes to its own cell and, as a visitor, to the smaller neighbouring cells. Candidates of all blocks are verified exactly in the task
that finds them, and a pair counts only in the first block that admits it, so links are counted once without ever listing pairs.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancebeam.llm.common import Forest, components, cut
from balancebeam.llm.topk import matrix

BLOCK_DIMS = 16
GRID_DIMS = 2
CHUNK = 16384  # rows of a crowded cell that one task compares with as many others
TILE = 2048  # rows compared at a time within a task
PAIRS = 1 << 17  # candidate pairs verified at a time


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.square(v).sum(axis=1, keepdims=True))


def rotate(u: np.ndarray, seed: int = 5) -> np.ndarray:
    """Distances stay. Element-wise steps only, so a row's result does not depend on the rows beside it."""
    size = 1 << max(0, (u.shape[1] - 1).bit_length())
    x = np.zeros((len(u), size))
    x[:, : u.shape[1]] = u
    x *= np.random.default_rng(seed).choice([-1.0, 1.0], size)
    h = 1
    while h < size:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), size)
        h *= 2
    return x / math.sqrt(size)


def blocks_of(dims: int) -> list[slice]:
    size = 1 << max(0, (dims - 1).bit_length())
    return [slice(s, min(size, s + BLOCK_DIMS)) for s in range(0, size, BLOCK_DIMS)]


def cells(x: np.ndarray, width: float) -> np.ndarray:
    return np.floor(x[:, :GRID_DIMS] / width).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, block: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate index pairs of rotated rows: within the share of ``block``, found by a matrix product with slack and settled element by element; not admitted by an
    earlier block."""
    parts = blocks_of(a.shape[1])
    share = limit / len(parts)
    p, q = a[:, parts[block]].astype(np.float32), b[:, parts[block]].astype(np.float32)
    one = lambda n: np.ones((n, 1), np.float32)
    squared = np.hstack((p, np.square(p).sum(1, keepdims=True), one(len(p)))) @ np.hstack((-2 * q, one(len(q)), np.square(q).sum(1, keepdims=True))).T
    i, j = np.divmod(np.flatnonzero(squared <= share + 1e-4), max(1, len(q)))
    keep_i, keep_j = [], []
    for s in range(0, len(i), PAIRS):
        x, y = i[s : s + PAIRS], j[s : s + PAIRS]
        for k in range(block):
            far = np.square(a[x, parts[k]] - b[y, parts[k]]).sum(1) > share
            x, y = x[far], y[far]
        ok = np.square(a[x, parts[block]] - b[y, parts[block]]).sum(1) <= share
        keep_i.append(x[ok])
        keep_j.append(y[ok])
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (np.zeros(0, int), np.zeros(0, int))


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) rows that can link (id not null; vector not null, not empty, all components finite, not all zero), and all others."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    finite = ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    return v.where(good), v.where(~good)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    n_links counts the other rows linked directly; component_id is the smallest id reachable. Equal vectors are joined as one and counted with their number, so a group
    of copies costs one vector. Rows with a null id, and vectors that are null, empty, zero or not finite, link with nothing (a null id has a null component). Vectors of
    different lengths never link. Rows that repeat an id belong to one component. Other columns are not read.
    """
    limit = 2 * (1 - cosine) + 1e-9
    good, rest = clean(vectors, id_col, vec_col)
    kind = good.schema["v"].dataType.simpleString()
    copies = cut(good.groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))).withColumn("rep", F.monotonically_increasing_id())
    width = lambda parts: math.sqrt(limit / parts) * (1 + 1e-9)

    def place(batches):
        """A row for each block and cell that a vector lies in (home) or visits."""
        for b in batches:
            dims = np.diff(b.column(0).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                n, blocks = part.num_rows, blocks_of(d)
                x = rotate(unit(matrix(pa.chunked_array([part.column(0)]))))
                for k, s in enumerate(blocks):
                    home = cells(x[:, s], width(len(blocks)))
                    own = (0,) * home.shape[1]
                    for offset in product((-1, 0, 1), repeat=home.shape[1]):
                        if offset <= own:
                            code = [".".join(map(str, c)) for c in (home + np.array(offset)).tolist()]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(code), pa.array(np.full(n, offset == own)), part.column(1), part.column(2), part.column(0)],
                                names=["d", "block", "cell", "home", "rep", "n", "v"])

    placed = copies.select("v", "rep", "n").mapInArrow(place, f"d int, block int, cell string, home boolean, rep long, n long, v {kind}")
    size = placed.groupBy("d", "block", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    # a crowded cell is dealt as pairs of chunks; the grid over the unit ball bounds how many cells there can be
    crowded = size.where((F.col("all") > CHUNK) & (F.col("homes") > 0)).select("d", "block", "cell", F.ceil(F.col("homes") / CHUNK).cast("int").alias("lefts"), F.ceil(F.col("all") / CHUNK).cast("int").alias("rights"))
    dealt = placed.join(F.broadcast(crowded), ["d", "block", "cell"], "left").na.fill(1, ["lefts", "rights"])
    pick = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), n).cast("int")
    other = lambda n: F.sequence(F.lit(0), n - 1)
    alone = (F.col("lefts") == 1) & (F.col("rights") == 1)
    role = lambda l, r, is_left, is_right: F.struct(l.alias("l"), r.alias("r"), is_left.alias("is_left"), is_right.alias("is_right"))
    left = F.transform(other(F.col("rights")), lambda r: role(pick(F.col("lefts"), 3), r, F.lit(True), alone))
    right = F.transform(other(F.col("lefts")), lambda l: role(l, pick(F.col("rights"), 5), F.lit(False), F.lit(True)))
    both = F.when(F.col("home") & alone, left).when(F.col("home"), F.concat(left, right)).otherwise(right)
    tasks = dealt.withColumn("to", F.explode(both)).select("d", "block", "cell", "to.l", "to.r", "to.is_left", "to.is_right", "home", "rep", "n", "v")

    def meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rep, n, is_left, is_right, home = (t.column(c).to_numpy() for c in ("rep", "n", "is_left", "is_right", "home"))
        li, ri = np.flatnonzero(is_left), np.flatnonzero(is_right)
        ids, of = np.unique(rep, return_inverse=True)
        count, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        if len(li):
            u = unit(matrix(t.column("v")))
            x = rotate(u)
            for s, r in product(range(0, len(li), TILE), range(0, len(ri), TILE)):
                a, b = li[s : s + TILE], ri[r : r + TILE]
                i, j = linked(x[a], x[b], key[1].as_py(), limit)
                i, j = a[i], b[j]
                once = ~home[j] | (rep[i] < rep[j])  # two rows of the home cell meet twice
                i, j = i[once], j[once]
                for p in range(0, len(i), PAIRS):
                    y, z = i[p : p + PAIRS], j[p : p + PAIRS]
                    ok = (u[y] * u[z]).sum(1) >= cosine
                    y, z = y[ok], z[ok]
                    np.add.at(count, of[y], n[z])
                    np.add.at(count, of[z], n[y])
                    forest.link(of[y], of[z])
        v = np.flatnonzero(count)
        return pa.table({"rep": ids[v], "links": count[v], "root": ids[forest.root[v]]})

    found = cut(tasks.groupBy("d", "block", "cell", "l", "r").applyInArrow(meet, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rows = cut(good.join(copies.join(links, "rep", "left"), "v").select("id", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    bridges = rows.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a")  # an id with several vectors
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionAll(rows.join(bridges, "id").select("a", F.col("rep").alias("b")))
    comp = components(edges)
    named = copies.select("rep", "first_id").join(comp, F.col("rep") == F.col("node"), "left").select("rep", "first_id", F.coalesce("root", "rep").alias("root"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = rows.join(named.join(names, "root").select("rep", "component_id"), "rep").select("id", "n_links", "component_id")
    everything = final.unionAll(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return everything.select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
