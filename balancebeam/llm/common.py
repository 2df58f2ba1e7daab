"""What several operators share: lineage cuts, connected components, a local forest and a bounded memo."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancebeam.session import ensure_checkpoint_dir, shuffles_freed, workers_import  # noqa: F401  (the operators take it from here)


def release_memory() -> None:
    """Give back what earlier tasks of a reused Python worker have freed but its allocators still hold. Nothing depends on it but the worker's size."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs a read and not the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame keeps the setting it was made under


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


class Memo(dict):
    """A memo of two generations: when the young one is full it becomes the old one, so at most twice ``size`` entries stay. Only speed depends on it."""

    def __init__(self, make, size: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Forest:
    """Connected components of local indices; keeps one root per vertex, never the links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.root
        while len(i):
            a, b = r[i], r[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(r, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = r[r]
                if np.array_equal(up, r):
                    break
                r[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(vertex, root) for each vertex that is not its own root."""
        v = np.flatnonzero(self.root != np.arange(len(self.root)))
        return v, self.root[v]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds. A round is an aggregate that combines before its shuffle and a join whose other side has one row per
    node, so a node with a third of all links is split by the skew join. Every round is written to the shared checkpoint folder.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _state(e: DataFrame) -> tuple:
    with shuffles_freed(e.sparkSession):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
