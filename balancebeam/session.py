"""Session defaults shared by the entry point, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def build_session(app: str = "balancebeam", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a local master, or a folder that all machines share); else ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder only where none is set (tests)."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="balancebeam-ckpt-"))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write or checkpoint made inside are removed when it has ended, since what it wrote stands for them, instead of when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_blocks: list[list[str]] = []  # folders that calls of stored_alone, one inside the other, have seen so far


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    if _blocks:
        _blocks[-1].append(folder)
    return folder


def _write(df: DataFrame, folder: str, *by: str) -> None:
    with shuffles_freed(df.sparkSession):
        # v2 pages: sorted numbers are written as differences
        df.write.option("compression", "zstd").option("parquet.writer.version", "v2").mode("overwrite").partitionBy(*by).parquet(folder)


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder as Parquet and read back: cuts the lineage as a checkpoint does, in compressed columns."""
    return stored_all([df])


def stored_all(frames: Iterable[DataFrame]) -> DataFrame:
    """The rows of all frames, which have the same columns. They are written one after another, so no more than one frame's shuffle is on disk."""
    folders = []
    for df in frames:
        folders.append(_folder(df.sparkSession))
        _write(df, folders[-1])
    return df.sparkSession.read.schema(df.schema).parquet(*folders)


def stored_alone(make: Callable[[], DataFrame], *more: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` and ``more`` return, which has the same columns, stored in turn. The files of all tables that a turn stored on the way are then emptied: nothing else may read them."""
    folders = []
    for turn in (make, *more):
        _blocks.append([])
        try:
            df = turn()
        finally:
            inner = _blocks.pop()
        folders.append(_folder(df.sparkSession))
        _write(df, folders[-1])
        for folder in inner:
            _write(df.sparkSession.createDataFrame([], df.schema), folder)
    return df.sparkSession.read.schema(df.schema).parquet(*folders)


def emptied(df: DataFrame) -> None:
    """Empty the files of a stored table, which nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _write(df.sparkSession.createDataFrame([], df.schema), folder)


def stored_slices(df: DataFrame, keys: Sequence[str], slices: int) -> Iterator[DataFrame]:
    """The rows of ``df`` in turn by a hash of ``keys``, from files that are written once. A turn's files are emptied when the next is asked for: it must be used up by then."""
    spark, schema, folder = df.sparkSession, df.schema, _folder(df.sparkSession)
    _write(df.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")), folder, "_slice")
    for k in range(slices):
        yield spark.read.schema(StructType([*schema, StructField("_slice", IntegerType())])).parquet(folder).where(F.col("_slice") == k).drop("_slice")
        _write(spark.createDataFrame([], schema), f"{folder}/_slice={k}")
