"""A stored table whose rows are replaced by key, batch by batch, such that a batch may be replayed.

Rows lie in hash buckets. A batch writes new files for the buckets it touches (its own version of them) and then a manifest that names the version of every bucket; nothing
that an earlier manifest names is changed. A batch that fails before its manifest has changed nothing that a reader sees, one that is replayed starts from the manifest before it
and writes the same again. Batches are numbered in ascending order, as Structured Streaming numbers them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, version bigint, batch bigint"
NONE = -1  # stands in a manifest so that one without any bucket is a manifest too


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int = 64, bucket_by: Sequence[str] | None = None):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, list(keys), schema, buckets
        self.bucket_by = list(bucket_by or keys)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def versions(self, below: int | None = None) -> dict[int, int]:
        """Bucket to version of the last manifest (before batch ``below``): at most as many entries as buckets."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        rows = rows if below is None else rows.filter(F.col("batch") < below)
        last = rows.agg(F.max("batch")).first()[0]
        return {} if last is None else {r.bucket: r.version for r in rows.filter(F.col("batch") == last).collect() if r.bucket != NONE}

    def read(self, below: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The current rows; only the files that the manifest names are read."""
        named = {b: v for b, v in self.versions(below).items() if only is None or b in only}
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        if not named:
            return self.spark.createDataFrame([], self.schema)
        version = F.create_map(*[F.lit(x) for b, v in named.items() for x in (b, v)])
        rows = self.spark.read.schema(f"{self.schema}, _version bigint, _bucket int").parquet(f"{self.path}/data")
        return rows.filter(F.col("_bucket").isin(list(named)) & (F.try_element_at(version, F.col("_bucket")) == F.col("_version"))).select(*columns)

    def replace(self, number: int, keys: DataFrame, rows: DataFrame) -> None:
        """As batch ``number``: the rows of these keys are ``rows`` from now on, none where ``rows`` has none. Buckets that hold none of the keys are not read or written."""
        keys = keys.select(*self.keys).distinct().persist()
        before = self.versions(number)
        touched = sorted(r.b for r in keys.select(self._bucket().alias("b")).distinct().collect())
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in self.keys]
        stay = self.read(number, touched).alias("s").join(keys.alias("k"), same, "left_anti")
        merged = stay.unionByName(rows.select(*stay.columns)).withColumn("_version", F.lit(number).cast("bigint")).withColumn("_bucket", self._bucket())
        # a bucket that is left without rows gets no files, and no rows is what its version then reads as
        merged.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_version", "_bucket").parquet(f"{self.path}/data")
        entries = [*{**before, **{b: number for b in touched}}.items(), (NONE, number)]
        manifest = self.spark.createDataFrame(entries, "bucket int, version bigint").withColumn("batch", F.lit(number).cast("bigint"))
        manifest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/manifest")
        keys.unpersist()
