"""Exact positions (1..n) within groups of any size.

No group ever meets in one task: rows are range-partitioned on (group, order), numbered inside each partition, and shifted by the rows the group has in
earlier partitions. The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balancebeam.session import stored, stored_all, stored_slices

SLICES = 8


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "pos", totals: dict[str, Column] | None = None, few: bool = False, slices: int = 1) -> DataFrame:
    """Add 1-based ``out`` per group. The order must be total (end it with a unique key) for the result to be deterministic.

    ``totals`` adds sums over the group to every row, e.g. ``{"n": F.count(F.lit(1))}``; they come with the shift, without a join of their own.
    ``few`` says that the groups are few however many rows there are (metrics, years, sectors, dates): their shifts are written and broadcast, so the rows are shuffled once only.
    ``slices``: the rows are written first and then placed in that many turns, whole groups at a time, so that the disk holds the shuffle of one turn only.
    Rows are written once: pass no more columns than are needed.
    """
    totals = totals or {}
    keys = [F.col(g).asc_nulls_first() for g in group]
    # storing pins each row to its partition: the offsets and the rows must come from the same range bounds. Sorted rows take a fraction of a checkpoint's bytes as Parquet
    ranged = lambda part: part.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    rows = stored(ranged(df)) if slices == 1 else stored_all(ranged(part) for part in stored_slices(df, group, slices))
    # partitions of different slices may share a number: they share no group
    rows = rows.withColumn("_part", F.shiftrightunsigned("_id", 33))
    per_part = rows.groupBy("_part", *group).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), *[a.alias(f"_t_{k}") for k, a in totals.items()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumns({"_base": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), **{f"_t_{k}": F.sum(f"_t_{k}").over(Window.partitionBy(*group)) for k in totals}})
    # at most groups + partitions rows, since every range partition starts at most one group part-way; for many groups adaptive execution picks the join
    renamed = offsets.select(F.col("_part").alias("_o_part"), "_first", "_base", *[f"_t_{k}" for k in totals], *[F.col(g).alias(f"_o_{g}") for g in group])
    same = F.col("_part") == F.col("_o_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    joined = rows.join(F.broadcast(stored(renamed)) if few else renamed, same)
    return joined.select(*df.columns, (F.col("_id") - F.col("_first") + F.col("_base") + 1).alias(out), *[F.col(f"_t_{k}").alias(k) for k in totals])
