"""Canonical sectors, metric applicability and the industry-code mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balancebeam.functions import dims


def canonical_sector(sector) -> Column:
    """'Financials' or 'Real Estate' for any known spelling, else NULL."""
    s = F.regexp_replace(F.lower(F.trim(sector)), r"[\s_-]+", " ")
    out = F.lit(None).cast("string")
    for target in ("Financials", "Real Estate"):
        names = [a for a, t in dims.SECTOR_ALIASES.items() if t == target]
        out = F.when(s.isin(names), target).otherwise(out)
    return out


def rule_rows() -> list[tuple[str, str, str, str]]:
    """(metric_key, kind, canonical sector, reason)."""
    rows = [(m, "excluded", sector, reason) for sector, groups in dims.SECTOR_EXCLUDED.items() for reason, keys in groups.items() for m in keys]
    return rows + [(m, "only", sector, "real-estate-only") for m, sector in dims.SECTOR_ONLY.items()]


def inapplicable_reason(metric_key: Column, sector: Column, canon: Column | None = None) -> Column:
    """Reason code when the metric does not describe the sector, else NULL. An unknown sector keeps excluded metrics and drops restricted ones.

    ``canon``: the canonical sector where the rows already have it."""
    canon = canonical_sector(sector) if canon is None else canon
    only = metric_key.isin(list(dims.SECTOR_ONLY))
    out = F.when(only & ~F.coalesce(canon == "Real Estate", F.lit(False)),
                 F.when(F.trim(F.coalesce(sector, F.lit(""))) == "", "real-estate-only, sector unknown").otherwise("real-estate-only"))
    for name, groups in dims.SECTOR_EXCLUDED.items():
        for reason, keys in groups.items():
            out = out.when((canon == name) & metric_key.isin(list(keys)), reason)
    return out


def gate_sector(values: DataFrame, canon: str | None = None) -> DataFrame:
    """Add ``reason``; rows with a reason must leave the peer group too. ``canon`` names a column with the canonical sector, for rows that repeat an entity per metric."""
    return values.withColumn("reason", inapplicable_reason(F.col("metric_key"), F.col("sector"), None if canon is None else F.col(canon)))


def sic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lo, hi, i, s) for i, (lo, hi, s) in enumerate(dims.SIC_RANGES)], "lo int, hi int, prio int, sector string")


def map_sic_sector(spark: SparkSession, codes: DataFrame, code: str = "sic") -> DataFrame:
    """First matching range wins. The range table is expanded to one row per code (< 10,000 rows), so the lookup is an equi join."""
    per_code = (
        sic_table(spark)
        .select(F.explode(F.sequence("lo", "hi")).alias(code), "prio", "sector")
        .groupBy(code)
        .agg(F.min_by("sector", "prio").alias("mapped_sector"))
    )
    return codes.join(F.broadcast(per_code), code, "left")
