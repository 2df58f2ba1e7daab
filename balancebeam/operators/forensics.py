"""Seven forensic checks on the newest fiscal year and its predecessors, for every entity at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancebeam.functions.dims import EV_EXCLUDED_SECTORS, FORENSIC_CHECKS
from balancebeam.functions.scalars import clamp, growth_pos_base, ratio_pos, round_half_up

LINES = ("revenue", "gross_profit", "operating_income", "ebit", "net_income", "shares_diluted", "receivables", "inventory", "total_assets", "total_liabilities",
         "total_current_assets", "total_current_liabilities", "retained_earnings", "operating_cash_flow")


def newest_periods(periods: DataFrame) -> DataFrame:
    """One row per entity: each line as of the newest year (x0), the year before (x1) and, for the margin, two before (x2).

    ``periods`` is the outer join of the statements with sector and market_cap; years count by position, not by calendar.
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    ranked = periods.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 3)
    at = lambda c, k: F.max(F.when(F.col("_k") == k + 1, F.col(c))).alias(f"{c}{k}")
    aggs = [at(c, k) for c in LINES for k in (0, 1)] + [at("revenue", 2), at("gross_profit", 2), at("fiscal_year", 0)]
    return ranked.groupBy("ticker").agg(F.first("sector").alias("sector"), F.first("market_cap").alias("market_cap"), *aggs)


def c(name: str) -> Column:
    return F.col(name)


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def suppressed() -> Column:
    """The two model scores are withheld for these exact sector names."""
    return yes(c("sector").isin(list(EV_EXCLUDED_SECTORS)))


def _check(key: str, computable: Column, tripped: Column, elevated: Column, value: Column) -> Column:
    severity = F.when(computable & yes(tripped), F.when(yes(elevated), "elevated").otherwise("noteworthy"))
    return F.struct(F.lit(key).alias("key"), computable.alias("checked"), severity.alias("severity"), value.alias("value"))


def altman_z() -> Column:
    ta = F.when(c("total_assets0") > 0, c("total_assets0"))
    tl = F.when(c("total_liabilities0") > 0, c("total_liabilities0"))
    ebit = F.coalesce("operating_income0", "ebit0")
    return (1.2 * ((c("total_current_assets0") - c("total_current_liabilities0")) / ta) + 1.4 * (c("retained_earnings0") / ta) + 3.3 * (ebit / ta)
            + 0.6 * (c("market_cap") / tl) + 1.0 * (c("revenue0") / ta))


def accrual_ratio() -> Column:
    return ratio_pos(c("net_income0") - c("operating_cash_flow0"), "total_assets0")


def growth_gap(line: Column, prior: Column) -> Column:
    return round_half_up((growth_pos_base(line, prior) - growth_pos_base("revenue0", "revenue1")) * 100, 1)


def margin(k: int) -> Column:
    return ratio_pos(f"gross_profit{k}", f"revenue{k}")


def quality_parts() -> dict[str, Column]:
    lev = lambda k: ratio_pos(f"total_liabilities{k}", f"total_assets{k}")
    both = (c("revenue0") > 0) & (c("revenue1") > 0) & (c("receivables1") > 0)
    return {
        "dsri": F.when(both, c("receivables0") / c("revenue0") / (c("receivables1") / c("revenue1"))),
        "gmi": F.when(margin(0) > 0, margin(1) / margin(0)),
        "sgi": ratio_pos("revenue0", "revenue1"),
        "lvgi": F.when(lev(1) > 0, lev(0) / lev(1)),
        "tata": accrual_ratio(),
    }


def checks(newest: DataFrame) -> DataFrame:
    """Add ``checks``: one struct (key, checked, severity, value) per check, in report order."""
    parts = quality_parts()
    df = newest.withColumns({"_z": altman_z(), "_acc": accrual_ratio(), **{f"_{k}": v for k, v in parts.items()}})
    df = df.withColumns({
        "_rec": growth_gap(c("receivables0"), c("receivables1")),
        "_inv": growth_gap(F.when(c("inventory0") > 0, c("inventory0")), F.when(c("inventory1") > 0, c("inventory1"))),
        "_gm1": round_half_up((margin(1) - margin(0)) * 10000, 1), "_gm2": round_half_up((margin(2) - margin(0)) * 10000, 1),
        "_dil": round_half_up(growth_pos_base("shares_diluted0", "shares_diluted1") * 100, 2),
        **{f"_{k}w": clamp(f"_{k}", 0.2, 5.0) for k in ("dsri", "gmi", "sgi", "lvgi")}, "_tataw": clamp("_tata", -0.5, 0.5)})
    # the three terms without a line item enter at their neutral value of one
    index = -4.84 + 0.92 * c("_dsriw") + 0.528 * c("_gmiw") + 0.892 * c("_sgiw") + 4.679 * c("_tataw") - 0.327 * c("_lvgiw") + (0.404 + 0.115 - 0.172)
    whole = F.lit(True)
    for k in parts:
        whole = whole & c(f"_{k}").isNotNull()
    df = df.withColumn("_index", F.when(whole, index))
    elevated_parts = sum((yes(x).cast("int") for x in (c("_dsriw") > 1.2, c("_gmiw") > 1.1, c("_sgiw") > 1.3, c("_tataw") > 0.05)), F.lit(0))
    pairs = [c("net_income0"), c("net_income1"), c("operating_cash_flow0"), c("operating_cash_flow1")]
    divergence_known = pairs[0].isNotNull() & pairs[1].isNotNull() & pairs[2].isNotNull() & pairs[3].isNotNull()
    diverging = divergence_known & (pairs[0] > pairs[1]) & (pairs[2] < pairs[3])
    high = yes(c("_acc") > 0.1)
    fall1, fall2 = yes(c("_gm1") > 300), yes(c("_gm2") > 500)
    keys = FORENSIC_CHECKS
    listed = [
        _check(keys[0], ~suppressed() & c("_z").isNotNull(), c("_z") <= 2.99, c("_z") < 1.81, c("_z")),
        _check(keys[1], divergence_known | c("_acc").isNotNull(), yes(diverging) | high, high, c("_acc")),
        _check(keys[2], c("_rec").isNotNull(), c("_rec") > 15, c("_rec") > 30, c("_rec")),
        _check(keys[3], c("_inv").isNotNull(), c("_inv") > 15, c("_inv") > 30, c("_inv")),
        _check(keys[4], c("_gm1").isNotNull(), fall1 | fall2, c("_gm1") > 500, F.when(fall1, c("_gm1")).otherwise(c("_gm2"))),
        _check(keys[5], c("_dil").isNotNull(), c("_dil") > 2, c("_dil") > 5, c("_dil")),
        _check(keys[6], ~suppressed() & c("_index").isNotNull(), (c("_index") > -1.5) & (elevated_parts >= 2), F.lit(False), c("_index")),
    ]
    return df.withColumn("checks", F.array(*listed)).withColumn("is_suppressed", suppressed()).select("ticker", "sector", "fiscal_year0", "is_suppressed", "checks")


def forensic_report(newest: DataFrame) -> DataFrame:
    """Per entity: flags (elevated first, then report order), how many checks were computable, which were withheld."""
    out = checks(newest)
    tripped = F.filter(F.transform("checks", lambda x, i: F.struct((x["severity"] != "elevated").cast("int").alias("sev"), i.alias("no"), x["key"].alias("key"),
                                                                   x["severity"].alias("severity"), x["value"].alias("value"))), lambda x: x["severity"].isNotNull())
    flags = F.transform(F.array_sort(tripped), lambda x: F.struct(x["key"].alias("key"), x["severity"].alias("severity"), x["value"].alias("value")))
    withheld = F.when(F.col("is_suppressed"), F.array(F.lit("altmanZ"), F.lit("earningsQualityIndex"))).otherwise(F.array().cast("array<string>"))
    return out.select("ticker", "sector", flags.alias("flags"), F.size(F.filter("checks", lambda x: x["checked"])).alias("checked_count"), withheld.alias("suppressed"))


def single_check(newest: DataFrame, key: str) -> DataFrame:
    """(ticker, checked, severity, value) for one check; the value only where the check is computable."""
    no = FORENSIC_CHECKS.index(key)
    x = F.col("checks")[no]
    return checks(newest).select("ticker", x["checked"].alias("checked"), x["severity"].alias("severity"), F.when(x["checked"], x["value"]).alias("value"))


def base_rates(spark: SparkSession, report: DataFrame) -> DataFrame:
    """Trips and percentage per check over entities with a computable check; every check listed."""
    covered = report.filter("checked_count > 0")
    total = covered.agg(F.count(F.lit(1)).alias("total"))
    trips = covered.select(F.explode("flags").alias("f")).groupBy(F.col("f.key").alias("key")).agg(F.count(F.lit(1)).alias("tripped"))
    dim = spark.createDataFrame([(k,) for k in FORENSIC_CHECKS], "key string")
    out = dim.join(trips, "key", "left").crossJoin(total).withColumn("tripped", F.coalesce("tripped", F.lit(0)))
    return out.select("key", "tripped", F.when(F.col("total") > 0, round_half_up(F.try_divide("tripped", "total") * 100, 1)).otherwise(0.0).alias("pct"))
