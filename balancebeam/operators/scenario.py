"""Growth and return-on-capital history, scenario bands, the three-case sweep and its dominant driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancebeam.functions.scalars import clamp, fcf_of, ratio_pos, round_to_half, tax_rate_scenario

YEARS, EXIT_PE_FALLBACK, EXIT_PE_SWING = 5, 15.0, 0.3
EXIT_PE_BOUNDS, GROWTH_RANGE, MARGIN_RANGE, EXIT_PE_RANGE = (8.0, 25.0), (-0.1, 0.3), (0.0, 0.5), (5.0, 40.0)
# Median, low, high used when an entity has no usable history.
CONVENTION = {"growth": (0.05, 0.0, 0.1), "margin": (0.1, 0.05, 0.15)}


def growth_roic_series(income: DataFrame, balance: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, revenue_growth, roic, invested_capital, guard)."""
    w = Window.partitionBy("ticker").orderBy("fiscal_year")
    sheet = balance.select("ticker", "fiscal_year", "total_equity", "total_debt", "cash", "total_assets", F.lit(True).alias("_sheet"))
    rows = income.join(sheet, ["ticker", "fiscal_year"], "left")
    prior, prior_year = F.lag("revenue").over(w), F.lag("fiscal_year").over(w)
    growth = F.when((prior_year == F.col("fiscal_year") - 1) & (prior > 0), F.col("revenue") / F.nullif(prior, F.lit(0.0)) - 1)
    known = F.col("_sheet").isNotNull() & F.col("operating_income").isNotNull() & F.col("total_equity").isNotNull()
    capital = F.when(known, F.col("total_equity") + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)))
    floor = F.coalesce(F.col("total_assets") * 0.1, F.lit(0.0))
    small = (capital <= 0) | (capital <= floor)
    guard = F.when(~known, "insufficient-data").when(small, "reinvestment-base-too-small")
    out = rows.withColumns({"revenue_growth": growth, "invested_capital": capital, "guard": guard})
    nopat = F.col("operating_income") * (1 - tax_rate_scenario())
    roic = F.when(F.col("guard").isNull(), nopat / F.nullif(F.col("invested_capital"), F.lit(0.0)))
    return out.select("ticker", "fiscal_year", "revenue_growth", roic.alias("roic"), "invested_capital", "guard")


def scenario_bands(income: DataFrame, cash_flow: DataFrame, market: DataFrame) -> DataFrame:
    """Per entity: median, low and high of historical growth and margin (or the convention), suggested exit multiple, cash conversion.

    ``market``: (ticker, share_price, shares_outstanding).
    """
    w = Window.partitionBy("ticker").orderBy("fiscal_year")
    prior = F.lag("revenue").over(w)
    growth = F.when((F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1) & (prior > 0), F.col("revenue") / F.nullif(prior, F.lit(0.0)) - 1)
    rows = income.withColumns({"_g": growth, "_m": ratio_pos("operating_income", "revenue")})
    flows = cash_flow.select("ticker", "fiscal_year", fcf_of().alias("_fcf"))
    rows = rows.join(flows, ["ticker", "fiscal_year"], "left").withColumn("_conv", ratio_pos("_fcf", "net_income"))
    aggs = [F.median("_conv").alias("cash_conversion"), F.max_by(F.struct("net_income", "shares_diluted"), "fiscal_year").alias("_last"),
            F.max_by(F.struct("revenue", tax_rate_scenario().alias("tax")), F.when(F.col("revenue") > 0, F.col("fiscal_year"))).alias("_base")]
    for name, col in (("growth", "_g"), ("margin", "_m")):
        aggs += [F.median(col).alias(f"_{name}_median"), F.min(col).alias(f"_{name}_low"), F.max(col).alias(f"_{name}_high"), F.count(col).alias(f"{name}_observations")]
    out = rows.groupBy("ticker").agg(*aggs).join(market, "ticker", "left")
    shares = F.coalesce("shares_outstanding", "_last.shares_diluted")
    pe = F.when((F.col("share_price") > 0) & (shares > 0), ratio_pos(F.col("share_price") * shares, "_last.net_income"))
    cols = {f"{n}_{s}": F.coalesce(f"_{n}_{s}", F.lit(CONVENTION[n][i])) for n in CONVENTION for i, s in enumerate(("median", "low", "high"))}
    out = out.withColumns({**cols, "exit_pe": round_to_half(clamp(F.coalesce(pe, F.lit(EXIT_PE_FALLBACK)), *EXIT_PE_BOUNDS)),
                           "revenue_base": F.col("_base.revenue"), "tax_rate": F.col("_base.tax"), "shares": shares})
    return out.select("ticker", *cols, "growth_observations", "margin_observations", "exit_pe", "cash_conversion", "revenue_base", "tax_rate", "shares", "share_price")


def valued(growth: Column, margin: Column, exit_pe: Column, years: int = YEARS) -> tuple[Column, Column, Column]:
    """(reason, implied price, annualised return) from the entity columns revenue_base, shares, share_price, tax_rate."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    reason = (
        F.when(bad(F.col("revenue_base") > 0), "no-revenue").when(bad(F.col("shares") > 0), "no-shares").when(bad(F.col("share_price") > 0), "no-price")
        .when(bad(growth > -1), "growth-too-low").when(bad(margin >= 0), "negative-margin").when(bad(exit_pe > 0), "no-exit-multiple")
    )
    revenue = F.col("revenue_base") * F.pow(1 + growth, F.lit(float(years)))
    price = revenue * margin * (1 - clamp("tax_rate", 0.0, 0.5)) / F.nullif(F.col("shares"), F.lit(0.0)) * exit_pe
    implied = F.when(reason.isNull(), price)
    rate = F.when(reason.isNull(), F.pow(price / F.nullif(F.col("share_price"), F.lit(0.0)), F.lit(1.0 / years)) - 1)
    return reason, implied, rate


def _base(df: DataFrame) -> DataFrame:
    return df.withColumns({"_g": clamp("growth_median", *GROWTH_RANGE), "_m": clamp("margin_median", *MARGIN_RANGE), "_e": clamp("exit_pe", *EXIT_PE_RANGE)})


def scenario_sweep(bands: DataFrame) -> DataFrame:
    """Entity x {bull, base, bear}: implied price and annualised return, or a reason."""
    spark: SparkSession = bands.sparkSession
    cases = F.broadcast(spark.createDataFrame([("bull", 1.0), ("base", 0.0), ("bear", -1.0)], "scenario string, sign double"))
    rows = _base(bands).crossJoin(cases)
    g = F.when(F.col("sign") == 0, F.col("_g")).otherwise(clamp(F.col("_g") + F.col("sign") * (F.col("growth_high") - F.col("growth_low")) / 2, *GROWTH_RANGE))
    m = F.when(F.col("sign") == 0, F.col("_m")).otherwise(clamp(F.col("_m") + F.col("sign") * (F.col("margin_high") - F.col("margin_low")) / 2, *MARGIN_RANGE))
    e = F.when(F.col("sign") == 0, F.col("_e")).otherwise(clamp(F.col("_e") * (1 + F.col("sign") * EXIT_PE_SWING), *EXIT_PE_RANGE))
    rows = rows.withColumns({"growth": g, "margin": m, "exit_multiple": e})
    reason, implied, rate = valued(F.col("growth"), F.col("margin"), F.col("exit_multiple"))
    return rows.select("ticker", "scenario", "growth", "margin", "exit_multiple", implied.alias("implied_price"), rate.alias("annualized_return"), reason.alias("reason"))


def scenario_driver(bands: DataFrame) -> DataFrame:
    """The input whose low-to-high swing moves the return most; the first wins ties."""
    rows = _base(bands)
    spread = lambda lo, hi: F.abs(valued(*hi)[2] - valued(*lo)[2])
    g, m, e = F.col("_g"), F.col("_m"), F.col("_e")
    rows = rows.withColumns({
        "growth_spread": spread((F.col("growth_low"), m, e), (F.col("growth_high"), m, e)),
        "margin_spread": spread((g, F.col("margin_low"), e), (g, F.col("margin_high"), e)),
        "exit_pe_spread": spread((g, m, e * (1 - EXIT_PE_SWING)), (g, m, e * (1 + EXIT_PE_SWING)))})
    widest = F.greatest("growth_spread", "margin_spread", "exit_pe_spread")
    driver = F.when(F.col("growth_spread") == widest, "growth").when(F.col("margin_spread") == widest, "margin").when(F.col("exit_pe_spread") == widest, "exit_pe")
    return rows.select("ticker", "growth_spread", "margin_spread", "exit_pe_spread", driver.alias("driver"))
