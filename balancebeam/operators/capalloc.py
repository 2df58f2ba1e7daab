"""Capital-allocation trends: the newest five fiscal years of every entity, newest against oldest usable value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balancebeam.functions.scalars import fcf_of, ratio_pos, safe_div, tax_rate_capalloc

WINDOW_YEARS, RELATIVE_BAND, PROFIT_BAND, SHARE_BAND, MIN_CAPITAL_GROWTH = 5, 0.1, 0.005, 0.005, 0.15


def _ends(name: str, value: Column) -> list[Column]:
    """Newest and oldest usable value of a series with their years, plus its length."""
    year = F.when(value.isNotNull(), F.col("fiscal_year"))
    return [F.max_by(value, year).alias(f"{name}_new"), F.min_by(value, year).alias(f"{name}_old"), F.max(year).alias(f"{name}_ny"),
            F.min(year).alias(f"{name}_oy"), F.count(value).alias(f"{name}_n")]


def relative_trend(name: str, falling_is_better: bool, band: float = RELATIVE_BAND) -> Column:
    new, old = F.col(f"{name}_new"), F.col(f"{name}_old")
    scale = F.greatest(F.abs(new), F.abs(old))
    return _direction(F.coalesce((new - old) / F.nullif(scale, F.lit(0.0)), F.lit(0.0)), falling_is_better, band)


def absolute_trend(name: str, falling_is_better: bool, band: float) -> Column:
    return _direction(F.col(f"{name}_new") - F.col(f"{name}_old"), falling_is_better, band)


def _direction(change: Column, falling_is_better: bool, band: float) -> Column:
    better = change < 0 if falling_is_better else change >= 0
    return F.when(F.abs(change) < band, "flat").when(better, "improving").otherwise("deteriorating")


def summary_rows(periods: DataFrame) -> DataFrame:
    """One row per entity with the ends of every series. ``periods``: outer join of the statements with sector and a flag per statement."""
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    rows = periods.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= WINDOW_YEARS)
    net_debt = F.col("total_debt") - F.col("cash")
    op = F.col("operating_income")
    invested = F.col("total_equity") + F.col("total_debt") - F.col("cash")
    nopat = op * (1 - tax_rate_capalloc())
    capital = F.when(invested.isNotNull() & nopat.isNotNull(), F.struct(invested.alias("invested"), nopat.alias("nopat")))
    flows = F.struct(fcf_of().alias("fcf"), "stock_buybacks", "stock_issuance", "dividends_paid", "fiscal_year")
    has_flows = F.coalesce("has_cash_flow", F.lit(False))
    return rows.groupBy("ticker").agg(
        F.first("sector").alias("sector"),
        *_ends("net_debt", net_debt), *_ends("leverage", F.when((net_debt > 0) & (op > 0), net_debt / op)),
        *_ends("coverage", safe_div(op, F.abs(F.col("interest_expense")))), *_ends("gp", ratio_pos("gross_profit", "total_assets")),
        *_ends("capital", capital), *_ends("shares", F.when(F.col("shares_diluted") > 0, F.col("shares_diluted"))),
        F.max_by(flows, F.when(has_flows, F.col("fiscal_year"))).alias("flow"))


def _balance() -> list[Column]:
    held = F.coalesce(F.col("sector") == "Financials", F.lit(False))
    show = lambda x: F.when(~held, x)
    comparable = (F.col("coverage_n") > 1) & (F.col("coverage_new") > 0) & (F.col("coverage_old") > 0)
    return [
        held.alias("suppressed"), show(F.col("net_debt_new")).alias("net_debt"), show(F.col("net_debt_old")).alias("net_debt_start"),
        show(F.when(F.col("net_debt_n") > 1, relative_trend("net_debt", True))).alias("net_debt_trend"),
        show(F.col("leverage_new")).alias("leverage"), show(F.when(F.col("leverage_n") > 1, relative_trend("leverage", True))).alias("leverage_trend"),
        show(F.col("coverage_new")).alias("coverage"), show(F.when(comparable, relative_trend("coverage", False))).alias("coverage_trend")]


def balance_sheet(rows: DataFrame) -> DataFrame:
    return rows.select("ticker", *_balance())


def _reinvestment() -> list[Column]:
    new, old = F.col("capital_new"), F.col("capital_old")
    added = new["invested"] - old["invested"]
    pair = F.col("capital_n") > 1
    grew = pair & (old["invested"] > 0) & (added > MIN_CAPITAL_GROWTH * old["invested"])
    return [
        F.col("gp_new").alias("gross_profitability"), F.when(F.col("gp_n") > 1, absolute_trend("gp", False, PROFIT_BAND)).alias("gross_profitability_trend"),
        F.when(grew, (new["nopat"] - old["nopat"]) / F.nullif(added, F.lit(0.0))).alias("incremental_return"),
        F.when(pair, F.when(grew, "measured").otherwise("base-too-small")).alias("incremental_status")]


def reinvestment(rows: DataFrame) -> DataFrame:
    return rows.select("ticker", *_reinvestment())


def _share_rate() -> Column:
    years = F.col("shares_ny") - F.col("shares_oy")
    return F.when(F.col("shares_n") > 1, F.pow(F.col("shares_new") / F.col("shares_old"), 1 / F.nullif(years, F.lit(0)).cast("double")) - 1)


def _distributions() -> list[Column]:
    f = F.col("flow")
    fcf = f["fcf"]
    net_buybacks = F.abs(f["stock_buybacks"]) - F.abs(F.coalesce(f["stock_issuance"], F.lit(0.0)))
    dividends = F.abs(f["dividends_paid"])
    either = F.coalesce(dividends, net_buybacks).isNotNull()
    total = F.when(either, F.coalesce(dividends, F.lit(0.0)) + F.greatest(F.coalesce(net_buybacks, F.lit(0.0)), F.lit(0.0)))
    rate = _share_rate()
    return [
        f["fiscal_year"].alias("flow_year"), net_buybacks.alias("net_buybacks"), dividends.alias("dividends"), total.alias("distributed"),
        ratio_pos(total, fcf).alias("share_of_fcf"), (total > fcf).alias("beyond_fcf"), rate.alias("share_rate"),
        F.when(rate.isNotNull(), F.when(F.abs(rate) < SHARE_BAND, "flat").when(rate < 0, "improving").otherwise("deteriorating")).alias("share_trend")]


def distributions(rows: DataFrame) -> DataFrame:
    return rows.select("ticker", *_distributions())


def capalloc_summary(rows: DataFrame) -> DataFrame:
    """Trend codes only, one row per entity."""
    return rows.select("ticker", *_balance(), *_reinvestment(), *_distributions()).select(
        "ticker", F.when(F.col("suppressed"), "suppressed").otherwise(F.col("net_debt_trend")).alias("leverage_code"), F.col("gross_profitability_trend").alias("profitability_code"),
        F.when(F.col("beyond_fcf"), "beyond-fcf").when(~F.col("beyond_fcf"), "covered").alias("distribution_code"),
        F.when(F.col("share_trend") != "flat", F.col("share_trend")).alias("share_code"))
