"""From joined statements to the metric panel, in one pass over each entity's years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balancebeam.functions.scalars import finite, safe_div, tax_rate_roic
from balancebeam.metrics.registry import metrics

READ_PERIODS, SCORED_PERIODS, CYCLE_YEARS = 6, 5, 10
MOMENTUM = ("return_12m1m", "risk_adjusted_3m", "risk_adjusted_6m")


def newest_first(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("fiscal_year"))


def roic() -> F.Column:
    capital = F.col("total_equity") + F.col("total_debt") - F.coalesce(F.col("cash"), F.lit(0.0))
    return safe_div(F.col("ebit") * (1 - tax_rate_roic()), capital)


def with_earnings_cycle(panel: DataFrame, history: DataFrame | Column | None = None) -> DataFrame:
    """Mean, count and latest of the newest <= 10 reported net incomes up to each row's year.

    ``history`` (ticker, fiscal_year, net_income) holds them for more years than the panel; without it the panel's own are taken. Its rows pass through the same window as the panel's, behind
    those of their year, so every period has its own cut of the history without a join of years to years. Where the panel's own rows report it, ``history`` is a column of them: an array of
    (fiscal_year, net_income) that a row reports. Then the entity's arrays meet in the panel's window and no second table is made, dealt and sorted.
    """
    if isinstance(history, Column):
        # of equal years, what stands first in its row's array is newer
        entry = F.transform(history, lambda e, i: F.struct(e["fiscal_year"].alias("fiscal_year"), (-i).alias("place"), e["net_income"].alias("net_income")))
        reported = F.flatten(F.collect_list(entry).over(newest_first("ticker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        known = F.filter("_reported", lambda e: e["net_income"].isNotNull() & (e["fiscal_year"].isNull() | (e["fiscal_year"] <= F.col("fiscal_year"))))
        rows = panel.withColumn("_reported", reported).withColumn("_ni", F.transform(F.slice(F.sort_array(known, asc=False), 1, CYCLE_YEARS), lambda e: e["net_income"]))
        return _cycle_figures(rows).drop("_reported", "_ni")
    if history is None:
        rows, latest = panel.withColumn("_past", F.col("net_income")).withColumn("_own", F.lit(1)), newest_first("ticker")
    else:
        past = history.select("ticker", "fiscal_year", F.col("net_income").alias("_past"), F.lit(0).alias("_own"))
        rows = panel.withColumn("_past", F.lit(None).cast("double")).withColumn("_own", F.lit(1)).unionByName(past, allowMissingColumns=True)
        latest = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"), F.desc("_own"))
    ni = F.slice(F.collect_list("_past").over(latest.rowsBetween(0, Window.unboundedFollowing)), 1, CYCLE_YEARS)
    return _cycle_figures(rows.withColumn("_ni", ni).filter("_own = 1")).drop("_ni", "_past", "_own")


def _cycle_figures(rows: DataFrame) -> DataFrame:
    mean = F.aggregate("_ni", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_ni"), F.lit(0))
    return rows.withColumns({"cycle_years": F.size("_ni"), "cycle_latest": F.get("_ni", F.lit(0)), "cycle_mean": mean})


def newest_common_periods(panel: DataFrame) -> DataFrame:
    """Each statement cut to its newest six years, then the years present in all three; year_index 0 is the newest."""
    w = newest_first("ticker")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rank = F.greatest(F.row_number().over(w), F.sum(F.col("has_balance").cast("int")).over(run), F.sum(F.col("has_cash_flow").cast("int")).over(run))
    return (
        panel.withColumn("_rank", rank)
        .filter((F.col("_rank") <= READ_PERIODS) & F.col("has_balance") & F.col("has_cash_flow"))
        .withColumn("year_index", F.row_number().over(w) - 1)
        .drop("_rank", "has_balance", "has_cash_flow")
    )


def with_history(series: DataFrame) -> DataFrame:
    """Row ratios, then every lookback and trailing statistic of the series over one window specification."""
    w = newest_first("ticker")
    older = w.rowsBetween(0, Window.unboundedFollowing)
    five = w.rowsBetween(0, 4)
    base = (
        series.withColumn("eps", F.coalesce("eps_diluted", "eps_basic"))
        .withColumn("gross_margin", safe_div("gross_profit", "revenue"))
        .withColumn("operating_margin", safe_div("operating_income", "revenue"))
        .withColumn("roa", safe_div("net_income", "total_assets"))
        .withColumn("roic", roic())
        .withColumn("current_ratio", safe_div("total_current_assets", "total_current_liabilities"))
        .withColumn("asset_turnover", safe_div("revenue", "total_assets"))
        .withColumn("lt_leverage", safe_div("long_term_debt", "total_assets"))
    )
    extra = {f"prev_{c}": F.lead(c).over(w) for c in ("roa", "lt_leverage", "current_ratio", "shares_diluted", "gross_margin",
                                                      "asset_turnover", "total_assets")}
    extra["has_prior"] = F.lead(F.lit(True), 1, False).over(w)
    extra["dividends_paid_3"] = F.lead("dividends_paid", 3).over(w)
    for line in ("revenue", "net_income", "eps", "operating_cash_flow", "free_cash_flow", "total_equity"):
        for k in (1, 3, 5):
            extra[f"{line}_{k}"] = F.lead(line, k).over(w)
    for c in ("gross_margin", "operating_margin", "revenue", "eps"):
        extra[f"{c}_mean"] = F.avg(c).over(older)
        extra[f"{c}_sd"] = F.stddev_samp(c).over(older)
    for c in ("roic", "gross_margin", "operating_margin"):
        extra[f"{c}_mean5"] = F.avg(c).over(five)
    # enterprise value is today's: the snapshot's own, else from the newest balance sheet of the series
    newest = w.rowsBetween(Window.unboundedPreceding, 0)
    extra["_debt0"] = F.first("total_debt").over(newest)
    extra["_cash0"] = F.first("cash").over(newest)
    ev = F.col("market_cap") + F.coalesce("_debt0", F.lit(0.0)) - F.coalesce("_cash0", F.lit(0.0))
    if "snapshot_ev" in base.columns:
        ev = F.coalesce("snapshot_ev", ev)
    return base.withColumns(extra).withColumn("enterprise_value", ev)


def metric_panel_wide(panel: DataFrame, momentum: DataFrame | None = None, history: DataFrame | Column | None = None) -> DataFrame:
    """(ticker, sector, period_key, year_index, 81 metrics). ``panel`` has one row per entity and year with the three statements joined, and may have today's enterprise value as snapshot_ev.

    ``momentum`` has one row per entity; it is joined by key, so its size does not matter. Without it the panel's own columns of that name are taken, if it has them. ``history``: yearly net incomes (see ``with_earnings_cycle``).
    """
    series = newest_common_periods(with_earnings_cycle(panel, history))
    if momentum is None:
        for c in set(MOMENTUM) - set(series.columns):
            series = series.withColumn(c, F.lit(None).cast("double"))
    else:
        series = series.join(momentum.select("ticker", *MOMENTUM), "ticker", "left")
    rows = with_history(series).filter(F.col("year_index") < SCORED_PERIODS)
    return rows.select("ticker", "sector", "period_key", "fiscal_year", "year_index", *[m.expr().alias(m.key) for m in metrics()])


def metric_panel_long(wide: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """(ticker, sector, period_key, year_index, metric_key, raw_value, is_missing) of all metrics, or of those named."""
    keys = [m.key for m in metrics()] if keys is None else list(keys)
    long = wide.unpivot(["ticker", "sector", "period_key", "year_index"], keys, "metric_key", "raw_value")
    return long.withColumn("raw_value", finite("raw_value")).withColumn("is_missing", F.col("raw_value").isNull())


def metric_null_coverage(wide: DataFrame) -> DataFrame:
    """(metric_key, n, missing, missing_share): counted on the wide rows, unpivoted only after the aggregation."""
    keys = [m.key for m in metrics()]
    one = wide.agg(F.count(F.lit(1)).alias("n"), *[F.count(finite(k)).alias(k) for k in keys])
    long = one.unpivot(["n"], keys, "metric_key", "present")
    missing = F.col("n") - F.col("present")
    return long.select("metric_key", "n", missing.alias("missing"), F.try_divide(missing, F.col("n")).alias("missing_share"))
