"""Statement joins, interval, nearest and as-of joins.

The as-of joins never cross facts with dates: every row is first reduced to the latest one per (entity, date slot), an aggregate that
combines map-side. The rows left are an entity's changes; each is expanded over the dates it holds for, at the very end. A hot entity is therefore never gathered.
"""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_years(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("fiscal_year"))
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def statements_inner(income: DataFrame, balance: DataFrame, cash_flow: DataFrame, n: int = 6) -> DataFrame:
    """Years present in all three statements, each cut to its newest n first."""
    on = ["ticker", "fiscal_year"]
    drop = [c for c in ("sector", "period_key", "period_end") if c in balance.columns]
    out = newest_years(income, n).join(newest_years(balance.drop(*drop), n), on).join(newest_years(cash_flow.drop(*drop), n), on)
    return newest_years(out, n)


def statements_outer(income: DataFrame, balance: DataFrame, cash_flow: DataFrame) -> DataFrame:
    """Union of years, null-padded."""
    on = ["ticker", "fiscal_year"]
    shared = [c for c in ("sector", "period_key", "period_end") if c in income.columns]
    out = income.drop(*shared).join(balance.drop(*shared), on, "full_outer")
    return out.join(cash_flow.drop(*shared), on, "full_outer")


def range_float(floats: DataFrame, years: DataFrame, max_gap: int = 300) -> DataFrame:
    """Each float date to the earliest period end within ``max_gap`` days after it; entities without any dated year match on the fiscal-year label.

    ``floats``: (ticker, float_as_of, float_year, ...). ``years``: (ticker, fiscal_year, period_end, ...). Both hold a few rows per entity and year.
    """
    f = floats.withColumn("_fid", F.struct("ticker", "float_as_of", "float_year"))
    dated = years.filter(F.col("period_end").isNotNull())
    gap = F.datediff("period_end", "float_as_of")
    first = f.select("ticker", "_fid", "float_as_of").join(dated.select("ticker", "fiscal_year", "period_end"), "ticker")
    first = first.filter((gap >= 0) & (gap <= max_gap)).groupBy("_fid").agg(F.min_by("fiscal_year", "period_end").alias("matched_year"))
    undated = years.groupBy("ticker").agg(F.count("period_end").alias("_dated")).filter("_dated = 0").select("ticker")
    label = f.join(undated, "ticker", "left_semi").join(years.select("ticker", F.col("fiscal_year").alias("float_year")), ["ticker", "float_year"], "left_semi")
    matched = first.unionByName(label.select("_fid", F.col("float_year").alias("matched_year")))
    return f.join(matched, "_fid").drop("_fid")


def nearest(left: DataFrame, right: DataFrame, left_date: str, right_date: str, max_days: int, value: str, key: str = "entity") -> DataFrame:
    """For each left row the closest right value within ``max_days``; the earlier date wins ties.

    Dates are cut to slots as wide as the tolerance and each left row looks at three of them, so the join key is (entity, slot) rather than the
    entity alone: a hot entity spreads over its slots.
    """
    day = lambda c: F.datediff(F.col(c), F.lit(datetime.date(1970, 1, 1)))
    slot = lambda c: F.floor(day(c) / F.lit(max_days + 1))
    l = left.withColumn("_slot", F.explode(F.array(slot(left_date) - 1, slot(left_date), slot(left_date) + 1)))
    r = right.select(key, F.col(right_date).alias("_rd"), F.col(value).alias("_rv"), slot(right_date).alias("_slot"))
    gap = F.abs(F.datediff(F.col("_rd"), F.col(left_date)))
    hits = l.join(r, [key, "_slot"]).filter(gap <= max_days)
    best = hits.groupBy(*left.columns).agg(F.min(F.struct(gap.alias("gap"), F.col("_rd").alias("date"), F.col("_rv").alias("value"))).alias("_b"))
    return best.select(*left.columns, F.col("_b.date").alias("matched_date"), F.col("_b.gap").alias("gap_days"), F.col("_b.value").alias("matched_value"))


def quarter_dates(start: datetime.date, end: datetime.date, months: int = 3) -> list[datetime.date]:
    """Evenly spaced as-of dates; a list of a few dozen at most."""
    out, i = [], 0
    while (d := plus_months(start, i * months)) <= end:
        out.append(d)
        i += 1
    return out


def plus_months(d: datetime.date, months: int) -> datetime.date:
    """The same day of a later month, or that month's last day."""
    years, month = divmod(d.month - 1 + months, 12)
    year = d.year + years
    return datetime.date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


def _date_array(dates: list[datetime.date]) -> Column:
    return F.array(*[F.lit(d) for d in dates])


def _count_dates(dates: list[datetime.date], date: Column, counted) -> Column:
    """How many as-of dates ``counted(as_of, date)`` holds for. One constant array, so a long list adds no code; the date is bound once, not once per element."""
    return F.get(F.transform(F.array(date), lambda x: F.size(F.filter(_date_array(dates), lambda d: counted(d, x)))), F.lit(0))


def slot_at_or_after(rows: DataFrame, known: str, dates: list[datetime.date]) -> DataFrame:
    """Rows known by the last of the sorted as-of dates, with ``slot``: the index of the first as-of date on or after ``known``."""
    return rows.filter(F.col(known) <= F.lit(dates[-1])).withColumn("slot", _count_dates(dates, F.col(known), lambda d, x: d < x))


def slot_at_or_before(rows: DataFrame, known: str, dates: list[datetime.date]) -> DataFrame:
    """Rows from the first of the sorted as-of dates on, with ``slot``: the index of the last as-of date on or before ``known``."""
    return rows.filter(F.col(known) >= F.lit(dates[0])).withColumn("slot", _count_dates(dates, F.col(known), lambda d, x: d <= x) - 1)


def dates_between(dates: list[datetime.date], first: Column, last: Column) -> Column:
    """The as-of dates of the slots ``first`` to ``last``; empty where the span is."""
    return F.slice(_date_array(dates), first + 1, F.greatest(last - first + 1, F.lit(0)))


def _carry(best: DataFrame, keys: list[str], dates: list[datetime.date], forward: bool) -> DataFrame:
    """Running extreme over the slots in which a key changes; every change spans the slots up to the next one and is expanded last."""
    w = Window.partitionBy(*keys).orderBy("slot")
    if forward:
        run = F.min("_best").over(w.rowsBetween(0, Window.unboundedFollowing))
        first, last = F.coalesce(F.lag("slot").over(w) + 1, F.lit(0)), F.col("slot")
    else:
        run = F.max("_best").over(w.rowsBetween(Window.unboundedPreceding, 0))
        first, last = F.col("slot"), F.coalesce(F.lead("slot").over(w) - 1, F.lit(len(dates) - 1))
    spans = best.select(*keys, run.alias("_best"), first.alias("_first"), last.alias("_last"))
    return spans.select(*keys, "_best", F.explode(dates_between(dates, F.col("_first"), F.col("_last"))).alias("as_of"))


def asof_backward(rows: DataFrame, dates: list[datetime.date], known: str, order: list[str], carry: list[str], keys: list[str]) -> DataFrame:
    """Per key and as-of date, among rows with ``known`` <= as_of, the one greatest by ``order``. The order must be total for a deterministic pick."""
    slotted = slot_at_or_after(rows, known, dates)
    best = slotted.groupBy(*keys, "slot").agg(F.max(F.struct(*order, *[c for c in carry if c not in order])).alias("_best"))
    out = _carry(best, keys, dates, forward=False)
    return out.select(*keys, "as_of", *[F.col(f"_best.{c}").alias(c) for c in carry])


def asof_forward(rows: DataFrame, dates: list[datetime.date], known: str, carry: list[str], keys: list[str]) -> DataFrame:
    """Per key and as-of date the first row with ``known`` >= as_of."""
    slotted = slot_at_or_before(rows, known, dates)
    best = slotted.groupBy(*keys, "slot").agg(F.min(F.struct(known, *[c for c in carry if c != known])).alias("_best"))
    out = _carry(best, keys, dates, forward=True)
    return out.select(*keys, "as_of", *[F.col(f"_best.{c}").alias(c) for c in carry])


def cross_sweep(entities: DataFrame, grid: DataFrame) -> DataFrame:
    """Entities x a handful of scenario rows (rates, cases or dates)."""
    return entities.crossJoin(grid)
