"""Daily price series: closes, moving averages, timeframe changes and momentum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING_POINTS = 5


def explode_chart(charts: DataFrame) -> DataFrame:
    """Zip the parallel ``timestamps`` (epoch seconds) and ``closes`` arrays to (entity, date, close); drop missing closes."""
    rows = charts.select("entity", F.inline(F.arrays_zip("timestamps", "closes")))
    return rows.filter(F.abs("closes") < float("inf")).select(
        "entity", F.to_date(F.timestamp_seconds("timestamps")).alias("date"), F.col("closes").alias("close"))


def daily_close(ticks: DataFrame, order_by: tuple[str, ...]) -> DataFrame:
    """One row per (entity, date): the value of the day's last tick. Partial max_by, so a hot entity is combined map-side."""
    return ticks.groupBy("entity", F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct(*order_by)).alias("close"))


def moving_average(prices: DataFrame, windows: tuple[int, ...] = (50, 200)) -> DataFrame:
    """Trailing means over the full series; NULL until a window is full. One row per entity and day bounds each entity's sort."""
    w = Window.partitionBy("entity").orderBy("date")
    out = prices
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"ma_{n}", F.when(F.row_number().over(w) >= n, F.avg("close").over(frame)))
    return out


def timeframe_change(prices: DataFrame, days: dict[str, int | None]) -> DataFrame:
    """First-to-last change over the trailing days of each timeframe; NULL with fewer than two rows or a zero first close."""
    latest = prices.groupBy("entity").agg(F.max("date").alias("latest"))
    rows = prices.join(latest, "entity")
    aggs = []
    for name, n in days.items():
        inside = F.lit(True) if n is None else F.col("date") >= F.date_sub("latest", n)
        pick = F.when(inside, F.col("close"))
        first = F.min_by(pick, F.when(inside, F.col("date")))
        last = F.max_by(pick, F.when(inside, F.col("date")))
        aggs += [F.count(pick).alias(f"n_{name}"),
                 F.when(F.count(pick) >= 2, F.try_divide(last - first, first)).alias(f"change_{name}")]
    return rows.groupBy("entity").agg(*aggs)


@dataclass(frozen=True)
class MomentumSpec:
    """Offsets are (count, unit) with unit 'months' or 'days'. Month offsets clamp to the month's last day."""

    skip: tuple[int, str] = (1, "months")
    look: tuple[int, str] = (12, "months")
    min_span_days: int = 335
    short: tuple[int, str] = (3, "months")
    long: tuple[int, str] = (6, "months")
    min_points: int = 15


def _back(date: Column, offset: tuple[int, str]) -> Column:
    n, unit = offset
    return F.add_months(date, -n) if unit == "months" else F.date_sub(date, n)


def _mean(points: Column) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + p["close"]) / F.nullif(F.size(points), F.lit(0))


def _tail(points: Column, n: int) -> Column:
    return F.slice(points, F.greatest(F.size(points) - n + 1, F.lit(1)), F.lit(n))


def smoothed_close(points: Column, target: Column) -> Column:
    """Mean of the last five closes on or before the target, else the earliest close."""
    upto = F.filter(points, lambda p: p["date"] <= target)
    return _mean(F.when(F.size(upto) > 0, _tail(upto, SMOOTHING_POINTS)).otherwise(F.slice(points, 1, 1)))


def _with_risk_adjusted(df: DataFrame, name: str, start: Column, min_points: int) -> DataFrame:
    """Smoothed first-to-last return over the sample deviation of simple returns. Staged, so no array is rebuilt per element."""
    inside, returns, mean = F.col("_inside"), F.col("_returns"), F.col("_mean")
    step = lambda p, q: F.when(p["close"] > 0, q["close"] / p["close"] - 1)
    pairs = F.zip_with(inside, F.slice(inside, F.lit(2), F.greatest(F.size(inside), F.lit(1))), lambda p, q: step(p, q))
    n = F.size(returns)
    first, last = F.col("_first"), F.col("_last")
    return (
        df.withColumn("_inside", F.filter("pts", lambda p: p["date"] >= start))
        .withColumn("_returns", F.filter(pairs, lambda x: x.isNotNull()))
        .withColumn("_mean", F.aggregate(returns, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0)))
        .withColumn("_sd", F.when(n >= 2, F.sqrt(F.aggregate(returns, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(n - 1, F.lit(0)))))
        .withColumn("_first", _mean(F.slice(inside, 1, SMOOTHING_POINTS)))
        .withColumn("_last", _mean(_tail(inside, SMOOTHING_POINTS)))
        .withColumn(name, F.when((F.size(inside) >= min_points) & (first > 0) & (F.col("_sd") > 0),
                                 (last / F.nullif(first, F.lit(0.0)) - 1) / F.nullif(F.col("_sd"), F.lit(0.0))))
        .drop("_inside", "_returns", "_mean", "_sd", "_first", "_last")
    )


def momentum(prices: DataFrame, spec: MomentumSpec = MomentumSpec()) -> DataFrame:
    """Snapshot per entity. The gathered series holds one point per entity and day, so its length is bounded by the calendar."""
    day = prices.groupBy("entity", "date").agg(F.max("close").alias("close"))
    series = day.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("pts"))
    latest, earliest = F.col("latest"), F.col("earliest")
    pts = F.col("pts")
    series = (
        series.withColumn("latest", F.element_at("pts", -1)["date"])
        .withColumn("earliest", F.element_at("pts", 1)["date"])
        .withColumn("_recent", smoothed_close(pts, _back(latest, spec.skip)))
        .withColumn("_base", smoothed_close(pts, _back(latest, spec.look)))
    )
    series = _with_risk_adjusted(series, "risk_adjusted_3m", _back(latest, spec.short), spec.min_points)
    series = _with_risk_adjusted(series, "risk_adjusted_6m", _back(latest, spec.long), spec.min_points)
    spans = F.datediff(latest, earliest) >= spec.min_span_days
    return series.select(
        "entity",
        F.when(spans & (F.col("_base") > 0), F.col("_recent") / F.nullif(F.col("_base"), F.lit(0.0)) - 1).alias("return_12m1m"),
        "risk_adjusted_3m", "risk_adjusted_6m", latest.alias("as_of"))
