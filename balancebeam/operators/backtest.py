"""Point-in-time metrics, ranking per as-of date, forward returns, buckets and the bucket report."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balancebeam.functions.scalars import ratio_pos
from balancebeam.metrics.registry import Metric
from balancebeam.operators import joins
from balancebeam.operators.positions import positions
from balancebeam.operators.rollup import rank_universe
from balancebeam.operators.xs import RankConfig

MIN_ENTITIES = 10
TASK_FACTS = 250_000  # of the point-in-time panel


def upper_median(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """(group, median): the element at floor(n / 2), not interpolated. ``key`` makes the order total."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = positions(df, group, [F.col(value), *[F.col(k) for k in keys]], "_r", {"_n": F.count(F.lit(1))})
    at = ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1)
    return at.select(*group, F.col(value).alias("median"))


def pit_values(facts: DataFrame, dates: list[datetime.date], keys: list[str]) -> DataFrame:
    """Per key and as-of date the newest period known by then, at its latest filing.

    Newest end first, then latest filing, is one ordering, so the pick is a single running maximum over the dates.
    ``facts``: (keys, end_date, filed, ord, line, val).
    """
    rows = facts.withColumns({"_o": -F.col("ord"), "_l": -F.col("line")})
    return joins.asof_backward(rows, dates, "filed", ["end_date", "filed", "_o", "_l"], ["end_date", "filed", "val"], keys)


def pit_panel(facts: DataFrame, dates: list[datetime.date], keys: list[str]) -> DataFrame:
    """(keys, as_of, end_date, filed, val, prior_val): ``pit_values`` and the value of the newest period of an earlier fiscal year known at the same date.

    One pass: facts are reduced to a row per (key, period end, date slot), the versions of that period. A key's few versions are gathered, and each date is picked
    among them inside the row: nothing is sorted, and no row per date is grouped again.
    """
    slotted = joins.slot_at_or_after(facts, "filed", dates)
    versions = slotted.groupBy(*keys, "end_date", "slot").agg(F.max(F.struct("filed", (-F.col("ord")).alias("o"), (-F.col("line")).alias("l"), "val")).alias("best"))
    # every key becomes a row per date, so tasks are bounded by facts and not by the bytes shuffled
    spark = facts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), facts.count() // TASK_FACTS + 1)
    gathered = versions.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list(F.struct("end_date", "best", "slot", F.year("end_date").alias("y"))).alias("_v"))
    # what is known changes only at the key's own slots; a state holds up to the next one
    slots = F.array_sort(F.array_distinct(F.col("_v.slot")))
    state = lambda s, i: F.struct(
        s.alias("first"), (F.coalesce(F.get("_slots", i + 1), F.lit(len(dates))) - 1).alias("last"), F.array_max(F.filter("_v", lambda v: v["slot"] <= s)).alias("now"))
    states = gathered.withColumn("_slots", slots).select(*keys, "_v", F.explode(F.transform("_slots", state)).alias("s"))
    earlier = F.array_max(F.filter("_v", lambda v: (v["slot"] <= F.col("s.first")) & (v["y"] < F.col("s.now.y"))))
    spans = states.select(*keys, "s", earlier["best"]["val"].alias("prior_val"))
    return spans.select(*keys, F.explode(joins.dates_between(dates, F.col("s.first"), F.col("s.last"))).alias("as_of"), "s.now.end_date", "s.now.best.filed", "s.now.best.val", "prior_val")


def as_of_dates(facts: DataFrame, filed: str, months: int = 3) -> DataFrame:
    """As-of dates over the span in which anything was filed, from the start of the first quarter."""
    span = facts.agg(F.to_date(F.date_trunc("quarter", F.min(filed))).alias("a"), F.max(filed).alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {months} months"))).alias("as_of"))


def pit_metrics(values: DataFrame, prices: DataFrame) -> DataFrame:
    """Seven metrics per (entity, as_of). ``values``: (entity, as_of, concept, val, prior_val); ``prices``: (entity, as_of, close).

    Without a price or a share count there is no row. Enterprise value is missing only when debt and cash both are.
    """
    concepts = ["revenue", "net_income", "gross_profit", "operating_income", "equity", "debt", "cash", "ocf", "capex", "eps", "shares"]
    pick = lambda c, v: F.max(F.when(F.col("concept") == c, F.col(v)))
    wide = values.groupBy("entity", "as_of").agg(*[pick(c, "val").alias(c) for c in concepts], pick("revenue", "prior_val").alias("prior_revenue"))
    rows = wide.join(prices, ["entity", "as_of"]).filter("shares is not null")
    cap = F.col("close") * F.col("shares")
    ev = F.when(F.coalesce("debt", "cash").isNotNull(), cap + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)))
    return rows.select(
        "entity", "as_of", ratio_pos("close", "eps").alias("pe"), ratio_pos(ev, "operating_income").alias("ev_ebit"),
        ratio_pos(F.col("ocf") - F.abs("capex"), cap).alias("fcf_yield"), ratio_pos("net_income", "equity").alias("roe"),
        ratio_pos("gross_profit", "revenue").alias("gross_margin"), (ratio_pos("revenue", "prior_revenue") - 1).alias("revenue_growth"),
        ratio_pos("debt", "equity").alias("debt_to_equity"))


# The seven back-test metrics and the category weights of the back-test. None is a registered key, so each takes its category's default weight.
PIT_REGISTRY = [("pe", "valuation", "asc"), ("ev_ebit", "valuation", "asc"), ("fcf_yield", "cashGeneration", "desc"), ("roe", "profitability", "desc"),
                ("gross_margin", "profitability", "desc"), ("revenue_growth", "growth", "desc"), ("debt_to_equity", "financialStrength", "asc")]
PIT_WEIGHTS = {"valuation": 0.25, "profitability": 0.25, "growth": 0.2, "financialStrength": 0.15, "cashGeneration": 0.15, "momentum": 0.0,
               "capitalAllocation": 0.0, "efficiency": 0.0, "earningsQuality": 0.0, "moat": 0.0}
PIT_CONFIG = RankConfig(category_weights=PIT_WEIGHTS, years=1)


def pit_registry() -> list[Metric]:
    return [Metric(k, c, d, "supporting" if c == "growth" else "core", lambda k=k: F.col(k)) for k, c, d in PIT_REGISTRY]


def pit_rank(metrics: DataFrame, min_entities: int = MIN_ENTITIES) -> DataFrame:
    """Full ranking per as-of date over dates with at least ``min_entities`` entities (1: every date): the as-of date joins every partition key."""
    sized = metrics.groupBy("as_of").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_entities).select("as_of")
    wide = metrics.join(sized, "as_of").withColumnRenamed("entity", "ticker").withColumns({"sector": F.lit(None).cast("string"), "year_index": F.lit(0)})
    return rank_universe(wide, wide.select("as_of", "ticker", "sector"), PIT_CONFIG, pit_registry(), by=("as_of",), turns=True)


def forward_returns(prices: DataFrame, dates: list[datetime.date], months: tuple[int, ...] = (6, 12), keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Per entity and as-of date: return from the price on or before the date to the first price on or after each horizon."""
    key = list(keys)
    base = joins.asof_backward(prices, dates, "date", ["date"], ["close"], key).withColumnRenamed("close", "base")
    out = base
    for m in months:
        later = [joins.plus_months(d, m) for d in dates]
        ahead = joins.asof_forward(prices, sorted(set(later)), "date", ["date", "close"], key).select(*key, F.col("as_of").alias("_at"), F.col("close").alias(f"_c{m}"))
        names = base.sparkSession.createDataFrame(list(zip(later, dates)), "_at date, as_of date")
        out = out.join(ahead.join(F.broadcast(names), "_at").drop("_at"), [*key, "as_of"], "left")
        out = out.withColumn(f"return_{m}m", F.try_divide(F.col(f"_c{m}") - F.col("base"), F.col("base"))).drop(f"_c{m}")
    return out.drop("base")


def quantile_buckets(scored: DataFrame, by: list[str], score: str, key: str, buckets: int = 5) -> DataFrame:
    """bucket = floor(i / ceil(n / k)), capped at k - 1, by score descending within ``by``. Not ntile."""
    sized = positions(scored, by, [F.round(score, 9).desc(), F.col(key)], "_r", {"_n": F.count(F.lit(1))})
    size = F.ceil(F.col("_n") / buckets)
    return sized.withColumn("bucket", F.least(F.floor((F.col("_r") - 1) / size), F.lit(buckets - 1))).drop("_r", "_n")


def bucket_report(bucketed: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, mean and upper median of the return per bucket."""
    stats = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_return"))
    return stats.join(upper_median(bucketed, ["bucket"], value, keys).withColumnRenamed("median", "median_return"), "bucket")


def snapshot_backtest(snapshots: DataFrame, prices: DataFrame, current: DataFrame, buckets: int = 5) -> DataFrame:
    """Earliest ranking per entity against today's price, bucketed by score. Fewer than 50 rows read better in four buckets, fewer than 20 in three.

    ``snapshots``: (entity, date, overall_score, overall_rank); ``prices``: (entity, date, close); ``current``: (entity, price_now).
    """
    first = snapshots.groupBy("entity").agg(F.min_by(F.struct("date", "overall_score", "overall_rank"), "date").alias("s")).select("entity", F.col("s.date").alias("snap_date"), "s.overall_score", "s.overall_rank")
    first = first.filter("overall_score is not null and overall_rank is not null")
    matched = joins.nearest(first, prices, "snap_date", "date", 14, "close").filter("matched_value > 0")
    rows = matched.join(current.filter("price_now > 0"), "entity").withColumn("forward_return", (F.col("price_now") - F.col("matched_value")) / F.col("matched_value"))
    return quantile_buckets(rows, [], "overall_score", "entity", buckets)
