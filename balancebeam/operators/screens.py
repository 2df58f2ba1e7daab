"""Quote resolution, universe screens, filters, searches, sorts and sector roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balancebeam.functions import dims
from balancebeam.functions.scalars import safe_div

MAX_MARKET_CAP, MAX_SALES_MULTIPLE = 1e13, 100
MIN_UNIVERSE_FLOAT, LARGE_CAP = 2e9, 1e10


def no(c: Column) -> Column:
    """A NULL condition counts as false."""
    return F.coalesce(c, F.lit(False))


def market_cap_plausible(cap, revenue) -> Column:
    cap, revenue = F.col(cap), F.col(revenue)
    return no((cap > 0) & (cap <= MAX_MARKET_CAP)) & ~no((revenue > 0) & (cap > MAX_SALES_MULTIPLE * revenue))


def float_corroborates(cap, public_float) -> Column:
    ratio = safe_div(cap, public_float)
    return no((F.col(cap) > 0) & (F.col(public_float) > 0) & (ratio >= 1 / 20) & (ratio <= 20))


def resolve_quote(live: DataFrame, approx: DataFrame, latest: DataFrame) -> DataFrame:
    """Plausible live quote; else a live one the float supports; else a plausible float; else no row.

    ``live`` (ticker, live_price, live_date), ``approx`` (ticker, public_float, float_shares, float_date), ``latest`` (ticker, revenue, shares, total_debt, cash):
    at most one row per ticker each.
    """
    q = latest.join(live, "ticker", "full_outer").join(approx, "ticker", "full_outer")
    q = q.withColumn("live_cap", F.when(F.col("live_price").isNotNull(), F.coalesce(F.col("live_price") * F.col("shares"), F.lit(0.0))))
    use_live = market_cap_plausible("live_cap", "revenue") | float_corroborates("live_cap", "public_float")
    use_float = market_cap_plausible("public_float", "revenue")
    q = q.withColumn("price_source", F.when(use_live, "live").when(use_float, "sec_public_float")).filter("price_source is not null")
    is_live = F.col("price_source") == "live"
    cap = F.when(is_live, F.col("live_cap")).otherwise(F.col("public_float"))
    ev = F.when(cap > 0, cap + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)))
    return q.select("ticker", F.when(is_live, F.col("live_date")).otherwise(F.col("float_date")).alias("date"),
                    F.when(is_live, F.col("live_price")).otherwise(safe_div("public_float", "float_shares")).alias("share_price"),
                    cap.alias("market_cap"), ev.alias("enterprise_value"),
                    F.when(is_live, F.col("shares")).otherwise(F.col("float_shares")).alias("shares_outstanding"), "price_source")


def universe_screen(candidates: DataFrame, present: DataFrame, min_float: float = MIN_UNIVERSE_FLOAT, large: float = LARGE_CAP) -> DataFrame:
    """New operating filers with a plausible float above the floor, one ticker per key, keys already present skipped."""
    fresh = candidates.join(present.select("cik").distinct(), "cik", "left_anti")
    keep = fresh.filter(no(F.col("public_float") >= min_float) & market_cap_plausible("public_float", "revenue") & no(F.col("has_operating_financials")))
    picked = primary_ticker(keep)
    return picked.withColumn("market_cap_tier", F.when(F.col("public_float") >= large, "large").otherwise("mid"))


def primary_order() -> list[Column]:
    t = F.col("ticker")
    return [t.rlike("[-.]"), F.length(t), t]


def primary_ticker(df: DataFrame) -> DataFrame:
    """One row per cik: a ticker without a suffix if any, then the shortest, then the first by name. Rows without a cik all stay."""
    rest = [c for c in df.columns if c != "cik"]
    best = df.filter(F.col("cik").isNotNull()).groupBy("cik").agg(F.min_by(F.struct(*rest), F.struct(*primary_order())).alias("_r"))
    picked = best.select("cik", *[F.col(f"_r.{c}").alias(c) for c in rest])
    return picked.select(*df.columns).unionByName(df.filter(F.col("cik").isNull()))


def superseded_tickers(df: DataFrame) -> DataFrame:
    """Tickers that lose to another ticker of the same cik."""
    return df.select("ticker").join(primary_ticker(df).select("ticker"), "ticker", "left_anti")


def cascade_delete(removed: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every child table without the removed tickers."""
    return {name: df.join(removed.select("ticker"), "ticker", "left_anti") for name, df in children.items()}


def non_operating(companies: DataFrame, income: DataFrame) -> DataFrame:
    """Entities with no reported revenue in any year."""
    return companies.join(income.filter(F.col("revenue").isNotNull()).select("ticker"), "ticker", "left_anti")


def rank_filters(df: DataFrame, *, sectors: list[str] | None = None, countries: list[str] | None = None, min_metrics: int | None = None,
                 bounds: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Chained filters; a NULL fails an active bound. ``bounds``: column -> (operator, limit)."""
    if sectors:
        df = df.filter(no(F.col("sector").isin(sectors)))
    if countries:
        df = df.filter(no(F.col("country").isin(countries)))
    if min_metrics:
        df = df.filter(F.col("metrics_included") >= min_metrics)
    for name, (op, limit) in (bounds or {}).items():
        df = df.filter(cmp(name, op, limit))
    return df


def text_search(df: DataFrame, text: str, columns: tuple[str, ...] = ("ticker", "company_name")) -> DataFrame:
    t = F.lit(text.strip().lower())
    return df.filter(reduce(lambda a, b: a | b, [no(F.contains(F.lower(c), t)) for c in columns]))


def cmp(field: str | Column, op: str, number: float) -> Column:
    """``field op number``; a missing field is false, so NOT of it is true."""
    c = F.col(field) if isinstance(field, str) else field
    return no({">": c > number, ">=": c >= number, "<": c < number, "<=": c <= number, "=": c == number, "!=": c != number}[op])


PERCENT, MILLION, BILLION = 0.01, 1e6, 1e9


def field_name(name: str) -> str:
    """Field names ignore case and underscores."""
    return name.replace("_", "").lower()


def resolve_field(df: DataFrame, name: str) -> Column:
    """The column a screen field names, or NULL where there is none."""
    for c in df.columns:
        if field_name(c) == field_name(name):
            return F.col(c)
    return F.lit(None).cast("double")


def screen_context(latest: DataFrame, aliases: dict[str, str], snapshot: DataFrame) -> DataFrame:
    """Newest metrics with aliases laid over them; an alias wins only where it has a value.

    ``aliases``: metric column -> snapshot column that overlays it (or adds it under that name).
    """
    joined = latest.join(snapshot, "ticker", "left")
    out = [F.coalesce(F.col(a), F.col(m)).alias(m) if m in latest.columns else F.col(a).alias(m) for m, a in aliases.items()]
    keep = [c for c in latest.columns if c not in aliases]
    return joined.select(*keep, *out)


def preset_counts(df: DataFrame, screens: dict[str, Column]) -> DataFrame:
    """Hits per named screen in one pass."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in screens.items()])
    return one.unpivot([], list(screens), "screen", "hits")


def negative_is_bad_order(value: str) -> list[Column]:
    """Positives ascending, then the rest by closeness to zero, missing last."""
    v = F.col(value)
    return [v.isNull(), v <= 0, F.abs(v)]


def trim_outliers(df: DataFrame, axes: tuple[str, ...], p: float, min_rows: int = 10) -> DataFrame:
    """Mark rows inside the [round(p(n-1)), round((1-p)(n-1))] order statistics of every axis; p <= 0 or fewer than ``min_rows`` rows keeps everything.

    The two bounds per axis come from range-partitioned positions, so no axis is sorted in one task.
    """
    from balancebeam.operators.positions import positions

    if p <= 0:
        return df.withColumn("kept", F.lit(True))
    at = lambda q: F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5) + 1
    out, inside = df, F.lit(True)
    for a in axes:
        ranked = positions(df.select("ticker", a), [], [F.col(a), F.col("ticker")], "_r", {"_n": F.count(F.lit(1))})
        bounds = ranked.agg(F.max(F.when(F.col("_r") == at(p), F.col(a))).alias(f"_{a}_lo"), F.max(F.when(F.col("_r") == at(1 - p), F.col(a))).alias(f"_{a}_hi"), F.max("_n").alias(f"_{a}_n"))
        out = out.crossJoin(F.broadcast(bounds))
        inside = inside & ((F.col(f"_{a}_n") < min_rows) | F.col(a).between(F.col(f"_{a}_lo"), F.col(f"_{a}_hi")))
    return out.withColumn("kept", inside).select(*df.columns, "kept")


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def sector_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(dims.SECTORS)), "ord int, sector string")


def sector_rollup(ranked: DataFrame) -> DataFrame:
    """Count, mean score and total capitalisation for each of the eleven sectors, empty ones included."""
    stats = ranked.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.avg("overall_score").alias("mean_score"),
                                         F.sum(F.coalesce("market_cap", F.lit(0.0))).alias("total_cap"))
    out = F.broadcast(sector_table(ranked.sparkSession)).join(stats, "sector", "left")
    return out.select("sector", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", F.coalesce("total_cap", F.lit(0.0)).alias("total_cap"))


def sector_category_heatmap(categories: DataFrame) -> DataFrame:
    """Mean category score x 100 for every sector and category; empty cells are NULL. ``categories``: (sector, category, score)."""
    from balancebeam.metrics.registry import CATEGORIES

    spark = categories.sparkSession
    cells = categories.groupBy("sector", "category").agg((F.avg("score") * 100).alias("mean_score"))
    grid = sector_table(spark).select("sector").crossJoin(spark.createDataFrame([(c,) for c in CATEGORIES], "category string"))
    return grid.join(cells, ["sector", "category"], "left")


def sector_peer_mean(ranked: DataFrame) -> DataFrame:
    """Mean score of the sector's other scored members: sector sums joined back, so no sector is gathered in one task."""
    sums = ranked.filter(F.col("sector").isNotNull()).groupBy("sector").agg(F.sum("overall_score").alias("_s"), F.count("overall_score").alias("_n"))
    own = F.coalesce("overall_score", F.lit(0.0))
    others = F.col("_n") - F.col("overall_score").isNotNull().cast("int")
    return ranked.join(sums, "sector", "left").withColumn("peer_mean", F.when(others > 0, (F.col("_s") - own) / others)).drop("_s", "_n")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows by ``order``: each task keeps its own k before they meet."""
    return df.orderBy(*order).limit(k)
