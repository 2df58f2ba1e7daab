"""Own-history multiples, normalised earnings, predictability, implied growth and realised growth.

An entity has at most a few dozen fiscal years, so per-entity windows and arrays are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancebeam.functions.dims import EV_EXCLUDED_SECTORS
from balancebeam.functions.scalars import cagr_both_pos, fcf_of, per_share, ratio_pos
from balancebeam.operators.sector import canonical_sector

MIN_DISTRIBUTION_YEARS, MIN_CYCLE_YEARS, MAX_CYCLE_YEARS = 5, 7, 10
MIN_CONSISTENCY_YEARS, REVENUE_CV_LIMIT, FCF_CV_LIMIT = 4, 0.25, 0.6
MULTIPLES = ("float_pe", "float_ps", "float_pb", "float_ev_ebit")


def quantile_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact interpolated quartiles of the positive values; NULL with a reason below five. Groups must be per entity (bounded by its years)."""
    v = F.when(F.col(value) > 0, F.col(value))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.percentile(v, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("_q"),
                                F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    enough = F.col("n") >= MIN_DISTRIBUTION_YEARS
    return out.select(*keys, "n", *[F.when(enough, F.col("_q")[i]).alias(a) for i, a in enumerate(("q1", "median", "q3"))],
                      F.when(enough, F.col("_lo")).alias("lowest"), F.when(enough, F.col("_hi")).alias("highest"),
                      F.when(~enough, F.lit("too-few-years")).alias("reason"))


def float_enterprise_value(equity: Column) -> Column:
    ev = F.when(equity > 0, equity + F.col("total_debt") - F.col("cash"))
    return F.when(ev > 0, ev)


def _multiple_columns(equity: Column) -> dict[str, Column]:
    return {"float_pe": ratio_pos(equity, "net_income"), "float_ps": ratio_pos(equity, "revenue"), "float_pb": ratio_pos(equity, "total_equity"),
            "float_ev_ebit": ratio_pos(float_enterprise_value(equity), "operating_income")}


def own_history_multiples(history: DataFrame) -> DataFrame:
    """(ticker, sector, fiscal_year, multiple, value): long, value NULL without a positive denominator."""
    rows = history.filter("public_float > 0").select("ticker", "sector", "fiscal_year", *[c.alias(k) for k, c in _multiple_columns(F.col("public_float")).items()])
    return rows.unpivot(["ticker", "sector", "fiscal_year"], list(MULTIPLES), "multiple", "value")


def ev_suppressed() -> Column:
    return (F.col("multiple") == "float_ev_ebit") & F.coalesce(F.col("sector").isin(list(EV_EXCLUDED_SECTORS)), F.lit(False))


def own_history_distribution(multiples: DataFrame) -> DataFrame:
    return quantile_summary(multiples.filter(~ev_suppressed()), ["ticker", "multiple"], "value")


def percentile_of_today(multiples: DataFrame, today: DataFrame) -> DataFrame:
    """Mid-rank percentile of today's value in the entity's own history; five usable years needed. ``today``: (ticker, multiple, today_value)."""
    rows = multiples.filter("value > 0").join(today.filter("today_value > 0"), ["ticker", "multiple"])
    below, equal, n = F.count_if(F.col("value") < F.col("today_value")), F.count_if(F.col("value") == F.col("today_value")), F.count(F.lit(1))
    out = rows.groupBy("ticker", "multiple").agg(n.alias("n"), ((below + equal / 2) / n * 100).alias("percentile"))
    return out.withColumn("percentile", F.when(F.col("n") >= MIN_DISTRIBUTION_YEARS, F.col("percentile")))


def float_anchor(anchors: DataFrame) -> DataFrame:
    """Per entity the float-to-cap ratio of the newest usable anchor: gap <= 10 days, ratio in [0.05, 1.05].

    ``anchors``: (ticker, fiscal_year, float_as_of, market_cap_as_of, market_cap, public_float).
    """
    ratio = F.col("public_float") / F.nullif(F.col("market_cap"), F.lit(0.0))
    ok = (F.col("market_cap") > 0) & (F.col("public_float") > 0) & (F.abs(F.datediff("float_as_of", "market_cap_as_of")) <= 10) & ratio.between(0.05, 1.05)
    usable = anchors.filter(ok).withColumn("float_ratio", ratio)
    return usable.groupBy("ticker").agg(F.max_by(F.struct("float_ratio", F.col("fiscal_year").alias("anchor_year")), "fiscal_year").alias("a")).select("ticker", "a.*")


def own_history_basis(history: DataFrame, today: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per entity: normalisation factor, float-basis value, status, and how many multiples have a distribution and a percentile.

    ``today``: (ticker, sector, market_cap, cap_is_float, net_income, revenue, total_equity, operating_income, total_debt, cash).
    """
    based = today.join(float_anchor(anchors), "ticker", "left")
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    based = based.withColumn("float_value", F.when(F.col("cap_is_float"), cap).otherwise(cap * F.col("float_ratio")))
    based = based.withColumn("factor", F.coalesce("float_ratio", F.when(F.col("cap_is_float"), F.lit(1.0))))
    values = based.select("ticker", *[c.alias(k) for k, c in _multiple_columns(F.col("float_value")).items()]).unpivot(["ticker"], list(MULTIPLES), "multiple", "today_value")
    multiples = own_history_multiples(history).filter(~ev_suppressed())
    dist = multiples.filter("value > 0").groupBy("ticker", "multiple").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_DISTRIBUTION_YEARS)
    counts = dist.join(values, ["ticker", "multiple"], "left").groupBy("ticker").agg(F.count(F.lit(1)).alias("distributions"), F.count_if(F.col("today_value") > 0).alias("percentiles"))
    out = based.join(counts, "ticker", "left")
    status = F.when(F.coalesce("distributions", F.lit(0)) == 0, "insufficient").when(F.col("percentiles") == 0, "not-comparable").otherwise("ok")
    return out.select("ticker", "factor", "anchor_year", "float_value", F.coalesce("distributions", F.lit(0)).alias("distributions"),
                      F.coalesce("percentiles", F.lit(0)).alias("percentiles"), status.alias("status"))


def discontinuities(history: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Consecutive years where revenue or equity moves by more than the threshold or changes sign."""
    w = Window.partitionBy("ticker").orderBy("fiscal_year")
    rows = history.withColumn("_step", F.col("fiscal_year") - F.lag("fiscal_year").over(w))
    drivers = []
    for field in ("revenue", "total_equity"):
        before, after = F.lag(field).over(w), F.col(field)
        change = (after - before) / F.nullif(F.abs(before), F.lit(0.0))
        hit = F.coalesce((before != 0) & (((before > 0) != (after > 0)) | (F.abs(change) > threshold)), F.lit(False))
        drivers.append(F.when(hit, F.struct(F.lit(field).alias("field"), change.alias("change"))))
    rows = rows.withColumn("_d", F.filter(F.array(*drivers), lambda x: x.isNotNull())).filter("_step = 1")
    return rows.select("ticker", "fiscal_year", F.inline("_d"))


def normalized_earnings(history: DataFrame) -> DataFrame:
    """Per entity over its newest <= 10 years with earnings; seven needed. ``history`` carries market_cap and sector per row."""
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    entity = history.groupBy("ticker").agg(F.first("sector").alias("sector"), F.first("market_cap").alias("market_cap"))
    rows = history.filter(F.col("net_income").isNotNull()).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= MAX_CYCLE_YEARS)
    margin = ratio_pos("net_income", "revenue")
    own = F.when(F.col("shares_outstanding") > 0, F.col("shares_outstanding"))
    own_year = F.when(own.isNotNull(), F.col("fiscal_year"))
    agg = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("years"), F.avg("net_income").alias("mean_earnings"), F.max_by("net_income", "fiscal_year").alias("latest_earnings"),
        F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.avg(margin).alias("_margin"), F.count(margin).alias("margin_years"),
        F.count_if(F.col("net_income") < 0).alias("loss_years"), F.count(own).alias("_owned"), F.min_by(own, own_year).alias("_s0"), F.max_by(own, own_year).alias("_s1"))
    out = entity.join(agg, "ticker", "left").withColumn("years", F.coalesce("years", F.lit(0)))
    excluded = F.coalesce(canonical_sector(F.col("sector")) == "Real Estate", F.lit(False))
    status = F.when(excluded, "not-applicable").when(F.col("years") < MIN_CYCLE_YEARS, "insufficient").otherwise("ok")
    drift = F.when(F.col("_owned") >= 2, (F.col("_s1") - F.col("_s0")) / F.nullif(F.col("_s0"), F.lit(0.0)))
    out = out.withColumn("status", status)
    ok = F.col("status") == "ok"
    positive = ok & (F.col("mean_earnings") > 0)
    return out.select(
        "ticker", "status", "years",
        F.when(ok, F.col("mean_earnings")).alias("normalized_earnings"), F.when(ok, F.col("latest_earnings")).alias("latest_earnings"),
        F.when(positive & (F.col("market_cap") > 0), F.col("market_cap") / F.nullif(F.col("mean_earnings"), F.lit(0.0))).alias("cape_ratio"),
        F.when(positive, F.col("latest_earnings") / F.nullif(F.col("mean_earnings"), F.lit(0.0))).alias("earnings_vs_normalized"),
        F.when(ok & (F.col("margin_years") >= MIN_CYCLE_YEARS), F.col("_margin")).alias("normalized_margin"),
        F.when(ok, F.col("last_year") - F.col("first_year") + 1 > F.col("years")).alias("has_gaps"),
        F.when(ok, F.col("loss_years")).alias("loss_years"),
        F.when(ok, F.coalesce(F.abs(drift) >= 0.15, F.lit(False))).alias("share_drift"))


def loglinear_cv(df: DataFrame, value: str, key: str = "ticker") -> DataFrame:
    """(key, cv, usable_years): deviation of the positive values around their log-linear trend over the years, relative to the mean."""
    w = Window.partitionBy(key)
    rows = df.filter(F.col(value) > 0).select(key, "fiscal_year", F.col(value).alias("_v"))
    ln, year = F.ln("_v"), F.col("fiscal_year").cast("double")
    fitted = rows.withColumns({"_s": F.regr_slope(ln, year).over(w), "_i": F.regr_intercept(ln, year).over(w)})
    err = F.col("_v") - F.exp(F.col("_i") + F.col("_s") * F.col("fiscal_year"))
    out = fitted.groupBy(key).agg(F.count(F.lit(1)).alias("usable_years"), (F.sqrt(F.avg(err * err)) / F.avg("_v")).alias("_cv"),
                                  F.count_distinct("fiscal_year").alias("_d"))
    return out.select(key, F.when((F.col("usable_years") >= MIN_CONSISTENCY_YEARS) & (F.col("_d") > 1), F.col("_cv")).alias("cv"), "usable_years")


def predictability(entities: DataFrame, income: DataFrame, cash_flow: DataFrame) -> DataFrame:
    """(ticker, revenue_cv, fcf_cv, predictable, reason)."""
    revenue = income.select("ticker", "fiscal_year", per_share("revenue", "shares_diluted").alias("v"))
    shares = income.select("ticker", "fiscal_year", "shares_diluted")
    fcf = cash_flow.join(shares, ["ticker", "fiscal_year"], "left").select("ticker", "fiscal_year", per_share(fcf_of(), "shares_diluted").alias("v"))
    r = loglinear_cv(revenue, "v").select("ticker", F.col("cv").alias("revenue_cv"))
    f = loglinear_cv(fcf, "v").select("ticker", F.col("cv").alias("fcf_cv"))
    out = entities.select("ticker").join(r, "ticker", "left").join(f, "ticker", "left")
    thin = F.col("revenue_cv").isNull() | F.col("fcf_cv").isNull()
    erratic = (F.col("revenue_cv") > REVENUE_CV_LIMIT) | (F.col("fcf_cv") > FCF_CV_LIMIT)
    reason = F.when(thin, "too-little-history").when(erratic, "too-erratic")
    return out.withColumn("reason", reason).withColumn("predictable", F.col("reason").isNull())


def reverse_dcf_inputs(companies: DataFrame, income: DataFrame, balance: DataFrame, cash_flow: DataFrame) -> DataFrame:
    """Per entity: cash-flow basis, net debt, enterprise value and the first reason that withholds the reading."""
    flows = cash_flow.groupBy("ticker").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("fiscal_year", fcf_of().alias("fcf"))))), 1, 2).alias("_f"))
    sheet = balance.groupBy("ticker").agg(F.max_by(F.struct("total_debt", "cash"), "fiscal_year").alias("_b"))
    filed = income.select("ticker").distinct().withColumn("_has_income", F.lit(True))
    out = companies.join(flows, "ticker", "left").join(sheet, "ticker", "left").join(filed, "ticker", "left")
    out = out.join(predictability(companies, income, cash_flow).select("ticker", "predictable", F.col("reason").alias("_why")), "ticker", "left")
    latest, prior = F.get("_f", F.lit(0))["fcf"], F.get("_f", F.lit(1))["fcf"]
    largest = F.greatest(F.abs(latest), F.abs(prior))
    smooth = latest.isNotNull() & prior.isNotNull() & (largest > 0) & (F.abs(latest - prior) / F.nullif(largest, F.lit(0.0)) > 0.4)
    out = out.withColumn("trailing_fcf", F.when(F.coalesce(smooth, F.lit(False)), (latest + prior) / 2).otherwise(latest))
    out = out.withColumn("fcf_basis", F.when(F.coalesce(smooth, F.lit(False)), "two-year-average").when(latest.isNotNull(), "latest"))
    out = out.withColumn("net_debt", F.when(F.col("_b").isNotNull(), F.coalesce("_b.total_debt", F.lit(0.0)) - F.coalesce("_b.cash", F.lit(0.0))))
    out = out.withColumn("enterprise_value", F.col("share_price") * F.col("shares_outstanding") + F.col("net_debt"))
    reason = (
        F.when(F.coalesce(F.col("sector").isin(list(EV_EXCLUDED_SECTORS)), F.lit(False)), "sector")
        .when(F.col("_has_income").isNull() | F.col("_f").isNull(), "no-statements")
        .when(~F.coalesce((F.col("share_price") > 0) & (F.col("shares_outstanding") > 0), F.lit(False)), "no-price")
        .when(F.col("net_debt").isNull(), "no-balance-sheet")
        .when(F.col("trailing_fcf").isNull(), "no-cash-flow")
        .when(F.col("trailing_fcf") <= 0, "negative-cash-flow")
        .when(~F.col("predictable"), F.col("_why"))
    )
    return out.withColumn("reason", reason).select("ticker", "trailing_fcf", "fcf_basis", "net_debt", "enterprise_value", "reason")


GROWTH_MIN, GROWTH_STEPS, GROWTH_STEP = -0.5, 1100, 0.001
DISCOUNT_RATES = (0.08, 0.1, 0.12)


def dcf_multiples(spark: SparkSession, rates: tuple[float, ...] = DISCOUNT_RATES, years: int = 10, terminal: float = 0.025) -> DataFrame:
    """(rate, growth, multiple, next_multiple): firm value per unit of trailing cash flow, growth fading linearly to the terminal rate."""
    grid = spark.range(GROWTH_STEPS + 1).select((F.lit(GROWTH_MIN) + F.col("id") * GROWTH_STEP).alias("growth"))
    grid = grid.crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in rates], "rate double")))
    start = F.struct(F.lit(1.0).alias("fcf"), F.lit(0.0).alias("pv"))

    def step(acc, t):
        fade = F.lit(0.0) if years == 1 else (t - 1) / F.lit(float(years - 1))
        fcf = acc["fcf"] * (1 + F.col("growth") + (terminal - F.col("growth")) * fade)
        return F.struct(fcf.alias("fcf"), (acc["pv"] + fcf / F.pow(1 + F.col("rate"), t)).alias("pv"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, step)
    value = end["pv"] + end["fcf"] * (1 + terminal) / (F.col("rate") - terminal) / F.pow(1 + F.col("rate"), F.lit(years))
    grid = grid.withColumn("multiple", value)
    w = Window.partitionBy("rate").orderBy("growth")
    return grid.withColumn("next_multiple", F.lead("multiple").over(w)).filter("next_multiple is not null")


def reverse_dcf_grid(inputs: DataFrame, rates: tuple[float, ...] = DISCOUNT_RATES) -> DataFrame:
    """Market-implied growth for every usable entity and rate: the bracket of EV / cash flow, interpolated; NULL outside the grid.

    Firm value is linear in cash flow, so one table of a few thousand brackets serves all entities. Brackets are looked up by the integer
    slots they touch, an equi join on a broadcast table.
    """
    spark = inputs.sparkSession
    slot = lambda c: F.floor(F.col(c) * 4)
    grid = dcf_multiples(spark, rates).withColumn("_slot", F.explode(F.sequence(slot("multiple"), slot("next_multiple"))))
    # last bracket keeps its upper end
    top = F.col("growth") >= GROWTH_MIN + (GROWTH_STEPS - 1.5) * GROWTH_STEP
    usable = inputs.filter("reason is null").select("ticker", (F.col("enterprise_value") / F.col("trailing_fcf")).alias("x"))
    asked = usable.select("ticker", "x", F.explode(F.array(*[F.lit(r) for r in rates])).alias("rate")).withColumn("_slot", slot("x"))
    hit = (F.col("x") >= F.col("multiple")) & ((F.col("x") < F.col("next_multiple")) | (top & (F.col("x") == F.col("next_multiple"))))
    found = asked.join(F.broadcast(grid), ["rate", "_slot"], "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    implied = F.col("growth") + GROWTH_STEP * (F.col("x") - F.col("multiple")) / (F.col("next_multiple") - F.col("multiple"))
    return found.groupBy("ticker", "rate").agg(F.max(F.when(F.col("_hit"), implied)).alias("implied_growth"))


def realized_growth(income: DataFrame, cash_flow: DataFrame) -> DataFrame:
    """Cash-flow and revenue growth over three years and over the full span, by position from the newest year."""
    newest = lambda c: F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("fiscal_year", c.alias("v"))))), lambda x: x["v"])
    i = income.groupBy("ticker").agg(newest(F.col("revenue")).alias("_r"))
    c = cash_flow.groupBy("ticker").agg(newest(fcf_of()).alias("_f"))
    out = i.join(c, "ticker", "left").withColumn("_f", F.coalesce("_f", F.array().cast("array<double>")))
    out = out.withColumn("span", F.least(F.size("_r"), F.size("_f")) - 1)
    at = lambda a, k: F.get(a, k)
    has3, has = F.size("_r") > 3, F.col("span") >= 1
    three = F.lit(3)
    return out.select(
        "ticker",
        F.when(has3, cagr_both_pos(at("_f", three), at("_f", F.lit(0)), 3)).alias("fcf_3y"),
        F.when(has3, cagr_both_pos(at("_r", three), at("_r", F.lit(0)), 3)).alias("revenue_3y"),
        F.when(has, F.col("span")).alias("full_span"),
        F.when(has, cagr_both_pos(at("_f", F.col("span")), at("_f", F.lit(0)), F.col("span"))).alias("fcf_full"),
        F.when(has, cagr_both_pos(at("_r", F.col("span")), at("_r", F.lit(0)), F.col("span"))).alias("revenue_full"))
