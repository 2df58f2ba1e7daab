"""Metric panel and cross-sectional ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from balancebeam.metrics.registry import CATEGORIES, metrics
from balancebeam.operators import panel as panel_ops
from balancebeam.operators import prices, rollup, xs
from balancebeam.operators import sector as sector_ops
from balancebeam.operators.positions import positions
from balancebeam.sources import sinks
from catalog.base import FIXTURE_MOMENTUM, companies, daily_prices, query, tidy, wide_panel
from catalog.sql import CANON, rnd, rollup_ctes, values, xs_ctes

KEYS = [m.key for m in metrics()]


@query("mom_snapshot", f"select entity, {rnd('return_12m1m')} as return_12m1m, {rnd('risk_adjusted_3m')} as risk_adjusted_3m, "
                       f"{rnd('risk_adjusted_6m')} as risk_adjusted_6m, as_of from o_momentum")
def mom_snapshot(spark, sf):
    return tidy(prices.momentum(daily_prices(spark, sf), FIXTURE_MOMENTUM))


@query("metric_panel_wide", f"select ticker, sector, period_key, fiscal_year, year_index, {', '.join(f'{rnd(k)} as {k}' for k in KEYS)} from o_wide")
def metric_panel_wide(spark, sf):
    return tidy(wide_panel(spark, sf))


@query("metric_panel_long", f"select ticker, sector, period_key, year_index, metric_key, {rnd('v')} as raw_value, v is null as is_missing from o_long")
def metric_panel_long(spark, sf):
    return tidy(panel_ops.metric_panel_long(wide_panel(spark, sf)))


def unit_frame(spark, sf):
    return xs.unit_scores_in_turns(wide_panel(spark, sf, turns=True), xs.RankConfig(), xs.enabled_metrics(), ordered=True)


def kept_frame(spark, sf):
    """The same, as the places that are stored."""
    return xs.kept_scores(wide_panel(spark, sf, turns=True), xs.RankConfig(), xs.enabled_metrics(), ordered=True)


@query("xs_unit_scores", f"select ticker, m, year_index, {rnd("score", 9)} as score, peer_rank, peer_count from o_unit")
def xs_unit_scores(spark, sf):
    return tidy(unit_frame(spark, sf), 9)


RANK_COLS = ["ticker", "overall_score", "overall_rank", "peer_count", "metrics_included", "metrics_applicable", "coverage_ratio", "coverage_tier"]
RANK_SQL = (f"select ticker, {rnd('overall_score')} as overall_score, overall_rank, peer_count, metrics_included, metrics_applicable, "
            f"{rnd('coverage_ratio')} as coverage_ratio, coverage_tier, "
            + ", ".join(f"(select {rnd('score')} from o_rank_cat c where c.ticker = r.ticker and c.category = '{c}') as {c}_score" for c in CATEGORIES) + " from o_rank r")


@query("rank_end_to_end", RANK_SQL)
def rank_end_to_end(spark, sf):
    return tidy(ranked(spark, sf).select(*RANK_COLS, *[f"{c}_score" for c in CATEGORIES]))


# --- parts of the ranking, each over the whole universe -------------------------------------------------------------------------


def key_of(registry):
    """The metric key a number stands for."""
    return F.expr("element_at(array(" + ", ".join(f"'{m.key}'" for m in registry) + "), m + 1)")


def subset(keep):
    return [m for m in metrics() if keep(m)]


def _unit(spark, sf, keep, config=xs.RankConfig(), wide=None):
    registry = subset(keep)
    scores = xs.unit_scores_in_turns(wide_panel(spark, sf, turns=True) if wide is None else wide, config, registry, ordered=True)
    return scores.withColumn("metric_key", key_of(registry)).drop("m")


UNIT_SQL = f"select ticker, metric_key, year_index, {rnd('score', 9)} as score, peer_rank, peer_count from o_unit join d_metrics using (m) where "


@query("xs_negative_split", UNIT_SQL + "negative_is_bad")
def xs_negative_split(spark, sf):
    return tidy(_unit(spark, sf, lambda m: m.negative_is_bad), 9)


@query("xs_sector_peers", UNIT_SQL + "sector_relative")
def xs_sector_peers(spark, sf):
    return tidy(_unit(spark, sf, lambda m: m.sector_relative), 9)


@query("xs_direction", f"select ticker, metric_key, year_index, direction, {rnd('score', 9)} as score, peer_rank, peer_count from o_unit join d_metrics using (m)")
def xs_direction(spark, sf):
    way = F.create_map(*[F.lit(x) for m in metrics() for x in (m.key, m.direction)])
    return tidy(_unit(spark, sf, lambda m: m.enabled).withColumn("direction", way[F.col("metric_key")]), 9)


Z_CONFIG = xs.RankConfig(method="zscore", years=3, winsor_lower=0.05, winsor_upper=0.95,
                         category_weights={"valuation": 0.3, "profitability": 0.3, "growth": 0.0, "cashGeneration": 0.1, "financialStrength": 0.0,
                                           "capitalAllocation": 0.05, "efficiency": 0.05, "earningsQuality": 0.1, "moat": 0.05, "momentum": 0.05},
                         metric_weights={"pe_ttm": 0.5, "roic": 2.0, "gross_margin": 0.0, "fcf_yield": 1.5, "piotroski_f_score": 0.0})
Z_SCORES = xs_ctes("z_unit", "(select * from o_gated where not inapplicable and year_index < 3)", "zscore", 0.05, 0.95)
Z_WEIGHTS = {
    "z_over": values(list(Z_CONFIG.metric_weights.items()), "metric_key, ow"),
    "z_weights": "select m, coalesce(ow, default_weight) as w from d_metrics left join z_over using (metric_key)",
    "z_categories": values([(i, c, float(w)) for i, (c, w) in enumerate(Z_CONFIG.category_weights.items())], "ord, category, cw"),
}


@query("xs_zscore", f"select ticker, metric_key, year_index, {rnd('score', 9)} as score, peer_rank, peer_count from z_unit join d_metrics using (m)", Z_SCORES)
def xs_zscore(spark, sf):
    return tidy(_unit(spark, sf, lambda m: m.enabled, Z_CONFIG), 9)


def rank_select(prefix):
    return (f"select ticker, {rnd('overall_score')} as overall_score, overall_rank, peer_count, metrics_included, metrics_applicable, "
            f"{rnd('coverage_ratio')} as coverage_ratio, coverage_tier from {prefix}")


@query("rank_zscore", rank_select("z_rank"), {**Z_SCORES, **Z_WEIGHTS, **rollup_ctes("z_rank", "z_unit", "fx_companies", "z_weights", "z_categories", 3)})
def rank_zscore(spark, sf):
    return tidy(rollup.rank_universe(wide_panel(spark, sf, turns=True), companies(spark, sf), Z_CONFIG, turns=True, ordered=True).select(*RANK_COLS))


# the same stored percentile scores under other weights and fewer years
REWEIGHT = xs.RankConfig(years=3, category_weights=Z_CONFIG.category_weights, metric_weights=Z_CONFIG.metric_weights)


@query("rank_reweight", rank_select("y_rank"), {**Z_WEIGHTS, **rollup_ctes("y_rank", "o_unit", "fx_companies", "z_weights", "z_categories", 3)})
def rank_reweight(spark, sf):
    scores, everyone = kept_frame(spark, sf), companies(spark, sf)
    return tidy(rollup.aggregate_rankings(scores, everyone, REWEIGHT, metrics()).select(*RANK_COLS))


@query("rank_override_apply", f"""select ticker, {rnd('overall_score')} as overall_score, overall_rank from
        (select r.ticker, case when o.ticker is not null then o.overall_score else r.overall_score end as overall_score,
                case when o.ticker is not null then o.overall_rank else r.overall_rank end as overall_rank
         from o_rank r left join y_rank o using (ticker))""",
       {**Z_WEIGHTS, **rollup_ctes("y_rank", "o_unit", "fx_companies", "z_weights", "z_categories", 3)})
def rank_override_apply(spark, sf):
    scores, everyone, registry = kept_frame(spark, sf), companies(spark, sf), metrics()
    base = rollup.aggregate_rankings(scores, everyone, xs.RankConfig(), registry)
    what_if = rollup.aggregate_rankings(scores, everyone, REWEIGHT, registry)
    return tidy(rollup.override_scores(base.select("ticker", "overall_score", "overall_rank"), what_if))


def _long_metric_values(wide, keys=None):
    return panel_ops.metric_panel_long(wide, keys).filter("raw_value is not null").select("ticker", "year_index", "metric_key", "raw_value")


VALUES = "from o_long where v is not null"


@query("xs_winsorize", f"""select ticker, metric_key, year_index, {rnd('least(greatest(v, lb), ub)')} as winsorized from (
        select *, max(case when r = floor(0.05::DOUBLE * (n - 1)) + 1 then v end) over g as lb, max(case when r = ceil(0.95::DOUBLE * (n - 1)) + 1 then v end) over g as ub
        from (select *, row_number() over (partition by metric_key, year_index order by v) as r, count(*) over (partition by metric_key, year_index) as n {VALUES})
        window g as (partition by metric_key, year_index))""")
def xs_winsorize(spark, sf):
    out = xs.winsorize(wide_panel(spark, sf, turns=True), ["metric_key", "year_index"], "raw_value", "ticker", 0.05, 0.95, metrics=KEYS, ordered=True)
    return tidy(out.select("ticker", "metric_key", "year_index", "winsorized"))


@query("xs_percentile_rank", f"""select ticker, metric_key, year_index, {rnd('case when n = 1 then 1.0::DOUBLE else (r - 1) / (n - 1)::DOUBLE end', 9)} as percentile
        from (select *, row_number() over (partition by metric_key, year_index order by v, ticker) as r, count(*) over (partition by metric_key, year_index) as n {VALUES})""")
def xs_percentile_rank(spark, sf):
    out = xs.percentile_rank(wide_panel(spark, sf, turns=True), ["metric_key", "year_index"], "raw_value", "ticker", metrics=KEYS, ordered=True)
    return tidy(out.select("ticker", "metric_key", "year_index", "percentile"), 9)


@query("rank_row_number", f"""select ticker, metric_key, row_number() over (partition by metric_key order by v desc, ticker) as rank {VALUES} and year_index = 0""")
def rank_row_number(spark, sf):
    rows = _long_metric_values(wide_panel(spark, sf)).filter("year_index = 0")
    return tidy(positions(rows, ["metric_key"], [F.desc("raw_value"), F.col("ticker")], "rank").select("ticker", "metric_key", "rank"))


@query("xs_applicability", f"select ticker, year_index, metric_key, {rnd('v')} as v from o_gated where not inapplicable and v is not null")
def xs_applicability(spark, sf):
    registry = metrics()
    out = xs.values_from_wide(wide_panel(spark, sf), xs.RankConfig(), registry)
    return tidy(out.select("ticker", "year_index", key_of(registry).alias("metric_key"), "v"))


@query("gate_sector", """select c.ticker, d.metric_key, case
          when r.kind = 'only' and not coalesce(cs = 'Real Estate', false) then case when trim(coalesce(sector, '')) = '' then 'real-estate-only, sector unknown' else 'real-estate-only' end
          when r.kind = 'excluded' then r.reason end as reason
        from (select *, """ + CANON + """ as cs from fx_companies) c cross join d_metrics d
        left join d_rules r on r.metric_key = d.metric_key and (r.kind = 'only' or r.canon = c.cs)""")
def gate_sector(spark, sf):
    keys = F.explode(F.array(*[F.lit(k) for k in KEYS])).alias("metric_key")
    # dealt by ticker and the spelling resolved before each company becomes a row per metric
    named = companies(spark, sf).select("ticker", "sector").repartition("ticker").withColumn("canon", sector_ops.canonical_sector(F.col("sector")))
    return tidy(sector_ops.gate_sector(named.select("ticker", "sector", "canon", keys), "canon").drop("sector", "canon"))


@query("metric_null_coverage", f"select metric_key, count(*) as n, sum(case when v is null then 1 else 0 end)::BIGINT as missing, "
                               f"{rnd('avg(case when v is null then 1.0::DOUBLE else 0.0::DOUBLE end)')} as missing_share from o_long group by metric_key")
def metric_null_coverage(spark, sf):
    return tidy(panel_ops.metric_null_coverage(wide_panel(spark, sf)))


@query("headline_metrics", f"select ticker, {', '.join(f'{rnd(k)} as {k}' for k in rollup.HEADLINE)} from o_wide where year_index = 0")
def headline_metrics(spark, sf):
    return tidy(rollup.headline_metrics(wide_panel(spark, sf)))


@query("src_metric_dim", """select m as ord, metric_key, category, direction, verdict, default_weight, negative_is_bad, sector_relative, enabled, coalesce(n, 0) as panel_values
        from d_metrics left join (select metric_key, count(v) as n from o_long group by metric_key) using (metric_key)""")
def src_metric_dim(spark, sf):
    """The dimension with the number of values that the panel holds of each metric."""
    held = panel_ops.metric_panel_long(wide_panel(spark, sf)).groupBy("metric_key").agg(F.count("raw_value").alias("panel_values"))
    return tidy(sinks.metric_dimension(spark).join(held, "metric_key", "left").withColumn("panel_values", F.coalesce("panel_values", F.lit(0))))


@query("roll_years", f"select ticker, m, {rnd('score', 9)} as score from o_rank_my")
def roll_years(spark, sf):
    return tidy(rollup.metric_scores_in_turns(wide_panel(spark, sf, turns=True), xs.RankConfig(), metrics(), ordered=True), 9)


@query("roll_category", f"select ticker, category, {rnd('score', 9)} as score, included, missing, not_applicable from o_rank_cat")
def roll_category(spark, sf):
    return tidy(category_scores(spark, sf), 9)


def category_scores(spark, sf, wide=None):
    config, registry = xs.RankConfig(), metrics()
    rolled = rollup.metric_scores_in_turns(wide_panel(spark, sf, turns=True) if wide is None else wide, config, registry, ordered=wide is None)
    return rollup.categories_long(rollup.roll_category(rolled, companies(spark, sf), config, registry))


@query("roll_overall", f"select ticker, {rnd('overall_score')} as overall_score from o_rank")
def roll_overall(spark, sf):
    return tidy(ranked(spark, sf).select("ticker", "overall_score"))


@query("score_coverage", f"select ticker, metrics_included, metrics_applicable, {rnd('coverage_ratio')} as coverage_ratio, coverage_tier from o_rank")
def score_coverage(spark, sf):
    return tidy(ranked(spark, sf).select("ticker", "metrics_included", "metrics_applicable", "coverage_ratio", "coverage_tier"))


@query("overall_rank", "select ticker, overall_rank, peer_count from o_rank")
def overall_rank(spark, sf):
    return tidy(ranked(spark, sf).select("ticker", "overall_rank", "peer_count"))


def ranked(spark, sf):
    """The default ranking."""
    return rollup.rank_universe(wide_panel(spark, sf, turns=True), companies(spark, sf), turns=True, ordered=True)


@query("xs_peer_rank", "select ticker, m, year_index, peer_rank, peer_count from o_unit")
def xs_peer_rank(spark, sf):
    return tidy(unit_frame(spark, sf).select("ticker", "m", "year_index", "peer_rank", "peer_count"))
