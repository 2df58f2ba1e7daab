"""Unit scores to metric, category and overall scores, with coverage and the overall rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancebeam.functions import dims
from balancebeam.functions.scalars import coverage_tier
from balancebeam.metrics.registry import CATEGORIES, YEAR_WEIGHTS, Metric
from balancebeam.operators.positions import SLICES, positions
from balancebeam.operators.sector import canonical_sector
from balancebeam.operators.xs import TURN_SLICES, KeptScores, RankConfig, enabled_metrics, kept_scores, turns_of, unit_scores, values_from_wide
from balancebeam.session import stored, stored_all, stored_alone


def _lookup(constants, number: str) -> str:
    """SQL text of a lookup by number in a constant array: a handful of constants instead of a join."""
    return f"element_at(array({', '.join(f'{float(x)!r}D' for x in constants)}), {number} + 1)"


def roll_years(scores: DataFrame | KeptScores, years: int, by: tuple[str, ...] = (), slices: int = SLICES, of: str = "m") -> DataFrame:
    """(by, ticker, m, score): year weights renormalised over the years present.

    Kept scores lie by entity already and are rolled up in one pass over their places. Of others
    metrics are taken in ``slices`` turns by ``of``, each written: the disk holds one turn's scores on their way to the entities, and a row per entity and metric of those before.
    """
    if isinstance(scores, KeptScores):
        return scores.rolled(years)
    kept = scores.filter(F.col("year_index") < min(years, len(YEAR_WEIGHTS))).select(*by, "ticker", "m", "year_index", "score")
    w = _lookup(YEAR_WEIGHTS, "year_index")
    # dealt by entity, of which a turn holds at most metrics x years rows, and written in its order
    turns = (kept.where(F.expr(f"pmod({of}, {slices}) = {k}")).repartition(*by, "ticker").groupBy(*by, "ticker", "m").agg(F.expr(f"sum({w} * score) / sum({w})").alias("score")) for k in range(slices))
    return stored_all(turns)


def metric_scores_in_turns(wide: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """``roll_years`` of the unit scores of a wide panel, metrics in turns: a turn's values leave the disk when they are placed.

    ``wide`` is read once a turn: it should be stored, or quickly derived from what is. ``ordered``: see ``blocks.placed``.
    """
    if config.method == "percentile":
        return roll_years(kept_scores(wide, config, registry, by, ordered), config.years, by)
    n = turns_of(registry)
    turn = lambda k: unit_scores(values_from_wide(wide, config, registry, by, k, n), config, registry, by, TURN_SLICES)
    return stored_alone(*[lambda k=k: roll_years(turn(k), config.years, by, TURN_SLICES, f"m div {n}") for k in range(n)])


def metric_weight(m: Metric, config: RankConfig) -> float:
    return config.metric_weights.get(m.key, m.default_weight)


def applicable_counts(registry: list[Metric]) -> dict[str, dict[str | None, int]]:
    """Metrics per category that describe each canonical sector; a constant of the registry."""
    out: dict[str, dict[str | None, int]] = {c: {} for c in CATEGORIES}
    for canon in (None, "Financials", "Real Estate"):
        gone = {k for ks in dims.SECTOR_EXCLUDED.get(canon or "", {}).values() for k in ks}
        gone |= {k for k, s in dims.SECTOR_ONLY.items() if s != canon}
        for c in CATEGORIES:
            out[c][canon] = sum(1 for m in registry if m.category == c and m.key not in gone)
    return out


def roll_category(metric_scores: DataFrame, companies: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per entity: for every category its score and the counts included / missing / not applicable."""
    aggs = []
    weights = [metric_weight(m, config) for m in registry]
    for c in CATEGORIES:
        numbers = [i for i, m in enumerate(registry) if m.category == c and weights[i] > 0]
        mine = f"m in ({', '.join(map(str, numbers))})" if numbers else "false"
        aggs += [F.expr(f"sum(w * score) filter (where {mine}) / sum(w) filter (where {mine})").alias(f"{c}_score"),
                 F.expr(f"count_if({mine})").alias(f"{c}_included")]
    weighted = metric_scores.withColumn("w", F.expr(_lookup(weights, "m")))
    scored = weighted.groupBy(*by, "ticker").agg(*aggs)
    out = companies.select(*by, "ticker", "sector").join(scored, [*by, "ticker"], "left")
    counts = applicable_counts(registry)
    extra = []
    for c in CATEGORIES:
        fits = f"case canon when 'Financials' then {counts[c]['Financials']} when 'Real Estate' then {counts[c]['Real Estate']} else {counts[c][None]} end"
        total = sum(1 for m in registry if m.category == c)
        extra += [f"{c}_score", f"coalesce({c}_included, 0) as {c}_included", f"{fits} - coalesce({c}_included, 0) as {c}_missing", f"{total} - {fits} as {c}_not_applicable"]
    return out.withColumn("canon", canonical_sector(F.col("sector"))).selectExpr(*by, "ticker", "sector", *extra)


def roll_overall(categories: DataFrame, config: RankConfig) -> DataFrame:
    """Add overall_score (0-100) and coverage over the weighted categories."""
    active = [(c, float(w)) for c, w in config.category_weights.items() if w > 0]
    add = lambda xs: " + ".join(xs) or "0"
    weight = add(f"if({c}_score is not null, {w!r}D, 0D)" for c, w in active)
    total = add(f"coalesce({c}_score * {w!r}D, 0D)" for c, w in active)
    sums = categories.selectExpr(
        "*", f"try_divide({total}, {weight}) * 100 as overall_score", f"{add(f'{c}_included' for c, _ in active)} as metrics_included",
        f"{add(f'{c}_included + {c}_missing' for c, _ in active)} as metrics_applicable")
    ratio = F.coalesce(F.try_divide("metrics_included", "metrics_applicable").cast("double"), F.lit(0.0))
    return sums.withColumn("coverage_ratio", ratio).withColumn("coverage_tier", coverage_tier("coverage_ratio"))


def overall_rank(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row-number rank by score, ties by ticker; no score, no rank. Without ``by``, peer_count is the whole universe.

    The wide rows are written once. Only (score, ticker) is ranked, over range partitions at any size, and joined back, so no task meets the universe.
    """
    scored = stored(scored)
    # rounding keeps equal scores tied however sums were partitioned
    narrow = scored.filter("overall_score is not null").select(*by, "ticker", F.round("overall_score", 9).alias("_s"))
    ranks = positions(narrow, list(by), [F.desc("_s"), F.col("ticker")], "overall_rank").select(*by, "ticker", F.col("overall_rank").cast("long"))
    out = scored.join(ranks, [*by, "ticker"], "left")
    # one row
    return out if by else out.crossJoin(F.broadcast(scored.agg(F.count(F.lit(1)).alias("peer_count"))))


def aggregate_rankings(scores: DataFrame | KeptScores, companies: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...] = ()) -> DataFrame:
    """The weight-dependent half: reusable over stored unit scores for any weights and for fewer years."""
    return _ranked(roll_years(scores, config.years, by), companies, config, registry, by)


def _ranked(metric_scores: DataFrame, companies: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...]) -> DataFrame:
    return overall_rank(roll_overall(roll_category(metric_scores, companies, config, registry, by), config), by)


def rank_universe(wide: DataFrame, companies: DataFrame, config: RankConfig = RankConfig(), registry: list[Metric] | None = None,
                  by: tuple[str, ...] = (), turns: bool = False, ordered: bool = False) -> DataFrame:
    """Full ranking. ``companies`` (by, ticker, sector) is the universe. ``turns``, ``ordered``: see ``metric_scores_in_turns``."""
    registry = enabled_metrics(registry)
    if turns:
        return _ranked(metric_scores_in_turns(wide, config, registry, by, ordered), companies, config, registry, by)
    scores = unit_scores(values_from_wide(wide, config, registry, by), config, registry, by)
    return aggregate_rankings(scores, companies, config, registry, by)


def override_scores(stored: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overlay what-if scores on the stored ranking: per entity present in ``overrides`` its score and rank replace the stored ones."""
    o = overrides.select("ticker", F.col("overall_score").alias("_s"), F.col("overall_rank").alias("_r"), F.lit(True).alias("_hit"))
    out = stored.join(o, "ticker", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return (
        out.withColumn("overall_score", F.when(hit, F.col("_s")).otherwise(F.col("overall_score")))
        .withColumn("overall_rank", F.when(hit, F.col("_r")).otherwise(F.col("overall_rank")))
        .drop("_s", "_r", "_hit")
    )


HEADLINE = ("pe_ttm", "ev_ebitda", "dividend_yield", "roic", "fcf_yield", "growth_revenue_1y")


def headline_metrics(wide: DataFrame) -> DataFrame:
    return wide.filter(F.col("year_index") == 0).select("ticker", *HEADLINE)


def categories_long(categories: DataFrame) -> DataFrame:
    """One row per entity and category: score and the three counts."""
    entry = lambda c: F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("score"), F.col(f"{c}_included").alias("included"),
                               F.col(f"{c}_missing").alias("missing"), F.col(f"{c}_not_applicable").alias("not_applicable"))
    return categories.select("ticker", F.inline(F.array(*[entry(c) for c in CATEGORIES])))
