"""Ranking against a plain restatement of the rules on a seeded universe, and the two physical plans against each other."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from balancebeam.metrics.registry import YEAR_WEIGHTS, Metric, metrics
from balancebeam.operators import rollup, xs
from balancebeam.operators.positions import positions

SECTORS = ["Technology"] * 52 + ["Financial Services"] * 6 + ["Financials"] * 34 + ["Energy"] * 66 + ["Real Estate"] * 40 + ["Utilities"] + [None] * 2

REGISTRY = [
    Metric("pe_ttm", "valuation", "asc", "core", lambda: None, negative_is_bad=True),
    Metric("fcf_yield", "valuation", "desc", "core", lambda: None),
    Metric("roic", "profitability", "desc", "supporting", lambda: None),
    Metric("asset_turnover", "efficiency", "desc", "caveat", lambda: None, sector_relative=True),
    Metric("fcf_exceeds_net_income", "earningsQuality", "desc", "core", lambda: None),  # 0/1: nothing but ties
    Metric("capex_to_revenue", "capitalAllocation", "asc", "core", lambda: None),  # constant
    Metric("ffo_yield", "valuation", "desc", "supporting", lambda: None),  # one sector only
    Metric("sbc_to_fcf", "earningsQuality", "asc", "caveat", lambda: None, negative_is_bad=True),  # never positive
]
KEYS = [m.key for m in REGISTRY]


def universe(seed=7):
    rng = random.Random(seed)
    rows = []
    for i, sector in enumerate(SECTORS):
        for y in range(rng.randint(1, 5)):
            q = lambda lo, hi: round(rng.uniform(lo, hi), 1)
            vals = [q(-10, 30), q(-1, 1), q(-0.5, 0.5), q(0, 3), float(rng.random() < 0.5), 0.05, q(0, 1), -q(0, 2)]
            rows.append((f"T{i:04d}", sector, y, *[None if rng.random() < 0.15 else v for v in vals]))
    return rows


def canon(s):
    return {"Financials": "Financials", "Financial Services": "Financials", "Real Estate": "Real Estate"}.get(s)


def fits(key, sector):
    if key == "ffo_yield":
        return canon(sector) == "Real Estate"
    return not ((canon(sector) == "Financials" and key in ("fcf_yield", "roic", "asset_turnover", "capex_to_revenue", "sbc_to_fcf"))
                or (canon(sector) == "Real Estate" and key == "pe_ttm"))


def brute(rows, config):
    """(ticker, key, year) -> (score, rank, peers)."""
    out = {}
    for mi, m in enumerate(REGISTRY):
        for y in range(config.years):
            members = [(r[0], r[1], r[3 + mi]) for r in rows if r[2] == y and r[3 + mi] is not None and fits(m.key, r[1])]
            groups = {}
            for t, s, v in members:
                groups.setdefault(s if m.sector_relative else "", []).append((t, v))
            for g in groups.values():
                if len(g) < 2:
                    continue
                g.sort()
                npos = sum(v > 0 for _, v in g) if m.negative_is_bad else len(g)
                flip = m.direction == "asc"
                if npos in (0, len(g)):
                    unit, order = norm(g, config)
                    rising = npos == 0 or not flip
                    sc = {t: (u if rising else 1 - u) for t, u in unit.items()}
                    rank = ranks(order, rising, 0)
                else:
                    p, n = [x for x in g if x[1] > 0], [x for x in g if x[1] <= 0]
                    up, op = norm(p, config)
                    un, on = norm(n, config)
                    sc = {t: 0.5 + 0.5 * (1 - u if flip else u) for t, u in up.items()} | {t: u * xs.NEGATIVE_CEILING for t, u in un.items()}
                    rank = ranks(op, not flip, 0) | ranks(on, True, len(p))
                if config.method == "zscore":
                    rank = {t: i + 1 for i, t in enumerate(sorted(sc, key=lambda t: (-sc[t], t)))}
                for t in sc:
                    out[t, m.key, y] = (sc[t], rank[t], len(g))
    return out


def norm(g, config):
    n = len(g)
    vals = sorted(v for _, v in g)
    lb, ub = vals[math.floor(config.winsor_lower * (n - 1))], vals[math.ceil(config.winsor_upper * (n - 1))]
    w = [(t, min(max(v, lb), ub)) for t, v in g]
    order = [t for t, _ in sorted(w, key=lambda x: (x[1], x[0]))]
    if config.method == "percentile":
        return ({order[0]: 1.0} if n == 1 else {t: i / (n - 1) for i, t in enumerate(order)}), order
    mu = sum(v for _, v in w) / n
    sd = 0.0 if lb == ub else math.sqrt(sum((v - mu) ** 2 for _, v in w) / n)
    return {t: 1 / (1 + math.exp(-(0 if sd == 0 else (v - mu) / sd))) for t, v in w}, order


def ranks(order, rising, base):
    return {t: base + i + 1 for i, t in enumerate(reversed(order) if rising else order)}


CONFIGS = [xs.RankConfig(), xs.RankConfig(method="zscore", years=3, winsor_lower=0.05, winsor_upper=0.95), xs.RankConfig(years=1, winsor_lower=0.0, winsor_upper=1.0)]


@pytest.mark.parametrize("config", CONFIGS, ids=["percentile", "zscore", "one-year"])
def test_unit_scores_match_the_rules(spark, config):
    rows = universe()
    wide = spark.createDataFrame(rows, "ticker string, sector string, year_index int, " + ", ".join(f"{k} double" for k in KEYS))
    got = xs.unit_scores(xs.values_from_wide(wide, config, REGISTRY), config, REGISTRY).collect()
    want = brute(rows, config)
    assert len(got) == len(want)
    for r in got:
        s, rank, peers = want[r.ticker, KEYS[r.m], r.year_index]
        assert r.score == pytest.approx(s, abs=1e-9) and r.peer_count == peers
        assert r.peer_rank == rank, (r, rank)


def test_overall_ranking(spark):
    rows, config = universe(), xs.RankConfig()
    wide = spark.createDataFrame(rows, "ticker string, sector string, year_index int, " + ", ".join(f"{k} double" for k in KEYS))
    everyone = wide.select("ticker", "sector").distinct()
    got = {r.ticker: r for r in rollup.rank_universe(wide, everyone, config, REGISTRY).collect()}
    units = brute(rows, config)
    scores = {}
    for i, sector in enumerate(SECTORS):
        t, cats = f"T{i:04d}", {}
        included = missing = 0
        for m in REGISTRY:
            if not fits(m.key, sector):
                continue
            ys = [(YEAR_WEIGHTS[y], units[t, m.key, y][0]) for y in range(5) if (t, m.key, y) in units]
            if not ys:
                missing += 1
                continue
            included += 1
            cats.setdefault(m.category, []).append((m.default_weight, sum(w * s for w, s in ys) / sum(w for w, _ in ys)))
        cat = [(config.category_weights[c], sum(w * s for w, s in v) / sum(w for w, _ in v)) for c, v in cats.items()]
        scores[t] = sum(w * s for w, s in cat) / sum(w for w, _ in cat) * 100 if cat else None
        assert got[t].metrics_included == included and got[t].metrics_applicable == included + missing
        if scores[t] is None:
            assert got[t].overall_score is None and got[t].overall_rank is None
        else:
            assert got[t].overall_score == pytest.approx(scores[t], abs=1e-9)
    order = sorted((t for t in scores if scores[t] is not None), key=lambda t: (-round(scores[t], 9), t))
    assert [got[t].overall_rank for t in order] == list(range(1, len(order) + 1))


def test_distributed_positions_with_one_hot_group(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), (F.col("id") * 7919 % 13).alias("v"))
    a = positions(df, ["g"], [F.col("v"), F.col("id")])
    b = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long"))
    assert a.exceptAll(b).count() == 0 and a.count() == 30_000


def test_weights_of_zero_count_as_missing(spark):
    rows = universe()
    wide = spark.createDataFrame(rows, "ticker string, sector string, year_index int, " + ", ".join(f"{k} double" for k in KEYS))
    everyone = wide.select("ticker", "sector").distinct()
    off = xs.RankConfig(metric_weights={"roic": 0.0})
    out = rollup.rank_universe(wide, everyone, off, REGISTRY)
    assert out.filter("profitability_included > 0").count() == 0
    assert out.filter("sector = 'Energy'").agg(F.min("profitability_missing")).first()[0] == 1


def test_registry():
    reg = metrics()
    assert len(reg) == 81 and len({m.key for m in reg}) == 81
    assert {m.key for m in reg if m.sector_relative} == {"asset_turnover", "inventory_turnover", "receivable_turnover"}


@pytest.mark.parametrize("method", ["percentile", "zscore"])
def test_scores_shuffle_values_only_to_sort_them(spark, method):
    """Group statistics and shifts reach the value rows by broadcast, however small the planner takes them to be."""
    df = spark.createDataFrame(universe(), "ticker string, sector string, year_index int, " + ", ".join(f"{k} double" for k in KEYS))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        config = xs.RankConfig(method=method)
        scores = xs.unit_scores(xs.values_from_wide(df, config, REGISTRY), config, REGISTRY)
        plan = scores._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("method", ["percentile", "zscore"])
def test_metrics_in_turns_score_as_at_once(spark, method):
    df = spark.createDataFrame(universe(), "ticker string, sector string, year_index int, " + ", ".join(f"{k} double" for k in KEYS))
    config = xs.RankConfig(method=method)
    take = lambda scores: sorted(tuple(x if not isinstance(x, float) else round(x, 12) for x in r) for r in scores.collect())
    whole = xs.unit_scores(xs.values_from_wide(df, config, REGISTRY), config, REGISTRY)
    want, parts = take(whole), xs.unit_scores_in_turns(df, config, REGISTRY)
    assert want and take(parts) == want and parts.columns == whole.columns
    rolled = rollup.metric_scores_in_turns(df, config, REGISTRY)
    assert take(rolled) == take(rollup.roll_years(whole, config.years))
    if method == "percentile":  # the values are not among what is kept
        assert " v#" not in parts._jdf.queryExecution().executedPlan().toString()
        assert " v#" in whole._jdf.queryExecution().executedPlan().toString()


def test_parts_of_whole_groups_are_placed_as_all_at_once(spark):
    df = spark.createDataFrame([(f"m{k % 5}", k % 3, f"T{k:03d}", float((k * 37) % 101) if k % 7 else 5.0) for k in range(200)], "metric_key string, year_index int, ticker string, v double")
    group, parts = ["metric_key", "year_index"], [df.filter("metric_key < 'm2'"), df.filter("metric_key >= 'm2'")]
    take = lambda out, c: sorted(map(tuple, out.select("ticker", *group, c).collect()))
    assert take(xs.winsorize(df, group, "v", "ticker", 0.05, 0.95, parts), "winsorized") == take(xs.winsorize(df, group, "v", "ticker", 0.05, 0.95), "winsorized")
    got = xs.percentile_rank(df, group, "v", "ticker", parts)
    assert take(got, "percentile") == take(xs.percentile_rank(df, group, "v", "ticker"), "percentile") and "v" not in got.columns
