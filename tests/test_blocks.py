"""Places taken in blocks of values against those taken row by row."""

import random

import pytest
from pyspark.sql import functions as F

from balancebeam.metrics.registry import Metric
from balancebeam.operators import blocks, panel, rollup, xs
from balancebeam.plans import bindings
from test_ranking import KEYS, REGISTRY, universe
from test_scale import _tables

SCHEMA = "ticker string, sector string, year_index int, " + ", ".join(f"{k} double" for k in KEYS)


def rows_of(df, *columns):
    return sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture
def small(monkeypatch, spark):
    """Many ranges of a group, several chunks of a task, and shared values that are ranges of their own."""
    for name, value in (("RANGE", 12), ("CHUNK", 40), ("SAMPLE", 1)):
        monkeypatch.setattr(blocks, name, value)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_and_chunks_change_no_place(spark, small):
    df = spark.createDataFrame(universe() + universe(8)[:40], SCHEMA)  # some entities come twice, with other values
    once = spark.createDataFrame(universe(), SCHEMA)
    for config in (xs.RankConfig(), xs.RankConfig(years=2, winsor_lower=0.2, winsor_upper=0.7), xs.RankConfig(winsor_lower=0.0, winsor_upper=1.0)):
        whole = xs.unit_scores(xs.values_from_wide(once, config, REGISTRY), config, REGISTRY)
        kept = xs.kept_scores(once, config, REGISTRY)
        assert len(kept.cells) < kept.found.where(F.col("kind") == blocks.SIZES).count()  # groups of several ranges
        assert any(rng % 2 for c in kept.cells.values() for rng, _ in c.ranges) and any(sub for c in kept.cells.values() for _, sub in c.ranges)
        assert rows_of(kept.scores()) == rows_of(whole) and kept.scores().columns == whole.columns
        assert rows_of(rollup.roll_years(kept, 2)) == rows_of(rollup.roll_years(whole, 2))
    assert xs.kept_scores(df, xs.RankConfig(), REGISTRY).scores().count() == xs.unit_scores(xs.values_from_wide(df, xs.RankConfig(), REGISTRY), xs.RankConfig(), REGISTRY).count()
    assert xs.kept_scores(df.where("false"), xs.RankConfig(), REGISTRY).scores().count() == 0


def test_groups_by_date_and_whole_number_keys(spark, small):
    rng = random.Random(3)
    rows = [(f"2015-0{q}-01" if q else None, t, None, 0, *[rng.choice([None, -1.0, 0.0, -0.0, 2.0, rng.random(), float("nan"), float("inf")]) for _ in range(2)]) for q in range(4) for t in rng.sample(range(1, 400), 90)]
    df = spark.createDataFrame(rows, "d string, ticker bigint, sector string, year_index int, a double, b double").withColumn("as_of", F.to_date("d")).drop("d")
    registry = [Metric("a", "valuation", "asc", "core", lambda: None, negative_is_bad=True), Metric("b", "growth", "desc", "core", lambda: None)]
    whole = xs.unit_scores(xs.values_from_wide(df, xs.RankConfig(), registry, ("as_of",)), xs.RankConfig(), registry, ("as_of",))
    dated = whole.where("as_of is not null")  # row by row, groups without a date met no statistics
    kept = xs.kept_scores(df, xs.RankConfig(), registry, ("as_of",))
    assert rows_of(kept.scores().where("as_of is not null")) == rows_of(dated) and dated.count() > 300


def test_wide_winsorizing_and_percentiles(spark, small):
    df = spark.createDataFrame(universe(), SCHEMA)
    long = panel.metric_panel_long(df.withColumn("period_key", F.lit("p")), KEYS).where("raw_value is not null")
    group = ["metric_key", "year_index"]
    want = xs.winsorize(long, group, "raw_value", "ticker", 0.05, 0.95)
    got = xs.winsorize(df, group, "raw_value", "ticker", 0.05, 0.95, metrics=KEYS)
    assert rows_of(got, "ticker", *group, "winsorized") == rows_of(want, "ticker", *group, "winsorized")
    want = xs.percentile_rank(long, group, "raw_value", "ticker")
    got = xs.percentile_rank(df, group, "raw_value", "ticker", metrics=KEYS)
    assert rows_of(got, "ticker", *group, "percentile") == rows_of(want, "ticker", *group, "percentile")


def test_values_move_in_blocks(spark):
    """What is kept has a row per chunk and peer group, not one per value, and entities do not meet again to roll up their years."""
    df = spark.range(0, 4000, 1, 4).select(F.format_string("T%06d", "id").alias("ticker"), F.lit("Energy").alias("sector"), F.lit(0).alias("year_index"), *[F.rand(k).alias(key) for k, key in enumerate(KEYS)])
    kept = xs.kept_scores(df, xs.RankConfig(), REGISTRY)
    assert kept.scores().count() == 7 * 4000  # one metric is of another sector
    assert kept.found.count() < 200
    plan = rollup.roll_years(kept, 5)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange") == 1


def test_rows_out_of_order_fail(spark):
    df = spark.createDataFrame(universe(), SCHEMA).repartition(3, "ticker").sortWithinPartitions("ticker")
    with pytest.raises(ValueError, match="order"):
        xs.kept_scores(df, xs.RankConfig(), REGISTRY, ordered=True)


def test_panel_over_stored_lines_has_the_same_rows_in_order(spark, tmp_path):
    _tables(spark, tmp_path)
    momentum = spark.createDataFrame([("P00000001", 1.0, 2.0, 3.0), ("P00000009", 4.0, 5.0, 6.0)], ["ticker", *panel.MOMENTUM])
    given = bindings.bind(spark, str(tmp_path), "fx_panel", fx_part_lines=bindings.part_lines(spark, str(tmp_path), momentum))
    plain = bindings.bind(spark, str(tmp_path), "fx_panel")
    assert rows_of(given, *plain.columns) == rows_of(plain) and given.count() > 4
    history = F.expr(bindings.EARNINGS_REPORTED)
    ranged = panel.metric_panel_wide(given, None, history)
    assert rows_of(ranged) == rows_of(panel.metric_panel_wide(plain, momentum, history))
    assert ranged.where("momentum_12m1m is not null").count() > 0
    tickers = [r.ticker for r in ranged.collect()]
    assert tickers == sorted(tickers)


def test_panel_tasks_follow_its_rows(spark, tmp_path, monkeypatch):
    """Every yearly row becomes a value per metric, so the bytes that are shuffled say too little about a task's work."""
    _tables(spark, tmp_path)
    monkeypatch.setattr(bindings, "TASK_ROWS", 3)
    lines = bindings.part_lines(spark, str(tmp_path), spark.createDataFrame([], "ticker string, " + ", ".join(f"{c} double" for c in panel.MOMENTUM)))
    held = bindings.bind(spark, str(tmp_path), "fx_panel", fx_part_lines=lines).select(F.spark_partition_id().alias("p"), "ticker")
    assert held.select("p").distinct().count() > 2 and held.groupBy("ticker").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
