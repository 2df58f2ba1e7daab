"""Plans that must not gather, sort or repeat what grows with the input."""

import datetime as dt
import glob
import tempfile
import time

from pyspark.sql import functions as F

from balancebeam.functions import dims
from balancebeam.llm.common import cut
from balancebeam.operators import backtest, joins, panel, sector, statements
from balancebeam.operators.positions import positions
from balancebeam.plans import bindings
from balancebeam.session import ensure_checkpoint_dir, stored, stored_all, stored_alone, stored_slices

D = dt.date


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_yoy_latest_hashes_two_rows_a_line(spark):
    rows = [("A", 2018, 1.0, None), ("A", 2020, 4.0, 7.0), ("A", 2021, 6.0, None), ("B", 2020, 0.0, 3.0), ("B", 2021, 2.0, -3.0), ("C", 2021, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, fiscal_year int, revenue double, cost double")
    config = [("revenue", 0, None), ("cost", 1, None)]
    want = {("A", "revenue", 2020, 2021, 0.5)}
    aged = statements.yoy_latest(statements.statement_rows(df, config, aged=True))
    for found in (aged, statements.yoy_latest(statements.statement_rows(df, config))):
        assert {tuple(r) for r in found.collect()} == want
    assert "ObjectHashAggregate" not in plan_of(aged) and "SortAggregate" not in plan_of(aged)


def test_point_in_time_panel_sorts_and_groups_no_dates(spark):
    facts = spark.createDataFrame([("a", D(2016, 3, 28), D(2016, 6, 1), 1, 1, 1.0)], "entity string, end_date date, filed date, ord int, line int, val double")
    plan = plan_of(backtest.pit_panel(facts, joins.quarter_dates(D(2015, 1, 1), D(2018, 1, 1)), ["entity"]))
    assert "Window" not in plan and plan.index("Generate") < plan.index("HashAggregate")  # nothing is grouped after the dates are expanded


def test_gate_takes_the_canonical_sector_of_the_entity(spark):
    spellings = ["financial_services", "Real Estate", " ", None, "Energy", "FINANCIALS"]
    keys = sorted(dims.SECTOR_ONLY) + sorted(k for g in dims.SECTOR_EXCLUDED.values() for ks in g.values() for k in ks) + ["roe"]
    df = spark.createDataFrame([(s, k) for s in spellings for k in keys], "sector string, metric_key string")
    named = df.withColumn("canon", sector.canonical_sector(F.col("sector")))
    a = sorted(map(tuple, sector.gate_sector(df).collect()), key=repr)
    b = sorted(map(tuple, sector.gate_sector(named, "canon").drop("canon").collect()), key=repr)
    assert a == b and any(r[2] for r in a)


def test_positions_taken_in_turns_are_those_taken_at_once(spark):
    rows = [(g, y, float(k * 7 % 5) if k % 6 else None, f"t{k % 30:02d}") for k in range(120) for g in ("a", "b", None) for y in (0, 1) if (k + y) % 3]
    df = spark.createDataFrame(rows, "g string, y int, v double, ticker string").select("*", F.monotonically_increasing_id().alias("row"))
    take = lambda n: positions(df, ["g", "y"], [F.col("v"), F.col("ticker"), F.col("row")], "r", {"n": F.count(F.lit(1)), "held": F.count("v")}, few=True, slices=n)
    want = sorted(map(tuple, take(1).collect()), key=repr)
    assert sorted(map(tuple, take(3).collect()), key=repr) == want and len(want) == len(rows)
    assert take(2).where("false").count() == positions(df.where("false"), ["g"], [F.col("v")], slices=2).count() == 0


def test_turns_leave_neither_shuffles_nor_rows_behind(spark):
    ensure_checkpoint_dir(spark)
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    shuffles = lambda: {f for d in glob.glob(f"{spark.conf.get('spark.local.dir', tempfile.gettempdir())}/blockmgr-*") for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, folders = shuffles(), set(glob.glob(f"{at}/stored-*"))
    df = spark.range(0, 1000, 1, 3).select((F.col("id") % 7).alias("g"), "id")
    kept = stored_all(part.repartitionByRange(3, "g", "id") for part in stored_slices(df, ["g"], 3))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    for _ in range(50):  # they are removed behind the job
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    sizes = [spark.read.parquet(f).count() for f in set(glob.glob(f"{at}/stored-*")) - folders]
    assert sum(sizes) == 1000  # the slices' own files are empty


def test_reported_earnings_meet_in_the_panels_window(spark):
    rows = [("A", y, float(y % 7) if y % 5 else None, 8) for y in range(2004, 2021)] + [("B", 2020, 1.0, 3), ("B", None, 2.0, 3), ("C", 2019, None, 4)]
    df = spark.createDataFrame(rows, "ticker string, fiscal_year int, net_income double, p_size int")
    take = lambda h: sorted(map(tuple, panel.with_earnings_cycle(df, h).select("ticker", "fiscal_year", "net_income", "cycle_years", "cycle_latest", F.round("cycle_mean", 9)).collect()), key=repr)
    plain = F.expr("array(named_struct('fiscal_year', fiscal_year, 'net_income', net_income), named_struct('fiscal_year', fiscal_year - 20, 'net_income', 2 * net_income))")
    assert take(plain) == take(df.select("ticker", F.inline(plain))) and len(take(plain)) == len(rows)
    plan = plan_of(panel.with_earnings_cycle(df, plain))
    assert plan.count("Exchange") == 1 and "Union" not in plan


def _tables(spark, tmp_path):
    """lineitem, part and nation with a few rows, an entity without a size and one without a year."""
    spark.sql("""select id as l_orderkey, id % 5 as l_partkey, 1L as l_suppkey, 1 as l_linenumber, cast(1 + id % 50 as double) as l_quantity, 100.0D + id as l_extendedprice, 0.05D as l_discount, 0.02D as l_tax,
                 'N' as l_returnflag, 'O' as l_linestatus, case when id % 11 > 0 then timestamp'2015-01-01' + make_interval(id % 4) end as l_shipdate from range(80)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id as p_partkey, 'n' as p_name, 'b' as p_brand, 'SMALL' as p_type, cast(case when id <> 3 then id + 3 end as int) as p_size, 10.0D as p_retailprice from range(5)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select id as n_nationkey, 'x' as n_name from range(25)").write.parquet(f"{tmp_path}/nation.parquet")


def test_panel_dealt_by_entity_has_the_same_rows(spark, tmp_path):
    _tables(spark, tmp_path)
    as_is, dealt = (bindings.bind(spark, str(tmp_path), "fx_panel", dealt=d) for d in (False, True))
    want = sorted(map(tuple, as_is.collect()), key=repr)
    assert want and sorted(map(tuple, dealt.collect()), key=repr) == want
    history = dealt.select("ticker", F.inline(F.expr(bindings.EARNINGS_REPORTED)))
    assert sorted(map(tuple, history.collect()), key=repr) == sorted(map(tuple, bindings.bind(spark, str(tmp_path), "fx_earnings_history").collect()), key=repr)
    plan = plan_of(panel.metric_panel_wide(dealt, None, F.expr(bindings.EARNINGS_REPORTED)))
    assert plan.count("FileScan parquet [l_") == 1  # the line items are read and aggregated once
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(ticker" in x]
    assert len(moved) == 1 and "REPARTITION_BY_COL" in moved[0]  # and the derived lines are not dealt


def test_what_is_stored_on_the_way_is_emptied(spark):
    ensure_checkpoint_dir(spark)
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    folders = set(glob.glob(f"{at}/stored-*"))
    kept = stored_alone(lambda: stored(stored(spark.range(300)).where("id % 3 = 0")).selectExpr("id * 2 as x"))
    assert sorted(r.x for r in kept.collect()) == [6 * k for k in range(100)]
    made = set(glob.glob(f"{at}/stored-*")) - folders
    assert len(made) == 3 and sum(spark.read.parquet(f).count() for f in made) == 100


def test_a_checkpoint_leaves_no_shuffle_of_a_frame_made_before(spark):
    ensure_checkpoint_dir(spark)
    shuffles = lambda: {f for d in glob.glob(f"{spark.conf.get('spark.local.dir', tempfile.gettempdir())}/blockmgr-*") for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = shuffles()
    kept = cut(spark.range(0, 1000, 1, 3).selectExpr("id % 7 as g", "id").repartition(3, "id"))
    for _ in range(50):  # they are removed behind the job
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before and kept.count() == 1000


def test_panel_over_stored_yearly_figures_has_the_same_rows(spark, tmp_path):
    _tables(spark, tmp_path)
    yearly = stored(bindings.bind(spark, str(tmp_path), "fx_part_years"))
    given = bindings.bind(spark, str(tmp_path), "fx_panel", dealt=True, fx_part_years=yearly)
    want = sorted(map(tuple, bindings.bind(spark, str(tmp_path), "fx_panel").collect()), key=repr)
    assert want and sorted(map(tuple, given.collect()), key=repr) == want
    assert "l_extendedprice" not in plan_of(given)  # the line items are not read again
