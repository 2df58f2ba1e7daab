"""Literal-row checks of the edge cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from balancebeam.functions import scalars as s
from balancebeam.functions.lexicon import Lexicon
from balancebeam.operators import backtest, facts, forensics, joins, prices, screens, sentiment, strategies, valuation
from balancebeam.sources import readers, sinks
from balancebeam.streaming import incremental

D = dt.date
FACT = "entity string, tag string, tag_priority int, start_date date, end_date date, filed date, val double, form string, ord int, line int"


def one(spark, expr, **values):
    row = [tuple(values.values())]
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) or v is None else 'string'}" for k, v in values.items())
    return spark.createDataFrame(row, kinds).select(expr.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, s.safe_div("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, s.ratio_pos("a", "b"), a=1.0, b=-2.0) is None
    assert one(spark, s.cagr_end("a", "b", 3), a=-1.0, b=2.0) is None
    assert one(spark, s.cagr_end("a", "b", 1), a=-1.0, b=2.0) == -1.5
    assert one(spark, s.clamp("a", 1.0, 2.0), a=None) is None
    assert one(spark, s.round_half_up("a", 1), a=-0.25) == -0.2
    assert one(spark, s.tax_rate_roic("a", "b"), a=5.0, b=-2.0) == 0.21
    assert one(spark, s.fiscal_year_end_label("a"), a="0930") == "September 30"
    assert one(spark, s.fiscal_year_end_label("a"), a="0231") is None
    assert one(spark, s.decode_entities("a"), a="A &amp;lt; &quot;B&quot;") == 'A < "B"'
    assert one(spark, s.compact_timestamp("a"), a="20240131T0930Z") is None


def test_facts(spark):
    e = D(2020, 12, 31)
    rows = [
        ("A", "t1", 0, D(2020, 1, 1), e, D(2021, 2, 1), 1.0, "10-K", 1, 1), ("A", "t1", 0, D(2020, 1, 1), e, D(2022, 2, 1), 2.0, "10-K", 2, 1),
        ("A", "t2", 1, D(2020, 1, 1), e, D(2023, 2, 1), 3.0, "10-K", 3, 1), ("A", "t1", 0, D(2020, 10, 1), e, D(2024, 2, 1), 9.0, "10-K", 4, 1),
        ("A", "t1", 0, D(2020, 1, 1), e, D(2024, 2, 1), 8.0, "10-Q", 5, 1),
        ("B", "t2", 1, None, e, D(2021, 2, 1), 5.0, "10-K", 1, 1), ("B", "t1", 0, None, e, D(2021, 2, 1), 4.0, "10-K", 2, 1),
        ("C", "t1", 0, None, D(2020, 6, 30), D(2020, 9, 1), 6.0, "10-K", 1, 1), ("C", "t1", 0, None, e, D(2020, 12, 1), 7.0, "10-K", 2, 1),
    ]
    df = spark.createDataFrame(rows, FACT)
    assert {r.entity: r.val for r in facts.latest_filed(df).filter("end_date = '2020-12-31'").collect()} == {"A": 3.0, "B": 4.0, "C": 7.0}
    assert {r.entity: r.val for r in facts.tag_fallback(df).filter("end_date = '2020-12-31'").collect()} == {"A": 2.0, "B": 4.0, "C": 7.0}
    assert {r.entity: r.val for r in facts.to_fiscal_year(facts.tag_fallback(df), 3).collect()} == {"A": 2.0, "B": 4.0, "C": 7.0}
    filed = {r.entity: r.filed_at for r in facts.filed_at(df.withColumn("concept", F.lit("x"))).collect()}
    # C's later period end carries a filing date before it, which clears the year
    assert filed == {"A": D(2023, 2, 1), "B": D(2021, 2, 1), "C": None}


def test_public_float_prefers_later_cover_then_later_filing(spark):
    rows = [("A", D(2020, 6, 30), D(2021, 2, 1), 1.0, "10-K", 2020, 1, 1), ("A", D(2020, 6, 30), D(2021, 5, 1), 2.0, "10-K/A", 2020, 2, 1),
            ("A", D(2019, 6, 30), D(2021, 6, 1), 3.0, "10-K", 2020, 3, 1), ("A", D(2020, 6, 30), D(2022, 1, 1), -5.0, "10-K", 2020, 4, 1)]
    df = spark.createDataFrame(rows, "entity string, end_date date, filed date, val double, form string, fy int, ord int, line int")
    assert [(r.fiscal_year, r.public_float) for r in facts.public_float_history(df, F.lit(True)).collect()] == [(2020, 2.0)]


def test_months_end_where_the_month_ends():
    assert joins.plus_months(D(2023, 10, 31), 4) == D(2024, 2, 29) and joins.plus_months(D(2020, 1, 1), 12) == D(2021, 1, 1)
    assert joins.quarter_dates(D(2020, 11, 30), D(2021, 6, 1)) == [D(2020, 11, 30), D(2021, 2, 28), D(2021, 5, 30)]


def test_snapshot_of_a_day_over_several_batches(spark, tmp_path):
    from balancebeam.streaming.incremental import snapshot_append

    for k, days in enumerate((["2024-01-01", "2024-01-02"], ["2024-01-01"], ["2024-01-01", "2024-01-02"])):
        spark.createDataFrame([(d, k) for d in days], "date string, v int").selectExpr("cast(date as date) as date", "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("date date, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        snapshot_append(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", lambda b: b.groupBy("date").count()).awaitTermination()
    assert {str(r.date): r["count"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"2024-01-01": 3, "2024-01-02": 2}


def test_companyfacts_json(spark):
    one = '[{"end":"2020-12-31","val":1,"form":"10-K","filed":"2021-02-01"}]'
    body = '{"facts":{"us-gaap":{"R":{"units":{"shares":%s,"USD":{}}},"S":{"units":{"shares":%s}},"T":{"units":{"EUR":%s}}}}}' % (one, one, one)
    assert [(r.tag, r.unit, r.val) for r in facts.explode_companyfacts(spark.createDataFrame([("A", body)], "ticker string, json string")).collect()] == [("S", "shares", 1.0)]


def test_momentum_defaults(spark):
    start = D(2023, 1, 2)
    points = [("A", start + dt.timedelta(days=i), 100.0 + i) for i in range(400)]
    points += [("B", start + dt.timedelta(days=i), 50.0) for i in range(20)]
    out = {r.entity: r for r in prices.momentum(spark.createDataFrame(points, "entity string, date date, close double")).collect()}
    last = start + dt.timedelta(days=399)  # 2024-02-05: one month back 2024-01-05, twelve months back 2023-02-05
    smooth = lambda d: sum(100.0 + (d - start).days - k for k in range(5)) / 5
    assert out["A"].as_of == last
    assert out["A"].return_12m1m == pytest.approx(smooth(D(2024, 1, 5)) / smooth(D(2023, 2, 5)) - 1)
    assert out["A"].risk_adjusted_3m > 0
    assert out["B"].return_12m1m is None and out["B"].risk_adjusted_3m is None  # short span; no volatility


def test_sentiment(spark):
    lex = Lexicon(frozenset({"gain"}), frozenset({"loss"}), frozenset({"not", "no"}))
    df = spark.createDataFrame([(1, "Gain, LOSS and gain"), (2, "not a big gain"), (3, "no one two three gain"), (4, "no loss"), (5, "")], "id int, text string")
    got = {r.id: (r.matched_positive, r.matched_negative, r.score) for r in sentiment.score_text(df, "text", lex).collect()}
    assert got[1][:2] == (2, 1) and got[1][2] == pytest.approx(1 / 3)
    assert got[2] == (0, 1, -1.0) and got[3] == (1, 0, 1.0) and got[4] == (1, 0, 1.0) and got[5] == (0, 0, 0.0)
    t = [r.token for r in sentiment.explode_tokens(spark.createDataFrame([(1, "It's a well-known-fact 42")], "id int, text string"), "id", "text").orderBy("pos").collect()]
    assert t == ["it's", "a", "well-known", "fact"]


def test_joins(spark):
    left = spark.createDataFrame([("A", D(2020, 1, 15))], "entity string, d date")
    right = spark.createDataFrame([("A", D(2020, 1, 10), 1.0), ("A", D(2020, 1, 20), 2.0), ("A", D(2020, 2, 20), 3.0)], "entity string, date date, close double")
    r = joins.nearest(left, right, "d", "date", 14, "close").first()
    assert (r.matched_date, r.gap_days, r.matched_value) == (D(2020, 1, 10), 5, 1.0)
    assert joins.nearest(left, right, "d", "date", 4, "close").count() == 0
    dates = [D(2020, 1, 1), D(2020, 1, 18), D(2020, 3, 1)]
    back = {(r.as_of): r.close for r in joins.asof_backward(right, dates, "date", ["date"], ["close"], ["entity"]).collect()}
    assert back == {D(2020, 1, 18): 1.0, D(2020, 3, 1): 3.0}
    ahead = {(r.as_of): r.close for r in joins.asof_forward(right, dates, "date", ["date", "close"], ["entity"]).collect()}
    assert ahead == {D(2020, 1, 1): 1.0, D(2020, 1, 18): 2.0}


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.4 else f"e{rng.randint(0, 20)}"), D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 700)), float(i)) for i in range(3000)]
    rows = list({(e, d): (e, d, v) for e, d, v in rows}.values())
    dates = joins.quarter_dates(D(2020, 1, 1), D(2022, 1, 1))
    got = {(r.entity, r.as_of): r.close for r in joins.asof_backward(spark.createDataFrame(rows, "entity string, date date, close double"), dates, "date", ["date"], ["date", "close"], ["entity"]).collect()}
    want = {}
    for e, d, v in sorted(rows):
        for a in dates:
            if d <= a:
                want[e, a] = v
    assert got == want


def test_range_float(spark):
    floats = spark.createDataFrame([("A", D(2020, 7, 31), 2020), ("U", D(2020, 7, 31), 2020)], "ticker string, float_as_of date, float_year int")
    years = spark.createDataFrame([("A", 2021, D(2021, 1, 31)), ("A", 2020, D(2020, 1, 31)), ("U", 2020, None)], "ticker string, fiscal_year int, period_end date")
    assert {r.ticker: r.matched_year for r in joins.range_float(floats, years).collect()} == {"A": 2021, "U": 2020}


def test_quote_and_universe(spark):
    df = spark.createDataFrame([(2e13, 1e12), (1e9, 1e6), (1e9, None), (1e9, -5.0), (None, 1.0)], "cap double, rev double")
    assert [r.x for r in df.select(screens.market_cap_plausible("cap", "rev").alias("x")).collect()] == [False, False, True, True, False]
    t = spark.createDataFrame([("AB-B", 1), ("ABC", 1), ("XY", None), ("XZ", None), ("BRK.A", 2), ("BRK-B", 2)], "ticker string, cik int")
    assert {r.ticker for r in screens.superseded_tickers(t).collect()} == {"AB-B", "BRK.A"}


def test_missing_field_is_false_and_not_inverts_it(spark):
    df = spark.createDataFrame([("A", None), ("B", 5.0)], "ticker string, pe double")
    assert [r.ticker for r in df.filter(screens.cmp("pe", "<", 10)).collect()] == ["B"]
    assert [r.ticker for r in df.filter(~screens.cmp("pe", "<", 10)).collect()] == ["A"]


def test_strategy_qualifies_is_null_while_gaps_could_pass(spark):
    chain = [("x", "X", [("a", ">", 1.0), ("b", ">", 1.0)], 2)]
    df = spark.createDataFrame([("P", 2.0, None), ("F", 0.0, None), ("T", 2.0, 2.0)], "ticker string, a double, b double")
    assert {r.ticker: r.qualifies for r in strategies.strategy_eval(df, chain).collect()} == {"P": None, "F": False, "T": True}


def test_point_in_time_panel_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice("abc"), D(2015 + rng.randint(0, 3), rng.choice([3, 9, 12]), 28), i, rng.randint(1, 3), float(i)) for i in range(400)]
    rows = [(e, end, end + dt.timedelta(days=rng.randint(10, 700)), o, n, v) for e, end, o, n, v in rows]
    rows += [("late", D(2016, 3, 28), D(2030, 1, 1), 1, 1, 1.0), ("void", D(2016, 3, 28), D(2016, 4, 1), 1, 1, None)]
    dates = joins.quarter_dates(D(2015, 1, 1), D(2020, 1, 1))
    facts = spark.createDataFrame(rows, "entity string, end_date date, filed date, ord int, line int, val double")
    got = {(r.entity, r.as_of): (r.end_date, r.filed, r.val, r.prior_val) for r in backtest.pit_panel(facts, dates, ["entity"]).collect()}
    want = {}
    for e in {r[0] for r in rows}:
        for a in dates:
            known = sorted(((end, f, -o, -n), v) for x, end, f, o, n, v in rows if x == e and f <= a)
            if known:
                (end, filed, *_), val = known[-1]
                prior = [v for (x, *_), v in known if x.year < end.year]
                want[e, a] = (end, filed, val, prior[-1] if prior else None)
    assert got == want


def test_implied_growth_matches_bisection(spark):
    def firm(g, rate):
        fcf, pv = 1.0, 0.0
        for t in range(1, 11):
            fcf *= 1 + g + (0.025 - g) * ((t - 1) / 9)
            pv += fcf / (1 + rate) ** t
        return pv + fcf * 1.025 / (rate - 0.025) / (1 + rate) ** 10

    xs_ = {f"T{i}": x for i, x in enumerate((3.0, 8.5, 15.0, 31.7, 60.0))}
    df = spark.createDataFrame([(t, x * 7, 7.0, None) for t, x in xs_.items()] + [("low", 0.01, 1.0, None), ("out", 50.0, 1.0, "sector")],
                               "ticker string, enterprise_value double, trailing_fcf double, reason string")
    for r in valuation.reverse_dcf_grid(df).collect():
        if r.ticker == "low":
            assert r.implied_growth is None
            continue
        lo, hi = -0.5, 0.6
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if firm(mid, r.rate) < xs_[r.ticker] else (lo, mid)
        assert r.implied_growth == pytest.approx(lo, abs=1e-4)


def test_forensic_sector_match_is_exact(spark):
    base = {c: 100.0 for c in forensics.LINES}
    rows = [(t, sec, 50.0, y, *[base[c] * (1 + 0.5 * (y - 2019) * (c == "receivables")) for c in forensics.LINES]) for t, sec in (("A", "Financials"), ("B", "Financial Services")) for y in (2020, 2019)]
    df = spark.createDataFrame(rows, "ticker string, sector string, market_cap double, fiscal_year int, " + ", ".join(f"{c} double" for c in forensics.LINES))
    out = {r.ticker: r for r in forensics.forensic_report(forensics.newest_periods(df)).collect()}
    assert out["A"].suppressed == ["altmanZ", "earningsQualityIndex"] and out["B"].suppressed == []
    assert [f.key for f in out["A"].flags] == ["receivablesVsRevenue"] and out["A"].flags[0].severity == "elevated" and out["A"].flags[0].value == 50.0
    assert out["A"].checked_count == 5


def test_upper_median_and_buckets(spark):
    df = spark.createDataFrame([("g", f"k{i}", float(i)) for i in range(12)], "g string, k string, v double")
    assert backtest.upper_median(df, ["g"], "v", "k").first()["median"] == 6.0
    sizes = {r.bucket: r["count"] for r in backtest.quantile_buckets(df, ["g"], "v", "k").groupBy("bucket").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 3, 3: 3}  # ceil(12 / 5) = 3 leaves the fifth bucket empty


def test_headlines(spark):
    rss = "<item><title>A - B - Wire</title><link>http://x</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate></item><item><title>no date</title><link>u</link><pubDate>soon</pubDate></item>"
    got = readers.headlines_rss(spark.createDataFrame([("T", rss)], "ticker string, body string"), ["ticker"]).collect()
    assert [(r.title, r.publisher) for r in got] == [("A - B", "Wire")]


def test_rerun_of_a_day_replaces_it(spark, tmp_path):
    path = str(tmp_path / "s")
    day = lambda d, v: spark.createDataFrame([("A", D(2024, 1, d), v)], "ticker string, date date, v double")
    for df in (day(1, 1.0), day(2, 2.0), day(1, 3.0)):
        sinks.overwrite_days(df, path)
    assert {r.date.day: r.v for r in spark.read.parquet(path).collect()} == {1: 3.0, 2: 2.0}


def test_stream_equals_batch_and_upserts(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, h), h, float(h)) for h in range(5)] + [("B", dt.datetime(2024, 1, 2, 1), 9, 7.0)]
    schema = "entity string, ts timestamp, event_id int, value double"
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    batch = {(r.entity, r.date): r.close for r in incremental.daily_quotes(spark.read.parquet(src)).collect()}
    stream = spark.readStream.schema(schema).parquet(src)
    q = incremental.daily_quotes(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.entity, r.date): r.close for r in spark.table("daily").collect()} == batch == {("A", D(2024, 1, 1)): 4.0, ("B", D(2024, 1, 2)): 7.0}
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    incremental.upsert_daily(stream, out, ck).awaitTermination()
    late = [("A", dt.datetime(2024, 1, 1, 2), 50, 99.0), ("A", dt.datetime(2024, 1, 1, 9), 51, 5.0)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(src)
    incremental.upsert_daily(stream, out, ck).awaitTermination()
    assert {(r.entity, r.date): r.value for r in spark.read.parquet(out).collect()} == {("A", D(2024, 1, 1)): 5.0, ("B", D(2024, 1, 2)): 7.0}


def test_quartiles_need_five(spark):
    df = spark.createDataFrame([("A", float(v)) for v in (1, 2, 3, 4, -1)] + [("B", float(v)) for v in (1, 2, 3, 4, 10)], "ticker string, v double")
    got = {r.ticker: r for r in valuation.quantile_summary(df, ["ticker"], "v").collect()}
    assert got["A"].median is None and got["A"].reason == "too-few-years"
    assert (got["B"].q1, got["B"].median, got["B"].q3) == (2.0, 3.0, 4.0) and math.isclose(got["B"].highest, 10.0)
