"""Sources and sinks that are written and read back, guards raised by the plan, and statements built from facts: literal rows."""

import csv
import datetime as dt
import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from balancebeam.operators import facts, panel
from balancebeam.sources import readers, sinks

D = dt.date
NAN = float("nan")


def test_universe_export_survives_its_files(spark, tmp_path):
    rows = [("A", "Energy", 1, 1.5, None), ("A", "Energy", 0, 0.1 + 0.2, -2.0), ("B", None, 0, NAN, float("inf")), ("C", 'x "y", z', 0, 1e-300, 123456789.123456789)]
    wide = spark.createDataFrame(rows, "ticker string, sector string, year_index int, roic double, pe_ttm double")
    path = str(tmp_path / "export")
    sinks.write_universe_export(sinks.universe_export(wide, ["roic", "pe_ttm"]), ["roic", "pe_ttm"], path, 1)
    files = glob.glob(f"{path}/entities/*.json.gz")
    lines = [json.loads(x) for f in files for x in gzip.open(f, "rt")]
    assert len(lines) == 3 and max(sum(1 for _ in gzip.open(f)) for f in files) == 1  # one entity a file was asked for
    assert next(x for x in lines if x["ticker"] == "A")["by_year"] == [[0.1 + 0.2, -2.0], [1.5, None]]
    exported, keys = sinks.read_universe_export(spark, path)
    assert keys == ["roic", "pe_ttm"]
    got = {(r.ticker, r.sector, r.year_index, r.metric_key): r.raw_value for r in sinks.universe_reshape(exported, keys).collect()}
    want = {(t, s, y, k): v if v is not None and abs(v) < float("inf") else None for t, s, y, *vs in rows for k, v in zip(keys, vs)}
    assert got == want
    assert {k: v for k, v in want.items() if k[2] == 0} == {(r.ticker, r.sector, r.year_index, r.metric_key): r.raw_value for r in sinks.universe_reshape(exported, keys, latest_only=True).collect()}
    assert sinks.universe_reshape(*(sinks.universe_export(wide.limit(0), keys), keys)).count() == 0


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_flat_files_are_in_rank_order(spark, tmp_path, kind):
    names = {3: 'Quote "Q", Inc', 5: "back\\slash", 7: None}
    flat = spark.createDataFrame([(f"T{k}", k, 100 / k if k % 4 else None, names.get(k, f"n{k}")) for k in range(1, 401)], "ticker string, overall_rank long, overall_score double, company_name string").repartition(7)
    path = str(tmp_path / kind)
    sinks.write_rankings_flat(flat, path, kind, 30)
    files = sorted(glob.glob(f"{path}/part-*"))
    if kind == "csv":
        ranks = [int(r["overall_rank"]) for f in files for r in csv.DictReader(open(f), escapechar="\\", doublequote=False)]
    else:
        ranks = [json.loads(x)["overall_rank"] for f in files for x in open(f)]
    assert ranks == list(range(1, 401)) and len(files) >= 400 // 30
    back = sinks.read_rankings_flat(spark, path, kind, flat.schema)
    assert back.exceptAll(flat).count() == 0 == flat.exceptAll(back).count()


def test_stored_metric_rows_stay_in_their_buckets(spark, tmp_path):
    values = spark.createDataFrame([(f"T{k % 50}", f"m{k % 7}", k % 3, float(k)) for k in range(2100)], "ticker string, metric_key string, year_index int, raw_value double").dropDuplicates(sinks.METRIC_ROW)
    sinks.store_metric_rows(values, "metric_rows_test", str(tmp_path / "rows"), 4)
    scores = values.filter("raw_value % 2 = 0").select(*sinks.METRIC_ROW, (F.col("raw_value") / 4200).alias("score"), F.lit(1).cast("long").alias("peer_rank"), F.lit(9).cast("long").alias("peer_count"))
    out = sinks.metric_percentiles(spark.table("metric_rows_test"), scores)
    plan = out._jdf.queryExecution().executedPlan().toString()
    stored = plan[: plan.index("Exchange")]  # the first side of the join, down to its scan
    assert "metric_rows_test" in stored and "Bucketed: true" in plan and plan.count("Exchange") >= 1
    rows = out.collect()
    assert len(rows) == values.count() and all((r.percentile is None) == (r.raw_value % 2 != 0) and r.peer_count == (0 if r.percentile is None else 9) for r in rows)
    spark.sql("drop table metric_rows_test")


def test_constituents_are_guarded_by_the_plan(spark):
    page = lambda n, start=0: '<table id="constituents">' + "".join(f"<tr><td>S{k}</td></tr>" for k in range(start, start + n)) + "</table><table><td>NO</td></table>"
    frame = lambda *html: spark.createDataFrame([(x,) for x in html], "html string")
    args = ("<td>([A-Z0-9]+)</td>",)
    table = r'(?s)<table[^>]*id="constituents".*?</table>'
    got = readers.constituents(frame(page(300), page(300, 200), None, ""), *args, table=table)  # the default guard
    assert sorted(r.symbol for r in got.collect()) == sorted(f"S{k}" for k in range(500))
    with pytest.raises(Exception, match="only 399 symbols found, expected at least 400"):
        readers.constituents(frame(page(399)), *args, table=table).collect()
    with pytest.raises(Exception, match="table of constituents was not found"):
        readers.constituents(frame("<td>AAA</td>" * 500), *args, table=table).collect()
    with pytest.raises(Exception, match="only 0 symbols found"):
        readers.constituents(frame(), *args).collect()
    assert readers.constituents(frame("<td>AAA</td><td>BBB</td>"), *args, minimum=2).count() == 2


def test_feeds_of_any_shape(spark):
    item = lambda t, d="Mon, 05 Feb 2024 10:00:00 GMT": f"<item><title>{t}</title><link> http://x </link><pubDate>{d}</pubDate></item>"
    feed = lambda *items: "<rss><channel><title>f</title>" + "".join(items) + "</channel></rss>"
    bodies = {
        "entities": feed(item("a &amp;amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39; - Wire")),
        "cdata": feed("<item><title><![CDATA[x < y & z - Wire]]></title><link>u</link><pubDate>Mon, 05 Feb 2024 10:00:00 +0100</pubDate></item>"),
        "two": feed(item("one - A"), item("two"), item("no date", "soon"), item("")),
        "broken": feed(item("kept &amp; read - Wire")).replace("</channel>", ""),
        "bare": item("only a block - Wire"), "none": feed(), "empty": "", "null": None, "text": "not a feed",
    }
    out = readers.headlines_rss(spark.createDataFrame(list(bodies.items()), "name string, body string"), ["name"])
    got = sorted((r.name, r.title, r.publisher, r.url) for r in out.collect())
    assert got == sorted([("entities", "a &amp; b <c> \"d\" 'e'", "Wire", "http://x"), ("cdata", "x < y & z", "Wire", "u"), ("two", "one", "A", "http://x"), ("two", "two", "News search", "http://x"),
                          ("broken", "kept & read", "Wire", "http://x"), ("bare", "only a block", "Wire", "http://x")])


FILING = "entity int, concept string, tag string, tag_priority int, start_date date, end_date date, filed date, val double, form string, ord int, line int"


def filing(concept, val, end=D(2020, 12, 31), tag=0, filed=D(2021, 2, 1), form="10-K", entity=1, instant=False, line=0):
    return (entity, concept, f"{concept}{tag}", tag, None if instant else end - dt.timedelta(days=364), end, filed, val, form, line, 0)


def test_statements_from_filings(spark):
    rows = [
        filing("revenue", 100.0, tag=0), filing("revenue", 110.0, tag=1, filed=D(2021, 5, 1)),  # merged: the later filing wins over the tag order
        filing("net_income", 7.0, tag=1, filed=D(2021, 9, 1)), filing("net_income", 5.0, tag=0),  # fallback: the first tag wins though filed earlier
        filing("cost_of_revenue", 60.0, tag=2), filing("revenue", 90.0, end=D(2019, 12, 31), filed=D(2019, 1, 1)), filing("net_income", 4.0, end=D(2018, 12, 31), filed=D(2019, 2, 1)),
        filing("revenue", 1.0, end=D(2021, 12, 31), form="10-Q"), filing("operating_income", 20.0, end=D(2020, 12, 26)), filing("operating_income", 21.0, end=D(2020, 12, 31)),
        filing("net_income", 3.0, entity=2, end=D(2020, 6, 30), filed=D(2020, 8, 1)), filing("gross_profit", 2.0, entity=2, end=D(2020, 6, 30), filed=D(2020, 8, 1)),
    ]
    series = lambda rows: facts.concept_series(spark.createDataFrame(rows, FILING), ["net_income", "cost_of_revenue", "gross_profit", "total_debt"])
    got = {(r.entity, r.fiscal_year): r for r in facts.build_income(series(rows)).collect()}
    assert set(got) == {(1, 2020), (1, 2019), (2, 2020)}  # 2018 has no revenue though the entity reports some; the other entity has none at all
    r = got[1, 2020]
    assert (r.revenue, r.net_income, r.cost_of_revenue, r.gross_profit, r.operating_income, r.ebit, r.ebitda) == (110.0, 5.0, 60.0, 50.0, 21.0, 21.0, None)
    assert r.filed_at == D(2021, 5, 1) and r.period_end == D(2020, 12, 31)
    assert got[1, 2019].filed_at is None and got[1, 2019].gross_profit is None  # filed before its period ended
    assert (got[2, 2020].gross_profit, got[2, 2020].period_end) == (2.0, D(2020, 6, 30))
    assert [r.fiscal_year for r in facts.build_income(series(rows), 1).filter("entity = 1").collect()] == [2020]

    balance = [filing(c, v, instant=True) for c, v in (("total_assets", 50.0), ("total_equity", 20.0), ("goodwill", 3.0), ("total_debt", 9.0))] + [filing("total_equity", 8.0, end=D(2019, 12, 31), instant=True)]
    b = facts.build_balance(series(balance)).collect()
    assert [(r.fiscal_year, r.total_assets, r.tangible_book, r.long_term_debt, r.intangibles, r.cash) for r in b] == [(2020, 50.0, 17.0, 9.0, None, None)]
    flow = [filing("operating_cash_flow", 30.0), filing("capex", 4.0), filing("dividends_paid", -2.0), filing("stock_issuance", 1.0), filing("capex", 9.0, end=D(2019, 12, 31)), filing("operating_cash_flow", 8.0, end=D(2018, 12, 31))]
    c = {r.fiscal_year: r for r in facts.build_cash_flow(series(flow)).collect()}
    assert set(c) == {2020, 2018} and (c[2020].capex, c[2020].dividends_paid, c[2020].stock_buybacks, c[2020].stock_issuance, c[2020].free_cash_flow) == (-4.0, -2.0, None, 1.0, 26.0) and c[2018].free_cash_flow is None


def test_every_period_has_its_own_cut_of_the_earnings_history(spark):
    rows = spark.createDataFrame([("A", y, 1.0) for y in (2018, 2020)] + [("B", 2020, 1.0)], "ticker string, fiscal_year int, net_income double")
    history = [("A", y, float(y - 2000)) for y in range(2004, 2022) if y != 2015] + [("A", 2015, None), ("C", 2020, 5.0)]
    out = panel.with_earnings_cycle(rows, spark.createDataFrame(history, "ticker string, fiscal_year int, net_income double"))
    got = {(r.ticker, r.fiscal_year): (r.cycle_years, r.cycle_latest, r.cycle_mean) for r in out.collect()}
    mean = lambda years: sum(y - 2000 for y in years) / len(years)
    assert got == {("A", 2018): (10, 18.0, mean([2018, 2017, 2016, 2014, 2013, 2012, 2011, 2010, 2009, 2008])), ("A", 2020): (10, 20.0, mean([2020, 2019, 2018, 2017, 2016, 2014, 2013, 2012, 2011, 2010])), ("B", 2020): (0, None, None)}
    assert set(out.columns) == {*rows.columns, "cycle_years", "cycle_latest", "cycle_mean"}


def test_statements_shuffle_facts_once_and_yearly_rows_once(spark):
    """The plan of a statement has two exchanges by hash: the facts' aggregate and the rows left, by entity."""
    empty = spark.createDataFrame([], FILING)
    plan = facts.build_balance(facts.concept_series(empty, ["total_debt"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
