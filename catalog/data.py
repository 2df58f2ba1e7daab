"""Facts, prices, text, back-tests, sources, sinks and incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from balancebeam.functions.lexicon import Lexicon
from balancebeam.operators import backtest, facts, prices, sentiment
from balancebeam.operators import sector as sector_ops
from balancebeam.operators.screens import market_cap_plausible
from balancebeam.session import ensure_checkpoint_dir, stored
from balancebeam.sources import readers, sinks
from balancebeam.streaming import incremental
from catalog.base import bind, companies, daily_prices, query, table, tidy, wide_panel
from catalog.ranking import KEYS, _unit, ranked
from catalog.relational import ASOF, D
from catalog.sql import quote, rnd

PRICE = "fx_trade_prices"


def fx(spark, sf):
    return bind(spark, sf, "fx_facts")


# --- facts -----------------------------------------------------------------------------------------------------------------------

ANNUAL = "(form = '10-K' and (start_date is null or end_date - start_date between 350 and 380))"
FACTS = {
    "c_annual": f"select * from fx_facts where {ANNUAL}",
    "c_latest": "select * from c_annual qualify row_number() over (partition by entity, end_date order by filed desc, tag_priority, ord, line) = 1",
    "c_first": "select * from c_annual qualify row_number() over (partition by entity, end_date order by tag_priority, filed desc, ord, line) = 1",
    # three concepts: every tag is one, so a concept is a subset of the facts
    "c_con": "select *, case tag when 'N' then 'revenue' when 'A' then 'net_income' else 'total_equity' end as concept from c_annual",
    "c_pick": "select * from c_con qualify row_number() over (partition by entity, concept, end_date order by filed desc, ord, line) = 1",
}


@query("fact_annual_filter", f"select entity, ord, line, tag, end_date from c_annual", FACTS)
def fact_annual_filter(spark, sf):
    return tidy(facts.annual_filter(fx(spark, sf)).select("entity", "ord", "line", "tag", "end_date"))


@query("fact_latest_filed", f"select entity, end_date, tag, filed, {rnd('val')} as val from c_latest", FACTS)
def fact_latest_filed(spark, sf):
    return tidy(facts.latest_filed(fx(spark, sf)).select("entity", "end_date", "tag", "filed", "val"))


@query("fact_tag_fallback", f"select entity, end_date, tag, filed, {rnd('val')} as val from c_first", FACTS)
def fact_tag_fallback(spark, sf):
    return tidy(facts.tag_fallback(fx(spark, sf)).select("entity", "end_date", "tag", "filed", "val"))


quoted = lambda names: ", ".join(quote(x) for x in names)
pivot_sql = lambda names: ", ".join(f"max(val) filter (where concept = '{x}') as {x}" for x in names)

# filings of all concepts: several tags a concept, period ends that differ by entity and move within a year
FALLBACK = ["cost_of_revenue", "gross_profit", "net_income", "total_debt", "stock_compensation"]
FILINGS = {
    "g_annual": f"select * from fx_filings where {ANNUAL}",
    "g_pick": f"""select * from g_annual qualify row_number() over (partition by entity, concept, end_date order by case when concept in ({quoted(FALLBACK)}) then tag_priority else 0 end, filed desc, tag_priority, ord, line) = 1""",
    "g_year": "select *, year(end_date) as fiscal_year from g_pick qualify row_number() over (partition by entity, concept, year(end_date) order by end_date desc) = 1",
    "g_kept": "select * from g_year qualify row_number() over (partition by entity, concept order by fiscal_year desc) <= 12",
    "g_net": "select * from g_year where concept = 'net_income' qualify row_number() over (partition by entity order by fiscal_year desc) <= 4",
}


def net_income(spark, sf):
    return bind(spark, sf, "fx_filings").filter("concept = 'net_income'")


def yearly(spark, sf, n=4):
    return facts.to_fiscal_year(facts.tag_fallback(net_income(spark, sf)), n)


@query("fact_to_fiscal_year", f"select entity, fiscal_year, end_date, {rnd('val')} as val from g_net", FILINGS)
def fact_to_fiscal_year(spark, sf):
    return tidy(yearly(spark, sf).select("entity", "fiscal_year", "end_date", "val"))


@query("fact_provenance", "select entity, string_agg(tag, ',' order by tag_priority) as tags from (select distinct entity, tag, tag_priority from g_net) group by entity", FILINGS)
def fact_provenance(spark, sf):
    return tidy(facts.provenance(yearly(spark, sf)))


def concept():
    return F.when(F.col("tag") == "N", "revenue").when(F.col("tag") == "A", "net_income").otherwise("total_equity")


@query("fact_filed_at", "select entity, year(end_date) as fiscal_year, max(case when filed >= end_date then filed end) as filed_at from c_pick group by all", FACTS)
def fact_filed_at(spark, sf):
    return tidy(facts.filed_at(fx(spark, sf).withColumn("concept", concept())))


@query("fact_period_end", """select entity, fiscal_year, coalesce(period_end, make_date(fiscal_year, 12, 31)) as period_end from (select distinct l_partkey as entity, year(l_shipdate) as fiscal_year from lineitem)
        left join (select entity, year(end_date) as fiscal_year, max(end_date) as period_end from g_annual where concept = 'net_income' group by all) using (entity, fiscal_year)""", FILINGS)
def fact_period_end(spark, sf):
    years = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("fiscal_year")).distinct()
    return tidy(facts.period_end(net_income(spark, sf), years))


def statement(spark, sf, lines, build):
    f = bind(spark, sf, "fx_filings").filter(F.col("concept").isin(lines))
    return tidy(build(facts.concept_series(f, FALLBACK, 12)))


def statement_sql(lines, backbone, second, columns):
    """Years of the backbone line, of the second where the entity has none of the first; newest twelve."""
    first = f"case when bool_or({backbone} is not null) over (partition by entity) then {backbone} is not null else {second} is not null end" if second else f"{backbone} is not null"
    ends = quoted([backbone] + ([second] if second else []))
    return f"""select entity, fiscal_year, coalesce(e, make_date(fiscal_year, 12, 31)) as period_end, filed_at, {columns} from (
          select * from (select *, {first} as has from (
            select entity, fiscal_year, {pivot_sql(lines)}, max(end_date) filter (where concept in ({ends})) as e, max(case when filed >= end_date then filed end) as filed_at
            from g_kept where concept in ({quoted(lines)}) group by all)) where has qualify row_number() over (partition by entity order by fiscal_year desc) <= 12)"""


same = lambda lines: ", ".join(f"{rnd(x)} as {x}" for x in lines)


@query("build_income", statement_sql(facts.INCOME, "revenue", "net_income", same([x for x in facts.INCOME if x != "gross_profit"]) + f""", {rnd('coalesce(gross_profit, revenue - cost_of_revenue)')} as gross_profit,
        {rnd('operating_income')} as ebit, null::DOUBLE as ebitda, null::DOUBLE as eps"""), FILINGS)
def build_income(spark, sf):
    return statement(spark, sf, facts.INCOME, facts.build_income)


@query("build_balance", statement_sql(facts.BALANCE, "total_assets", "total_equity", same(facts.BALANCE) + f""", {rnd('total_debt')} as long_term_debt,
        {rnd('total_equity - coalesce(intangibles, 0) - coalesce(goodwill, 0)')} as tangible_book"""), FILINGS)
def build_balance(spark, sf):
    return statement(spark, sf, facts.BALANCE, facts.build_balance)


OUT = ["capex", "dividends_paid", "stock_buybacks"]


@query("build_cash_flow", statement_sql(facts.CASH_FLOW, "operating_cash_flow", None, same([x for x in facts.CASH_FLOW if x not in OUT]) + ", " + ", ".join(f"{rnd(f'-abs({x})')} as {x}" for x in OUT) + f""",
        {rnd('operating_cash_flow - abs(capex)')} as free_cash_flow"""), FILINGS)
def build_cash_flow(spark, sf):
    return statement(spark, sf, facts.CASH_FLOW, facts.build_cash_flow)


@query("build_statements_quarterly", """select l_partkey as entity, year(l_shipdate) || (case when l_linestatus = 'O' then '-Q' || quarter(l_shipdate) else '-FY' end) as period_key, year(l_shipdate) as fiscal_year, count(*) as n
        from lineitem group by all""")
def build_statements_quarterly(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.to_date("l_shipdate").alias("period_end"), (F.col("l_linestatus") == "O").alias("quarterly"))
    return tidy(facts.build_quarterly(rows).groupBy("entity", "period_key", "fiscal_year").agg(F.count(F.lit(1)).alias("n")))


SEVEN = ["net_income", "revenue", "total_equity", "operating_income", "total_debt", "cash", "shares_diluted"]


@query("annual_fundamentals", f"""select entity, fiscal_year, {', '.join(f'{rnd(c)} as {c}' for c in SEVEN)}, coalesce(d, i) as period_end from
        (select entity, fiscal_year, {pivot_sql(SEVEN)} from g_kept where concept in ({quoted(SEVEN)}) group by entity, fiscal_year
         qualify row_number() over (partition by entity order by fiscal_year desc) <= 12) w
        left join (select entity, year(end_date) as fiscal_year, max(end_date) filter (where start_date is not null) as d, max(end_date) filter (where start_date is null) as i from g_annual where concept in ({quoted(SEVEN)}) group by all) using (entity, fiscal_year)""", FILINGS)
def annual_fundamentals(spark, sf):
    f = bind(spark, sf, "fx_filings").filter(F.col("concept").isin(SEVEN))
    return tidy(facts.annual_fundamentals(facts.concept_series(f, FALLBACK, 12), f.filter("start_date is not null"), f.filter("start_date is null"), SEVEN))


FLOATS = {
    # every fifth filing is an amendment; some facts state a fiscal year of their own, some are absurd
    "c_float": "select * replace (case when ord % 5 = 0 and form = '10-K' then '10-K/A' else form end as form, case when ord % 11 = 0 then val * 1e10 when ord % 13 = 0 then -val else val end as val), case when ord % 3 = 0 then (year(end_date) + ord % 2)::INT end as fy from fx_facts",
}


@query("public_float_history", f"""select entity, fiscal_year, as_of, {rnd('val')} as public_float from (select *, coalesce(fy, year(end_date)) as fiscal_year, end_date as as_of from c_float where val > 0 and val <= 1e13 and form in ('10-K', '10-K/A')
        qualify row_number() over (partition by entity, coalesce(fy, year(end_date)) order by end_date desc, filed desc, ord, line) = 1) qualify row_number() over (partition by entity order by fiscal_year desc) <= 12""", FLOATS)
def public_float_history(spark, sf):
    o = F.col("ord")
    f = fx(spark, sf).withColumn("form", F.when((o % 5 == 0) & (F.col("form") == "10-K"), "10-K/A").otherwise(F.col("form"))).withColumn("fy", F.when(o % 3 == 0, F.year("end_date") + o % 2).cast("int"))
    f = f.withColumn("val", F.when(o % 11 == 0, F.col("val") * 1e10).when(o % 13 == 0, -F.col("val")).otherwise(F.col("val")))
    return tidy(facts.public_float_history(f, F.col("val") <= 1e13))


@query("approx_market_value", f"""select f.entity, {rnd('f.val')} as public_float, f.end_date as public_float_as_of, {rnd('s.val')} as shares, {rnd('r.val')} as revenue, r.val is not null as has_operating_financials from
        (select * from fx_facts where tag = 'N' and form = '10-K' qualify row_number() over (partition by entity order by filed desc, tag_priority, ord, line) = 1) f
        left join (select * from fx_facts where tag = 'A' and form = '10-K' qualify row_number() over (partition by entity order by filed desc, tag_priority, ord, line) = 1) s using (entity)
        left join (select entity, arg_max(val, end_date) as val from (select * from c_pick where tag = 'R') group by entity) r using (entity)""", FACTS)
def approx_market_value(spark, sf):
    f = fx(spark, sf).filter("form = '10-K'")
    revenue = facts.annual_filter(f.filter("tag = 'R'"))
    return tidy(facts.approx_market_value(f.filter("tag = 'N'"), f.filter("tag = 'A'"), revenue, revenue))


@query("valuation_history_build", f"""select ticker, fiscal_year, float_as_of, {rnd('public_float')} as public_float, {rnd('revenue')} as revenue from (
          select v.ticker, y.fiscal_year, v.float_as_of, v.public_float, y.revenue, row_number() over (partition by v.ticker, v.float_as_of order by y.period_end) as k
          from (select *, public_float * (case when fiscal_year = 1997 then 1000 else 1 end) as pf from fx_valuation_history) v0
          join (select ticker, float_as_of, pf as public_float from (select *, public_float * (case when fiscal_year = 1997 then 1000 else 1 end) as pf from fx_valuation_history)) v on v.ticker = v0.ticker and v.float_as_of = v0.float_as_of
          join fx_income y on y.ticker = v.ticker and y.period_end - v.float_as_of between 0 and 300)
        where k = 1 and public_float > 0 and public_float <= 1e13 and not coalesce(revenue > 0 and public_float > 100 * revenue, false)""")
def valuation_history_build(spark, sf):
    v = bind(spark, sf, "fx_valuation_history")
    floats = v.select("ticker", "float_as_of", F.col("fiscal_year").alias("float_year"), (F.col("public_float") * F.when(F.col("fiscal_year") == 1997, 1000).otherwise(1)).alias("public_float"))
    years = bind(spark, sf, "fx_income").select("ticker", "fiscal_year", "period_end", "revenue", "net_income", "operating_income", F.lit(None).cast("double").alias("total_equity"))
    out = facts.valuation_history_build(floats, years)
    return tidy(out.select("ticker", "fiscal_year", "float_as_of", "public_float", "revenue"))


@query("cik_override", "select ticker, case when p_partkey % 50 = 0 then -p_partkey else cik end as cik from fx_companies")
def cik_override(spark, sf):
    c = companies(spark, sf)
    over = c.filter("p_partkey % 50 = 0").select("ticker", (-F.col("p_partkey")).alias("cik"))
    return facts.cik_override(c.select("ticker"), c.select("ticker", "cik"), over)


@query("map_sic_sector", """select ticker, sic, (select arg_min(sector, prio) from sic_t where s.sic between lo and hi) as mapped_sector from (select ticker, 1000 + (p_partkey * 37) % 8900 as sic from fx_companies) s""",
       {"sic_t": "select * from (values " + ", ".join(f"({lo}, {hi}, {i}, {quote(s)})" for i, (lo, hi, s) in enumerate(__import__("balancebeam.functions.dims", fromlist=["x"]).SIC_RANGES)) + ") v(lo, hi, prio, sector)"})
def map_sic_sector(spark, sf):
    codes = companies(spark, sf).select("ticker", (1000 + (F.col("p_partkey") * 37) % 8900).cast("int").alias("sic"))
    return tidy(sector_ops.map_sic_sector(spark, codes)).select("ticker", "sic", "mapped_sector")


@query("src_facts_explode", f"""select entity, taxonomy, tag, unit, start_date, end_date, {rnd('val')} as val, case when ord % 7 <> 0 then year(end_date) end as fy, case when form = '10-K' then 'FY' else 'Q3' end as fp, form, filed
        from (select *, case when tag = 'R' then 'dei' else 'us-gaap' end as taxonomy, case when tag = 'N' then 'USD' when tag = 'A' and entity % 2 = 1 then 'shares' when tag = 'R' and entity % 3 <> 0 then 'USD/shares' end as unit from fx_facts)
        where unit is not null""")
def src_facts_explode(spark, sf):
    # one document per entity with all its facts: two taxonomies; N has two units, of which the first by priority counts; for half the entities the first unit of A is no array, and so empty;
    # R has a unit that is not read for a third of them
    fact = lambda scale: F.struct(F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"), (F.col("val") * scale).alias("val"), F.when(F.col("ord") % 7 != 0, F.year("end_date")).alias("fy"), F.when(F.col("form") == "10-K", "FY").otherwise("Q3").alias("fp"), "form", F.col("filed").cast("string").alias("filed"))  # noqa: E731, E501
    lists = {f"{t}{k}": F.to_json(F.collect_list(F.when(F.col("tag") == t, fact(k)))) for t, k in (("N", 1), ("N", 2), ("A", 1), ("R", 1))}
    rows = fx(spark, sf).groupBy("entity").agg(*[x.alias(n) for n, x in lists.items()])
    no_array = F.when(F.col("entity") % 2 == 1, '{"shares":').otherwise('{"USD":{"not":"a list"},"shares":')
    unread = F.when(F.col("entity") % 3 != 0, '{"USD/shares":').otherwise('{"EUR":')
    body = F.concat(F.lit('{"entityName":"x","facts":{"us-gaap":{"N":{"label":"n","units":{"shares":'), F.col("N2"), F.lit(',"USD":'), F.col("N1"), F.lit('}},"A":{"units":'), no_array, F.col("A1"), F.lit('}}},"dei":{"R":{"units":'), unread, F.col("R1"), F.lit("}}}}}"))
    return tidy(facts.explode_companyfacts(rows.select("entity", body.alias("json")), "entity"))


# --- prices ----------------------------------------------------------------------------------------------------------------------


@query("src_prices", f"select user_id as entity, ts::DATE as date, {rnd('value')} as close from events where event_id % 9 <> 0")
def src_prices(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    close = F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.col("value"))
    charts = ev.groupBy(F.col("user_id").alias("entity"), "day").agg(F.collect_list(F.struct(F.unix_timestamp("ts").alias("t"), F.coalesce(close, F.lit(float("nan"))).alias("c"))).alias("p"))
    charts = charts.select("entity", F.transform("p", lambda x: x["t"]).alias("timestamps"), F.transform("p", lambda x: x["c"]).alias("closes"))
    return tidy(prices.explode_chart(charts))


@query("inc_daily_quote", f"select entity, date, {rnd('close')} as close from fx_daily_prices")
def inc_daily_quote(spark, sf):
    """The stream over three deliveries; a part of each arrives with the next one, out of order but within the lateness. Each run goes on from the checkpoint of the one before."""
    ticks = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    path, source = _scratch(spark), _scratch(spark)
    low, high = ticks.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    part = F.floor((F.unix_seconds("ts") - F.lit(low or 0)) / third)
    dealt = ticks.withColumn("part", F.least(part + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.lit(2)))
    stream = spark.readStream.schema("entity bigint, ts timestamp, event_id bigint, value double").parquet(f"{source}/*")
    store = incremental.quote_store(spark, path, 16)
    for k in range(3):
        dealt.filter(F.col("part") == k).drop("part").write.parquet(f"{source}/{k}")
        incremental.stream_daily(stream, store, path + "-ckpt", f"{third + 86400} seconds").awaitTermination()
    return tidy(store.read().select("entity", "date", "close"))


@query("win_moving_avg", f"""select entity, date, {', '.join(rnd(f'case when row_number() over w >= {n} then avg(close) over (partition by entity order by date rows between {n - 1} preceding and current row) end') + f' as ma_{n}' for n in (5, 15))}
        from fx_daily_prices window w as (partition by entity order by date)""")
def win_moving_avg(spark, sf):
    return tidy(prices.moving_average(daily_prices(spark, sf), (5, 15)).drop("close"))


FRAMES = {"short": 5, "mid": 15, "all": None}


@query("price_timeframe_change", "select entity, " + ", ".join(
    f"count(*) filter (where {w}) as n_{k}, case when count(*) filter (where {w}) >= 2 then " + rnd(f"(arg_max(close, date) filter (where {w}) - arg_min(close, date) filter (where {w})) / nullif(arg_min(close, date) filter (where {w}), 0)") + f" end as change_{k}"
    for k, w in (("short", "date >= latest - 5"), ("mid", "date >= latest - 15"), ("all", "true"))) + " from o_daily group by entity")
def price_timeframe_change(spark, sf):
    return tidy(prices.timeframe_change(daily_prices(spark, sf), FRAMES))


@query("mom_smoothed_close", f"select entity, {rnd('recent')} as recent, {rnd('base')} as base from o_smooth")
def mom_smoothed_close(spark, sf):
    day = daily_prices(spark, sf).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("pts"))
    day = day.withColumn("latest", F.element_at("pts", -1)["date"])
    return tidy(day.select("entity", prices.smoothed_close(F.col("pts"), F.date_sub("latest", 3)).alias("recent"), prices.smoothed_close(F.col("pts"), F.date_sub("latest", 20)).alias("base")))


def _momentum(spark, sf):
    from catalog.base import FIXTURE_MOMENTUM

    return prices.momentum(daily_prices(spark, sf), FIXTURE_MOMENTUM)


@query("mom_12_1", f"select entity, {rnd('return_12m1m')} as return_12m1m from o_momentum")
def mom_12_1(spark, sf):
    return tidy(_momentum(spark, sf).select("entity", "return_12m1m"))


@query("mom_risk_adjusted", f"select entity, {rnd('risk_adjusted_3m')} as risk_adjusted_3m, {rnd('risk_adjusted_6m')} as risk_adjusted_6m from o_momentum")
def mom_risk_adjusted(spark, sf):
    return tidy(_momentum(spark, sf).select("entity", "risk_adjusted_3m", "risk_adjusted_6m"))


# --- text ------------------------------------------------------------------------------------------------------------------------

LEX = Lexicon(frozenset({"for", "with", "is", "that"}), frozenset({"from", "than", "was", "by"}), frozenset({"a", "on"}))
_l = lambda words: ", ".join(quote(w) for w in sorted(words))
TEXT = {
    "x_tok": r"select doc_id, ticker, source, w.t[i] as token, i - 1 as pos, w.t[greatest(i - 3, 1):i - 1] as before from (select doc_id, ticker, source, regexp_extract_all(lower(title), '[a-z'']+(?:-[a-z'']+)?') as t from fx_headlines) w, lateral (select unnest(range(1, len(w.t) + 1)) as i)",
    "x_hit": f"select *, (token in ({_l(LEX.positive)})) as good, (token in ({_l(LEX.negative)})) as bad, list_has_any(before, [{_l(LEX.negation)}]) as neg from x_tok where token in ({_l(LEX.positive | LEX.negative)})",
    "x_doc": "select h.doc_id, h.ticker, h.source, count(*) filter (where case when neg then bad else good end) as p, count(*) filter (where token is not null and not (case when neg then bad else good end)) as n from fx_headlines h left join x_hit using (doc_id) group by all",
    "x_s": "select *, case when p + n = 0 then 0::DOUBLE else (p - n) / (p + n)::DOUBLE end as score from x_doc",
    "x_src": "select ticker, source, (avg(score) + 1) * 50 as score, count(*) as article_count, count_if(score > 0.15) as positive_count, count_if(score < -0.15) as negative_count from x_s group by all",
    "x_agg": "select ticker, sum((score / 50 - 1) * article_count) / sum(article_count) as raw, sum(article_count)::BIGINT as article_count, sum(positive_count)::BIGINT as positive_count, sum(negative_count)::BIGINT as negative_count from x_src where source <> (select min(source) from x_src) group by ticker",
    "x_eff": "select *, (raw + 1) * 50 as score, case when raw > 0.15 then 'positive' when raw < -0.15 then 'negative' else 'neutral' end as label from x_agg",
}


def scored(spark, sf):
    return sentiment.score_text(bind(spark, sf, "fx_headlines"), "title", LEX)


@query("sent_tokens", "select doc_id, pos, token from x_tok", TEXT)
def sent_tokens(spark, sf):
    return tidy(sentiment.explode_tokens(bind(spark, sf, "fx_headlines"), "doc_id", "title"))


@query("sent_score_text", f"select doc_id, {rnd('score')} as score, p as matched_positive, n as matched_negative from x_s", TEXT)
def sent_score_text(spark, sf):
    return tidy(scored(spark, sf).select("doc_id", "score", "matched_positive", "matched_negative"))


@query("sentiment_source_summary", f"select ticker, source, {rnd('score')} as score, article_count, positive_count, negative_count from x_src", TEXT)
def sentiment_source_summary(spark, sf):
    return tidy(sentiment.source_summary(scored(spark, sf)))


def effective(spark, sf):
    s = sentiment.source_summary(scored(spark, sf))
    first = bind(spark, sf, "fx_headlines").agg(F.min("source").alias("s0"))
    return sentiment.aggregate(s.join(F.broadcast(first), F.col("source") != F.col("s0")).drop("s0"))


@query("sentiment_aggregate", f"select ticker, {rnd('score')} as score, label, article_count, positive_count, negative_count from x_eff", TEXT)
def sentiment_aggregate(spark, sf):
    return tidy(effective(spark, sf))


@query("sent_rank", f"""select ticker, company_name, {rnd('score')} as score, label, (select count(*) from fx_companies where ticker not in (select ticker from x_eff)) as without_data
        from fx_companies join x_eff using (ticker) where sector in ('Technology', 'Energy', 'Financials', 'Real Estate')""", TEXT)
def sent_rank(spark, sf):
    c = companies(spark, sf).select("ticker", "company_name", "sector")
    out = sentiment.sentiment_rank(c, effective(spark, sf), sectors=["Technology", "Energy", "Financials", "Real Estate"])
    return tidy(out.select("ticker", "company_name", "score", "label", "without_data"))


@query("headlines_recent", "select ticker, doc_id, row_number() over (partition by ticker order by published_order desc) as place from fx_headlines")
def headlines_recent(spark, sf):
    """The place of each headline among its entity's, read off the order of the rows: a position over partitions, less the first of the entity."""
    from pyspark.sql import Window

    h = sentiment.headlines_recent(bind(spark, sf, "fx_headlines").select("ticker", "doc_id", "published_order"))
    ensure_checkpoint_dir(spark)
    rows = h.withColumn("at", F.monotonically_increasing_id()).checkpoint().withColumn("part", F.shiftrightunsigned("at", 33))
    run = rows.groupBy("ticker", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("ticker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tidy(rows.join(run.withColumn("earlier", earlier), ["ticker", "part"]).select("ticker", "doc_id", (F.col("at") - F.col("first") + F.col("earlier") + 1).alias("place")))


CARRY = "select ticker, source, doc_id from fx_headlines where doc_id % 4 <> 1 and (ticker, source) not in (select ticker, source from fx_headlines where doc_id % 4 = 1) union all select ticker, source, doc_id from fx_headlines where doc_id % 4 = 1"


def _old_new(spark, sf, df):
    return df.filter("doc_id % 4 <> 1"), df.filter("doc_id % 4 = 1")


@query("sent_carry_forward", CARRY)
def sent_carry_forward(spark, sf):
    old, new = _old_new(spark, sf, bind(spark, sf, "fx_headlines").select("ticker", "source", "doc_id"))
    return sentiment.carry_forward(old, new, new)


# a source that comes back empty loses its headlines
EMPTY = "select distinct ticker, source from fx_headlines where doc_id % 4 <> 1 and substr(ticker, 2)::INT % 7 = 3 and (ticker, source) not in (select ticker, source from fx_headlines where doc_id % 4 = 1)"


@query("inc_sentiment", f"select ticker, source, count(*) as headlines, {rnd('avg(score)')} as mean_score from ({CARRY}) join x_s using (ticker, source, doc_id) where (ticker, source) not in ({EMPTY}) group by ticker, source", TEXT)
def inc_sentiment(spark, sf):
    """Three deliveries of fetches into the stored headlines, each a run that goes on from the checkpoint; the last batch is applied once more, as after a failure."""
    h = bind(spark, sf, "fx_headlines")
    score = lambda df: sentiment.score_text(df, "title", LEX)
    path, source = _scratch(spark), _scratch(spark)
    schema = "doc_id bigint, ticker string, source string, title string, fetched_at int"
    store = incremental.KeyedStore(spark, path, ["ticker", "source"], "ticker string, source string, doc_id bigint, score double", 16)
    old, new = _old_new(spark, sf, h)
    again = new.select("ticker", "source").distinct()
    keys = old.select("ticker", "source").distinct().filter(F.substring("ticker", 2, 8).cast("int") % 7 == 3).join(again, ["ticker", "source"], "left_anti")
    empty = keys.select(F.lit(None).cast("bigint").alias("doc_id"), "ticker", "source", F.lit(None).cast("string").alias("title"))
    half = F.pmod(F.xxhash64("ticker", "source"), F.lit(2))
    rows = h.select("doc_id", "ticker", "source", "title")
    # the second delivery holds an earlier fetch of its sources too, which the newer one replaces
    first = old.join(again, ["ticker", "source"], "left_semi").filter(half == 0).select(rows.columns).withColumn("fetched_at", F.lit(1))
    parts = [old.select(rows.columns).withColumn("fetched_at", F.lit(0)), first.unionByName(new.filter(half == 0).select(rows.columns).withColumn("fetched_at", F.lit(2))),
             new.filter(half == 1).select(rows.columns).unionByName(empty).withColumn("fetched_at", F.lit(3))]
    stream = spark.readStream.schema(schema).parquet(f"{source}/*")
    for k, part in enumerate(parts):
        part.write.parquet(f"{source}/{k}")
        incremental.refresh_sentiment(stream, store, score, path + "-ckpt").awaitTermination()
    incremental.apply_fetch(spark.read.schema(schema).parquet(f"{source}/2"), 2, store, score)
    return tidy(store.read().groupBy("ticker", "source").agg(F.count(F.lit(1)).alias("headlines"), F.avg("score").alias("mean_score")))


@query("src_constituents", """select distinct s as symbol from (select unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]+)</a>', 1)) as s from pages) where s <> ''""")
def src_constituents(spark, sf):
    # the smaller fixtures list fewer symbols than an index has; the default guard and its errors are held in tests/
    return readers.constituents(table(spark, sf, "pages").select("html"), r'<li><a href="[^"]*">([^<]+)</a>', minimum=1)


@query("src_headlines", """with d as (select doc_id, text, source, regexp_replace(text, '^[\\x00-\\x20]+', '') as stripped, 'http://x/' || doc_id as url, timestamp '2024-01-01' + doc_id * interval 1 minute as published_at from documents where text is not null)
        select doc_id, text as title, source as publisher, url, published_at from d where (doc_id % 3 = 0 or doc_id % 3 = 2 and doc_id % 5 <> 0) and text <> ''
        union all select doc_id, case when stripped = '' then '- ' || source else stripped end, case when stripped = '' then 'News search' else source end, url, published_at from d where doc_id % 3 = 1""")
def src_headlines(spark, sf):
    """The whole text of every document as a title, escaped into one of three shapes and read again; one feed in seven is not well-formed."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text").filter("text is not null")
    url = F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    lit, title = F.lit, F.col("text").alias("title")
    a = d.filter("doc_id % 3 = 0").select("doc_id", F.to_json(F.struct(F.array(F.struct(title, F.col("source").alias("publisher"), url.alias("link"), F.unix_seconds(at).alias("providerPublishTime"))).alias("news"))).alias("body"))
    escaped = F.concat("text", lit(" - "), "source")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = F.replace(escaped, lit(sign), lit(entity))
    item = F.concat(lit("<item><title>"), escaped, lit("</title><link>"), url, lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), lit("</pubDate></item>"))
    end = F.when(F.col("doc_id") % 7 == 0, "</rss>").otherwise("</channel></rss>")
    b = d.filter("doc_id % 3 = 1").select("doc_id", F.concat(lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>'), item, end).alias("body"))
    seen = F.when(F.col("doc_id") % 5 == 0, "soon").otherwise(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))
    c = d.filter("doc_id % 3 = 2").select("doc_id", F.to_json(F.struct(F.array(F.struct(title, url.alias("url"), seen.alias("seendate"), F.col("source").alias("domain"))).alias("articles"))).alias("body"))
    out = readers.headlines_search(a, ["doc_id"]).unionByName(readers.headlines_rss(b, ["doc_id"])).unionByName(readers.headlines_articles(c, ["doc_id"]))
    return out.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


STATES = [("CA", "California"), ("NY", "New York"), ("TX", "Texas")]


@query("src_profile", """select ticker, case p_partkey % 3 when 0 then 'Nyse, Nasdaq' when 1 then 'Nasdaq' end as exchange, case when p_partkey % 4 = 0 then '0930' when p_partkey % 4 = 1 then '1231' end as fiscal_year_end,
        nullif(trim(industry), '') as filer_category, case p_partkey % 5 when 0 then 'San Jose, California' when 1 then 'Austin, Texas' when 2 then 'New York' when 3 then 'Toronto, A6' end as headquarters from fx_companies""")
def src_profile(spark, sf):
    c = companies(spark, sf)
    k = F.col("p_partkey")
    ex = F.when(k % 3 == 0, F.array(F.lit("Nyse"), F.lit(" "), F.lit("NYSE"), F.lit("Nasdaq"))).when(k % 3 == 1, F.array(F.lit("Nasdaq"), F.lit("NASDAQ"))).otherwise(F.array(F.lit("")))
    fye = F.when(k % 4 == 0, "0930").when(k % 4 == 1, "1231").when(k % 4 == 2, "0931").otherwise("")
    city = F.when(k % 5 == 0, "SAN JOSE").when(k % 5 == 1, "AUSTIN").when(k % 5 == 3, "toronto").otherwise(" ")
    state = F.when(k % 5 == 0, "CA").when(k % 5 == 1, "TX").when(k % 5 == 2, "NY").when(k % 5 == 3, "A6").otherwise("")
    rows = c.select("ticker", ex.alias("exchanges"), fye.alias("fiscal_year_end"), city.alias("city"), state.alias("state"), F.col("industry").alias("category"))
    return readers.filer_profile(rows, spark.createDataFrame(STATES, "code string, name string"))


# --- point-in-time back-test -----------------------------------------------------------------------------------------------------

PIT = {
    **D,
    # the newest filing of each year of period ends that is known at the date; the newest year and the one before it among those on file
    "v_k": "select f.entity, f.tag, d.as_of, year(f.end_date) as y, max(f.end_date) as end_date, arg_max(f.filed, row(f.end_date, f.filed, -f.ord, -f.line)) as filed, arg_max(f.val, row(f.end_date, f.filed, -f.ord, -f.line)) as val from fx_facts f join d_asof d on f.filed <= d.as_of where form = '10-K' and (start_date is null or end_date - start_date between 350 and 380) group by f.entity, f.tag, d.as_of, year(f.end_date)",
    "v_s": "select *, lead(val) over w as prior, row_number() over w as k from v_k window w as (partition by entity, tag, as_of order by y desc)",
    "v_v": "select entity, tag, as_of, end_date, filed, val from v_s where k = 1",
    "v_prior": "select entity, tag, as_of, prior as val from v_s where k = 1",
    "v_p": "select e.entity, e.as_of, p.close from (select entity, as_of from (select distinct entity from fx_trade_prices), d_asof) e asof join fx_trade_prices p on p.entity = e.entity and p.date <= e.as_of",
    # revenue = N, net income and eps = A, equity and shares = R
    "v_w": """select p.entity, p.as_of, p.close, n.val as revenue, a.val as net_income, a.val / 5000 as eps, r.val as equity, r.val / 5 as shares, pr.val as prior_revenue
              from v_p p left join v_v n on n.entity = p.entity and n.as_of = p.as_of and n.tag = 'N' left join v_v a on a.entity = p.entity and a.as_of = p.as_of and a.tag = 'A'
              join v_v r on r.entity = p.entity and r.as_of = p.as_of and r.tag = 'R' left join v_prior pr on pr.entity = p.entity and pr.as_of = p.as_of and pr.tag = 'N'""",
    "v_m": """select entity, as_of, close / (case when eps > 0 then eps end) as pe, (close * shares + coalesce(revenue * 0.25::DOUBLE, 0) - coalesce(net_income * 0.1::DOUBLE, 0)) / (case when revenue > 0 then revenue end) as ev_ebit,
              (revenue - abs(net_income)) / (case when close * shares > 0 then close * shares end) as fcf_yield, net_income / (case when equity > 0 then equity end) as roe,
              equity * 0.5::DOUBLE / (case when revenue > 0 then revenue end) as gross_margin, revenue / (case when prior_revenue > 0 then prior_revenue end) - 1 as revenue_growth, revenue * 0.25::DOUBLE / (case when equity > 0 then equity end) as debt_to_equity, coalesce(revenue, net_income) as net_income from v_w""",
    "v_me": "select entity, as_of, pe, case when net_income is not null then ev_ebit end as ev_ebit, fcf_yield, roe, gross_margin, revenue_growth, debt_to_equity from v_m",
}


def _pit_values(spark, sf):
    """Three tags stand for eleven concepts: each concept reads one tag with a factor."""
    rows = backtest.pit_panel(facts.annual_filter(fx(spark, sf)), ASOF, ["entity", "tag"])
    mapping = {"revenue": ("N", 1.0), "gross_profit": ("R", 0.5), "debt": ("N", 0.25), "operating_income": ("N", 1.0), "ocf": ("N", 1.0), "net_income": ("A", 1.0), "eps": ("A", 1 / 5000), "cash": ("A", 0.1), "capex": ("A", 1.0), "equity": ("R", 1.0), "shares": ("R", 0.2)}
    entry = lambda c, t, k: F.when(F.col("tag") == t, F.struct(F.lit(c).alias("concept"), (F.col("val") / (1 / k) if k == 1 / 5000 else F.col("val") / 5 if k == 0.2 else F.col("val") * k).alias("val"), (F.col("prior_val") * k).alias("prior_val")))
    return rows.select("entity", "as_of", F.inline(F.filter(F.array(*[entry(c, t, k) for c, (t, k) in mapping.items()]), lambda x: x.isNotNull())))


@query("pit_dates", "select unnest(generate_series(date_trunc('quarter', a), b, interval 3 month))::DATE as as_of from (select min(filed)::TIMESTAMP as a, max(filed)::TIMESTAMP as b from fx_facts)", PIT)
def pit_dates(spark, sf):
    return backtest.as_of_dates(fx(spark, sf), "filed")


@query("pit_value_asof", f"select entity, tag, as_of, end_date, filed, {rnd('val')} as val from v_v", PIT)
def pit_value_asof(spark, sf):
    return tidy(backtest.pit_values(facts.annual_filter(fx(spark, sf)), ASOF, ["entity", "tag"]))


PIT_KEYS = [k for k, _, _ in backtest.PIT_REGISTRY]


def pit_metric_frame(spark, sf):
    from balancebeam.operators import joins

    px = joins.asof_backward(bind(spark, sf, PRICE), ASOF, "date", ["date"], ["close"], ["entity"])
    return backtest.pit_metrics(_pit_values(spark, sf), px)


@query("pit_metrics", f"select entity, as_of, {', '.join(f'{rnd(k)} as {k}' for k in PIT_KEYS)} from v_me", PIT)
def pit_metrics(spark, sf):
    return tidy(pit_metric_frame(spark, sf))


from catalog.sql import rollup_ctes, values, xs_ctes  # noqa: E402

PIT_RANK = {
    **PIT,
    "q_dim": values([(i, k, c, d, False, False, 0.66 if c == "growth" else 1.0) for i, (k, c, d) in enumerate(backtest.PIT_REGISTRY)], "m, metric_key, category, direction, negative_is_bad, sector_relative, w"),
    "q_uni": "select as_of, entity as ticker, null::VARCHAR as sector, * exclude (as_of, entity) from v_me where as_of in (select as_of from v_me group by as_of having count(*) >= 10)",
    "q_long": f"select u.as_of, u.ticker, u.sector, 0 as year_index, u.metric_key, u.v, d.* exclude (metric_key) from (select * from q_uni unpivot include nulls (v for metric_key in ({', '.join(PIT_KEYS)}))) u join q_dim d using (metric_key)",
    "q_w": "select m, w from q_dim",
    "q_cat": values([(i, c, w) for i, (c, w) in enumerate(backtest.PIT_WEIGHTS.items())], "ord, category, cw"),
    **xs_ctes("q_unit", "q_long", "percentile", 0.01, 0.99, by="as_of"),
    **rollup_ctes("q_rank", "q_unit", "q_uni", "q_w", "q_cat", 1, registry="(select m, metric_key, category from q_dim)", by="as_of"),
    "q_base": "select e.entity, e.as_of, p.close as base from (select entity, as_of from (select distinct entity from fx_trade_prices), d_asof) e asof join fx_trade_prices p on p.entity = e.entity and p.date <= e.as_of",
    "q_f6": "select e.entity, e.as_of, p.close from (select entity, as_of, (as_of + interval 6 month)::DATE as t from q_base) e asof join fx_trade_prices p on p.entity = e.entity and p.date >= e.t",
    "q_f12": "select e.entity, e.as_of, p.close from (select entity, as_of, (as_of + interval 12 month)::DATE as t from q_base) e asof join fx_trade_prices p on p.entity = e.entity and p.date >= e.t",
    "q_ret": "select b.entity, b.as_of, (s.close - b.base) / b.base as return_6m, (y.close - b.base) / b.base as return_12m from q_base b left join q_f6 s using (entity, as_of) left join q_f12 y using (entity, as_of)",
    "q_obs": "select r.as_of, r.ticker, r.overall_score, x.return_6m from q_rank r join q_ret x on x.entity = r.ticker and x.as_of = r.as_of where r.overall_score is not null and x.return_6m is not null",
    "q_b": "select *, least(floor((row_number() over (partition by as_of order by round(overall_score, 9) desc, ticker) - 1) / ceil(count(*) over (partition by as_of) / 5)), 4)::BIGINT as bucket from q_obs",
    "q_rep": "select bucket, count(*) as n, avg(return_6m) as mean_return, max(case when k = c // 2 + 1 then return_6m end) as median_return from (select *, row_number() over (partition by bucket order by return_6m) as k, count(*) over (partition by bucket) as c from q_b) group by bucket",
}


def pit_ranked(spark, sf):
    # the point-in-time panel feeds the universe, its size and the ranking: written once
    return backtest.pit_rank(stored(pit_metric_frame(spark, sf)))


@query("pit_rank_by_date", f"select as_of, ticker, {rnd('overall_score')} as overall_score, overall_rank, metrics_included, metrics_applicable from q_rank", PIT_RANK)
def pit_rank_by_date(spark, sf):
    return tidy(pit_ranked(spark, sf).select("as_of", "ticker", "overall_score", "overall_rank", "metrics_included", "metrics_applicable"))


@query("forward_returns", f"select entity, as_of, {rnd('return_6m')} as return_6m, {rnd('return_12m')} as return_12m from q_ret", PIT_RANK)
def forward_returns(spark, sf):
    return tidy(backtest.forward_returns(bind(spark, sf, PRICE), ASOF))


def bucketed(spark, sf):
    returns = backtest.forward_returns(bind(spark, sf, PRICE), ASOF, (6,)).withColumnRenamed("entity", "ticker")
    obs = pit_ranked(spark, sf).select("as_of", "ticker", "overall_score").join(returns, ["as_of", "ticker"]).filter("overall_score is not null and return_6m is not null")
    return backtest.quantile_buckets(obs, ["as_of"], "overall_score", "ticker")


@query("quantile_buckets", f"select as_of, ticker, bucket, {rnd('return_6m')} as return_6m from q_b", PIT_RANK)
def quantile_buckets(spark, sf):
    return tidy(bucketed(spark, sf).select("as_of", "ticker", "bucket", "return_6m"))


@query("bucket_report", f"select bucket, n, {rnd('mean_return')} as mean_return, {rnd('median_return')} as median_return, {rnd('(select corr(overall_score, return_6m) from q_b)')} as score_return_corr from q_rep", PIT_RANK)
def bucket_report(spark, sf):
    ensure_checkpoint_dir(spark)
    b = bucketed(spark, sf).checkpoint()
    report = backtest.bucket_report(b, "return_6m", ["as_of", "ticker"])
    return tidy(report.crossJoin(F.broadcast(b.agg(F.corr("overall_score", "return_6m").alias("score_return_corr")))))


SNAPS = {
    "u_s": "select l_partkey as entity, l_shipdate::DATE as date, round(l_extendedprice / 1000, 3) as overall_score, l_orderkey as overall_rank from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) = 1",
    "u_m": "select s.*, p.date as pd, p.close, row_number() over (partition by s.entity order by abs(p.date - s.date), p.date) as k from u_s s join fx_trade_prices p on p.entity = s.entity and abs(p.date - s.date) <= 14 and p.date <> s.date",
    "u_r": "select m.entity, m.date as snap_date, m.overall_score, m.pd as matched_date, (c.p_retailprice - m.close) / m.close as forward_return from u_m m join part c on c.p_partkey = m.entity where k = 1 and m.close > 0",
    "u_b": "select *, 5 as nb, row_number() over (order by round(overall_score, 9) desc, entity) as k, count(*) over () as n from u_r",
}


@query("snapshot_backtest", f"select entity, snap_date, matched_date, {rnd('forward_return')} as forward_return, least(floor((k - 1) / ceil(n / nb)), nb - 1)::BIGINT as bucket from u_b", SNAPS)
def snapshot_backtest(spark, sf):
    ensure_checkpoint_dir(spark)
    li = table(spark, sf, "lineitem")
    first = li.groupBy(F.col("l_partkey").alias("entity")).agg(F.min(F.struct(F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_extendedprice")).alias("r"))
    snaps = first.select("entity", "r.date", F.round(F.col("r.l_extendedprice") / 1000, 3).alias("overall_score"), F.col("r.l_orderkey").alias("overall_rank"))
    # a price of another day than the snapshot's, so the tolerance matters
    px = bind(spark, sf, PRICE).join(snaps.select("entity", "date"), ["entity", "date"], "left_anti")
    now = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("price_now"))
    out = backtest.snapshot_backtest(snaps, px, now)
    return tidy(out.select("entity", "snap_date", "matched_date", "forward_return", "bucket"))


# --- sinks and incremental -------------------------------------------------------------------------------------------------------


@query("snk_metric_percentiles", f"""select ticker, metric_key, year_index, {rnd('v', 9)} as raw_value, {rnd('score', 9)} as percentile, peer_rank, coalesce(peer_count, 0) as peer_count
        from o_long left join d_metrics using (metric_key) left join o_unit using (ticker, m, year_index)""")
def snk_metric_percentiles(spark, sf):
    """Scores of all metrics merged on the stored rows, which stay in their buckets."""
    from balancebeam.operators.panel import metric_panel_long

    path = _scratch(spark)
    name = "metric_rows_" + path.rsplit("-", 1)[1]
    wide = wide_panel(spark, sf, turns=True)  # read for the rows and for the scores
    sinks.store_metric_rows(metric_panel_long(wide).select("ticker", "metric_key", "year_index", "raw_value"), name, path, 16)
    return tidy(sinks.metric_percentiles(spark.table(name), _unit(spark, sf, lambda m: m.enabled, wide=wide)), 9)


def exported(spark, sf):
    """The universe with all metrics, written and read back."""
    path = _scratch(spark)
    sinks.write_universe_export(sinks.universe_export(wide_panel(spark, sf), KEYS), KEYS, path)
    return sinks.read_universe_export(spark, path)


@query("snk_universe_export", f"select ticker, sector, year_index, metric_key, {rnd('v')} as raw_value from o_long")
def snk_universe_export(spark, sf):
    return tidy(sinks.universe_reshape(*exported(spark, sf)))


@query("src_universe_reshape", f"select ticker, sector, year_index, metric_key, {rnd('v')} as raw_value from o_long where year_index = 0")
def src_universe_reshape(spark, sf):
    return tidy(sinks.universe_reshape(*exported(spark, sf), latest_only=True))


@query("snk_rankings_flat", f"select ticker, overall_rank, {rnd('overall_score')} as overall_score, " + ", ".join(
    f"(select {rnd('score')} from o_rank_cat k where k.ticker = r.ticker and k.category = '{c}') as {c}Score" for c in ("valuation", "profitability", "growth", "cashGeneration", "financialStrength", "capitalAllocation", "efficiency", "earningsQuality", "moat", "momentum"))
    + ", company_name, sector, true as in_order, true as same_json from o_rank r left join fx_companies using (ticker) where overall_rank is not null")
def snk_rankings_flat(spark, sf):
    """CSV and JSON files, written and read back: in_order says that all ranks of a file follow those of the files before it, same_json that the JSON row equals the CSV row."""
    from pyspark.sql import Window

    path = _scratch(spark)
    flat = sinks.rankings_flat(ranked(spark, sf), companies(spark, sf))
    for kind in ("csv", "json"):
        sinks.write_rankings_flat(flat, f"{path}/{kind}", kind, 500)
    csv, js = (sinks.read_rankings_flat(spark, f"{path}/{kind}", kind, flat.schema) for kind in ("csv", "json"))
    csv = csv.withColumn("file", F.input_file_name())
    before = F.lag("hi").over(Window.orderBy("file"))  # a row per file
    files = csv.groupBy("file").agg(F.min("overall_rank").alias("lo"), F.max("overall_rank").alias("hi")).withColumn("in_order", F.coalesce(F.col("lo") > before, F.lit(True)))
    other = js.select("ticker", F.struct(*flat.columns).alias("j"))
    rows = csv.join(files.select("file", "in_order"), "file").join(other, "ticker", "left")
    return tidy(rows.select(*flat.columns, "in_order", F.struct(*flat.columns).eqNullSafe(F.col("j")).alias("same_json")))


@query("snk_preview_top20", f"select ticker, overall_rank, {rnd('overall_score')} as overall_score, coalesce(company_name, ticker) as company_name, sector from o_rank left join fx_companies using (ticker) where overall_rank <= 20")
def snk_preview_top20(spark, sf):
    return tidy(sinks.preview_top(ranked(spark, sf), companies(spark, sf)))


@query("snk_refresh_log", """select l_suppkey as job, count(*) as requested, count_if(l_quantity > 5) as succeeded, count_if(l_quantity <= 5) as failed,
        case when count_if(l_quantity <= 5) = 0 then 'success' when count_if(l_quantity > 5) = 0 then 'failure' else 'partial_failure' end as status,
        count_if(l_quantity <= 5) as error_rows, max(case when l_quantity <= 5 then l_orderkey end) as last_order from lineitem group by l_suppkey""")
def snk_refresh_log(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("job"), F.struct("l_orderkey", "l_linenumber").alias("key"), (F.col("l_quantity") > 5).alias("ok"), F.lit("too small").alias("error"))
    errors = sinks.refresh_errors(li, ["job"]).groupBy("job").agg(F.count(F.lit(1)).alias("error_rows"), F.max("key.l_orderkey").alias("last_order"))
    return tidy(sinks.refresh_log(li, ["job"]).join(errors, "job", "left").withColumn("error_rows", F.coalesce("error_rows", F.lit(0))))


def _scratch(spark) -> str:
    """A folder next to the checkpoints the cluster names."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    import uuid

    return f"{base}/sink-{uuid.uuid4().hex}"


@query("snk_market_data", f"select entity, date, {rnd('close')} as close from fx_daily_prices")
def snk_market_data(spark, sf):
    path = _scratch(spark)
    ticks = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "ts", "event_id", F.col("value").alias("close"))
    sinks.overwrite_days(sinks.latest_per_key(ticks, ["entity", "date"], ["ts", "event_id"]).select("entity", "date", "close"), path)
    return tidy(spark.read.parquet(path).select("entity", "date", "close"))


@query("snk_rankings", f"select ticker, overall_rank, {rnd('overall_score')} as overall_score, date '2002-01-02' as date from o_rank")
def snk_rankings(spark, sf):
    path = _scratch(spark)
    sinks.write_rankings(ranked(spark, sf).select("ticker", "overall_rank", "overall_score"), path, "2002-01-02")
    return tidy(spark.read.parquet(f"{path}/snapshots").select("ticker", "overall_rank", "overall_score", "date"))


@query("inc_snapshot_append", "select ts::DATE as date, count(*) as n from events group by ts::DATE")
def inc_snapshot_append(spark, sf):
    ev = table(spark, sf, "events")
    path, source = _scratch(spark), _scratch(spark)
    ev.select("event_id", F.to_date("ts").alias("date")).repartition(4).write.parquet(source)  # every day is spread over the files
    stream = spark.readStream.schema("event_id bigint, date date").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new and changes nothing
        incremental.snapshot_append(stream, path, path + "-ckpt", lambda b: b.groupBy("date").agg(F.count(F.lit(1)).alias("n"))).awaitTermination()
    return spark.read.parquet(path).select("date", "n")


@query("inc_restatement", """select i.ticker, i.period_key, i.filed_at + 10 as filed_at, i.filed_at as old_filed_at from fx_income i join fx_companies c using (ticker) where filed_at is not null and c.p_size % 3 = 0""")
def inc_restatement(spark, sf):
    old = bind(spark, sf, "fx_panel").select("ticker", "period_key", "filed_at", "p_size")
    new = old.withColumn("filed_at", F.date_add("filed_at", F.when(F.col("p_size") % 3 == 0, 10).when(F.col("p_size") % 3 == 1, -5).otherwise(0)))
    return incremental.restatements(old, new)


@query("inc_affected_recompute", f"""select ticker, year_index, {rnd('roic')} as roic from o_wide where ticker in (select 'P' || lpad(l_partkey::VARCHAR, 8, '0') from lineitem where l_shipdate >= timestamp '2001-10-01')""")
def inc_affected_recompute(spark, sf):
    changed = table(spark, sf, "lineitem").filter("l_shipdate >= '2001-10-01'").select(F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("ticker"))
    from balancebeam.operators.panel import metric_panel_wide

    return tidy(metric_panel_wide(incremental.affected(bind(spark, sf, "fx_panel"), changed)).select("ticker", "year_index", "roic"))
