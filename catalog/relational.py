"""Joins, aggregations, windows, filters, sorts and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from balancebeam.operators import joins, rollup, screens
from balancebeam.operators.joins import newest_years
from catalog.base import bind, companies, query, table, tidy, wide_panel
from catalog.ranking import category_scores, ranked
from catalog.sql import rnd

ASOF = joins.quarter_dates(datetime.date(1996, 1, 1), datetime.date(2001, 1, 1))
ASOF_SQL = "select unnest(generate_series(timestamp '1996-01-01', timestamp '2001-01-01', interval 3 month))::DATE as as_of"
D = {"d_asof": ASOF_SQL}


def statements(spark, sf):
    return bind(spark, sf, "fx_income"), bind(spark, sf, "fx_balance"), bind(spark, sf, "fx_cash_flow")


def newest(name, n):
    return f"(select * from (select *, row_number() over (partition by ticker order by fiscal_year desc) as k from {name}) where k <= {n})"


@query("src_statements", f"select ticker, fiscal_year, {rnd('revenue')} as revenue from {newest('fx_income', 5)}")
def src_statements(spark, sf):
    return tidy(newest_years(bind(spark, sf, "fx_income"), 5).select("ticker", "fiscal_year", "revenue"))


@query("topk_per_entity", "select ticker, fiscal_year from " + newest("fx_cash_flow", 3))
def topk_per_entity(spark, sf):
    return tidy(newest_years(bind(spark, sf, "fx_cash_flow"), 3).select("ticker", "fiscal_year"))


@query("join_statements_inner", f"""select i.ticker, i.fiscal_year, {rnd('i.revenue')} as revenue, {rnd('b.total_assets')} as total_assets, {rnd('c.free_cash_flow')} as free_cash_flow
        from {newest('fx_income', 6)} i join {newest('fx_balance', 6)} b using (ticker, fiscal_year) join {newest('fx_cash_flow', 6)} c using (ticker, fiscal_year)
        qualify row_number() over (partition by i.ticker order by i.fiscal_year desc) <= 6""")
def join_statements_inner(spark, sf):
    return tidy(joins.statements_inner(*statements(spark, sf)).select("ticker", "fiscal_year", "revenue", "total_assets", "free_cash_flow"))


@query("join_statements_outer", f"""select ticker, fiscal_year, {rnd('i.revenue')} as revenue, {rnd('b.total_assets')} as total_assets, {rnd('c.free_cash_flow')} as free_cash_flow
        from fx_income i full join fx_balance b using (ticker, fiscal_year) full join fx_cash_flow c using (ticker, fiscal_year)""")
def join_statements_outer(spark, sf):
    return tidy(joins.statements_outer(*statements(spark, sf)).select("ticker", "fiscal_year", "revenue", "total_assets", "free_cash_flow"))


@query("join_lookup_left", f"""select i.ticker, fiscal_year, {rnd('b.total_debt')} as total_debt, c.sector, c.company_name
        from fx_income i left join fx_balance b using (ticker, fiscal_year) left join fx_companies c on c.ticker = i.ticker""")
def join_lookup_left(spark, sf):
    income, balance, _ = statements(spark, sf)
    out = income.select("ticker", "fiscal_year").join(balance.select("ticker", "fiscal_year", "total_debt"), ["ticker", "fiscal_year"], "left")
    return tidy(out.join(companies(spark, sf).select("ticker", "sector", "company_name"), "ticker", "left"))


FLOATS = {"r_floats": "select l_partkey, o_orderkey, o_orderdate::DATE as float_as_of, year(o_orderdate) as float_year from orders join lineitem on l_orderkey = o_orderkey",
          "r_years": "select distinct l_partkey, year(l_shipdate) as fiscal_year, case when l_partkey % 5 <> 0 then make_date(year(l_shipdate), 12, 31) end as period_end from lineitem"}


@query("join_range_float", """select 'P' || lpad(l_partkey::VARCHAR, 8, '0') as ticker, float_as_of, float_year, min(fiscal_year) as matched_year from (
          select f.l_partkey, f.float_as_of, f.float_year, arg_min(y.fiscal_year, y.period_end) as fiscal_year from (select distinct l_partkey, float_as_of, float_year from r_floats) f
          join r_years y on y.l_partkey = f.l_partkey and y.period_end - f.float_as_of between 0 and 300 group by all
          union all
          select distinct f.l_partkey, f.float_as_of, f.float_year, y.fiscal_year from r_floats f join r_years y on y.l_partkey = f.l_partkey and y.period_end is null and y.fiscal_year = f.float_year
        ) group by all""", FLOATS)
def join_range_float(spark, sf):
    ticker = F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("ticker")
    li = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    floats = li.select("l_orderkey", "l_partkey").join(orders, li.l_orderkey == orders.o_orderkey).select(
        ticker, F.to_date("o_orderdate").alias("float_as_of"), F.year("o_orderdate").alias("float_year")).distinct()
    years = li.select(ticker, "l_partkey", F.year("l_shipdate").alias("fiscal_year")).distinct().select(
        "ticker", "fiscal_year", F.when(F.col("l_partkey") % 5 != 0, F.make_date("fiscal_year", F.lit(12), F.lit(31))).alias("period_end"))
    return tidy(joins.range_float(floats, years))


SNAP = {"r_snap": "select entity, min(date) as first_date, (date '1998-01-01' + (entity % 900)::INT) as snap_date from fx_trade_prices group by entity",
        "r_near": """select s.entity, s.snap_date, p.date, p.close, abs(p.date - s.snap_date) as gap, row_number() over (partition by s.entity order by abs(p.date - s.snap_date), p.date) as k
                     from r_snap s join fx_trade_prices p on p.entity = s.entity and abs(p.date - s.snap_date) <= 14"""}


def snapshots(spark, sf):
    prices = bind(spark, sf, "fx_trade_prices")
    return prices.groupBy("entity").agg(F.min("date").alias("first_date")).select(
        "entity", F.date_add(F.lit(datetime.date(1998, 1, 1)), (F.col("entity") % 900).cast("int")).alias("snap_date"))


@query("join_nearest", f"select entity, snap_date, date as matched_date, gap as gap_days, {rnd('close')} as matched_value from r_near where k = 1", SNAP)
def join_nearest(spark, sf):
    return tidy(joins.nearest(snapshots(spark, sf), bind(spark, sf, "fx_trade_prices"), "snap_date", "date", 14, "close"))


@query("join_asof_backward", f"""select e.entity, e.as_of, p.date, {rnd('p.close')} as close from (select entity, as_of from (select distinct entity from fx_trade_prices), d_asof) e
        asof join fx_trade_prices p on p.entity = e.entity and p.date <= e.as_of""", D)
def join_asof_backward(spark, sf):
    return tidy(joins.asof_backward(bind(spark, sf, "fx_trade_prices"), ASOF, "date", ["date"], ["date", "close"], ["entity"]))


@query("join_asof_forward", f"""select e.entity, e.as_of, p.date, {rnd('p.close')} as close from (select entity, as_of from (select distinct entity from fx_trade_prices), d_asof) e
        asof join fx_trade_prices p on p.entity = e.entity and p.date >= e.as_of""", D)
def join_asof_forward(spark, sf):
    return tidy(joins.asof_forward(bind(spark, sf, "fx_trade_prices"), ASOF, "date", ["date", "close"], ["entity"]))


WATCH = "select distinct 'P' || lpad(l_partkey::VARCHAR, 8, '0') as ticker from lineitem where l_quantity = 50"


@query("semi_watchlist", f"select ticker, {rnd('overall_score')} as overall_score, overall_rank from o_rank where ticker in ({WATCH})")
def semi_watchlist(spark, sf):
    watched = table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("ticker"))
    out = ranked(spark, sf).join(watched, "ticker", "left_semi").select("ticker", "overall_score", "overall_rank")
    return tidy(out).orderBy(F.desc_nulls_last("overall_score"))


def _members(spark, sf, flag):
    """Membership lists of every year: the parts of each ship year."""
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag)
    return li.select(F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("ticker"), F.year("l_shipdate").cast("bigint").alias("list_year")).distinct()


MEMBERS = {f"r_{n}": f"select distinct 'P' || lpad(l_partkey::VARCHAR, 8, '0') as ticker, year(l_shipdate) as list_year from lineitem where l_returnflag = '{f}'"
           for n, f in (("old", "A"), ("new", "R"))}


@query("anti_membership", "select ticker, list_year, true as is_member from r_new union all select ticker, list_year, false from r_old anti join r_new using (ticker, list_year)", MEMBERS)
def anti_membership(spark, sf):
    old, new = _members(spark, sf, "A"), _members(spark, sf, "R")
    return new.withColumn("is_member", F.lit(True)).unionByName(old.join(new, ["ticker", "list_year"], "left_anti").withColumn("is_member", F.lit(False)))


@query("set_except_members", "select ticker, list_year from r_old except select ticker, list_year from r_new", MEMBERS)
def set_except_members(spark, sf):
    return _members(spark, sf, "A").subtract(_members(spark, sf, "R"))


@query("set_union_years", """select ticker, fiscal_year from fx_income union select ticker, fiscal_year from fx_balance union select ticker, fiscal_year from fx_cash_flow""")
def set_union_years(spark, sf):
    a, b, c = (x.select("ticker", "fiscal_year") for x in statements(spark, sf))
    return tidy(a.union(b).union(c).distinct())


@query("set_intersect_years", "select ticker, fiscal_year from fx_income intersect select ticker, fiscal_year from fx_balance intersect select ticker, fiscal_year from fx_cash_flow")
def set_intersect_years(spark, sf):
    a, b, c = (x.select("ticker", "fiscal_year") for x in statements(spark, sf))
    return tidy(a.intersect(b).intersect(c))


@query("anti_non_operating", "select ticker from fx_companies where ticker not in (select ticker from fx_income where revenue is not null and operating_income > 0.6 * revenue)")
def anti_non_operating(spark, sf):
    income = bind(spark, sf, "fx_income").withColumn("revenue", F.expr("case when operating_income > 0.6 * revenue then revenue end"))  # only very profitable years count as reported
    return screens.non_operating(companies(spark, sf), income).select("ticker")


@query("join_self_lag", f"""select ticker, fiscal_year, {rnd('lead(revenue, 2) over (partition by ticker order by fiscal_year desc)')} as revenue_2 from fx_income""")
def join_self_lag(spark, sf):
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    return tidy(bind(spark, sf, "fx_income").select("ticker", "fiscal_year", F.lead("revenue", 2).over(w).alias("revenue_2")))


@query("cross_sweep", f"select ticker, rate, {rnd('market_cap * rate')} as required from fx_companies, (values (0.08::DOUBLE), (0.1::DOUBLE), (0.12::DOUBLE)) v(rate)")
def cross_sweep(spark, sf):
    rates = spark.createDataFrame([(0.08,), (0.1,), (0.12,)], "rate double")
    out = joins.cross_sweep(companies(spark, sf).select("ticker", "market_cap"), rates)
    return tidy(out.select("ticker", "rate", (F.col("market_cap") * F.col("rate")).alias("required")))


# --- aggregations ----------------------------------------------------------------------------------------------------------------


@query("agg_weighted_avg", f"select sector, {rnd('sum(revenue * (net_income / revenue)) / nullif(sum(revenue), 0)')} as margin from fx_panel group by sector")
def agg_weighted_avg(spark, sf):
    p = bind(spark, sf, "fx_panel")
    return tidy(p.groupBy("sector").agg(F.try_divide(F.sum(F.col("revenue") * (F.col("net_income") / F.col("revenue"))), F.sum("revenue")).alias("margin")))


@query("agg_mean_sd_cv", f"select ticker, {rnd('avg(net_income)')} as mean, {rnd('stddev_samp(net_income)')} as sd, "
                         f"{rnd('case when avg(net_income) <> 0 then stddev_samp(net_income) / abs(avg(net_income)) end')} as cv from fx_panel group by ticker")
def agg_mean_sd_cv(spark, sf):
    from balancebeam.functions.scalars import coefficient_of_variation

    g = bind(spark, sf, "fx_panel").groupBy("ticker").agg(F.avg("net_income").alias("mean"), F.stddev_samp("net_income").alias("sd"))
    return tidy(g.withColumn("cv", coefficient_of_variation("mean", "sd")))



@query("agg_quantiles_r7", f"""select ticker, count(*) as n, {', '.join(rnd(f"case when count(*) >= 5 then quantile_cont(r, {p}) end") + f' as {a}' for a, p in
        (('q1', 0.25), ('median', 0.5), ('q3', 0.75), ('lowest', 0.0), ('highest', 1.0)))} from (select ticker, market_cap / net_income as r from fx_panel where net_income > 0) group by ticker""")
def agg_quantiles_r7(spark, sf):
    from balancebeam.operators.valuation import quantile_summary

    p = bind(spark, sf, "fx_panel").filter("net_income > 0").withColumn("r", F.col("market_cap") / F.col("net_income"))
    return tidy(quantile_summary(p, ["ticker"], "r").drop("reason"))


@query("agg_median", f"select ticker, {rnd('median(revenue)', 6)} as median_revenue from fx_panel group by ticker")
def agg_median(spark, sf):
    return tidy(bind(spark, sf, "fx_panel").groupBy("ticker").agg(F.median("revenue").alias("median_revenue")))


@query("agg_upper_median", f"""select fiscal_year, {rnd('max(case when r = n // 2 + 1 then revenue end)')} as upper_median from
        (select fiscal_year, revenue, row_number() over (partition by fiscal_year order by revenue) as r, count(*) over (partition by fiscal_year) as n from fx_panel) group by fiscal_year""")
def agg_upper_median(spark, sf):
    from balancebeam.operators.backtest import upper_median

    return tidy(upper_median(bind(spark, sf, "fx_panel"), ["fiscal_year"], "revenue", "ticker").withColumnRenamed("median", "upper_median"))


@query("agg_pearson", f"select sector, {rnd('corr(revenue, net_income)')} as r from fx_panel group by sector")
def agg_pearson(spark, sf):
    return tidy(bind(spark, sf, "fx_panel").groupBy("sector").agg(F.corr("revenue", "net_income").alias("r")))


@query("agg_loglinear_cv", f"""select ticker, {rnd("case when n >= 4 and sxx > 0 then sqrt(avg((v - exp(i + s * fiscal_year)) ** 2)) / avg(v) end", 6)} as cv, n as usable_years from
        (select ticker, fiscal_year, v, regr_slope(ln(v), fiscal_year) over g as s, regr_intercept(ln(v), fiscal_year) over g as i, count(*) over g as n, var_pop(fiscal_year) over g as sxx
         from (select ticker, fiscal_year, revenue / shares_diluted as v from fx_panel where revenue / shares_diluted > 0) window g as (partition by ticker)) group by ticker, n, sxx""")
def agg_loglinear_cv(spark, sf):
    from balancebeam.operators.valuation import loglinear_cv

    p = bind(spark, sf, "fx_panel").select("ticker", "fiscal_year", (F.col("revenue") / F.col("shares_diluted")).alias("v"))
    return tidy(loglinear_cv(p, "v"))


R = "(select r.*, c.sector, c.market_cap, c.country, c.company_name, c.cik from o_rank r join fx_companies c using (ticker))"


def ranked_companies(spark, sf):
    return ranked(spark, sf).drop("sector").join(companies(spark, sf).select("ticker", "sector", "market_cap", "country", "company_name", "cik"), "ticker")


@query("sector_rollup", f"""select s.sector, count(r.ticker) as n, {rnd('avg(overall_score)')} as mean_score, {rnd('coalesce(sum(market_cap), 0)')} as total_cap
        from d_sectors s left join {R} r using (sector) group by s.sector""")
def sector_rollup(spark, sf):
    return tidy(screens.sector_rollup(ranked_companies(spark, sf)))


@query("sector_category_heatmap", f"""select s.sector, c.category, {rnd('avg(k.score) * 100')} as mean_score from d_sectors s cross join d_categories c
        left join (select sector, k.category, k.score from o_rank_cat k join fx_companies using (ticker)) k on k.sector = s.sector and k.category = c.category group by s.sector, c.category""")
def sector_category_heatmap(spark, sf):
    cats = category_scores(spark, sf).join(companies(spark, sf).select("ticker", "sector"), "ticker")
    return tidy(screens.sector_category_heatmap(cats))


@query("sector_peer_mean_excl_self", f"""select ticker, {rnd("case when sector is not null and n - own > 0 then (s - coalesce(overall_score, 0)) / (n - own) end")} as peer_mean from
        (select ticker, sector, overall_score, sum(overall_score) over (partition by sector) as s, count(overall_score) over (partition by sector) as n,
                case when overall_score is not null then 1 else 0 end as own from {R})""")
def sector_peer_mean_excl_self(spark, sf):
    return tidy(screens.sector_peer_mean(ranked_companies(spark, sf)).select("ticker", "peer_mean"))


@query("distinct_values", "select 'country' as kind, country as value from fx_companies where country is not null group by country "
                          "union all select 'fiscal_year', fiscal_year::VARCHAR from fx_panel group by fiscal_year")
def distinct_values(spark, sf):
    a = companies(spark, sf).filter("country is not null").select(F.lit("country").alias("kind"), F.col("country").alias("value")).distinct()
    b = bind(spark, sf, "fx_panel").select(F.lit("fiscal_year").alias("kind"), F.col("fiscal_year").cast("string").alias("value")).distinct()
    return a.union(b).orderBy("kind", "value")


@query("refresh_counts", """select l_suppkey as job, count(*) as requested, count_if(l_quantity > 5) as succeeded, count_if(l_quantity <= 5) as failed from lineitem group by l_suppkey""")
def refresh_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("job")).agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("l_quantity") > 5).alias("succeeded"), F.count_if(F.col("l_quantity") <= 5).alias("failed"))


# --- windows ---------------------------------------------------------------------------------------------------------------------


@query("win_year_index", "select ticker, fiscal_year, year_index from (select ticker, fiscal_year, row_number() over (partition by ticker order by period_key desc) - 1 as year_index from fx_panel) where year_index < 5")
def win_year_index(spark, sf):
    w = Window.partitionBy("ticker").orderBy(F.desc("period_key"))
    return tidy(bind(spark, sf, "fx_panel").select("ticker", "fiscal_year", (F.row_number().over(w) - 1).alias("year_index")).filter("year_index < 5"))


SERIES6 = "(select * from (select *, row_number() over (partition by ticker order by fiscal_year desc) as k from fx_panel) where k <= 6)"


@query("win_lookback", f"select ticker, fiscal_year, {rnd('lead(revenue, 1) over w')} as r1, {rnd('lead(revenue, 3) over w')} as r3, {rnd('lead(revenue, 5) over w')} as r5 "
                       f"from {SERIES6} window w as (partition by ticker order by fiscal_year desc)")
def win_lookback(spark, sf):
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    p = newest_years(bind(spark, sf, "fx_panel"), 6)
    return tidy(p.select("ticker", "fiscal_year", *[F.lead("revenue", k).over(w).alias(f"r{k}") for k in (1, 3, 5)]))


@query("win_trailing_series", f"select ticker, fiscal_year, {rnd('avg(net_income) over o')} as mean_older, {rnd('avg(net_income) over f')} as mean_5 from {SERIES6} "
       "window o as (partition by ticker order by fiscal_year desc rows between current row and unbounded following), f as (partition by ticker order by fiscal_year desc rows between current row and 4 following)")
def win_trailing_series(spark, sf):
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    p = newest_years(bind(spark, sf, "fx_panel"), 6)
    return tidy(p.select("ticker", "fiscal_year", F.avg("net_income").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("mean_older"),
                         F.avg("net_income").over(w.rowsBetween(0, 4)).alias("mean_5")))


@query("win_yoy_calendar", f"""select ticker, fiscal_year, {rnd("case when fiscal_year - lag(fiscal_year) over w = 1 then total_assets / nullif(lag(total_assets) over w, 0) - 1 end")} as growth
        from fx_balance window w as (partition by ticker order by fiscal_year)""")
def win_yoy_calendar(spark, sf):
    w = Window.partitionBy("ticker").orderBy("fiscal_year")
    b = bind(spark, sf, "fx_balance")
    prior = F.lag("total_assets").over(w)
    consecutive = F.col("fiscal_year") - F.lag("fiscal_year").over(w) == 1
    return tidy(b.select("ticker", "fiscal_year", F.when(consecutive, F.try_divide("total_assets", prior) - 1).alias("growth")))


# --- filters ---------------------------------------------------------------------------------------------------------------------


@query("flt_market_cap_plausible", "select ticker, fiscal_year, coalesce(market_cap > 0 and market_cap <= 1e13, false) and not coalesce(revenue > 0 and market_cap > 100 * revenue, false) as plausible from fx_panel")
def flt_market_cap_plausible(spark, sf):
    return tidy(bind(spark, sf, "fx_panel").select("ticker", "fiscal_year", screens.market_cap_plausible("market_cap", "revenue").alias("plausible")))


@query("flt_float_corroborates", "select ticker, fiscal_year, coalesce(market_cap > 0 and inventory > 0 and market_cap / inventory between 1.0 / 20 and 20, false) as ok from fx_panel")
def flt_float_corroborates(spark, sf):
    return tidy(bind(spark, sf, "fx_panel").select("ticker", "fiscal_year", screens.float_corroborates("market_cap", "inventory").alias("ok")))


QUOTES = {
    "r_latest": "select ticker, arg_max(revenue, fiscal_year) as revenue, arg_max(shares_diluted, fiscal_year) as shares, arg_max(coalesce(total_debt, -1), fiscal_year) as debt0, arg_max(cash, fiscal_year) as cash from fx_panel group by ticker",
    "r_q": """select c.ticker, c.p_partkey as k, l.revenue, l.shares, nullif(l.debt0, -1) as total_debt, l.cash, case when c.p_partkey % 3 <> 0 then share_price * (case when c.p_partkey % 4 = 0 then 1000 else 1 end) end as live_price,
              case when c.p_partkey % 7 <> 0 then shares_outstanding * share_price * (case when c.p_partkey % 11 = 0 then 1e6 else 0.5 end) end as public_float, shares_outstanding as float_shares
              from fx_companies c left join r_latest l using (ticker)""",
    "r_c": "select *, case when live_price is not null then coalesce(live_price * shares, 0) end as live_cap from r_q",
    "r_s": """select *, (coalesce(live_cap > 0 and live_cap <= 1e13, false) and not coalesce(revenue > 0 and live_cap > 100 * revenue, false))
                or coalesce(live_cap > 0 and public_float > 0 and live_cap / public_float between 0.05 and 20, false) as use_live,
              coalesce(public_float > 0 and public_float <= 1e13, false) and not coalesce(revenue > 0 and public_float > 100 * revenue, false) as use_float from r_c""",
}


def quote_inputs(spark, sf):
    c = companies(spark, sf)
    k = F.col("p_partkey")
    live = c.filter(k % 3 != 0).select("ticker", (F.col("share_price") * F.when(k % 4 == 0, 1000).otherwise(1)).alias("live_price"), F.lit(datetime.date(2002, 1, 2)).alias("live_date"))
    approx = c.filter(k % 7 != 0).select("ticker", (F.col("market_cap") * F.when(k % 11 == 0, 1e6).otherwise(0.5)).alias("public_float"),
                                         F.col("shares_outstanding").alias("float_shares"), F.lit(datetime.date(2001, 6, 30)).alias("float_date"))
    latest = bind(spark, sf, "fx_panel").groupBy("ticker").agg(F.max_by(F.struct("revenue", F.col("shares_diluted").alias("shares"), "total_debt", "cash"), "fiscal_year").alias("r")).select("ticker", "r.*")
    return live, approx, latest


@query("resolve_quote", f"""select ticker, case when use_live then date '2002-01-02' else date '2001-06-30' end as date, {rnd('case when use_live then live_price else public_float / nullif(float_shares, 0) end')} as share_price,
        {rnd('case when use_live then live_cap else public_float end')} as market_cap,
        {rnd('case when (case when use_live then live_cap else public_float end) > 0 then (case when use_live then live_cap else public_float end) + coalesce(total_debt, 0) - coalesce(cash, 0) end')} as enterprise_value,
        {rnd('case when use_live then shares else float_shares end')} as shares_outstanding, case when use_live then 'live' else 'sec_public_float' end as price_source from r_s where use_live or use_float""", QUOTES)
def resolve_quote(spark, sf):
    out = tidy(screens.resolve_quote(*quote_inputs(spark, sf)))
    return tidy(out)


def candidates(spark, sf):
    c = companies(spark, sf)
    rev = bind(spark, sf, "fx_panel").groupBy("ticker").agg(F.max_by("revenue", "fiscal_year").alias("revenue"))
    return c.join(rev, "ticker", "left").select(F.concat("ticker", F.when(F.col("p_partkey") % 10 == 8, F.lit("-B")).otherwise("")).alias("ticker"), "cik", (F.col("market_cap") * 1000).alias("public_float"),
                                                (F.col("revenue") * 1000).alias("revenue"), (F.col("p_size") % 9 != 0).alias("has_operating_financials"))


CAND = {"r_cand": """select c.ticker || (case when p_partkey % 10 = 8 then '-B' else '' end) as ticker, cik, market_cap * 1000 as public_float, rev * 1000 as revenue, p_size % 9 <> 0 as has_operating_financials
                     from fx_companies c left join (select ticker, arg_max(revenue, fiscal_year) as rev from fx_panel group by ticker) using (ticker)"""}


@query("universe_screen", f"""select ticker, cik, {rnd('public_float')} as public_float, case when public_float >= 4.9e9 then 'large' else 'mid' end as market_cap_tier from (
          select *, row_number() over (partition by cik order by regexp_matches(ticker, '[-.]'), length(ticker), ticker) as k from r_cand
          where public_float >= 4.52e9 and public_float <= 1e13 and not coalesce(revenue > 0 and public_float > 100 * revenue, false) and has_operating_financials
            and cik not in (select cik from fx_companies where p_size % 10 = 0)) where k = 1""", CAND)
def universe_screen(spark, sf):
    present = companies(spark, sf).filter("p_size % 10 = 0").select("cik")
    out = screens.universe_screen(candidates(spark, sf), present, min_float=4.52e9, large=4.9e9)
    return tidy(out.select("ticker", "cik", "public_float", "market_cap_tier"))


@query("dedupe_primary_ticker", "select ticker, cik, k > 1 as superseded from (select *, row_number() over (partition by cik order by regexp_matches(ticker, '[-.]'), length(ticker), ticker) as k from r_cand)", CAND)
def dedupe_primary_ticker(spark, sf):
    c = candidates(spark, sf).select("ticker", "cik")
    gone = screens.superseded_tickers(c).withColumn("superseded", F.lit(True))
    return c.join(gone, "ticker", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


@query("cascade_delete", """select t.kind, t.ticker, count(*) as n from (select 'income' as kind, ticker from fx_income union all select 'valuation_history', ticker from fx_valuation_history
        union all select 'headlines', ticker from fx_headlines) t where ticker not in (select ticker from fx_companies where p_partkey % 10 = 9) group by all""")
def cascade_delete(spark, sf):
    removed = companies(spark, sf).filter("p_partkey % 10 = 9")
    kept = screens.cascade_delete(removed, {"income": bind(spark, sf, "fx_income"), "valuation_history": bind(spark, sf, "fx_valuation_history"), "headlines": bind(spark, sf, "fx_headlines")})
    parts = [df.select(F.lit(name).alias("kind"), "ticker") for name, df in kept.items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind", "ticker").agg(F.count(F.lit(1)).alias("n"))


LATEST = f"(select r.*, w.* exclude (ticker, sector) from {R} r left join (select * from o_wide where year_index = 0) w using (ticker))"


@query("rank_filters", f"""select ticker, overall_rank from {LATEST} where sector in ('Technology', 'Energy') and country in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6')
        and metrics_included >= 40 and pe_ttm <= 200 and fcf_yield >= 0.0001 and market_cap >= 4.52e6""")
def rank_filters(spark, sf):
    joined = ranked_companies(spark, sf).join(wide_panel(spark, sf).filter("year_index = 0").drop("sector"), "ticker", "left")
    out = screens.rank_filters(joined, sectors=["Technology", "Energy"], countries=[f"NATION_{i}" for i in range(1, 7)], min_metrics=40,
                               bounds={"pe_ttm": ("<=", 200.0), "fcf_yield": (">=", 0.0001), "market_cap": (">=", 4.52e6)})
    return out.select("ticker", "overall_rank")


@query("text_search", "select ticker, company_name from fx_companies where contains(lower(ticker), 'ring') or contains(lower(company_name), 'ring')")
def text_search(spark, sf):
    return screens.text_search(companies(spark, sf).select("ticker", "company_name"), " RING ")


@query("category_data_count", "select ticker, sum(included)::BIGINT as n from o_rank_cat join d_categories using (category) where cw > 0 group by ticker")
def category_data_count(spark, sf):
    from balancebeam.metrics.registry import CATEGORY_WEIGHTS

    active = [c for c, w in CATEGORY_WEIGHTS.items() if w > 0]
    return category_scores(spark, sf).filter(F.col("category").isin(active)).groupBy("ticker").agg(F.sum("included").alias("n"))


def latest_wide(spark, sf):
    return wide_panel(spark, sf).filter("year_index = 0")


@query("screen_formula", """select ticker from o_wide where year_index = 0 and ((coalesce(pe_ttm < 30, false) and coalesce(roic > 0.05, false)) or not coalesce(interest_coverage > 2, false))""")
def screen_formula(spark, sf):
    c = screens.cmp
    df = latest_wide(spark, sf)
    return df.filter((c(screens.resolve_field(df, "PeTtm"), "<", 30) & c("roic", ">", 5 * screens.PERCENT)) | ~c("interest_coverage", ">", 2)).select("ticker")


@query("screen_context", f"""select w.ticker, {rnd('coalesce(c.share_price, w.pe_ttm)')} as pe_ttm, {rnd('c.market_cap')} as market_cap, {rnd('w.roic')} as roic
        from o_wide w left join (select ticker, market_cap, case when p_size % 2 = 0 then share_price end as share_price from fx_companies) c using (ticker) where year_index = 0""")
def screen_context(spark, sf):
    snap = companies(spark, sf).select("ticker", "market_cap", F.when(F.col("p_size") % 2 == 0, F.col("share_price")).alias("quoted"))
    out = screens.screen_context(latest_wide(spark, sf).select("ticker", "pe_ttm", "roic"), {"pe_ttm": "quoted", "market_cap": "market_cap"}, snap)
    return tidy(out)


@query("preset_screen_counts", """select * from (select 'cheap' as screen, count_if(pe_ttm < 15 and pb < 2) as hits from o_wide where year_index = 0
        union all select 'quality', count_if(roic > 0.1 and gross_margin > 0.2) from o_wide where year_index = 0 union all select 'cash', count_if(fcf_yield > 0.0005) from o_wide where year_index = 0)""")
def preset_screen_counts(spark, sf):
    c = screens.cmp
    return screens.preset_counts(latest_wide(spark, sf), {"cheap": c("pe_ttm", "<", 15) & c("pb", "<", 2), "quality": c("roic", ">", 0.1) & c("gross_margin", ">", 0.2), "cash": c("fcf_yield", ">", 0.0005)})


# --- sorts, limits ---------------------------------------------------------------------------------------------------------------


@query("sort_negative_is_bad", "select ticker, row_number() over (order by pe_ttm is null, pe_ttm <= 0, abs(pe_ttm), ticker) as place from o_wide where year_index = 0")
def sort_negative_is_bad(spark, sf):
    from balancebeam.operators.positions import positions

    order = [*screens.negative_is_bad_order("pe_ttm"), F.col("ticker")]
    return tidy(positions(latest_wide(spark, sf), [], order, "place").select("ticker", "place"))


@query("sort_null_defaults", f"select ticker, coalesce(overall_rank, 9999) as rank_key, {rnd('coalesce(market_cap, 0)')} as cap_key, {rnd('coalesce(overall_score, -1)')} as score_key from {R}")
def sort_null_defaults(spark, sf):
    d = screens_defaults(ranked_companies(spark, sf))
    return tidy(d)


def screens_defaults(df):
    return df.select("ticker", F.coalesce("overall_rank", F.lit(9999)).alias("rank_key"), F.coalesce("market_cap", F.lit(0.0)).alias("cap_key"),
                     F.coalesce("overall_score", F.lit(-1.0)).alias("score_key")).orderBy("rank_key", F.desc("cap_key"))


SCATTER = "(select ticker, market_cap, roic, growth_revenue_1y from (select w.*, c.market_cap, c.sector as s2 from o_wide w join fx_companies c using (ticker) where year_index = 0) where roic is not null and growth_revenue_1y is not null and s2 is not null order by market_cap desc, ticker limit 200)"


def scatter(spark, sf):
    c = companies(spark, sf).select("ticker", "market_cap")
    w = latest_wide(spark, sf).filter("roic is not null and growth_revenue_1y is not null and sector is not null").select("ticker", "roic", "growth_revenue_1y")
    return screens.top_k(w.join(c, "ticker"), [F.desc("market_cap"), F.col("ticker")], 200)


@query("topk_scatter", f"select ticker, {rnd('market_cap')} as market_cap, {rnd('roic')} as roic from {SCATTER}")
def topk_scatter(spark, sf):
    return tidy(scatter(spark, sf).select("ticker", "market_cap", "roic"))


@query("trim_outliers", """select ticker, roic between (select max(roic) from tr_b where rr = lo + 1) and (select max(roic) from tr_b where rr = hi + 1)
          and growth_revenue_1y between (select max(growth_revenue_1y) from tr_b where rg = lo + 1) and (select max(growth_revenue_1y) from tr_b where rg = hi + 1) as kept from tr_b""",
       {"tr_b": """select *, row_number() over (order by roic) as rr, row_number() over (order by growth_revenue_1y) as rg, floor(0.05::DOUBLE * (count(*) over () - 1) + 0.5) as lo,
                floor(0.95::DOUBLE * (count(*) over () - 1) + 0.5) as hi from o_wide where year_index = 0 and roic is not null and growth_revenue_1y is not null"""})
def trim_outliers(spark, sf):
    df = latest_wide(spark, sf).filter("roic is not null and growth_revenue_1y is not null").select("ticker", "roic", "growth_revenue_1y")
    return screens.trim_outliers(df, ("roic", "growth_revenue_1y"), 0.05).select("ticker", "kept")


@query("page_rows", "select ticker, company_name from fx_companies order by ticker limit 25 offset 50")
def page_rows(spark, sf):
    return screens.page(companies(spark, sf).select("ticker", "company_name"), [F.col("ticker")], 2)


@query("sector_members_ranked", f"select ticker, {rnd('overall_score')} as overall_score from {R} where sector = 'Technology'")
def sector_members_ranked(spark, sf):
    out = ranked_companies(spark, sf).filter("sector = 'Technology'").select("ticker", "overall_score")
    return tidy(out).orderBy(F.desc_nulls_last("overall_score"), "ticker")
