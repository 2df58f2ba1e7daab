"""Set-wide analyses over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from balancebeam.functions import dims
from balancebeam.operators import capalloc, forensics, scenario, statements, strategies, valuation
from balancebeam.session import stored
from catalog.base import bind, companies, query, tidy, wide_panel
from catalog.ranking import category_scores
from catalog.sql import quote, rnd, values

BALANCE = ["cash", "receivables", "inventory", "total_current_assets", "total_assets", "accounts_payable", "total_current_liabilities", "total_debt", "long_term_debt",
           "total_liabilities", "total_equity", "goodwill", "intangibles", "tangible_book", "retained_earnings"]
FLOW = ["operating_cash_flow", "capex", "free_cash_flow", "dividends_paid", "stock_buybacks", "stock_issuance", "depreciation_amortization", "stock_compensation"]


def periods(spark, sf):
    """The outer join of the bound statements: income covers every year, so masking the absent statements gives the same rows from one pass."""
    p = bind(spark, sf, "fx_panel")
    return p.withColumns({**{c: F.when(F.col("has_balance"), F.col(c)) for c in BALANCE}, **{c: F.when(F.col("has_cash_flow"), F.col(c)) for c in FLOW}})


def newest(spark, sf):
    return forensics.newest_periods(periods(spark, sf))


_at = [f"max({c}) filter (where k = {k + 1}) as {c}{k}" for c in forensics.LINES for k in (0, 1)] + [f"max({c}) filter (where k = 3) as {c}2" for c in ("revenue", "gross_profit")]
G = lambda a, b: f"(case when {b} > 0 then ({a} - {b}) / {b} end)"
P = lambda a, b: f"(case when {b} > 0 then ({a}) / {b} end)"
REV_G = G("revenue0", "revenue1")
RH = lambda x, d: f"(floor(({x}) * {10.0 ** d!r}::DOUBLE + 0.5) / {10.0 ** d!r}::DOUBLE)"
CL = lambda x, a, b: f"greatest(least({x}, {b}::DOUBLE), {a}::DOUBLE)"
NOT_MODEL = "coalesce(sector in ('Financials', 'Real Estate'), false)"
FORENSIC = {
    "f_p": """select i.ticker, i.fiscal_year, c.sector, c.market_cap, i.* exclude (ticker, fiscal_year, sector, period_key, period_end), b.* exclude (ticker, fiscal_year, sector, period_key, period_end),
              f.* exclude (ticker, fiscal_year, sector, period_key, period_end), f.ticker is not null as has_cash_flow
              from fx_income i full join fx_balance b on b.ticker = i.ticker and b.fiscal_year = i.fiscal_year full join fx_cash_flow f on f.ticker = i.ticker and f.fiscal_year = i.fiscal_year
              left join fx_companies c on c.ticker = i.ticker""",
    "f_n": f"select ticker, any_value(sector) as sector, any_value(market_cap) as market_cap, {', '.join(_at)} from (select *, row_number() over (partition by ticker order by fiscal_year desc) as k from f_p) where k <= 3 group by ticker",
    "f_a": f"""select *, {NOT_MODEL} as sup,
          1.2 * ((total_current_assets0 - total_current_liabilities0) / ta) + 1.4 * (retained_earnings0 / ta) + 3.3 * (coalesce(operating_income0, ebit0) / ta) + 0.6 * (market_cap / tl) + 1.0 * (revenue0 / ta) as z,
          (net_income0 - operating_cash_flow0) / ta as acc, {RH('(' + G('receivables0', 'receivables1') + ' - ' + REV_G + ') * 100', 1)} as rec,
          {RH('(case when inventory0 > 0 then ' + G('inventory0', 'inventory1') + ' end - ' + REV_G + ') * 100', 1)} as inv,
          {RH('(gm1 - gm0) * 10000', 1)} as m1, {RH('(gm2 - gm0) * 10000', 1)} as m2, {RH(G('shares_diluted0', 'shares_diluted1') + ' * 100', 2)} as dil,
          case when revenue0 > 0 and revenue1 > 0 and receivables1 > 0 then receivables0 / revenue0 / (receivables1 / revenue1) end as dsri, case when gm0 > 0 then gm1 / gm0 end as gmi,
          {P('revenue0', 'revenue1')} as sgi, case when {P('total_liabilities1', 'total_assets1')} > 0 then {P('total_liabilities0', 'total_assets0')} / {P('total_liabilities1', 'total_assets1')} end as lvgi
          from (select *, case when total_assets0 > 0 then total_assets0 end as ta, case when total_liabilities0 > 0 then total_liabilities0 end as tl,
                {P('gross_profit0', 'revenue0')} as gm0, {P('gross_profit1', 'revenue1')} as gm1, {P('gross_profit2', 'revenue2')} as gm2 from f_n)""",
    "f_b": f"""select *, net_income0 is not null and net_income1 is not null and operating_cash_flow0 is not null and operating_cash_flow1 is not null as div,
          case when dsri is not null and gmi is not null and sgi is not null and lvgi is not null and acc is not null then
            -4.84 + 0.92 * {CL('dsri', 0.2, 5)} + 0.528 * {CL('gmi', 0.2, 5)} + 0.892 * {CL('sgi', 0.2, 5)} + 4.679 * {CL('acc', -0.5, 0.5)} - 0.327 * {CL('lvgi', 0.2, 5)} + (0.404 + 0.115 - 0.172) end as ix,
          (dsri > 1.2)::INT + (gmi > 1.1)::INT + (sgi > 1.3)::INT + (acc > 0.05)::INT as hot from f_a""",
    "f_c": """select ticker, sector, sup, 0 as no, 'altmanZ' as key, not sup and z is not null as checked, case when z < 1.81 then 'elevated' when z <= 2.99 then 'noteworthy' end as severity, z as value from f_b
        union all select ticker, sector, sup, 1, 'accrualDivergence', div or acc is not null, case when acc > 0.1 then 'elevated' when div and net_income0 > net_income1 and operating_cash_flow0 < operating_cash_flow1 then 'noteworthy' end, acc from f_b
        union all select ticker, sector, sup, 2, 'receivablesVsRevenue', rec is not null, case when rec > 30 then 'elevated' when rec > 15 then 'noteworthy' end, rec from f_b
        union all select ticker, sector, sup, 3, 'inventoryBuild', inv is not null, case when inv > 30 then 'elevated' when inv > 15 then 'noteworthy' end, inv from f_b
        union all select ticker, sector, sup, 4, 'grossMarginErosion', m1 is not null, case when (m1 > 300 or m2 > 500) and m1 > 500 then 'elevated' when m1 > 300 or m2 > 500 then 'noteworthy' end, case when m1 > 300 then m1 else m2 end from f_b
        union all select ticker, sector, sup, 5, 'shareCountGrowth', dil is not null, case when dil > 5 then 'elevated' when dil > 2 then 'noteworthy' end, dil from f_b
        union all select ticker, sector, sup, 6, 'earningsQualityIndex', not sup and ix is not null, case when ix > -1.5 and hot >= 2 then 'noteworthy' end, ix from f_b""",
    "f_d": "select *, case when checked then severity end as sev from f_c",
    "f_r": """select ticker, any_value(sector) as sector, coalesce(string_agg(key || ':' || sev, ',' order by sev, no) filter (where sev is not null), '') as flags, count_if(checked) as checked_count,
              case when any_value(sup) then 'altmanZ,earningsQualityIndex' else '' end as suppressed from f_d group by ticker""",
}

for _id, _key in (("forensic_altman_z", "altmanZ"), ("forensic_accruals", "accrualDivergence"), ("forensic_receivables", "receivablesVsRevenue"), ("forensic_inventory", "inventoryBuild"),
                  ("forensic_margin", "grossMarginErosion"), ("forensic_dilution", "shareCountGrowth"), ("forensic_quality_index", "earningsQualityIndex")):
    @query(_id, f"select ticker, checked, sev as severity, {rnd('case when checked then value end')} as value from f_d where key = '{_key}'", FORENSIC)
    def _run(spark, sf, key=_key):
        return tidy(forensics.single_check(newest(spark, sf), key))


def report(spark, sf):
    return forensics.forensic_report(newest(spark, sf))


def _flags_text():
    return F.array_join(F.transform("flags", lambda f: F.concat(f["key"], F.lit(":"), f["severity"])), ",")


@query("forensic_report", "select ticker, flags, checked_count, suppressed from f_r", FORENSIC)
def forensic_report(spark, sf):
    return tidy(report(spark, sf).select("ticker", _flags_text().alias("flags"), "checked_count", F.array_join("suppressed", ",").alias("suppressed")))


@query("flags_by_severity", "select ticker, key, sev as severity, row_number() over (partition by ticker order by sev, no) as place from f_d where sev is not null", FORENSIC)
def flags_by_severity(spark, sf):
    out = report(spark, sf).select("ticker", F.posexplode("flags").alias("i", "f"))
    return tidy(out.select("ticker", F.col("f.key").alias("key"), F.col("f.severity").alias("severity"), (F.col("i") + 1).alias("place")))


@query("forensic_base_rates", f"""select k.key, count(sev) as tripped, {rnd("floor(count(sev) / (select count(*) from f_r where checked_count > 0)::DOUBLE * 100 * 10 + 0.5) / 10")} as pct
        from (select unnest([{', '.join(quote(k) for k in dims.FORENSIC_CHECKS)}]) as key) k left join f_d d on d.key = k.key and d.sev is not null group by k.key""", FORENSIC)
def forensic_base_rates(spark, sf):
    return tidy(forensics.base_rates(spark, report(spark, sf)))


# --- capital allocation ----------------------------------------------------------------------------------------------------------

_series = {"net_debt": "total_debt - cash", "leverage": "case when total_debt - cash > 0 and operating_income > 0 then (total_debt - cash) / operating_income end",
           "coverage": "operating_income / nullif(abs(interest_expense), 0)", "gp": "case when total_assets > 0 then gross_profit / total_assets end",
           "invested": "case when operating_income is not null then total_equity + total_debt - cash end", "nopat": "case when total_equity + total_debt - cash is not null then operating_income * (1 - "
           "case when income_tax_expense is not null and pretax_income > 0 then least(abs(income_tax_expense) / pretax_income, 0.5) else 0.24 end) end",
           "shares": "case when shares_diluted > 0 then shares_diluted end"}


def _rel(n, better_down, band=0.1):
    change = f"coalesce(({n}_new - {n}_old) / nullif(greatest(abs({n}_new), abs({n}_old)), 0), 0)"
    up, down = ("deteriorating", "improving") if better_down else ("improving", "deteriorating")
    return f"case when {n}_n > 1 then case when abs({change}) < {band} then 'flat' when {change} < 0 then '{down}' else '{up}' end end"


CAP = {**FORENSIC,
       "k_p": "select * from (select *, row_number() over (partition by ticker order by fiscal_year desc) as k from f_p) where k <= 5",
       "k_s": "select *, " + ", ".join(f"{v} as s_{k}" for k, v in _series.items()) + " from k_p",
       "k_r": "select ticker, any_value(sector) as sector, " + ", ".join(
           f"arg_max(s_{k}, fiscal_year) filter (where s_{k} is not null) as {k}_new, arg_min(s_{k}, fiscal_year) filter (where s_{k} is not null) as {k}_old, "
           f"max(fiscal_year) filter (where s_{k} is not null) as {k}_ny, min(fiscal_year) filter (where s_{k} is not null) as {k}_oy, count(s_{k}) as {k}_n" for k in _series)
       + ", max(fiscal_year) filter (where has_cash_flow) as fy from k_s group by ticker",
       "k_b": f"""select ticker, coalesce(sector = 'Financials', false) as suppressed, net_debt_new as net_debt, net_debt_old as net_debt_start, {_rel('net_debt', True)} as net_debt_trend, leverage_new as leverage,
              {_rel('leverage', True)} as leverage_trend, coverage_new as coverage, case when coverage_new > 0 and coverage_old > 0 then {_rel('coverage', False)} end as coverage_trend from k_r""",
       "k_g": """select ticker, gp_new as gross_profitability, case when gp_n > 1 then case when abs(gp_new - gp_old) < 0.005 then 'flat' when gp_new < gp_old then 'deteriorating' else 'improving' end end as gross_profitability_trend,
              case when invested_n > 1 and invested_old > 0 and invested_new - invested_old > 0.15 * invested_old then (nopat_new - nopat_old) / (invested_new - invested_old) end as incremental_return,
              case when invested_n > 1 then case when invested_old > 0 and invested_new - invested_old > 0.15 * invested_old then 'measured' else 'base-too-small' end end as incremental_status from k_r""",
       "k_f": """select r.*, fiscal_year as flow_year, coalesce(free_cash_flow, operating_cash_flow - abs(capex)) as fcf, abs(stock_buybacks) - abs(coalesce(stock_issuance, 0)) as nb, abs(dividends_paid) as dv,
              case when shares_n > 1 then pow(shares_new / shares_old, 1 / (shares_ny - shares_oy)::DOUBLE) - 1 end as rate from k_r r left join k_p p on p.ticker = r.ticker and p.fiscal_year = r.fy""",
       "k_d": """select *, case when coalesce(dv, nb) is not null then coalesce(dv, 0) + greatest(coalesce(nb, 0), 0) end as total from k_f""",
       "k_e": """select ticker, flow_year, nb as net_buybacks, dv as dividends, total as distributed, case when fcf > 0 then total / fcf end as share_of_fcf, total > fcf as beyond_fcf, rate as share_rate,
              case when abs(rate) < 0.005 then 'flat' when rate < 0 then 'improving' when rate >= 0 then 'deteriorating' end as share_trend from k_d"""}


def alloc(spark, sf):
    return capalloc.summary_rows(periods(spark, sf))


@query("capalloc_balance_sheet", f"""select ticker, suppressed, {', '.join(f'case when not suppressed then {rnd(c)} end as {c}' for c in ('net_debt', 'net_debt_start', 'leverage', 'coverage'))},
        {', '.join(f'case when not suppressed then {c} end as {c}' for c in ('net_debt_trend', 'leverage_trend', 'coverage_trend'))} from k_b""", CAP)
def capalloc_balance_sheet(spark, sf):
    return tidy(capalloc.balance_sheet(alloc(spark, sf)))


@query("capalloc_reinvestment", f"select ticker, {rnd('gross_profitability')} as gross_profitability, gross_profitability_trend, {rnd('incremental_return')} as incremental_return, incremental_status from k_g", CAP)
def capalloc_reinvestment(spark, sf):
    return tidy(capalloc.reinvestment(alloc(spark, sf)))


@query("capalloc_distributions", f"""select ticker, flow_year, {rnd('net_buybacks')} as net_buybacks, {rnd('dividends')} as dividends, {rnd('distributed')} as distributed,
        {rnd('share_of_fcf')} as share_of_fcf, beyond_fcf, {rnd('share_rate')} as share_rate, share_trend from k_e""", CAP)
def capalloc_distributions(spark, sf):
    return tidy(capalloc.distributions(alloc(spark, sf)))


@query("capalloc_summary", """select ticker, case when suppressed then 'suppressed' else net_debt_trend end as leverage_code, gross_profitability_trend as profitability_code,
        case when beyond_fcf then 'beyond-fcf' when not beyond_fcf then 'covered' end as distribution_code, case when share_trend <> 'flat' then share_trend end as share_code
        from k_b join k_g using (ticker) join k_e using (ticker)""", CAP)
def capalloc_summary(spark, sf):
    return capalloc.capalloc_summary(alloc(spark, sf))


# --- earnings and own history ----------------------------------------------------------------------------------------------------

VH = {
    "n_w": "select * from (select *, row_number() over (partition by ticker order by fiscal_year desc) as k from fx_valuation_history where net_income is not null) where k <= 10",
    "n_a": """select ticker, any_value(sector) as sector, any_value(market_cap) as cap, count(*) as years, avg(net_income) as me, arg_max(net_income, fiscal_year) as le, max(fiscal_year) - min(fiscal_year) + 1 as span,
              avg(net_income / revenue) filter (where revenue > 0) as mm, count(*) filter (where revenue > 0) as my, count_if(net_income < 0) as losses,
              (arg_max(shares_outstanding, fiscal_year) - arg_min(shares_outstanding, fiscal_year)) / arg_min(shares_outstanding, fiscal_year) as drift from n_w group by ticker""",
    "n_s": """select *, case when regexp_replace(lower(trim(sector)), '[\\s_-]+', ' ', 'g') in ('real estate', 'realestate', 'reit', 'reits') then 'not-applicable' when years < 7 then 'insufficient' else 'ok' end as status from n_a""",
    "m_w": """select ticker, sector, fiscal_year, market_cap, public_float / (case when net_income > 0 then net_income end) as float_pe, public_float / (case when revenue > 0 then revenue end) as float_ps,
              public_float / (case when total_equity > 0 then total_equity end) as float_pb,
              case when public_float + total_debt - cash > 0 and operating_income > 0 then (public_float + total_debt - cash) / operating_income end as float_ev_ebit from fx_valuation_history where public_float > 0""",
    "m_l": "select ticker, sector, fiscal_year, multiple, value from m_w unpivot include nulls (value for multiple in (float_pe, float_ps, float_pb, float_ev_ebit))",
    "m_k": "select * from m_l where not (multiple = 'float_ev_ebit' and coalesce(sector in ('Financials', 'Real Estate'), false))",
    "t_0": "select * from fx_valuation_history qualify row_number() over (partition by ticker order by fiscal_year desc) = 1",
    "t_f": "select *, market_cap * 0.9::DOUBLE as fv from t_0",
    "t_w": """select ticker, fv / (case when net_income > 0 then net_income end) as float_pe, fv / (case when revenue > 0 then revenue end) as float_ps, fv / (case when total_equity > 0 then total_equity end) as float_pb,
              case when fv + total_debt - cash > 0 and operating_income > 0 then (fv + total_debt - cash) / operating_income end as float_ev_ebit from t_f""",
    "t_l": "select ticker, multiple, today from t_w unpivot include nulls (today for multiple in (float_pe, float_ps, float_pb, float_ev_ebit))",
    "a_c": """select ticker, fiscal_year, public_float / fx_valuation_history.market_cap as ratio from fx_valuation_history join fx_companies c using (ticker) where (c.p_partkey + fiscal_year) % 3 = 0
              and (c.p_partkey + fiscal_year) % 21 <= 10 and public_float / fx_valuation_history.market_cap between 0.05 and 1.05""",
    "a_b": "select ticker, arg_max(ratio, fiscal_year) as ratio, max(fiscal_year) as anchor_year from a_c group by ticker",
    "b_t": """select t.*, a.ratio, a.anchor_year, c.p_partkey % 13 = 0 as is_float, case when c.p_partkey % 13 = 0 then t.market_cap else t.market_cap * a.ratio end as fv2
              from t_0 t left join a_b a using (ticker) join fx_companies c using (ticker)""",
    "b_w": """select ticker, fv2 / (case when net_income > 0 then net_income end) as float_pe, fv2 / (case when revenue > 0 then revenue end) as float_ps, fv2 / (case when total_equity > 0 then total_equity end) as float_pb,
              case when fv2 > 0 and fv2 + total_debt - cash > 0 and operating_income > 0 then (fv2 + total_debt - cash) / operating_income end as float_ev_ebit from b_t""",
    "b_l": "select ticker, multiple, today from b_w unpivot include nulls (today for multiple in (float_pe, float_ps, float_pb, float_ev_ebit))",
    "b_c": """select ticker, count(*) as distributions, count(*) filter (where today > 0) as percentiles from (select ticker, multiple from m_k where value > 0 group by ticker, multiple having count(*) >= 5) left join b_l using (ticker, multiple) group by ticker""",
}


def history(spark, sf):
    return bind(spark, sf, "fx_valuation_history")


@query("normalized_earnings", f"""select ticker, status, years, {', '.join("case when status = 'ok' then " + rnd(e) + f" end as {a}" for e, a in (('me', 'normalized_earnings'), ('le', 'latest_earnings')))},
        case when status = 'ok' and me > 0 and cap > 0 then {rnd('cap / me')} end as cape_ratio, case when status = 'ok' and me > 0 then {rnd('le / me')} end as earnings_vs_normalized,
        case when status = 'ok' and my >= 7 then {rnd('mm')} end as normalized_margin, case when status = 'ok' then span > years end as has_gaps, case when status = 'ok' then losses end as loss_years,
        case when status = 'ok' then abs(drift) >= 0.15 end as share_drift from n_s""", VH)
def normalized_earnings(spark, sf):
    return tidy(valuation.normalized_earnings(history(spark, sf)))


@query("own_history_multiples", f"select ticker, fiscal_year, multiple, {rnd('value')} as value from m_l", VH)
def own_history_multiples(spark, sf):
    return tidy(valuation.own_history_multiples(history(spark, sf)).drop("sector"))


@query("own_history_distribution", f"""select ticker, multiple, count(v) as n, {', '.join(rnd(f'case when count(v) >= 5 then quantile_cont(v, {p}) end') + f' as {a}' for a, p in
        (('q1', 0.25), ('median', 0.5), ('q3', 0.75), ('lowest', 0.0), ('highest', 1.0)))}, case when count(v) < 5 then 'too-few-years' end as reason
        from (select ticker, multiple, case when value > 0 then value end as v from m_k) group by ticker, multiple""", VH)
def own_history_distribution(spark, sf):
    return tidy(valuation.own_history_distribution(valuation.own_history_multiples(history(spark, sf))))


def today(spark, sf):
    return history(spark, sf).groupBy("ticker").agg(F.max_by(F.struct("sector", "market_cap", "net_income", "revenue", "total_equity", "operating_income", "total_debt", "cash"), "fiscal_year").alias("r")).select("ticker", "r.*")


@query("own_history_percentile", f"""select ticker, multiple, count(*) as n, case when count(*) >= 5 then {rnd('(count_if(value < today) + count_if(value = today) / 2) / count(*) * 100')} end as percentile
        from (select * from m_k where value > 0) join t_l using (ticker, multiple) where today > 0 group by ticker, multiple""", VH)
def own_history_percentile(spark, sf):
    t = today(spark, sf).withColumn("fv", F.col("market_cap") * 0.9)
    values_ = t.select("ticker", *[c.alias(k) for k, c in valuation._multiple_columns(F.col("fv")).items()]).unpivot(["ticker"], list(valuation.MULTIPLES), "multiple", "today_value")
    multiples = valuation.own_history_multiples(history(spark, sf)).filter(~valuation.ev_suppressed())
    return tidy(valuation.percentile_of_today(multiples, values_))


@query("own_history_basis", f"""select ticker, {rnd('coalesce(ratio, case when is_float then 1 end)')} as factor, anchor_year, {rnd('fv2')} as float_value, coalesce(distributions, 0) as distributions, coalesce(percentiles, 0) as percentiles,
        case when coalesce(distributions, 0) = 0 then 'insufficient' when percentiles = 0 then 'not-comparable' else 'ok' end as status from b_t left join b_c using (ticker)""", VH)
def own_history_basis(spark, sf):
    c = companies(spark, sf).select("ticker", "p_partkey")
    h = history(spark, sf)
    anchors = h.join(c, "ticker").filter((F.col("p_partkey") + F.col("fiscal_year")) % 3 == 0).select(
        "ticker", "fiscal_year", "float_as_of", F.date_add("float_as_of", ((F.col("p_partkey") + F.col("fiscal_year")) % 21).cast("int")).alias("market_cap_as_of"), "market_cap", "public_float")
    t = today(spark, sf).join(c, "ticker").withColumn("cap_is_float", F.col("p_partkey") % 13 == 0)
    return tidy(valuation.own_history_basis(h, t, anchors))


@query("win_discontinuity", f"""select ticker, fiscal_year, field, {rnd('change')} as change from (
        select ticker, fiscal_year, 'revenue' as field, (revenue - p) / abs(nullif(p, 0)) as change, (p > 0) <> (revenue > 0) as flip from (select *, lag(revenue) over w as p, fiscal_year - lag(fiscal_year) over w as s from fx_valuation_history window w as (partition by ticker order by fiscal_year)) where s = 1 and p <> 0
        union all select ticker, fiscal_year, 'total_equity', (total_equity - p) / abs(nullif(p, 0)), (p > 0) <> (total_equity > 0) from (select *, lag(total_equity) over w as p, fiscal_year - lag(fiscal_year) over w as s from fx_valuation_history window w as (partition by ticker order by fiscal_year)) where s = 1 and p <> 0)
        where flip or abs(change) > 0.6""")
def win_discontinuity(spark, sf):
    return tidy(valuation.discontinuities(history(spark, sf)))


# --- implied growth and scenarios ------------------------------------------------------------------------------------------------

FIT = """select ticker, sqrt(avg((v - exp(i + s * fiscal_year)) ** 2)) / avg(v) as cv from (select ticker, fiscal_year, v, regr_slope(ln(v), fiscal_year) over g as s, regr_intercept(ln(v), fiscal_year) over g as i, count(*) over g as n
         from {} where v > 0 window g as (partition by ticker)) where n >= 4 group by ticker"""
DCF = {
    "p_rev": "select ticker, fiscal_year, revenue / shares_diluted as v from fx_income where shares_diluted > 0",
    "p_fcf": "select ticker, fiscal_year, free_cash_flow / shares_diluted as v from fx_cash_flow join fx_income using (ticker, fiscal_year) where shares_diluted > 0",
    "p_a": "select ticker, cv as revenue_cv from (" + FIT.format("p_rev") + ")",
    "p_b": "select ticker, cv as fcf_cv from (" + FIT.format("p_fcf") + ")",
    "p_g": """select c.ticker, revenue_cv, fcf_cv, case when revenue_cv is null or fcf_cv is null then 'too-little-history' when revenue_cv > 0.25 or fcf_cv > 0.6 then 'too-erratic' end as reason
              from fx_companies c left join p_a using (ticker) left join p_b using (ticker)""",
    "i_f": "select ticker, max(free_cash_flow) filter (where k = 1) as f0, max(free_cash_flow) filter (where k = 2) as f1 from (select *, row_number() over (partition by ticker order by fiscal_year desc) as k from fx_cash_flow) group by ticker",
    "i_b": "select ticker, coalesce(total_debt, 0) - coalesce(cash, 0) as net_debt from fx_balance qualify row_number() over (partition by ticker order by fiscal_year desc) = 1",
    "i_t": """select c.ticker, c.sector, coalesce(abs(f0 - f1) / nullif(greatest(abs(f0), abs(f1)), 0) > 0.4 and f0 is not null and f1 is not null, false) as smooth, f.f0, f.f1, f.ticker is not null as has_f, net_debt, share_price, shares_outstanding
              from fx_companies c left join i_f f using (ticker) left join i_b using (ticker)""",
    "i_r": """select t.ticker, case when smooth then (f0 + f1) / 2 else f0 end as trailing_fcf, case when smooth then 'two-year-average' when f0 is not null then 'latest' end as fcf_basis, net_debt, share_price * shares_outstanding + net_debt as ev,
              case when sector in ('Financials', 'Real Estate') then 'sector' when not has_f or t.ticker not in (select ticker from fx_income) then 'no-statements' when net_debt is null then 'no-balance-sheet'
                   when (case when smooth then (f0 + f1) / 2 else f0 end) is null then 'no-cash-flow' when (case when smooth then (f0 + f1) / 2 else f0 end) <= 0 then 'negative-cash-flow' else g.reason end as reason
              from i_t t join p_g g using (ticker)""",
    "g_t": """select rate, growth, t, product(1 + growth + (0.025::DOUBLE - growth) * ((t - 1) / 9::DOUBLE)) over (partition by rate, growth order by t) as fcf
              from (select -0.5::DOUBLE + i * 0.001::DOUBLE as growth from range(1101) r(i)), (values (0.08::DOUBLE), (0.1::DOUBLE), (0.12::DOUBLE)) v(rate), range(1, 11) tt(t)""",
    "g_m": "select rate, growth, sum(fcf / pow(1 + rate, t)) + max(fcf) filter (where t = 10) * 1.025::DOUBLE / (rate - 0.025::DOUBLE) / pow(1 + rate, 10) as mult from g_t group by rate, growth",
    "g_b": "select rate, growth, mult as lo, lead(mult) over (partition by rate order by growth) as hi, row_number() over (partition by rate order by growth) as k from g_m",
    "g_x": "select ticker, rate, ev / trailing_fcf as x from i_r, (values (0.08::DOUBLE), (0.1::DOUBLE), (0.12::DOUBLE)) v(rate) where reason is null",
}


def three(spark, sf):
    return bind(spark, sf, "fx_income"), bind(spark, sf, "fx_balance"), bind(spark, sf, "fx_cash_flow")


@query("predictability_gate", f"select ticker, {rnd('revenue_cv')} as revenue_cv, {rnd('fcf_cv')} as fcf_cv, reason, reason is null as predictable from p_g", DCF)
def predictability_gate(spark, sf):
    i, _, c = three(spark, sf)
    return tidy(valuation.predictability(companies(spark, sf), i, c))


def dcf_inputs(spark, sf):
    return valuation.reverse_dcf_inputs(companies(spark, sf), *three(spark, sf))


@query("reverse_dcf_inputs", f"select ticker, {rnd('trailing_fcf')} as trailing_fcf, fcf_basis, {rnd('net_debt')} as net_debt, {rnd('ev')} as enterprise_value, reason from i_r", DCF)
def reverse_dcf_inputs(spark, sf):
    return tidy(dcf_inputs(spark, sf))


@query("reverse_dcf_grid", f"""select ticker, x.rate, {rnd('growth + 0.001::DOUBLE * (x - lo) / (hi - lo)')} as implied_growth from g_x x left join g_b b on b.rate = x.rate and hi is not null and x >= lo and (x < hi or (k = 1100 and x = hi))""", DCF)
def reverse_dcf_grid(spark, sf):
    return tidy(valuation.reverse_dcf_grid(dcf_inputs(spark, sf)))


REALIZED = {"rg": """select ticker, list(revenue order by fiscal_year desc) as r from fx_income group by ticker""", "rf": "select ticker, list(free_cash_flow order by fiscal_year desc) as f from fx_cash_flow group by ticker",
            "rj": "select ticker, r, coalesce(f, []) as f, least(len(r), len(coalesce(f, []))) - 1 as s from rg left join rf using (ticker)"}


def _cg(a, k, n):
    return f"case when {a}[{k}] > 0 and {a}[1] > 0 then pow({a}[1] / {a}[{k}], 1::DOUBLE / {n}) - 1 end"


@query("realized_growth", f"""select ticker, {rnd("case when len(r) > 3 then " + _cg('f', '4', '3') + " end")} as fcf_3y, {rnd("case when len(r) > 3 then " + _cg('r', '4', '3') + " end")} as revenue_3y,
        case when s >= 1 then s end as full_span, {rnd("case when s >= 1 then " + _cg('f', '(s + 1)', 's') + " end")} as fcf_full, {rnd("case when s >= 1 then " + _cg('r', '(s + 1)', 's') + " end")} as revenue_full from rj""", REALIZED)
def realized_growth(spark, sf):
    i, _, c = three(spark, sf)
    return tidy(valuation.realized_growth(i, c))


TAXS = "case when income_tax_expense is not null and pretax_income > 0 then greatest(least(income_tax_expense / pretax_income, 0.5), 0) else 0.24::DOUBLE end"


@query("growth_roic_series", f"""select ticker, fiscal_year, {rnd("case when fiscal_year - py = 1 and pr > 0 then revenue / pr - 1 end")} as revenue_growth, {rnd(f"case when guard is null then operating_income * (1 - {TAXS}) / ic end")} as roic,
        {rnd('ic')} as invested_capital, guard from (select *, case when ic is null then 'insufficient-data' when ic <= 0 or ic <= coalesce(total_assets * 0.1, 0) then 'reinvestment-base-too-small' end as guard
        from (select i.*, b.total_assets, b.total_equity + coalesce(b.total_debt, 0) - coalesce(b.cash, 0) as ic, lag(i.revenue) over w as pr, lag(i.fiscal_year) over w as py from fx_income i left join fx_balance b using (ticker, fiscal_year)
              window w as (partition by i.ticker order by i.fiscal_year)))""")
def growth_roic_series(spark, sf):
    i, b, _ = three(spark, sf)
    return tidy(scenario.growth_roic_series(i, b))


SCEN = {
    "s_r": f"""select i.*, case when revenue > 0 then operating_income / revenue end as mg, case when fiscal_year - lag(fiscal_year) over w = 1 and lag(revenue) over w > 0 then revenue / lag(revenue) over w - 1 end as gr,
               case when net_income > 0 then free_cash_flow / net_income end as cv, {TAXS} as tax from fx_income i left join (select ticker, fiscal_year, free_cash_flow from fx_cash_flow) c using (ticker, fiscal_year) window w as (partition by ticker order by fiscal_year)""",
    "s_a": """select ticker, coalesce(median(gr), 0.05) as growth_median, coalesce(min(gr), 0) as growth_low, coalesce(max(gr), 0.1) as growth_high, count(gr) as growth_observations,
              coalesce(median(mg), 0.1) as margin_median, coalesce(min(mg), 0.05) as margin_low, coalesce(max(mg), 0.15) as margin_high, count(mg) as margin_observations, median(cv) as cash_conversion,
              arg_max(net_income, fiscal_year) as ni, arg_max(revenue, fiscal_year) as rb, arg_max(tax, fiscal_year) as tax from s_r group by ticker""",
    "s_b": "select a.*, c.share_price, c.shares_outstanding as shares, floor(greatest(least(coalesce(case when ni > 0 then share_price * shares_outstanding / ni end, 15), 25), 8) * 2 + 0.5) / 2 as exit_pe from s_a a left join fx_companies c using (ticker)",
    "s_base": "select *, greatest(least(growth_median, 0.3), -0.1) as g, greatest(least(margin_median, 0.5), 0) as m, greatest(least(exit_pe, 40), 5) as e from s_b",
    "s_c": """select s.*, scenario, case when sg = 0 then g else greatest(least(g + sg * (growth_high - growth_low) / 2, 0.3), -0.1) end as gg, case when sg = 0 then m else greatest(least(m + sg * (margin_high - margin_low) / 2, 0.5), 0) end as mm,
              case when sg = 0 then e else greatest(least(e * (1 + sg * 0.3::DOUBLE), 40), 5) end as ee from s_base s, (values ('bull', 1), ('base', 0), ('bear', -1)) v(scenario, sg)""",
}


def bands(spark, sf):
    i, _, c = three(spark, sf)
    return scenario.scenario_bands(i, c, companies(spark, sf).select("ticker", "share_price", "shares_outstanding"))


_bc = ["growth_median", "growth_low", "growth_high", "margin_median", "margin_low", "margin_high", "exit_pe", "cash_conversion"]


@query("scenario_bands", f"select ticker, {', '.join(f'{rnd(c)} as {c}' for c in _bc)}, growth_observations, margin_observations from s_b", SCEN)
def scenario_bands(spark, sf):
    return tidy(bands(spark, sf).select("ticker", *_bc, "growth_observations", "margin_observations"))


def _px(g, m, e):
    return f"(rb * pow(1 + {g}, 5) * {m} * (1 - greatest(least(tax, 0.5), 0)) / shares * {e})"


def _ret(g, m, e):
    return f"(case when {g} > -1 and {m} >= 0 and {e} > 0 and rb > 0 then pow({_px(g, m, e)} / share_price, 1::DOUBLE / 5) - 1 end)"


@query("scenario_sweep", f"""select ticker, scenario, {rnd('gg')} as growth, {rnd('mm')} as margin, {rnd('ee')} as exit_multiple, {rnd(_px('gg', 'mm', 'ee'))} as implied_price, {rnd(_ret('gg', 'mm', 'ee'))} as annualized_return,
        null::VARCHAR as reason from s_c""", SCEN)
def scenario_sweep(spark, sf):
    return tidy(scenario.scenario_sweep(bands(spark, sf)))


SPREADS = {"growth_spread": (("growth_low", "m", "e"), ("growth_high", "m", "e")), "margin_spread": (("g", "margin_low", "e"), ("g", "margin_high", "e")),
           "exit_pe_spread": (("g", "m", "(e * (1 - 0.3::DOUBLE))"), ("g", "m", "(e * (1 + 0.3::DOUBLE))"))}


@query("scenario_driver", f"""select ticker, {', '.join(f'{rnd(k)} as {k}' for k in SPREADS)}, case greatest(growth_spread, margin_spread, exit_pe_spread) when growth_spread then 'growth' when margin_spread then 'margin' when exit_pe_spread then 'exit_pe' end as driver
        from (select ticker, {', '.join(f'abs({_ret(*hi)} - {_ret(*lo)}) as {k}' for k, (lo, hi) in SPREADS.items())} from s_base)""", SCEN)
def scenario_driver(spark, sf):
    return tidy(scenario.scenario_driver(bands(spark, sf)))


# --- strategies ------------------------------------------------------------------------------------------------------------------


def _strategy_sql():
    parts = []
    for key, name, rules, needed in dims.STRATEGIES:
        conds = [f"({m} > 0 and {m} < {t}::DOUBLE)" if op == "between" else f"({m} {op} {t!r}::DOUBLE)" for m, op, t in rules]
        passed = " + ".join(f"coalesce({c}::INT, 0)" for c in conds)
        gaps = " + ".join(f"({c} is null)::INT" for c in conds)
        parts.append(f"select ticker, {quote(key)} as strategy, {quote(name)} as name, {passed} as passed, {len(rules)} - ({gaps}) as total, {gaps} as not_computable, {needed} as needed "
                     "from (select w.*, c.market_cap * 1000 as market_cap from o_wide w join fx_companies c using (ticker) where year_index = 0)")
    return " union all ".join(parts)


STRAT = {"st": _strategy_sql(), "sq": "select *, case when passed >= needed then true when passed + not_computable < needed then false end as qualifies from st"}


def evaluated(spark, sf):
    caps = companies(spark, sf).select("ticker", (F.col("market_cap") * 1000).alias("market_cap"))
    return strategies.strategy_eval(wide_panel(spark, sf).filter("year_index = 0").join(caps, "ticker"))


@query("strategy_eval", "select ticker, strategy, passed, total, not_computable, qualifies from sq", STRAT)
def strategy_eval(spark, sf):
    return tidy(evaluated(spark, sf).drop("name"))


@query("strategy_order", "select ticker, strategy, row_number() over (partition by ticker order by passed desc, not_computable, name) as place from sq", STRAT)
def strategy_order(spark, sf):
    return tidy(strategies.strategy_order(evaluated(spark, sf)).select("ticker", "strategy", "place"))


# --- statements ------------------------------------------------------------------------------------------------------------------


STATEMENTS = (("income", "fx_income", statements.INCOME_ROWS), ("balance", "fx_balance", statements.BALANCE_ROWS), ("cash_flow", "fx_cash_flow", statements.CASH_FLOW_ROWS))


def _rows_sql():
    out, parts = {}, []
    for name, source, config in STATEMENTS:
        cfg, p = [(line, i, indent) for i, (line, indent, _) in enumerate(config)], f"w_{name}"
        out[f"{p}_cfg"] = values(cfg, "line, line_no, indent")
        out[f"{p}_u"] = (f"select * from (select ticker, fiscal_year, {', '.join(f'{c[0]}::DOUBLE as {c[0]}' for c in cfg)} from {source}) "
                         f"unpivot include nulls (value for line in ({', '.join(c[0] for c in cfg)}))")
        twins = [(line, twin) for line, _, twin in config if twin]
        out[f"{p}_e"] = f"select ticker, {', '.join(f'bool_or({a} is distinct from {b}) as own_{a}' for a, b in twins) or '1'} from {source} group by ticker"
        own = " and ".join(["c > 0", *(f"(line <> '{a}' or own_{a})" for a, _ in twins)])
        parts.append(f"select '{name}' as statement, ticker, fiscal_year, line, line_no, indent, value from (select *, count(value) over (partition by ticker, line) as c from {p}_u) join {p}_e using (ticker) join {p}_cfg using (line) where {own}")
    return {**out, "w_r": " union all ".join(parts)}


ROWS = _rows_sql()


def each_statement(spark, sf, view=lambda rows: rows, aged=False):
    """A view of each of the three statements, one under the other."""
    out = None
    for name, source, config in STATEMENTS:
        part = view(statements.statement_rows(bind(spark, sf, source), config, aged)).withColumn("statement", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@query("stmt_rows", f"select statement, ticker, fiscal_year, line, line_no, indent, {rnd('value')} as value from w_r", ROWS)
def stmt_rows(spark, sf):
    return each_statement(spark, sf)


@query("stmt_groups", """select statement, ticker, line, line_no, indent, last_value(case when indent = 0 then line end ignore nulls) over (partition by statement, ticker order by line_no) as parent
        from (select distinct statement, ticker, line, line_no, indent from w_r)""", ROWS)
def stmt_groups(spark, sf):
    return each_statement(spark, sf, statements.statement_groups)


NN = {**ROWS, "w_n": "select *, lead(value) over w as before, lead(fiscal_year) over w as before_year, row_number() over w as k from w_r where value is not null window w as (partition by statement, ticker, line order by fiscal_year desc)"}


@query("stmt_yoy_latest", f"""select statement, ticker, line, before_year as from_year, fiscal_year as to_year, {rnd('(value - before) / abs(before)')} as change from w_n
        where k = 1 and before <> 0 and sign(value) = sign(before)""", NN)
def stmt_yoy_latest(spark, sf):
    return each_statement(spark, sf, statements.yoy_latest, aged=True)


@query("stmt_trend", """select statement, ticker, line, case when arg_max(value, fiscal_year) = arg_min(value, fiscal_year) then 'flat' when arg_max(value, fiscal_year) > arg_min(value, fiscal_year) then 'up' else 'down' end as trend
        from w_n group by statement, ticker, line having count(*) >= 2""", NN)
def stmt_trend(spark, sf):
    return each_statement(spark, sf, statements.trend)


@query("stmt_latest_filing", "select ticker, period_end, filed_at from (select * from fx_income qualify row_number() over (partition by ticker order by fiscal_year desc) = 1) where period_end is not null and filed_at is not null")
def stmt_latest_filing(spark, sf):
    return statements.latest_filing(bind(spark, sf, "fx_income"))


def _bridge_sql():
    out = ["select ticker, fiscal_year, 0 as step, 'Revenue' as name, 0::DOUBLE as base, revenue as value, true as is_subtotal, revenue as raw from fx_income where revenue is not null"]
    need = "revenue is not null"
    for i, (a, b, dn, n) in enumerate(statements.BRIDGE):
        need += f" and {b} is not null"
        out.append(f"select ticker, fiscal_year, {2 * i + 1}, {quote(dn)}, least({a}, {b}), abs({b} - {a}), false, {b} - {a} from fx_income where {need}")
        out.append(f"select ticker, fiscal_year, {2 * i + 2}, {quote(n)}, 0, {b}, true, {b} from fx_income where {need}")
    return " union all ".join(out)


@query("income_waterfall", f"select ticker, fiscal_year, step, name, {rnd('base')} as base, {rnd('value')} as value, is_subtotal, {rnd('raw')} as raw from ({_bridge_sql()})")
def income_waterfall(spark, sf):
    return tidy(statements.income_waterfall(bind(spark, sf, "fx_income")))


COMPARE = ["P00000001", "P00000002", "P00000005"]


@query("company_compare", "select measure, " + ", ".join(f"max(v) filter (where ticker = '{t}') as {t}" for t in COMPARE) + f""" from (select ticker, category as measure, {rnd('score')} as v from o_rank_cat
        union all select ticker, measure, {rnd('v')} from (select ticker, pe_ttm, ev_ebitda, dividend_yield, roic, fcf_yield, growth_revenue_1y from o_wide where year_index = 0)
        unpivot include nulls (v for measure in (pe_ttm, ev_ebitda, dividend_yield, roic, fcf_yield, growth_revenue_1y))) where ticker in ({', '.join(quote(t) for t in COMPARE)}) group by measure""")
def company_compare(spark, sf):
    from balancebeam.operators.rollup import headline_metrics

    # the panel feeds the ranking, which reads it more than once, and the headline figures: written once
    wide = stored(wide_panel(spark, sf))
    return tidy(statements.company_compare(category_scores(spark, sf, wide), headline_metrics(wide), COMPARE))


@query("company_scale", f"""select y.ticker, y.fiscal_year, {rnd('revenue')} as revenue, {rnd('net_income')} as net_income, {rnd('free_cash_flow')} as free_cash_flow, {rnd('total_assets')} as total_assets, {rnd('c.market_cap')} as market_cap
        from (select ticker, max(fiscal_year) as fiscal_year from fx_income group by ticker) y left join fx_income i using (ticker, fiscal_year) left join fx_balance b using (ticker, fiscal_year)
        left join fx_cash_flow f using (ticker, fiscal_year) left join fx_companies c on c.ticker = y.ticker""")
def company_scale(spark, sf):
    return tidy(statements.company_scale(*three(spark, sf), companies(spark, sf)))
