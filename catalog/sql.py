"""Check SQL: reusable CTEs over the bindings, and helpers to assemble one statement per query."""

from __future__ import annotations

import re

from balancebeam.functions import dims
from balancebeam.metrics.registry import CATEGORIES, CATEGORY_WEIGHTS, YEAR_WEIGHTS, metrics
from balancebeam.operators.sector import rule_rows
from balancebeam.plans.bindings import BINDINGS


def quote(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, cols: str) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(quote(v) for v in r) + ')' for r in rows)}) v({cols})"


def rnd(expr: str, digits: int = 6) -> str:
    # the same arithmetic on both sides, so equal doubles stay equal after rounding
    return f"(floor(({expr}) * 1e{digits} + 0.5::DOUBLE) / 1e{digits})"


def cagr(end: str, start: str, n: int) -> str:
    if n == 1:
        return f"case when {start} > 0 then {end} / {start} - 1 end"
    return f"case when {start} > 0 and {end} >= 0 then pow({end} / {start}, 1.0::DOUBLE / {n}) - 1 end"


def div(n: str, d: str) -> str:
    return f"(({n}) / nullif({d}, 0))"


def pos(n: str, d: str) -> str:
    return f"(case when ({d}) > 0 then ({n}) / ({d}) end)"


SHY = "(abs(coalesce(dividends_paid,0)) + abs(coalesce(stock_buybacks,0)) - abs(coalesce(stock_issuance,0)))"
CYCLE = "(case when cycle_years >= 7 then cycle_mean end)"
METRIC_SQL = {
    "ev_fcf": div("ev", "free_cash_flow"), "ev_ebit": div("ev", "ebit"), "ev_ebitda": div("ev", "ebitda"),
    "pe_ttm": div("market_cap", "net_income"), "pb": div("market_cap", "total_equity"), "ps": div("market_cap", "revenue"),
    "price_tangible_book": div("market_cap", "tangible_book"), "earnings_yield": div("ebit", "ev"),
    "fcf_yield": div("free_cash_flow", "market_cap"), "shareholder_yield_valuation": div(SHY, "market_cap"),
    "ffo_yield": pos("net_income + depreciation_amortization", "market_cap"),
    "cape_ratio": f"(case when market_cap > 0 then {pos('market_cap', CYCLE)} end)",
    "earnings_vs_normalized": f"(case when cycle_latest >= 0 then {pos('cycle_latest', CYCLE)} end)",
    "price_to_ffo": f"(case when market_cap > 0 then {pos('market_cap', 'net_income + depreciation_amortization')} end)",
    "momentum_12m1m": "return_12m1m", "momentum_risk_adj_3m": "risk_adjusted_3m", "momentum_risk_adj_6m": "risk_adjusted_6m",
    "roic": "roic", "roe": div("net_income", "total_equity"), "roa": "roa", "gross_margin": "gross_margin",
    "operating_margin": "operating_margin", "net_margin": div("net_income", "revenue"), "fcf_margin": div("free_cash_flow", "revenue"),
    "gross_profitability": div("gross_profit", "total_assets"), "ocf_margin": div("operating_cash_flow", "revenue"),
    "fcf_to_revenue": div("free_cash_flow", "revenue"), "fcf_to_net_income": div("free_cash_flow", "net_income"),
    "cash_conversion_ratio": div("operating_cash_flow", "net_income"), "cash_to_market_cap": div("cash", "market_cap"),
    "net_cash_to_market_cap": div("cash - total_debt", "market_cap"), "debt_to_equity": div("total_debt", "total_equity"),
    "current_ratio": "current_ratio",
    "quick_ratio": div("total_current_assets - coalesce(inventory,0)", "total_current_liabilities"),
    "interest_coverage": div("ebit", "abs(interest_expense)"), "debt_to_ebitda": div("total_debt", "ebitda"),
    "debt_maturity_mix": div("long_term_debt", "total_debt"), "dividend_yield": div("abs(dividends_paid)", "market_cap"),
    "dividend_cagr_3y": f"(case when dividends_paid <> 0 then {cagr('abs(dividends_paid)', 'abs(lead(dividends_paid,3) over w)', 3)} end)",
    "buyback_yield": div("abs(stock_buybacks)", "market_cap"), "shareholder_yield_capalloc": div(SHY, "market_cap"),
    "share_count_change": div("shares_diluted - lead(shares_diluted) over w", "lead(shares_diluted) over w"),
    "capex_to_revenue": div("abs(capex)", "revenue"), "asset_turnover": "asset_turnover",
    "inventory_turnover": div("cost_of_revenue", "inventory"), "receivable_turnover": div("revenue", "receivables"),
    "cash_conversion_cycle": f"365 * ({div('inventory', 'cost_of_revenue')} + {div('receivables', 'revenue')} - {div('accounts_payable', 'cost_of_revenue')})",
    "accrual_ratio": div("net_income - operating_cash_flow", "total_assets"),
    "fcf_exceeds_net_income": "(case when free_cash_flow > net_income then 1.0::DOUBLE when free_cash_flow <= net_income then 0.0::DOUBLE end)",
    "gross_margin_stability": f"1 / (1 + {div('stddev_samp(gross_margin) over o', 'abs(avg(gross_margin) over o)')})",
    "operating_margin_stability": f"1 / (1 + {div('stddev_samp(operating_margin) over o', 'abs(avg(operating_margin) over o)')})",
    "revenue_volatility": div("stddev_samp(revenue) over o", "abs(avg(revenue) over o)"),
    "eps_volatility": div("stddev_samp(eps) over o", "abs(avg(eps) over o)"),
    "asset_growth": pos("total_assets - lead(total_assets) over w", "lead(total_assets) over w"),
    "net_operating_assets": pos("total_equity + total_debt - cash", "lead(total_assets) over w"),
    "sbc_to_revenue": pos("stock_compensation", "revenue"), "sbc_to_fcf": pos("stock_compensation", "free_cash_flow"),
    "avg_roic_5y": "avg(roic) over f", "avg_gross_margin_5y": "avg(gross_margin) over f", "avg_operating_margin_5y": "avg(operating_margin) over f",
    "rnd_to_revenue": div("research_and_development", "revenue"),
    "intangible_assets_pct": f"case when coalesce(intangibles, goodwill) is not null then {div('coalesce(intangibles,0) + coalesce(goodwill,0)', 'total_assets')} end",
}
_checks = ["roa > 0", "operating_cash_flow > 0", "roa > lead(roa) over w", "operating_cash_flow > net_income", "lt_leverage < lead(lt_leverage) over w",
           "current_ratio > lead(current_ratio) over w", "shares_diluted <= lead(shares_diluted) over w", "gross_margin > lead(gross_margin) over w",
           "asset_turnover > lead(asset_turnover) over w"]
METRIC_SQL["piotroski_f_score"] = (
    "case when lead(ticker) over w is not null and " + " + ".join(f"(case when ({c}) is null then 0 else 1 end)" for c in _checks)
    + " >= 6 then (" + " + ".join(f"(case when {c} then 1 else 0 end)" for c in _checks) + ")::DOUBLE end")
for _item, _line in (("revenue", "revenue"), ("netIncome", "net_income"), ("eps", "eps"), ("operatingCashFlow", "operating_cash_flow"),
                     ("freeCashFlow", "free_cash_flow"), ("bookValue", "total_equity")):
    for _n in (1, 3, 5):
        METRIC_SQL[f"growth_{_item}_{_n}y"] = cagr(_line, f"lead({_line},{_n}) over w", _n)


def metric_select() -> str:
    return ", ".join(f"{METRIC_SQL[m.key]} as {m.key}" for m in metrics())


CANON = ("case when regexp_replace(lower(trim(sector)), '[\\s_-]+', ' ', 'g') in (" +
         ",".join(quote(a) for a, t in dims.SECTOR_ALIASES.items() if t == "Financials") + ") then 'Financials' " +
         "when regexp_replace(lower(trim(sector)), '[\\s_-]+', ' ', 'g') in (" +
         ",".join(quote(a) for a, t in dims.SECTOR_ALIASES.items() if t == "Real Estate") + ") then 'Real Estate' end")

CTES: dict[str, str] = {
    "d_metrics": values([(i, m.key, m.category, m.direction, m.verdict, m.default_weight, m.negative_is_bad, m.sector_relative, m.enabled)
                         for i, m in enumerate(metrics())],
                        "m, metric_key, category, direction, verdict, default_weight, negative_is_bad, sector_relative, enabled"),
    "d_rules": values(rule_rows(), "metric_key, kind, canon, reason"),
    "d_years": values(list(enumerate(YEAR_WEIGHTS)), "year_index, yw"),
    "d_categories": values([(i, c, CATEGORY_WEIGHTS[c]) for i, c in enumerate(CATEGORIES)], "ord, category, cw"),
    "d_sectors": values(list(enumerate(dims.SECTORS)), "ord, sector"),
    "o_daily": "select *, row_number() over (partition by entity order by date) as rn, count(*) over (partition by entity) as n, "
               "max(date) over (partition by entity) as latest, min(date) over (partition by entity) as earliest from fx_daily_prices",
    "o_smooth": """select entity, latest, earliest,
           coalesce((select avg(close) from (select close from o_daily p where p.entity = e.entity and p.date <= e.latest - 3 order by p.date desc limit 5)),
                    (select close from o_daily p where p.entity = e.entity and rn = 1)) as recent,
           coalesce((select avg(close) from (select close from o_daily p where p.entity = e.entity and p.date <= e.latest - 20 order by p.date desc limit 5)),
                    (select close from o_daily p where p.entity = e.entity and rn = 1)) as base
         from (select distinct entity, latest, earliest from o_daily) e""",
    "o_risk": """select entity, days, count(*) as n, avg(close) filter (where a <= 5) as first5, avg(close) filter (where z <= 5) as last5,
           stddev_samp(case when prev > 0 then close / prev - 1 end) as sd
         from (select *, row_number() over (partition by entity, days order by date) as a, row_number() over (partition by entity, days order by date desc) as z,
                      lag(close) over (partition by entity, days order by date) as prev
               from o_daily, (values (10), (20)) v(days) where date >= latest - days) group by entity, days""",
    "o_momentum": """select s.entity, case when latest - earliest >= 20 and base > 0 then recent / base - 1 end as return_12m1m,
           case when a.n >= 8 and a.first5 > 0 and a.sd > 0 then (a.last5 / a.first5 - 1) / a.sd end as risk_adjusted_3m,
           case when b.n >= 8 and b.first5 > 0 and b.sd > 0 then (b.last5 / b.first5 - 1) / b.sd end as risk_adjusted_6m, latest as as_of
         from o_smooth s left join o_risk a on a.entity = s.entity and a.days = 10 left join o_risk b on b.entity = s.entity and b.days = 20""",
    "o_cycle": """select ticker, fiscal_year, len(l) as cycle_years, l[1] as cycle_latest, list_sum(l) / nullif(len(l), 0) as cycle_mean
         from (select p.ticker, p.fiscal_year, (list(h.net_income order by h.fiscal_year desc) filter (where h.net_income is not null))[1:10] as l
               from fx_panel p left join fx_earnings_history h on h.ticker = p.ticker and h.fiscal_year <= p.fiscal_year group by p.ticker, p.fiscal_year)""",
    "o_series": """select p.*, cycle_years, cycle_latest, cycle_mean, row_number() over (partition by p.ticker order by p.fiscal_year desc) - 1 as year_index,
           coalesce(eps_diluted, eps_basic) as eps, gross_profit / nullif(revenue, 0) as gross_margin, operating_income / nullif(revenue, 0) as operating_margin,
           net_income / nullif(total_assets, 0) as roa, total_current_assets / nullif(total_current_liabilities, 0) as current_ratio,
           revenue / nullif(total_assets, 0) as asset_turnover, long_term_debt / nullif(total_assets, 0) as lt_leverage,
           ebit * (1 - case when income_tax_expense / nullif(pretax_income, 0) between 0 and 1 then income_tax_expense / nullif(pretax_income, 0) else 0.21::DOUBLE end)
             / nullif(total_equity + total_debt - coalesce(cash, 0), 0) as roic
         from fx_panel p join (select ticker, fiscal_year from (select ticker, fiscal_year, row_number() over (partition by ticker order by fiscal_year desc) as k from fx_income) where k <= 6) using (ticker, fiscal_year)
           join (select ticker, fiscal_year from (select ticker, fiscal_year, row_number() over (partition by ticker order by fiscal_year desc) as k from fx_balance) where k <= 6) using (ticker, fiscal_year)
           join (select ticker, fiscal_year from (select ticker, fiscal_year, row_number() over (partition by ticker order by fiscal_year desc) as k from fx_cash_flow) where k <= 6) using (ticker, fiscal_year)
           join o_cycle using (ticker, fiscal_year)""",
    "o_wide_all": f"""select ticker, sector, period_key, fiscal_year, year_index, {metric_select()}
         from (select s.*, mo.return_12m1m, mo.risk_adjusted_3m, mo.risk_adjusted_6m,
                      coalesce(snapshot_ev, market_cap + coalesce(first(total_debt) over (partition by ticker order by fiscal_year desc), 0)
                                 - coalesce(first(cash) over (partition by ticker order by fiscal_year desc), 0)) as ev
               from o_series s left join o_momentum mo on mo.entity = s.p_partkey)
         window w as (partition by ticker order by fiscal_year desc),
                o as (partition by ticker order by fiscal_year desc rows between current row and unbounded following),
                f as (partition by ticker order by fiscal_year desc rows between current row and 4 following)""",
    "o_wide": "select * from o_wide_all where year_index <= 4",
    "o_long": "select ticker, sector, period_key, year_index, metric_key, case when isfinite(v) then v end as v "
              "from o_wide unpivot include nulls (v for metric_key in (" + ", ".join(m.key for m in metrics()) + "))",
    "o_gated": f"""select l.*, {CANON} as canon, m.m, m.category, m.direction, m.negative_is_bad, m.sector_relative,
           case when exists (select 1 from d_rules r where r.metric_key = l.metric_key and r.kind = 'only')
                then not coalesce(canon = 'Real Estate', false)
                else exists (select 1 from d_rules r where r.metric_key = l.metric_key and r.kind = 'excluded' and r.canon = ({CANON})) end as inapplicable
         from o_long l join d_metrics m using (metric_key)""",
}


def xs_ctes(prefix: str, source: str, method: str, lo: float, hi: float, by: str = "") -> dict[str, str]:
    """Unit scores for one configuration. ``source`` has (by, ticker, sector, year_index, m, v, direction, negative_is_bad, sector_relative)."""
    b = f"{by}, " if by else ""
    grp = f"{b}m, year_index, peer"
    score = {
        "percentile": "case when ns = 1 then 1.0::DOUBLE else (rw - 1) / (ns - 1)::DOUBLE end",
        "zscore": "1 / (1 + exp(-(case when wmax - wmin <= 1e-12::DOUBLE * greatest(abs(wmin), abs(wmax)) then 0.0::DOUBLE else (wv - mu) / sd end)))",
    }[method]
    rank = {
        "percentile": "(case when low then np else 0 end) + (case when rising then ns - rw + 1 else rw end)",
        "zscore": f"row_number() over (partition by {grp} order by floor(score * 1e9 + 0.5::DOUBLE) desc, ticker)",
    }[method]
    return {
        f"{prefix}_g": f"""select {b}ticker, m, year_index, v, case when sector_relative then coalesce(sector, '~') else '' end as peer,
              direction = 'asc' as flip, negative_is_bad as neg from {source} where v is not null""",
        f"{prefix}_n": f"select *, count(*) over (partition by {grp}) as n, count(*) filter (where v > 0) over (partition by {grp}) as np from {prefix}_g",
        f"{prefix}_s": f"select *, neg and np > 0 and np < n as split, neg and np > 0 and np < n and v <= 0 as low from {prefix}_n where n >= 2",
        f"{prefix}_r": f"""select *, count(*) over (partition by {grp}, low) as ns,
              row_number() over (partition by {grp}, low order by v) as rv from {prefix}_s""",
        f"{prefix}_b": f"""select *, max(case when rv = floor({lo!r}::DOUBLE * (ns - 1)) + 1 then v end) over (partition by {grp}, low) as lb,
              max(case when rv = ceil({hi!r}::DOUBLE * (ns - 1)) + 1 then v end) over (partition by {grp}, low) as ub from {prefix}_r""",
        f"{prefix}_w": f"select *, least(greatest(v, lb), ub) as wv, case when low or (neg and np = 0) then true else not flip end as rising from {prefix}_b",
        f"{prefix}_p": f"""select *, row_number() over (partition by {grp}, low order by wv, ticker) as rw, avg(wv) over (partition by {grp}, low) as mu,
              stddev_pop(wv) over (partition by {grp}, low) as sd, min(wv) over (partition by {grp}, low) as wmin, max(wv) over (partition by {grp}, low) as wmax
              from {prefix}_w""",
        f"{prefix}_u": f"select *, {score} as unit from {prefix}_p",
        f"{prefix}_d": f"""select *, case when low then unit * (0.5::DOUBLE - 1e-9::DOUBLE)
              when split then 0.5::DOUBLE + 0.5::DOUBLE * (case when rising then unit else 1 - unit end)
              when rising then unit else 1 - unit end as score from {prefix}_u""",
        prefix: f"select {b}ticker, m, year_index, score, ({rank})::BIGINT as peer_rank, n as peer_count, wv, peer from {prefix}_d",
    }


def rollup_ctes(prefix: str, scores: str, companies: str, weights: str, categories: str, years: int, registry: str = "d_metrics", by: str = "") -> dict[str, str]:
    """Roll-ups for one weighting. ``weights`` has (m, w); ``categories`` has (ord, category, cw)."""
    b = f"{by}, " if by else ""
    using = f"using ({b}ticker)"
    return {
        f"{prefix}_my": f"select {b}ticker, m, sum(yw * score) / sum(yw) as score from {scores} join d_years using (year_index) where year_index < {years} group by {b}ticker, m",
        f"{prefix}_grid": f"""select c.*, d.m, d.metric_key, d.category, {CANON} as canon,
              case when exists (select 1 from d_rules r where r.metric_key = d.metric_key and r.kind = 'only') then coalesce(({CANON}) = 'Real Estate', false)
                   else not exists (select 1 from d_rules r where r.metric_key = d.metric_key and r.kind = 'excluded' and r.canon = ({CANON})) end as fits
              from (select {b}ticker, sector from {companies}) c, {registry} d""",
        f"{prefix}_cat": f"""select g.{b.replace(', ', ', g.') if b else ''}ticker, g.category, sum(w * score) filter (where w > 0) / sum(w) filter (where w > 0 and score is not null) as score,
              count(*) filter (where fits and w > 0 and score is not null) as included,
              count(*) filter (where fits and not coalesce(w > 0 and score is not null, false)) as missing, count(*) filter (where not fits) as not_applicable
              from {prefix}_grid g join {weights} using (m) left join {prefix}_my s on s.m = g.m and s.ticker = g.ticker {f'and s.{by} = g.{by}' if by else ''}
              group by g.{b.replace(', ', ', g.') if b else ''}ticker, g.category""",
        f"{prefix}_all": f"""select {b}ticker, sum(cw * score) filter (where cw > 0) / sum(cw) filter (where cw > 0 and score is not null) * 100 as overall_score,
              (sum(included) filter (where cw > 0))::BIGINT as metrics_included, (sum(included + missing) filter (where cw > 0))::BIGINT as metrics_applicable
              from {prefix}_cat join {categories} using (category) group by {b}ticker""",
        f"{prefix}_cov": f"""select *, coalesce(metrics_included / nullif(metrics_applicable, 0)::DOUBLE, 0) as coverage_ratio,
              case when overall_score is not null then row_number() over ({f'partition by {by} ' if by else ''}order by round(overall_score, 9) desc nulls last, ticker) end as overall_rank,
              count(*) over ({f'partition by {by}' if by else ''}) as peer_count from {prefix}_all""",
        prefix: f"""select *, case when coverage_ratio >= 0.7 then 'full' when coverage_ratio >= 0.4 then 'partial' else 'thin' end as coverage_tier from {prefix}_cov""",
    }


CTES.update(xs_ctes("o_unit", "(select * from o_gated where not inapplicable)", "percentile", 0.01, 0.99))
CTES["d_weights"] = "select m, default_weight as w from d_metrics"
CTES.update(rollup_ctes("o_rank", "o_unit", "fx_companies", "d_weights", "d_categories", 5))


def with_ctes(select: str, extra: dict[str, str] | None = None) -> str:
    """The statement with every CTE and binding it needs, dependencies first."""
    known = {**BINDINGS, **CTES, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z]\w*", sql):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(select)
    body = ",\n".join(f"{n} as ({known[n]})" for n in order)
    return (f"with {body}\n{select}" if order else select).replace("STRUCT_OF", "row")
