"""Bindings of the provided star-schema tables to the shapes the operators read.

Every binding is one SELECT that both Spark SQL and an ANSI engine accept, so the checks can run on identical inputs.
Amounts are summed as whole hundredths of a cent and cast to DOUBLE once, which keeps every derived figure independent of partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

BINDINGS: dict[str, str] = {
    "fx_companies": """
        select 'P' || lpad(cast(p_partkey as string), 8, '0') as ticker,
               p_name as company_name,
               cast(case when p_partkey % 10 = 9 then p_partkey - 1 else p_partkey end as bigint) as cik,
               case p_type when 'ECONOMY' then 'Financials' when 'LARGE' then 'Real Estate' when 'MEDIUM' then 'Technology'
                           when 'PROMO' then 'Financial Services' when 'SMALL' then 'Energy' end as sector,
               p_brand as industry, n_name as country, p_partkey, p_size, p_retailprice,
               p_retailprice as share_price, cast(5000 as double) as shares_outstanding,
               p_retailprice * 5000 as market_cap
        from part left join nation on n_nationkey = p_partkey % 25""",
    "fx_part_years": """
        select l_partkey, year(l_shipdate) as fiscal_year,
               cast(sum(cast(l_quantity as bigint)) as double) as qty,
               cast(max(l_quantity) as int) as max_qty,
               sum(cast(floor(l_extendedprice * (1 - l_discount) * 10000 + 0.5e0) as bigint)) / 1e4 as net_amount,
               sum(cast(floor(l_extendedprice * l_discount * 10000 + 0.5e0) as bigint)) / 1e4 as discount_amount,
               sum(cast(floor(l_extendedprice * l_tax * 10000 + 0.5e0) as bigint)) / 1e4 as tax_amount,
               sum(case when l_returnflag = 'N' then cast(floor(l_extendedprice * 100 + 0.5e0) as bigint) end) / 1e2 as open_amount,
               cast(sum(case when l_linestatus = 'O' then cast(l_quantity as bigint) end) as double) as open_qty
        from lineitem group by l_partkey, year(l_shipdate)""",
    "fx_panel": """
        select ticker, cik, sector, industry, country, p_partkey, p_size, share_price, shares_outstanding, market_cap,
               case when p_size % 6 = 0 then 1.1e0 * market_cap end as snapshot_ev,
               cast(fiscal_year as int) as fiscal_year, cast(fiscal_year as string) || '-FY' as period_key,
               make_date(fiscal_year, 12, 31) as period_end,
               case when max_qty >= 30 then make_date(fiscal_year, 12, 31) + (max_qty - 30) end as filed_at,
               (p_partkey + fiscal_year) % 17 <> 0 as has_balance, (p_partkey + fiscal_year) % 23 <> 0 as has_cash_flow,
               net_amount as revenue, cost_of_revenue, gross_profit, operating_income, operating_income as ebit,
               operating_income + 0.08e0 * net_amount as ebitda, interest_expense, pretax_income,
               0.21e0 * pretax_income as income_tax_expense, net_income,
               net_income / (1000 + qty) as eps_basic,
               case when p_size % 5 <> 0 then net_income / (1000 + qty) end as eps_diluted,
               1000 + qty as shares_diluted,
               case when p_size % 7 <> 0 then 0.5e0 * discount_amount end as research_and_development,
               tax_amount as cash, receivables, inventory, total_current_assets, total_assets,
               0.1e0 * cost_of_revenue as accounts_payable, total_current_liabilities, total_debt, total_debt as long_term_debt,
               total_liabilities, total_assets - total_liabilities as total_equity,
               10 * p_retailprice as goodwill, 5 * p_retailprice as intangibles,
               total_assets - total_liabilities - 10 * p_retailprice - 5 * p_retailprice as tangible_book,
               0.5e0 * net_income as retained_earnings,
               net_income + 0.1e0 * net_amount as operating_cash_flow, -0.05e0 * net_amount as capex,
               net_income + 0.1e0 * net_amount - 0.05e0 * net_amount as free_cash_flow,
               case when p_size % 13 <> 0 then -0.02e0 * net_amount end as dividends_paid,
               -0.01e0 * net_amount as stock_buybacks, 0.005e0 * net_amount as stock_issuance,
               0.08e0 * net_amount as depreciation_amortization,
               case when p_size % 17 <> 0 then 0.05e0 * discount_amount end as stock_compensation
        from (
          select s.*, total_assets_base + coalesce(receivables, 0) + coalesce(inventory, 0) as total_current_assets,
                 total_assets_base + coalesce(receivables, 0) + coalesce(inventory, 0) + 100 * p_retailprice as total_assets,
                 0.3e0 * cost_of_revenue as total_current_liabilities,
                 0.3e0 * cost_of_revenue + coalesce(total_debt, 0) as total_liabilities,
                 operating_income - coalesce(interest_expense, 0) as pretax_income,
                 (operating_income - coalesce(interest_expense, 0)) - 0.21e0 * (operating_income - coalesce(interest_expense, 0)) as net_income
          from (
            select b.*, gross_profit - 0.15e0 * net_amount as operating_income
            from (
              select y.*, c.*, net_amount - qty * p_retailprice * 1.5e0 as gross_profit, qty * p_retailprice * 1.5e0 as cost_of_revenue,
                     case when p_size % 11 <> 0 then 0.01e0 * qty * p_retailprice end as interest_expense,
                     case when p_size % 19 <> 0 then 2 * discount_amount end as total_debt,
                     0.2e0 * open_amount as receivables, 0.4e0 * open_qty * p_retailprice as inventory,
                     tax_amount as total_assets_base
              from fx_part_years y join fx_companies c on l_partkey = p_partkey
            ) b
          ) s
        ) t""",
    "fx_income": """
        select ticker, sector, period_key, fiscal_year, period_end, filed_at, revenue, cost_of_revenue, gross_profit, operating_income,
               ebit, ebitda, interest_expense, pretax_income, income_tax_expense, net_income, eps_basic, eps_diluted, shares_diluted,
               research_and_development
        from fx_panel""",
    "fx_balance": """
        select ticker, sector, period_key, fiscal_year, period_end, cash, receivables, inventory, total_current_assets, total_assets,
               accounts_payable, total_current_liabilities, total_debt, long_term_debt, total_liabilities, total_equity, goodwill,
               intangibles, tangible_book, retained_earnings
        from fx_panel where has_balance""",
    "fx_cash_flow": """
        select ticker, sector, period_key, fiscal_year, period_end, operating_cash_flow, capex, free_cash_flow, dividends_paid,
               stock_buybacks, stock_issuance, depreciation_amortization, stock_compensation
        from fx_panel where has_cash_flow""",
    "fx_valuation_history": """
        select ticker, sector, market_cap, fiscal_year, make_date(fiscal_year, 6, 30) as float_as_of,
               0.9e0 * market_cap * (1 + 0.05e0 * (fiscal_year - 1998)) as public_float,
               net_income, revenue, total_equity, operating_income, total_debt, cash, shares_diluted as shares_outstanding
        from fx_panel""",
    "fx_earnings_history": """
        select ticker, fiscal_year, net_income from fx_panel
        union all
        select ticker, fiscal_year - 8 as fiscal_year, case when p_size % 4 <> 0 then 0.8e0 * net_income end as net_income from fx_panel""",
    "fx_daily_prices": """
        select user_id as entity, cast(ts as date) as date, max_by(value, struct_key) as close
        from (select user_id, ts, value, STRUCT_OF(ts, event_id) as struct_key from events) e
        group by user_id, cast(ts as date)""",
    "fx_facts": """
        select l_partkey as entity, l_returnflag as tag,
               case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end as tag_priority,
               case when l_linenumber <> 7 then make_date(year(l_shipdate), 12, 31) - cast(350 + l_orderkey % 40 as int) end as start_date,
               make_date(year(l_shipdate), 12, 31) as end_date,
               make_date(year(l_shipdate), 12, 31) + (cast(l_quantity as int) - 5) as filed,
               l_extendedprice as val,
               case when l_linestatus = 'O' and l_orderkey % 9 = 0 then '10-Q' else '10-K' end as form,
               l_orderkey as ord, l_linenumber as line
        from lineitem""",
    # filings of 31 concepts: each line item files a quarter of them, under one of the concept's tags; fiscal years end in any month, and on two days of it
    "fx_filings": """
        select l_partkey as entity, concept, concept || '_' || cast((l_linenumber + l_orderkey) % tags as string) as tag, cast((l_linenumber + l_orderkey) % tags as int) as tag_priority,
               case when ci < 11 or ci > 23 then ends - cast(350 + l_orderkey % 40 as int) end as start_date, ends as end_date, ends + (cast(l_quantity as int) - 5) as filed,
               case when concept = 'retained_earnings' and l_linenumber % 2 = 0 then -1 else 1 end * l_extendedprice * (ci + 1) as val,
               case when l_linestatus = 'O' and l_orderkey % 9 = 0 then '10-Q' else '10-K' end as form, l_orderkey as ord, l_linenumber as line
        from (select *, last_day(make_date(year(l_shipdate), cast(1 + l_partkey % 12 as int), 1)) - cast(3 * (l_orderkey % 2) as int) as ends, (l_orderkey + l_linenumber) % 4 as slot from lineitem) f
        join (select ci, concept, tags, ci % 4 as slot from (values """ + ", ".join(
        f"({i}, '{c}', {t})" for i, (c, t) in enumerate([
            ("revenue", 2), ("cost_of_revenue", 3), ("gross_profit", 2), ("research_and_development", 1), ("operating_income", 1), ("interest_expense", 1), ("pretax_income", 1), ("income_tax_expense", 1),
            ("net_income", 3), ("eps_diluted", 1), ("shares_diluted", 1), ("cash", 1), ("receivables", 1), ("inventory", 1), ("total_current_assets", 1), ("total_assets", 1), ("intangibles", 1),
            ("goodwill", 1), ("total_current_liabilities", 1), ("accounts_payable", 1), ("total_debt", 3), ("total_liabilities", 1), ("total_equity", 1), ("retained_earnings", 1),
            ("operating_cash_flow", 1), ("capex", 1), ("dividends_paid", 1), ("stock_buybacks", 1), ("stock_issuance", 1), ("depreciation_amortization", 2), ("stock_compensation", 2)])) + """) v(ci, concept, tags)) c
             on f.slot = c.slot""",
    "fx_trade_prices": """
        select l_partkey as entity, cast(l_shipdate as date) as date,
               sum(cast(floor(l_extendedprice * 100 + 0.5e0) as bigint)) / 1e2 / sum(cast(l_quantity as bigint)) as close
        from lineitem group by l_partkey, cast(l_shipdate as date)""",
    "fx_headlines": """
        select doc_id, 'P' || lpad(cast(doc_id % 50 as string), 8, '0') as ticker, source, text as title, doc_id as published_order
        from documents""",
}

# where Spark deals a binding's rows by a key: the yearly figures before the lines that are derived from them, which would be shuffled besides
DEALT = {"fx_panel": ("select y.*, c.*,", "select /*+ REPARTITION(ticker) */ y.*, c.*,")}

# ``fx_part_lines``, yearly figures joined with companies, may be given as a table; then the panel's rows come from it, in ranges of entities, with the other columns that it has of ``CARRIED``
LINES = "from fx_part_years y join fx_companies c on l_partkey = p_partkey"
TASK_ROWS = 50_000
CARRIED = ("return_12m1m", "risk_adjusted_3m", "risk_adjusted_6m")

# the rows of fx_earnings_history that a row of fx_panel stands for
EARNINGS_REPORTED = """array(named_struct('fiscal_year', fiscal_year, 'net_income', net_income),
                              named_struct('fiscal_year', fiscal_year - 8, 'net_income', case when p_size % 4 <> 0 then 0.8e0 * net_income end))"""


def needed(text: str, known: dict[str, str] = BINDINGS) -> list[str]:
    """Binding names a text refers to, dependencies first."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bfx_\w+", sql):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def bind(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False, **given: DataFrame) -> DataFrame:
    """One binding as a DataFrame over the Parquet tables in ``sf_dir``. ``dealt``: by entity, for a reader that gathers each entity's rows (the same rows). ``given``: bindings that are tables already."""
    bindings = {n: sql for n, sql in BINDINGS.items() if n not in given}
    if "fx_part_lines" in given:
        columns = given["fx_part_lines"].columns
        parts = given["fx_part_lines"].count() // TASK_ROWS + 1  # by rows and not by bytes: each becomes a value per metric
        panel = bindings["fx_panel"].replace(DEALT["fx_panel"][0], f"select /*+ REPARTITION_BY_RANGE({parts}, ticker) */ y.*,").replace(LINES, "from fx_part_lines y")
        bindings["fx_panel"] = panel.replace("select ticker,", f"select {''.join(f'{c}, ' for c in CARRIED if c in columns)}ticker,", 1)
    names = needed(f"from {name}", bindings)
    text = " ".join(bindings[n] for n in names).replace("STRUCT_OF", "struct")
    uses = {n: df for n, df in given.items() if re.search(rf"\b{n}\b", text)}
    parts = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in BASE_TABLES if re.search(rf"\b{t}\b", text)]
    parts += [f"{n} as (select * from {{{n}}})" for n in uses]
    parts += [f"{n} as ({bindings[n].replace(*DEALT[n]) if dealt and n in DEALT else bindings[n]})" for n in names]
    return spark.sql(("with " + ",\n".join(parts) + f"\nselect * from {name}").replace("STRUCT_OF", "struct"), **uses)


def part_lines(spark: SparkSession, sf_dir: str, extra: DataFrame) -> DataFrame:
    """The rows of ``fx_part_lines``, with the columns that ``extra`` has of an entity (a row per ticker)."""
    named = bind(spark, sf_dir, "fx_companies").drop("company_name").join(extra, "ticker", "left")
    return bind(spark, sf_dir, "fx_part_years").join(named, F.col("l_partkey") == F.col("p_partkey"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
