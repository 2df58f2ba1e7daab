"""Scalar functions, each over every row of a bound table."""

from __future__ import annotations

from pyspark.sql import functions as F

from balancebeam.functions import scalars as s
from catalog.base import bind, query, tidy
from catalog.sql import rnd

PANEL, KEYS = "fx_panel", ["ticker", "fiscal_year"]


def register(name, columns, digits=6, source=PANEL, keys=KEYS):
    """``columns``: alias -> (Column builder, check SQL, is a double)."""
    sql = ", ".join(f"{rnd(q, digits) if dbl else q} as {a}" for a, (_, q, dbl) in columns.items())

    @query(name, f"select {', '.join(keys)}, {sql} from {source}")
    def run(spark, sf):
        return tidy(bind(spark, sf, source).select(*keys, *[b().alias(a) for a, (b, _, _) in columns.items()]), digits)


register("safe_div", {"pe": (lambda: s.safe_div("market_cap", "net_income"), "market_cap / nullif(net_income, 0)", True),
                      "to_zero": (lambda: s.safe_div("revenue", F.col("revenue") - F.col("revenue")), "null::DOUBLE", True)})
register("ratio_pos", {"roe": (lambda: s.ratio_pos("net_income", "total_equity"), "case when total_equity > 0 then net_income / total_equity end", True)})
register("growth_pos_base", {"gap": (lambda: s.growth_pos_base("gross_profit", "net_income"),
                                     "case when net_income > 0 then (gross_profit - net_income) / net_income end", True)})
register("cagr_end", {"g1": (lambda: s.cagr_end("net_income", "gross_profit", 1), "case when gross_profit > 0 then net_income / gross_profit - 1 end", True),
                      "g3": (lambda: s.cagr_end("net_income", "gross_profit", 3),
                             "case when gross_profit > 0 and net_income >= 0 then pow(net_income / gross_profit, 1::DOUBLE / 3) - 1 end", True)})
register("cagr_both_pos", {"g": (lambda: s.cagr_both_pos("gross_profit", "net_income", 3),
                                 "case when gross_profit > 0 and net_income > 0 then pow(net_income / gross_profit, 1::DOUBLE / 3) - 1 end", True)})
register("sum_present", {"total": (lambda: s.sum_present("receivables", "inventory", "interest_expense"),
                                   "case when coalesce(receivables, inventory, interest_expense) is not null then "
                                   "coalesce(receivables,0) + coalesce(inventory,0) + coalesce(interest_expense,0) end", True)})
register("avg_present", {"mean": (lambda: s.avg_present("receivables", "inventory", "interest_expense"), "list_avg([receivables, inventory, interest_expense])", True)})
register("round_half_up", {"pct1": (lambda: s.round_half_up(F.col("net_income") / F.col("revenue") * 100, 1), "floor(net_income / revenue * 100 * 10 + 0.5) / 10", True)})
register("round_to_half", {"pe_half": (lambda: s.round_to_half(s.clamp(s.ratio_pos("market_cap", "net_income"), 8.0, 25.0)),
                                       "floor(case when net_income > 0 then greatest(least(market_cap / net_income, 25), 8) end * 2 + 0.5) / 2", True)})
register("clamp", {"margin": (lambda: s.clamp(F.col("gross_profit") / F.col("revenue"), -0.5, 0.5), "greatest(least(gross_profit / revenue, 0.5), -0.5)", True)})
register("logistic", {"p": (lambda: s.logistic(F.col("net_income") / F.col("revenue")), "1 / (1 + exp(-(net_income / revenue)))", True)})
register("tax_rate_roic", {"rate": (lambda: s.tax_rate_roic("interest_expense", "pretax_income"),
                                    "case when interest_expense / nullif(pretax_income, 0) between 0 and 1 then interest_expense / nullif(pretax_income, 0) else 0.21 end", True)})
register("tax_rate_scenario", {"rate": (lambda: s.tax_rate_scenario("interest_expense", "pretax_income"),
                                        "case when interest_expense is not null and pretax_income > 0 then greatest(least(interest_expense / pretax_income, 0.5), 0) else 0.24 end", True)})
register("tax_rate_capalloc", {"rate": (lambda: s.tax_rate_capalloc("dividends_paid", "pretax_income"),
                                        "case when dividends_paid is not null and pretax_income > 0 then least(abs(dividends_paid) / pretax_income, 0.5) else 0.24 end", True)})
register("fcf_of", {"fcf": (lambda: s.fcf_of("inventory", "operating_cash_flow", "capex"), "coalesce(inventory, operating_cash_flow - abs(capex))", True)})
register("per_share", {"rps": (lambda: s.per_share("revenue", "shares_diluted"), "case when shares_diluted > 0 then revenue / shares_diluted end", True)})
register("approx_ffo", {"ffo": (lambda: s.approx_ffo(), "net_income + depreciation_amortization", True)})
register("score_display", {"display": (lambda: s.score_display(F.col("net_income") / F.col("revenue")), "(net_income / revenue + 1) * 50", True)})
register("sentiment_label", {"label": (lambda: s.sentiment_label(F.col("net_income") / F.col("revenue")),
                                       "case when net_income / revenue > 0.15 then 'positive' when net_income / revenue < -0.15 then 'negative' else 'neutral' end", False)})
register("coverage_tier", {"tier": (lambda: s.coverage_tier(F.col("gross_profit") / F.col("revenue")),
                                    "case when gross_profit / revenue >= 0.7 then 'full' when gross_profit / revenue >= 0.4 then 'partial' else 'thin' end", False)})
register("period_key", {"annual": (lambda: s.period_key("date", F.lit(False)), "year(date) || '-FY'", False),
                        "quarterly": (lambda: s.period_key("date", F.lit(True)), "year(date) || '-Q' || quarter(date)", False)},
         source="fx_trade_prices", keys=["entity", "date"])

MMDD = "lpad(cast((entity * 37) % 13 as varchar), 2, '0') || lpad(cast((entity * 11 + day(date)) % 33 as varchar), 2, '0')"
MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"


def _mmdd():
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(part((F.col("entity") * 37) % 13), part((F.col("entity") * 11 + F.dayofmonth("date")) % 33))


VALID = ("case when m between 1 and 12 and d between 1 and (case when m = 2 then 29 when m in (4, 6, 9, 11) then 30 else 31 end) then {} end")


@query("fiscal_year_end_label", f"""select entity, date, {VALID.format("(" + MONTHS + ")[m] || ' ' || d")} as label, {VALID.format("mmdd <> '1231'")} as non_calendar
        from (select *, substr(mmdd, 1, 2)::INT as m, substr(mmdd, 3, 2)::INT as d from (select entity, date, {MMDD} as mmdd from fx_trade_prices))""")
def fiscal_year_end_label(spark, sf):
    rows = bind(spark, sf, "fx_trade_prices").withColumn("mmdd", _mmdd())
    return tidy(rows.select("entity", "date", s.fiscal_year_end_label("mmdd").alias("label"), s.is_non_calendar("mmdd").alias("non_calendar")))


@query("decode_entities", """select page_id, replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
        '&nbsp;', ' ') as text from pages""")
def decode_entities(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", s.decode_entities("html").alias("text"))


@query("gdelt_ts", """select event_id, case when event_id % 7 <> 0 then date_trunc('second', ts) end as seen from events""")
def gdelt_ts(spark, sf):
    raw = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), raw)).otherwise(raw)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", s.compact_timestamp(text).cast("timestamp_ntz").alias("seen"))
