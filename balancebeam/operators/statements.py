"""Statement views: long rows in canonical order, groups, trends, the income bridge and side-by-side comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Line, indent (0 is a subtotal), twin line it is dropped against.
INCOME_ROWS = [("revenue", 0, None), ("cost_of_revenue", 1, None), ("gross_profit", 0, None), ("research_and_development", 1, None), ("operating_income", 0, None),
               ("ebit", 1, "operating_income"), ("interest_expense", 1, None), ("pretax_income", 0, None), ("income_tax_expense", 1, None), ("net_income", 0, None),
               ("eps_diluted", 1, None), ("shares_diluted", 1, None)]
BALANCE_ROWS = [("cash", 1, None), ("receivables", 1, None), ("inventory", 1, None), ("total_current_assets", 0, None), ("goodwill", 1, None), ("intangibles", 1, None),
                ("total_assets", 0, None), ("accounts_payable", 1, None), ("total_current_liabilities", 0, None), ("total_debt", 1, None),
                ("long_term_debt", 1, "total_debt"), ("total_liabilities", 0, None), ("retained_earnings", 1, None), ("total_equity", 0, None), ("tangible_book", 1, None)]
CASH_FLOW_ROWS = [("operating_cash_flow", 0, None), ("depreciation_amortization", 1, None), ("stock_compensation", 1, None), ("capex", 1, None), ("free_cash_flow", 0, None),
                  ("dividends_paid", 1, None), ("stock_buybacks", 1, None), ("stock_issuance", 1, None)]


def _group_of(configs) -> list[str | None]:
    """The subtotal each line hangs under: itself for a subtotal, else the last one before it."""
    out, last = [], None
    for line, indent, _ in configs:
        last = line if indent == 0 else last
        out.append(last)
    return out


def statement_rows(periods: DataFrame, configs=INCOME_ROWS, aged: bool = False) -> DataFrame:
    """(ticker, line, line_no, indent, fiscal_year, value): one cell per year on file; lines without any value and lines equal to their twin in every
    year are dropped.

    The per-line tests are aggregates over the entity's years, so twins are compared without a self join. ``aged`` adds ``age``, the number of newer years in which
    the line has a value, counted before the lines become rows.
    """
    w = Window.partitionBy("ticker")
    newer = w.orderBy(F.desc("fiscal_year")).rowsBetween(Window.unboundedPreceding, -1)
    flags = {}
    for line, _, twin in configs:
        shown = F.count(line).over(w) > 0
        if twin:
            shown = shown & (F.count_if(~F.col(line).eqNullSafe(F.col(twin))).over(w) > 0)
        flags[f"_s_{line}"] = shown
        if aged:
            flags[f"_a_{line}"] = F.count(line).over(newer)
    marked = periods.withColumns(flags)
    cells = [F.struct(F.lit(line).alias("line"), F.lit(i).alias("line_no"), F.lit(indent).alias("indent"), F.col(line).cast("double").alias("value"), F.col(f"_s_{line}").alias("shown"),
                      *([F.col(f"_a_{line}").alias("age")] if aged else []))
             for i, (line, indent, _) in enumerate(configs)]
    return marked.select("ticker", "fiscal_year", F.inline(F.array(*cells))).filter("shown").drop("shown")


def statement_groups(rows: DataFrame) -> DataFrame:
    """Component lines attached to the subtotal before them among the rows that are left; a leading component has none."""
    lines = rows.select("ticker", "line", "line_no", "indent").distinct()
    w = Window.partitionBy("ticker").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("parent", F.last(F.when(F.col("indent") == 0, F.col("line")), ignorenulls=True).over(w))


def yoy_latest(rows: DataFrame) -> DataFrame:
    """Change between the two newest years with a value; NULL on a zero base or a sign change."""
    if "age" not in rows.columns:
        w = Window.partitionBy("ticker", "line").orderBy(F.desc("fiscal_year"), F.desc("value"))
        rows = rows.filter("value is not null").withColumn("age", F.row_number().over(w) - 1)
    # plain values, so that the aggregate hashes and sorts no rows
    pair = rows.filter("value is not null and age < 2").groupBy("ticker", "line").agg(F.count(F.lit(1)).alias("n"), *[
        F.max(F.when(F.col("age") == k, F.col(c))).alias(f"{c}_{k}") for k in (0, 1) for c in ("fiscal_year", "value")])
    out = pair.filter("n = 2")
    last, prev = ({c: F.col(f"{c}_{k}") for c in ("fiscal_year", "value")} for k in (0, 1))
    ok = (prev["value"] != 0) & (F.signum(prev["value"]) == F.signum(last["value"]))
    change = F.when(ok, (last["value"] - prev["value"]) / F.nullif(F.abs(prev["value"]), F.lit(0.0)))
    return out.select("ticker", "line", prev["fiscal_year"].alias("from_year"), last["fiscal_year"].alias("to_year"), change.alias("change")).filter("change is not null")


def trend(rows: DataFrame) -> DataFrame:
    """up / down / flat from the first to the last year with a value."""
    g = rows.filter("value is not null").groupBy("ticker", "line").agg(F.min_by("value", "fiscal_year").alias("a"), F.max_by("value", "fiscal_year").alias("b"), F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("b") == F.col("a"), "flat").when(F.col("b") > F.col("a"), "up").otherwise("down")
    return g.filter("n >= 2").select("ticker", "line", code.alias("trend"))


def latest_filing(periods: DataFrame) -> DataFrame:
    """The newest year's dates, or no row: an older year never stands in."""
    g = periods.groupBy("ticker").agg(F.max_by(F.struct("period_end", "filed_at"), "fiscal_year").alias("r")).select("ticker", "r.*")
    return g.filter("period_end is not null and filed_at is not null")


BRIDGE = (("revenue", "gross_profit", "Cost of Revenue", "Gross Profit"), ("gross_profit", "operating_income", "Operating Expenses", "Operating Income"),
          ("operating_income", "pretax_income", "Non-Operating Items", "Pretax Income"), ("pretax_income", "net_income", "Taxes", "Net Income"))


def income_waterfall(income: DataFrame) -> DataFrame:
    """Revenue to net income per entity and year: subtotals and the floating deltas between them; the chain stops at the first missing line."""
    def step(no: int, name: str, base: Column, value: Column, subtotal: bool, raw: Column, present: Column) -> Column:
        s = F.struct(F.lit(no).alias("step"), F.lit(name).alias("name"), base.alias("base"), value.alias("value"), F.lit(subtotal).alias("is_subtotal"), raw.alias("raw"))
        return F.when(present, s)

    present = F.col("revenue").isNotNull()
    steps = [step(0, "Revenue", F.lit(0.0), F.col("revenue"), True, F.col("revenue"), present)]
    for i, (a, b, delta_name, name) in enumerate(BRIDGE):
        present = present & F.col(b).isNotNull()
        delta = F.col(b) - F.col(a)
        steps.append(step(2 * i + 1, delta_name, F.least(a, b), F.abs(delta), False, delta, present))
        steps.append(step(2 * i + 2, name, F.lit(0.0), F.col(b), True, F.col(b), present))
    return income.select("ticker", "fiscal_year", F.inline(F.filter(F.array(*steps), lambda s: s.isNotNull())))


def company_scale(income: DataFrame, balance: DataFrame, cash_flow: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Figures of the newest year over the three statements, matched on that exact year only."""
    rows = (
        income.select("ticker", "fiscal_year", "revenue", "net_income")
        .unionByName(balance.select("ticker", "fiscal_year", "total_assets"), allowMissingColumns=True)
        .unionByName(cash_flow.select("ticker", "fiscal_year", "free_cash_flow"), allowMissingColumns=True)
    )
    lines = ("revenue", "net_income", "free_cash_flow", "total_assets")
    per_year = rows.groupBy("ticker", "fiscal_year").agg(*[F.max(c).alias(c) for c in lines])
    newest = per_year.groupBy("ticker").agg(F.max_by(F.struct("fiscal_year", *lines), "fiscal_year").alias("r")).select("ticker", "r.*")
    return newest.join(snapshot.select("ticker", "market_cap"), "ticker", "left")


def company_compare(categories: DataFrame, headline: DataFrame, tickers: list[str]) -> DataFrame:
    """One row per measure, one column per ticker."""
    cats = categories.filter(F.col("ticker").isin(tickers)).select("ticker", F.col("category").alias("measure"), F.col("score").alias("value"))
    names = [c for c in headline.columns if c != "ticker"]
    heads = headline.filter(F.col("ticker").isin(tickers)).unpivot(["ticker"], names, "measure", "value")
    return cats.unionByName(heads).groupBy("measure").pivot("ticker", tickers).agg(F.first("value"))
