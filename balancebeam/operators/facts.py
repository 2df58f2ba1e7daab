"""Raw reported facts to yearly statements.

Every pick (latest filed, first tag, latest end) is an aggregate over an ordering struct rather than a window, so it combines before the
shuffle and one entity with most of the facts is never sorted in one task.

Fact rows: (entity, tag, tag_priority, start_date, end_date, filed, val, form, ord, line); (ord, line) is the order in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANNUAL_FORMS = ("10-K", "10-K/A")
UNITS = ("USD", "USD/shares", "shares")


def explode_companyfacts(raw: DataFrame, entity: str = "ticker") -> DataFrame:
    """Nested facts.taxonomy.tag.units.unit[] JSON text to flat rows: the first unit present by priority for each tag; where that is no array the tag has no facts.

    A document is parsed once into a VARIANT and exploded level by level, so a whole company's file of any number of taxonomies, tags and facts is never held as nested maps of strings.
    Text that is no JSON gives no rows; a field that is missing or of another kind is NULL.
    """
    explode = lambda df, value, names: df.lateralJoin(SparkSession.active().tvf.variant_explode(F.col(value).outer())).withColumnsRenamed(names)
    facts = raw.select(entity, F.try_variant_get(F.try_parse_json("json"), "$.facts", "variant").alias("_facts"))
    tags = explode(facts, "_facts", {"pos": "_p1", "key": "taxonomy", "value": "_tags"})
    units = explode(tags.drop("_facts"), "_tags", {"pos": "_p2", "key": "tag", "value": "_tag"}).drop("_tags")
    at = lambda u: F.try_variant_get("_tag", f'$.units["{u}"]', "variant")
    found = [at(u) for u in UNITS]
    unit = F.coalesce(*[F.when(x.isNotNull(), F.lit(u)) for u, x in zip(UNITS, found)])
    picked = units.select(entity, "taxonomy", "tag", unit.alias("unit"), F.coalesce(*found).alias("_list")).filter("unit is not null and schema_of_variant(_list) like 'ARRAY<%'")
    rows = explode(picked, "_list", {"pos": "_p3", "key": "_k3", "value": "_fact"})
    get = lambda name, kind: F.try_variant_get("_fact", f"$.{name}", kind)
    day = lambda name: F.try_to_date(get(name, "string"), "yyyy-MM-dd")
    return rows.select(entity, "taxonomy", "tag", "unit", day("start").alias("start_date"), day("end").alias("end_date"), get("val", "double").alias("val"), get("fy", "int").alias("fy"),
                       get("fp", "string").alias("fp"), get("form", "string").alias("form"), day("filed").alias("filed"))


def annual_filter(facts: DataFrame) -> DataFrame:
    """Annual forms; a duration must span 350 to 380 days, an instant passes."""
    days = F.datediff("end_date", "start_date")
    return facts.filter((F.col("form") == "10-K") & (F.col("start_date").isNull() | days.between(350, 380)))


def _first(fields: list[str], order: list[Column]) -> Column:
    """The fields of the row that comes first in the order, as one mergeable aggregate."""
    return F.min_by(F.struct(*fields), F.struct(*order))



def latest_order() -> list[Column]:
    """Latest filing; on equal dates the first seen by tag order, then file order."""
    return [-F.unix_date(F.col("filed")), F.col("tag_priority"), F.col("ord"), F.col("line")]


FIELDS = ["val", "filed", "tag", "tag_priority"]


def latest_filed(facts: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Per entity and period end, the latest filing over all tags together."""
    picked = annual_filter(facts).groupBy(*keys, "end_date").agg(_first(FIELDS, latest_order()).alias("r"))
    return picked.select(*keys, "end_date", "r.*")


def tag_fallback(facts: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Per entity and period end, the first tag with any value wins, at its own latest filing, even where a later tag was filed later."""
    order = [F.col("tag_priority"), -F.unix_date(F.col("filed")), F.col("ord"), F.col("line")]
    picked = annual_filter(facts).groupBy(*keys, "end_date").agg(_first(FIELDS, order).alias("r"))
    return picked.select(*keys, "end_date", "r.*")


def to_fiscal_year(ends: DataFrame, years: int, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Year of the period end; the latest end wins within a year; newest ``years`` kept. At most one row per year reaches the window."""
    rest = [c for c in ends.columns if c not in (*keys, "end_date")]
    per = ends.groupBy(*keys, F.year("end_date").alias("fiscal_year")).agg(F.max_by(F.struct("end_date", *rest), "end_date").alias("r"))
    w = Window.partitionBy(*keys).orderBy(F.desc("fiscal_year"))
    return per.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= years).select(*keys, "fiscal_year", "r.*")


def provenance(yearly: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Tags that supplied the kept years, in precedence order. A concept has a handful of tags."""
    tags = F.transform(F.array_sort(F.collect_set(F.struct("tag_priority", "tag"))), lambda x: x["tag"])
    return yearly.groupBy(*keys).agg(F.array_join(tags, ",").alias("tags"))


def usable_filed(filed="filed", end="end_date") -> Column:
    """A filing date before the period end is unusable."""
    return F.when(F.col(filed) >= F.col(end), F.col(filed))


def filed_at(facts_by_concept: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Public date of a yearly row: the latest of its concepts' winning filings.

    Within a concept the latest period end of the year decides, so an unusable date there removes the concept's entry.
    """
    ends = annual_filter(facts_by_concept).groupBy(*keys, "concept", "end_date").agg(_first(["filed"], latest_order()).alias("r"))
    ends = ends.select(*keys, "concept", "end_date", F.col("r.filed").alias("filed"))
    per = ends.groupBy(*keys, "concept", F.year("end_date").alias("fiscal_year")).agg(F.max_by(F.struct(usable_filed().alias("ok")), "end_date").alias("r"))
    return per.groupBy(*keys, "fiscal_year").agg(F.max("r.ok").alias("filed_at"))


def period_end(facts: DataFrame, years: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Real period end per year on file, else 31 December."""
    ends = annual_filter(facts).groupBy(*keys, F.year("end_date").alias("fiscal_year")).agg(F.max("end_date").alias("period_end"))
    out = years.join(ends, [*keys, "fiscal_year"], "left")
    return out.withColumn("period_end", F.coalesce("period_end", F.make_date("fiscal_year", F.lit(12), F.lit(31))))


def pivot_concepts(yearly: DataFrame, concepts: list[str], keys: tuple[str, ...] = ("entity",), more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per entity and year with a column per concept; the concept list is given, so no extra pass finds it."""
    return yearly.groupBy(*keys, "fiscal_year").agg(*[F.max(F.when(F.col("concept") == c, F.col("val"))).alias(c) for c in concepts], *more)


INCOME = ["revenue", "cost_of_revenue", "gross_profit", "research_and_development", "operating_income", "interest_expense", "pretax_income", "income_tax_expense", "net_income", "eps_diluted", "shares_diluted"]
BALANCE = ["cash", "receivables", "inventory", "total_current_assets", "total_assets", "intangibles", "goodwill", "total_current_liabilities", "accounts_payable", "total_debt", "total_liabilities", "total_equity",
           "retained_earnings"]
CASH_FLOW = ["operating_cash_flow", "capex", "dividends_paid", "stock_buybacks", "stock_issuance", "depreciation_amortization", "stock_compensation"]


def concept_series(facts: DataFrame, fallback: list[str], years: int = 12) -> DataFrame:
    """Per entity, concept and fiscal year the winning fact, newest ``years`` of each concept: (entity, concept, fiscal_year, end_date, val, filed, tag, tag_priority).

    For the concepts in ``fallback`` the first tag with any value wins a period, for the others the latest filing over all tags. All concepts pass in one aggregate.
    """
    first = F.when(F.col("concept").isin(fallback), F.col("tag_priority")).otherwise(0)
    # the latest end of a year, then the order within it: one ordering, so a year is picked in one aggregate; what the order holds is not carried twice
    names = ["_end", "_first", "_filed", "_priority", "_ord", "_line", "val", "tag"]
    order = [-F.unix_date(F.col("end_date")), first, -F.unix_date(F.col("filed")), F.col("tag_priority"), F.col("ord"), F.col("line"), F.col("val"), F.col("tag")]
    best = F.min(F.when(F.col("end_date").isNotNull(), F.struct(*[c.alias(n) for c, n in zip(order, names)])))
    per = annual_filter(facts).groupBy("entity", "concept", F.year("end_date").alias("fiscal_year")).agg(best.alias("r"))
    # a handful of rows per concept and year are left: placed by entity once, for these windows and those of the builders
    w = Window.partitionBy("entity", "concept").orderBy(F.desc("fiscal_year"))
    kept = per.repartition("entity").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= years)
    day = lambda c: F.date_from_unix_date(-F.col(c))
    return kept.select("entity", "concept", "fiscal_year", day("r._end").alias("end_date"), "r.val", day("r._filed").alias("filed"), "r.tag", F.col("r._priority").alias("tag_priority"))


def _lines(series: DataFrame, concepts: list[str], backbone: str, second: str | None, years: int) -> DataFrame:
    """The concepts side by side with period_end and filed_at, for the newest years that have the backbone line (the second line where an entity has none of the first).

    period_end is the latest end of the backbone lines, else 31 December; filed_at the latest usable filing of all lines.
    """
    spine = [backbone] + ([second] if second else [])
    end = F.max(F.when(F.col("concept").isin(spine), F.col("end_date"))).alias("_end")
    filed = F.max(usable_filed()).alias("filed_at")
    wide = pivot_concepts(series, concepts, more=(end, filed))
    has = F.col(backbone).isNotNull()
    if second:
        has = F.when(F.max(has).over(Window.partitionBy("entity")), has).otherwise(F.col(second).isNotNull())
    newest = Window.partitionBy("entity").orderBy(F.desc("fiscal_year"))
    kept = wide.withColumn("_has", has).filter("_has").withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= years)
    return kept.withColumn("period_end", F.coalesce("_end", F.make_date("fiscal_year", F.lit(12), F.lit(31)))).drop("_has", "_k", "_end")


def build_income(series: DataFrame, years: int = 12) -> DataFrame:
    """Income statement of a ``concept_series``: backbone years from revenue, else from net income; a reported gross profit wins, else revenue less cost where both are known. EBIT is operating
    income; EBITDA and basic EPS stay empty."""
    none = F.lit(None).cast("double")
    rows = _lines(series, INCOME, "revenue", "net_income", years)
    gross = F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))
    return rows.withColumns({"gross_profit": gross, "ebit": F.col("operating_income"), "ebitda": none, "eps": none}).select(
        "entity", "fiscal_year", "period_end", "filed_at", *INCOME, "ebit", "ebitda", "eps")


def build_balance(series: DataFrame, years: int = 12) -> DataFrame:
    """Balance sheet: backbone years from total assets, else from equity; tangible book takes missing intangibles and goodwill as zero; long-term debt is the total."""
    tangible = F.col("total_equity") - F.coalesce("intangibles", F.lit(0.0)) - F.coalesce("goodwill", F.lit(0.0))
    rows = _lines(series, BALANCE, "total_assets", "total_equity", years)
    return rows.select("entity", "fiscal_year", "period_end", "filed_at", *BALANCE, F.col("total_debt").alias("long_term_debt"), tangible.alias("tangible_book"))


def build_cash_flow(series: DataFrame, years: int = 12) -> DataFrame:
    """Cash flow statement: backbone operating cash flow; outflows stored as negatives; free cash flow needs both of its parts."""
    out = ("capex", "dividends_paid", "stock_buybacks")
    rows = _lines(series, CASH_FLOW, "operating_cash_flow", None, years)
    return rows.select("entity", "fiscal_year", "period_end", "filed_at", *[(-F.abs(c)).alias(c) if c in out else F.col(c) for c in CASH_FLOW],
                       (F.col("operating_cash_flow") - F.abs("capex")).alias("free_cash_flow"))


def build_quarterly(rows: DataFrame) -> DataFrame:
    """Alternate provider shape: yearly and quarterly rows keyed by period."""
    from balancebeam.functions.scalars import period_key

    return rows.withColumn("period_key", period_key("period_end", F.col("quarterly"))).withColumn("fiscal_year", F.year("period_end"))


def annual_fundamentals(yearly: DataFrame, durations: DataFrame, instants: DataFrame, concepts: list[str], years: int = 12) -> DataFrame:
    """Union of the concepts' years, newest twelve, absent lines NULL; period end from duration facts, else instants, else NULL."""
    wide = pivot_concepts(yearly, concepts)
    w = Window.partitionBy("entity").orderBy(F.desc("fiscal_year"))
    wide = wide.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= years).drop("_k")
    ends = lambda f, name: annual_filter(f).groupBy("entity", F.year("end_date").alias("fiscal_year")).agg(F.max("end_date").alias(name))
    out = wide.join(ends(durations, "_d"), ["entity", "fiscal_year"], "left").join(ends(instants, "_i"), ["entity", "fiscal_year"], "left")
    return out.withColumn("period_end", F.coalesce("_d", "_i")).drop("_d", "_i")


def public_float_history(facts: DataFrame, plausible: Column, years: int = 12) -> DataFrame:
    """(entity, fiscal_year, as_of, public_float): annual forms and amendments, per fiscal year the latest cover date, then the latest filing."""
    ok = facts.filter(F.col("form").isin(list(ANNUAL_FORMS)) & (F.col("val") > 0) & plausible)
    fy = F.coalesce("fy", F.year("end_date"))
    order = [-F.unix_date(F.col("end_date")), -F.unix_date(F.col("filed")), F.col("ord"), F.col("line")]
    per = ok.groupBy("entity", fy.alias("fiscal_year")).agg(_first(["end_date", "val"], order).alias("r"))
    w = Window.partitionBy("entity").orderBy(F.desc("fiscal_year"))
    return per.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= years).select("entity", "fiscal_year", F.col("r.end_date").alias("as_of"), F.col("r.val").alias("public_float"))


def approx_market_value(floats: DataFrame, shares: DataFrame, revenue: DataFrame, operating: DataFrame) -> DataFrame:
    """Per entity the latest-filed float and share count, the latest annual revenue and whether it reports operating figures."""
    pick = lambda df, name: df.groupBy("entity").agg(_first(["val", "end_date"], latest_order()).alias("r")).select("entity", F.col("r.val").alias(name), F.col("r.end_date").alias(f"{name}_as_of"))
    rev = to_fiscal_year(latest_filed(revenue), 1).select("entity", F.col("val").alias("revenue"))
    has = operating.select("entity").distinct().withColumn("has_operating_financials", F.lit(True))
    out = pick(floats, "public_float").join(pick(shares, "shares").drop("shares_as_of"), "entity", "left").join(rev, "entity", "left").join(has, "entity", "left")
    return out.withColumn("has_operating_financials", F.coalesce("has_operating_financials", F.lit(False)))


def valuation_history_build(floats: DataFrame, years: DataFrame, keep: int = 12) -> DataFrame:
    """Floats aligned to the year they fall in, with a usable fundamental and a float plausible against that year's revenue; the last cover date per year."""
    from balancebeam.operators.joins import range_float
    from balancebeam.operators.screens import market_cap_plausible

    matched = range_float(floats, years)
    lines = ("net_income", "revenue", "total_equity", "operating_income")
    out = matched.join(years.withColumnRenamed("fiscal_year", "matched_year"), ["ticker", "matched_year"])
    out = out.filter(F.coalesce(*lines).isNotNull() & market_cap_plausible("public_float", "revenue"))
    per = out.groupBy("ticker", F.col("matched_year").alias("fiscal_year")).agg(F.max_by(F.struct("float_as_of", "public_float", *lines), F.struct("float_as_of", "public_float")).alias("r"))
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    return per.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).select("ticker", "fiscal_year", "r.*")


def cik_override(tickers: DataFrame, directory: DataFrame, overrides: DataFrame) -> DataFrame:
    """Explicit key first, then the directory. ``overrides`` is a short hand-kept list; both are equi joins and are left to the planner."""
    o = overrides.select("ticker", F.col("cik").alias("_o"))
    d = directory.select("ticker", F.col("cik").alias("_d"))
    return tickers.join(o, "ticker", "left").join(d, "ticker", "left").select("ticker", F.coalesce("_o", "_d").alias("cik"))
