"""Null-aware arithmetic as Column expressions. Missing is NULL, never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def safe_div(n, d) -> Column:
    """n / d, NULL on a missing or zero denominator."""
    return F.try_divide(_c(n), _c(d))


def ratio_pos(n, d) -> Column:
    """n / d, NULL unless the denominator is positive."""
    n, d = _c(n), _c(d)
    return F.when(d > 0, n / d)


def growth_pos_base(cur, prior) -> Column:
    cur, prior = _c(cur), _c(prior)
    return F.when(prior > 0, (cur - prior) / prior)


def cagr_end(end, start, years) -> Column:
    """Growth rate needing a positive start; a negative end is only valid over one year."""
    end, start = _c(end), _c(start)
    if years == 1:
        return F.when(start > 0, end / start - 1)
    return F.when((start > 0) & (end >= 0), F.pow(end / start, F.lit(1.0 / years)) - 1)


def cagr_both_pos(start, end, years) -> Column:
    start, end, years = _c(start), _c(end), _c(years)
    return F.when((years > 0) & (start > 0) & (end > 0), F.pow(end / start, F.lit(1.0) / years) - 1)


def sum_present(*cols) -> Column:
    cols = [_c(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), total)


def avg_present(*cols) -> Column:
    cols = [_c(c) for c in cols]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return sum_present(*cols) / F.nullif(n, F.lit(0))


def clamp(x, lo, hi) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, _c(lo)), _c(hi)))


def round_half_up(x, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves always move towards +infinity."""
    f = float(10**digits)
    return F.floor(_c(x) * f + 0.5).cast("double") / f


def round_to_half(x) -> Column:
    return F.floor(_c(x) * 2 + 0.5).cast("double") / 2


def logistic(z) -> Column:
    return 1 / (1 + F.exp(-_c(z)))


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = _c(x)
    return F.when(F.abs(x) < float("inf"), x)


def tax_rate_roic(tax="income_tax_expense", pretax="pretax_income") -> Column:
    rate = safe_div(tax, pretax)
    return F.when((rate >= 0) & (rate <= 1), rate).otherwise(0.21)


DEFAULT_TAX_RATE = 0.24


def tax_rate_scenario(tax="income_tax_expense", pretax="pretax_income") -> Column:
    tax, pretax = _c(tax), _c(pretax)
    return F.when(tax.isNotNull() & (pretax > 0), clamp(tax / F.nullif(pretax, F.lit(0.0)), 0.0, 0.5)).otherwise(DEFAULT_TAX_RATE)


def tax_rate_capalloc(tax="income_tax_expense", pretax="pretax_income") -> Column:
    return tax_rate_scenario(F.abs(_c(tax)), pretax)


def fcf_of(fcf="free_cash_flow", ocf="operating_cash_flow", capex="capex") -> Column:
    return F.coalesce(_c(fcf), _c(ocf) - F.abs(_c(capex)))


def per_share(value, shares) -> Column:
    return ratio_pos(value, shares)


def approx_ffo(ni="net_income", da="depreciation_amortization") -> Column:
    return _c(ni) + _c(da)


def score_display(s) -> Column:
    return (_c(s) + 1) * 50


def sentiment_label(s) -> Column:
    s = _c(s)
    return F.when(s > 0.15, "positive").when(s < -0.15, "negative").when(s.isNotNull(), "neutral")


def coverage_tier(r) -> Column:
    r = _c(r)
    return F.when(r >= 0.7, "full").when(r >= 0.4, "partial").otherwise("thin")


def coefficient_of_variation(mean, sd) -> Column:
    mean, sd = _c(mean), _c(sd)
    return F.when(mean != 0, sd / F.abs(mean))


def period_key(period_end, quarterly) -> Column:
    """YYYY-FY, or YYYY-Qn where ``quarterly`` holds."""
    d = _c(period_end)
    y = F.year(d).cast("string")
    return F.when(_c(quarterly), F.concat(y, F.lit("-Q"), F.quarter(d).cast("string"))).otherwise(F.concat(y, F.lit("-FY")))


def fiscal_year_end_valid(mmdd) -> Column:
    """MMDD checked against month lengths (29 February allowed), else NULL."""
    s = _c(mmdd)
    m, d = F.substring(s, 1, 2), F.substring(s, 3, 2)
    days = F.when(m == "02", 29).when(m.isin("04", "06", "09", "11"), 30).otherwise(31)
    ok = s.rlike("^(0[1-9]|1[0-2])[0-3][0-9]$") & (F.try_to_number(d, F.lit("99")) >= 1) & (F.try_to_number(d, F.lit("99")) <= days)
    return F.when(ok, s)


def fiscal_year_end_label(mmdd) -> Column:
    """'0930' -> 'September 30'."""
    s = fiscal_year_end_valid(mmdd)
    return F.date_format(F.to_date(F.concat(F.lit("2000"), s), "yyyyMMdd"), "MMMM d")


def is_non_calendar(mmdd) -> Column:
    return fiscal_year_end_valid(mmdd) != "1231"


def decode_entities(text) -> Column:
    """The six common HTML entities, ampersand first."""
    out = _c(text)
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def compact_timestamp(text) -> Column:
    """'20240131T093000Z' to a timestamp, NULL on any other shape."""
    s = _c(text)
    return F.when(s.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(s, F.lit("yyyyMMdd'T'HHmmss'Z'")))
