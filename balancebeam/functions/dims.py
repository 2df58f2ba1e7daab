"""Reference data carried as small tables: sectors, applicability rules, named strategies, industry-code ranges."""

from __future__ import annotations

# The sector list, in display order.
SECTORS = ("Technology", "Healthcare", "Financials", "Consumer Discretionary", "Consumer Staples", "Energy", "Utilities",
           "Industrials", "Real Estate", "Communication Services", "Materials")

# Spellings that mean one of the two sectors with rules.
SECTOR_ALIASES = {
    "financials": "Financials", "financial": "Financials", "financial services": "Financials", "financial service": "Financials",
    "banks": "Financials", "banking": "Financials", "insurance": "Financials", "insurers": "Financials",
    "real estate": "Real Estate", "realestate": "Real Estate", "reit": "Real Estate", "reits": "Real Estate",
}

# Metrics a sector leaves out, with a reason code.
SECTOR_EXCLUDED = {
    "Financials": {
        "enterprise-value": ("ev_ebit", "ev_ebitda", "ev_fcf", "earnings_yield"),
        "cash-flow": ("fcf_yield", "fcf_margin", "fcf_to_revenue", "fcf_to_net_income", "cash_conversion_ratio", "ocf_margin",
                      "capex_to_revenue", "sbc_to_fcf"),
        "invested-capital": ("roic", "avg_roic_5y"),
        "liquidity-and-leverage": ("current_ratio", "quick_ratio", "debt_to_equity", "debt_to_ebitda", "interest_coverage",
                                   "debt_maturity_mix", "net_cash_to_market_cap", "cash_to_market_cap"),
        "turnover": ("asset_turnover", "inventory_turnover", "receivable_turnover", "cash_conversion_cycle"),
        "gross-profit": ("gross_profitability",),
        "operating-assets": ("net_operating_assets",),
    },
    "Real Estate": {
        "depreciation": ("pe_ttm", "cape_ratio", "earnings_vs_normalized"),
        "turnover": ("inventory_turnover", "receivable_turnover", "cash_conversion_cycle"),
    },
}
# Metrics that exist for one sector only.
SECTOR_ONLY = {"ffo_yield": "Real Estate", "price_to_ffo": "Real Estate"}

# Named strategies: key, name, rules (metric, operator, threshold), rules needed to qualify.
STRATEGIES = [
    ("earnings_yield_roc", "Earnings Yield + Return on Capital", [("earnings_yield", ">", 0.08), ("roic", ">", 0.15), ("market_cap", ">", 2e9)], 3),
    ("low_ev_ebit", "Low EV/EBIT", [("ev_ebit", "between", 8.0), ("debt_to_ebitda", "<", 3.0)], 2),
    ("value_composite", "Value Composite", [("pe_ttm", "<", 15.0), ("pb", "<", 2.0), ("ps", "<", 1.5), ("ev_ebitda", "<", 10.0),
                                            ("fcf_yield", ">", 0.05)], 4),
    ("f_score_value", "F-Score Value", [("piotroski_f_score", ">=", 7.0), ("pb", "<", 1.5)], 2),
    ("owner_earnings_yield", "Owner-Earnings Yield", [("fcf_yield", ">", 0.08), ("fcf_to_net_income", ">", 0.9),
                                                      ("share_count_change", "<=", 0.0)], 3),
    ("quality_reasonable_price", "Quality at a Reasonable Price", [("roic", ">", 0.15), ("avg_gross_margin_5y", ">", 0.3),
                                                                   ("pe_ttm", "<", 20.0), ("debt_to_equity", "<", 1.0)], 4),
]

# Industry-code ranges (low, high, sector); the first range that holds a code wins.
SIC_RANGES = [
    (6798, 6798, "Real Estate"), (2830, 2836, "Healthcare"), (3570, 3579, "Technology"), (3660, 3699, "Technology"),
    (3711, 3711, "Consumer Discretionary"), (3721, 3721, "Consumer Discretionary"), (7370, 7379, "Technology"), (8000, 8099, "Healthcare"),
    (100, 999, "Consumer Staples"), (1000, 1099, "Materials"), (1200, 1299, "Energy"), (1300, 1399, "Energy"), (1400, 1499, "Materials"),
    (1500, 1799, "Industrials"), (2000, 2199, "Consumer Staples"), (2200, 2399, "Consumer Discretionary"), (2400, 2599, "Materials"),
    (2600, 2699, "Materials"), (2700, 2799, "Communication Services"), (2800, 2899, "Materials"), (2900, 2999, "Energy"),
    (3000, 3099, "Materials"), (3200, 3299, "Materials"), (3300, 3399, "Materials"), (3400, 3499, "Industrials"),
    (3500, 3599, "Industrials"), (3600, 3699, "Technology"), (3700, 3799, "Industrials"), (3800, 3849, "Healthcare"),
    (3850, 3899, "Technology"), (3900, 3999, "Consumer Discretionary"), (4000, 4799, "Industrials"),
    (4800, 4899, "Communication Services"), (4900, 4999, "Utilities"), (5000, 5199, "Industrials"),
    (5200, 5399, "Consumer Discretionary"), (5400, 5499, "Consumer Staples"), (5500, 5799, "Consumer Discretionary"),
    (5900, 5999, "Consumer Discretionary"), (6000, 6199, "Financials"), (6200, 6299, "Financials"), (6300, 6499, "Financials"),
    (6500, 6599, "Real Estate"), (6700, 6799, "Financials"), (7000, 7099, "Consumer Discretionary"),
    (7200, 7299, "Consumer Discretionary"), (7300, 7399, "Technology"), (7400, 7599, "Consumer Discretionary"),
    (7800, 7999, "Communication Services"), (8100, 8999, "Healthcare"),
]

# Forensic check keys in report order.
FORENSIC_CHECKS = ("altmanZ", "accrualDivergence", "receivablesVsRevenue", "inventoryBuild", "grossMarginErosion", "shareCountGrowth",
                   "earningsQualityIndex")
EV_EXCLUDED_SECTORS = ("Financials", "Real Estate")
