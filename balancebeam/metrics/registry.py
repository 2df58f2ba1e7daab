"""The metric registry: one entry per metric, each with a Column builder over the prepared panel.

``register_metric`` is the extension point: a key, its flags and a function returning a Column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

# Category order, default category weights, year weights, weight per verdict.
CATEGORIES = ("valuation", "profitability", "growth", "cashGeneration", "financialStrength", "capitalAllocation",
              "efficiency", "earningsQuality", "moat", "momentum")
CATEGORY_WEIGHTS = {"valuation": 0.2, "profitability": 0.15, "growth": 0.15, "cashGeneration": 0.1, "financialStrength": 0.1,
                    "capitalAllocation": 0.1, "efficiency": 0.1, "earningsQuality": 0.05, "moat": 0.05, "momentum": 0.0}
YEAR_WEIGHTS = (0.35, 0.25, 0.2, 0.1, 0.1)
VERDICT_WEIGHT = {"core": 1.0, "supporting": 0.66, "caveat": 0.33, "not-value-investing": 1.0}


@dataclass(frozen=True)
class Metric:
    key: str
    category: str
    direction: str  # 'desc': higher is better
    verdict: str
    expr: Callable[[], Column]
    negative_is_bad: bool = False
    sector_relative: bool = False
    enabled: bool = True

    @property
    def default_weight(self) -> float:
        return VERDICT_WEIGHT[self.verdict]


REGISTRY: dict[str, Metric] = {}


def register_metric(key: str, category: str, direction: str, verdict: str, expr: Callable[[], Column], *,
                    negative_is_bad: bool = False, sector_relative: bool = False, enabled: bool = True) -> Metric:
    if key in REGISTRY:
        raise ValueError(f"metric {key} is already registered")
    if category not in CATEGORIES or direction not in ("asc", "desc") or verdict not in VERDICT_WEIGHT:
        raise ValueError(f"metric {key}: unknown category, direction or verdict")
    REGISTRY[key] = Metric(key, category, direction, verdict, expr, negative_is_bad, sector_relative, enabled)
    return REGISTRY[key]


def metrics() -> list[Metric]:
    from balancebeam.metrics import catalogue  # noqa: F401  (fills the registry)

    return list(REGISTRY.values())


def metric_rows() -> list[tuple]:
    return [(i, m.key, m.category, m.direction, m.verdict, m.default_weight, m.negative_is_bad, m.sector_relative, m.enabled)
            for i, m in enumerate(metrics())]
