"""Named rule chains over the newest metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancebeam.functions.dims import STRATEGIES


def rule(metric: str, op: str, limit: float) -> Column:
    v = F.col(metric)
    return {">": v > limit, ">=": v >= limit, "<": v < limit, "<=": v <= limit, "between": (v > 0) & (v < limit)}[op]


def strategy_eval(latest: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """One row per entity and strategy: rules passed, computable and not, and whether it qualifies.

    ``qualifies`` is NULL when the missing rules could still make it pass. All rules are Columns over one row, so nothing is joined or shuffled.
    """
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    rows = []
    for key, name, rules, needed in strategies:
        results = [rule(*r) for r in rules]
        passed = add([F.coalesce(r.cast("int"), F.lit(0)) for r in results])
        missing = add([r.isNull().cast("int") for r in results])
        qualifies = F.when(passed >= needed, True).when(passed + missing < needed, False)
        rows.append(F.struct(F.lit(key).alias("strategy"), F.lit(name).alias("name"), passed.alias("passed"), (F.lit(len(rules)) - missing).alias("total"),
                             missing.alias("not_computable"), qualifies.alias("qualifies")))
    return latest.select("ticker", F.inline(F.array(*rows)))


def strategy_order(evaluated: DataFrame) -> DataFrame:
    """Per entity: most rules passed, then fewest gaps, then name."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy(F.desc("passed"), "not_computable", "name")
    return evaluated.withColumn("place", F.row_number().over(w))
