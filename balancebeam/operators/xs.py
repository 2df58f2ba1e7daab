"""Cross-sectional normalisation: winsorise, percentile or z-score, sector peers, sign split, peer ranks.

Input rows are (entity key, metric number, year_index, sector, value). Universe order is ticker ascending.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancebeam.functions import dims
from balancebeam.functions.scalars import clamp, finite, logistic
from balancebeam.metrics.registry import CATEGORY_WEIGHTS, YEAR_WEIGHTS, Metric, metrics
from balancebeam.operators import blocks
from balancebeam.operators.positions import SLICES, positions
from balancebeam.operators.sector import canonical_sector
from balancebeam.session import emptied, stored, stored_alone

# Negatives of a mixed group score below this, positives from one half up: the bands never meet.
NEGATIVE_CEILING = 0.5 - 1e-9
# A spread below this share of the values is rounding residue of a constant ratio: its deviation counts as zero.
CONSTANT_SPREAD = 1e-12
TURNS = 2  # of metrics: what a turn places is reduced to what later steps need before the next begins
TURN_SLICES = 6  # of a turn: it places whole groups in so many parts


@dataclass(frozen=True)
class RankConfig:
    category_weights: dict[str, float] = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))
    metric_weights: dict[str, float] = field(default_factory=dict)
    method: str = "percentile"  # or 'zscore'
    winsor_lower: float = 0.01
    winsor_upper: float = 0.99
    years: int = 5


def enabled_metrics(registry: list[Metric] | None = None) -> list[Metric]:
    return [m for m in (registry or metrics()) if m.enabled]


def _flag(registry: list[Metric], keep) -> Column:
    """Whether metric number ``m`` has a property, read from a constant array."""
    return F.expr("element_at(array(" + ", ".join(str(bool(keep(m))).lower() for m in registry) + "), m + 1)")


def applicable_value(m: Metric) -> str:
    """SQL text of the metric column, NULL where it does not describe the row's canonical sector ``canon``; gating costs no join."""
    if m.key in dims.SECTOR_ONLY:
        return f"if(canon <=> '{dims.SECTOR_ONLY[m.key]}', {m.key}, null)"
    barred = [name for name, groups in dims.SECTOR_EXCLUDED.items() if any(m.key in ks for ks in groups.values())]
    return f"if(canon in ({', '.join(repr(b) for b in barred)}), null, {m.key})" if barred else m.key


def values_from_wide(wide: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...] = (), turn: int = 0, turns: int = 1) -> DataFrame:
    """Unpivot a wide panel to numbered metric values; missing and inapplicable values leave before any shuffle. Of several turns each has its own metrics, and their columns only are read."""
    rows = wide.filter(F.col("year_index") < config.years).withColumn("canon", canonical_sector(F.col("sector")))
    cells = F.expr("array(" + ", ".join(applicable_value(m) for m in registry[turn::turns]) + ")")
    long = rows.select(*by, "ticker", "sector", "year_index", F.posexplode(cells).alias("m", "v")).filter(F.abs("v") < float("inf"))
    return long if turns == 1 else long.withColumn("m", F.col("m") * turns + turn)


def turns_of(registry: list) -> int:
    return max(1, min(TURNS, len(registry)))


def unit_scores(values: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...] = (), slices: int = SLICES) -> DataFrame:
    """(by, ticker, m, year_index, score, peer_rank, peer_count): score in [0, 1], higher is better; rank 1 is best.

    One row of ``values`` per entity, metric and year. Peer groups with fewer than two values give no score.
    """
    return _scored(_placed(values, config, registry, by, slices), config, registry, by)


def unit_scores_in_turns(wide: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """``unit_scores`` of a wide panel, metrics in turns. Only places are kept and not the values: a place and a few counts give the score.

    ``wide`` is read once a turn: it should be stored, or quickly derived from what is. ``ordered``: see ``blocks.placed``.
    """
    if config.method == "percentile":
        return kept_scores(wide, config, registry, by, ordered).scores()
    n = turns_of(registry)
    turns = [lambda k=k: _placed(values_from_wide(wide, config, registry, by, k, n), config, registry, by, TURN_SLICES) for k in range(n)]
    return _scored(stored_alone(*turns), config, registry, by)


@dataclass(frozen=True)
class KeptScores:
    """Percentile scores of a wide panel, kept as the places of their values: a pass over them gives the scores, or rolls up their years."""

    found: DataFrame
    cells: dict[str, blocks.Cell]
    tails: DataFrame
    config: RankConfig
    registry: list[Metric]
    by: tuple[str, ...]
    kinds: str  # of by, ticker

    def scores(self) -> DataFrame:
        """As ``unit_scores``."""
        registry, keys = self.registry, [*self.by, "ticker"]

        def make(header: pa.Table, cells: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for c, idx, place, earlier in cells:
                if c.n >= 2:
                    at = pa.array(idx)
                    score, rank = _unit_scores(c, place, earlier, registry[c.m])
                    columns = {k: header[k].combine_chunks().take(at) for k in keys} | {"m": np.full(len(idx), c.m, np.int32), "year_index": header["year_index"].combine_chunks().take(at).cast(pa.int32())}
                    yield pa.RecordBatch.from_pydict(columns | {"score": score, "peer_rank": rank, "peer_count": np.full(len(idx), c.n, np.int64)})

        return blocks.assembled(self.found, self.cells, self.tails, make, f"{self.kinds}, m int, year_index int, score double, peer_rank long, peer_count long")

    def rolled(self, years: int) -> DataFrame:
        """(by, ticker, m, score): year weights renormalised over the years present."""
        registry, keys, weights = self.registry, [*self.by, "ticker"], YEAR_WEIGHTS[: max(0, years)]

        def make(header: pa.Table, cells: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            code = np.zeros(header.num_rows, np.int64)
            for k in keys:
                d = pc.dictionary_encode(header[k].combine_chunks(), null_encoding="encode")
                code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
            _, first, entity = np.unique(code, return_index=True, return_inverse=True)
            year, sums = header["year_index"].to_numpy(), {}
            for c, idx, place, earlier in cells:
                if c.n >= 2 and year[idx[0]] < len(weights):
                    w = weights[int(year[idx[0]])]
                    total = sums.setdefault(c.m, np.zeros((2, len(first))))
                    total[0] += np.bincount(entity[idx], weights=w * _unit_scores(c, place, earlier, registry[c.m])[0], minlength=len(first))
                    total[1] += np.bincount(entity[idx], weights=np.full(len(idx), w), minlength=len(first))
            for m, (score, weight) in sums.items():
                have = np.flatnonzero(weight > 0)
                at = pa.array(first[have])
                yield pa.RecordBatch.from_pydict({k: header[k].combine_chunks().take(at) for k in keys} | {"m": np.full(len(have), m, np.int32), "score": score[have] / weight[have]})

        return blocks.assembled(self.found, self.cells, self.tails, make, f"{self.kinds}, m int, score double")


def kept_scores(wide: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...] = (), ordered: bool = False) -> KeptScores:
    """The percentile scores of a wide panel. Metrics are placed in turns: the disk holds the values of one turn on their way, and what comes back of all, a place per value."""
    n = turns_of(registry)
    rows = wide.filter(F.col("year_index") < config.years).withColumn("canon", canonical_sector(F.col("sector")))
    peer = F.coalesce("sector", F.lit("~"))

    def turn(k: int) -> DataFrame:
        cells = {i: F.expr(applicable_value(registry[i])) for i in range(k, len(registry), n)}
        return blocks.placed(rows, cells, by, [registry[i].sector_relative for i in cells], peer, k, ordered)

    found = stored_alone(*[lambda k=k: turn(k) for k in range(n)])
    if ordered:
        blocks.in_order(found)
    cells = blocks.sized(found)
    blocks.with_tails(cells, found, config.winsor_lower, config.winsor_upper, lambda m: registry[m].negative_is_bad)
    return KeptScores(found, cells, stored(blocks.earlier(found, cells)), config, registry, by, _kinds(wide, [*by, "ticker"]))


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _unit_scores(c: blocks.Cell, place: np.ndarray, earlier: Sequence[int], metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Score and rank of the values at some places of a peer group. Clamping to the bounds changes no order but in the two tails, where entities then stand in their own order."""
    score, rank = np.empty(len(place)), np.empty(len(place), np.int64)
    for k, (start, n, low, high) in enumerate(c.sides):
        side = (place > start) & (place <= start + n)
        at = place[side]
        w = at - start
        for tail, base, before in ((at <= low, 0, earlier[2 * k]), (at >= high, high - 1 - start, earlier[2 * k + 1])):
            w[tail] = base + before + np.arange(1, int(tail.sum()) + 1)
        low_side = c.split and k == 0
        # a whole group that is not positive is scored by closeness to zero, without the metric's direction
        rising = low_side or (metric.negative_is_bad and c.n_pos == 0) or metric.direction != "asc"
        unit = np.ones(len(w)) if n == 1 else (w - 1) / float(n - 1)
        directed = unit if rising else 1 - unit
        score[side] = directed if not c.split else unit * NEGATIVE_CEILING if low_side else 0.5 + 0.5 * directed
        rank[side] = (c.n_pos if low_side else 0) + (n - w + 1 if rising else w)
    return score, rank


def _placed(values: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...], slices: int) -> DataFrame:
    """What scores and ranks hang on: by percentile the place within the side of the peer group and the counts, by z-score the score itself and its place."""
    neg = _flag(registry, lambda x: x.negative_is_bad)
    rel = _flag(registry, lambda x: x.sector_relative)
    rows = values.select(*by, "m", "year_index", F.when(rel, F.coalesce("sector", F.lit("~"))).otherwise("").alias("peer"),
                         "ticker", F.col("v").alias("v"))
    group = [*by, "m", "year_index", "peer"]
    totals = {"n": F.count(F.lit(1)), "n_pos": F.count(F.when(F.col("v") > 0, True))}
    counted = positions(rows, group, [F.col("v"), F.col("ticker")], "r", totals, few=True, slices=slices).filter(F.col("n") >= 2)
    counted = (
        counted.withColumn("split", _split(neg))
        .withColumn("low_side", F.col("split") & (F.col("v") <= 0))
        .withColumn("n_side", F.when(~F.col("split"), F.col("n")).when(F.col("low_side"), F.col("n") - F.col("n_pos")).otherwise(F.col("n_pos")))
        .withColumn("r_side", F.when(F.col("split") & ~F.col("low_side"), F.col("r") - (F.col("n") - F.col("n_pos"))).otherwise(F.col("r")))
    )
    # winsor bounds are order statistics of the side, not interpolated percentiles
    lo_at = F.floor(F.lit(config.winsor_lower) * (F.col("n_side") - 1)) + 1
    hi_at = F.ceil(F.lit(config.winsor_upper) * (F.col("n_side") - 1)) + 1
    bounds = {}
    for side, cond in (("low", F.col("low_side")), ("high", ~F.col("low_side"))):
        bounds[f"lb_{side}"] = F.max(F.when(cond & (F.col("r_side") == lo_at), F.col("v")))
        bounds[f"ub_{side}"] = F.max(F.when(cond & (F.col("r_side") == hi_at), F.col("v")))
    bounded = _attach(counted, group, bounds)
    pick = lambda b: F.when(F.col("low_side"), F.col(f"{b}_low")).otherwise(F.col(f"{b}_high"))
    bounded = bounded.withColumns({"lb": pick("lb"), "ub": pick("ub"), "high_side": ~F.col("low_side")}).drop("lb_low", "lb_high", "ub_low", "ub_high", "r")
    bounded = bounded.withColumn("wv", clamp("v", "lb", "ub")).drop("v")
    side = [*group, "high_side"]
    if config.method == "percentile":
        return _clamped_positions(bounded, side).select(*by, "ticker", "m", "year_index", "n", "n_pos", "low_side", "n_side", "rw")
    stats = {"mu": F.avg("wv"), "sd": F.stddev_pop("wv"), "w_min": F.min("wv"), "w_max": F.max("wv")}
    z = F.when(_constant("w_min", "w_max"), F.lit(0.0)).otherwise((F.col("wv") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)))
    scored = _attach(bounded, side, stats).select(*group, "ticker", "n", _banded(logistic(z), _rising(registry)).alias("score"))
    # ranked by nine decimals, as overall scores are, so that a rank does not hang on the last bits of a mean
    scored = positions(scored, group, [F.floor(F.col("score") * 1e9 + 0.5).desc(), F.col("ticker")], "peer_rank", few=True, slices=slices)
    return scored.select(*by, "ticker", "m", "year_index", "n", "score", "peer_rank")


def _scored(placed: DataFrame, config: RankConfig, registry: list[Metric], by: tuple[str, ...]) -> DataFrame:
    if config.method == "percentile":
        rising = _rising(registry)
        unit = F.when(F.col("n_side") == 1, F.lit(1.0)).otherwise((F.col("rw") - 1) / F.nullif((F.col("n_side") - 1).cast("double"), F.lit(0.0)))
        rank = F.when(F.col("low_side"), F.col("n_pos")).otherwise(0) + F.when(rising, F.col("n_side") - F.col("rw") + 1).otherwise(F.col("rw"))
        split = _split(_flag(registry, lambda x: x.negative_is_bad))
        placed = placed.withColumn("split", split).withColumns({"score": _banded(unit, rising), "peer_rank": rank})
    return placed.select(*by, "ticker", "m", "year_index", "score", F.col("peer_rank").cast("long").alias("peer_rank"), F.col("n").alias("peer_count"))


def _split(neg: Column) -> Column:
    return neg & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))


def _rising(registry: list[Metric]) -> Column:
    """A whole group that is not positive is scored by closeness to zero, without the metric's direction."""
    neg, flip = _flag(registry, lambda x: x.negative_is_bad), _flag(registry, lambda x: x.direction == "asc")
    return F.when(F.col("low_side") | (neg & (F.col("n_pos") == 0)), F.lit(True)).otherwise(~flip)


def _constant(lo: str, hi: str) -> Column:
    return (F.col(hi) - F.col(lo)) <= CONSTANT_SPREAD * F.greatest(F.abs(lo), F.abs(hi))


def _banded(unit: Column, rising: Column) -> Column:
    directed = F.when(rising, unit).otherwise(1 - unit)
    return F.when(~F.col("split"), directed).when(F.col("low_side"), unit * NEGATIVE_CEILING).otherwise(0.5 + 0.5 * directed)


def _clamped_positions(bounded: DataFrame, side: list[str]) -> DataFrame:
    """Add ``rw``, the position by (clamped value, ticker) within ``side``. Between the bounds clamping changes no order, so only the two tails are numbered again:
    each is a run of positions, dealt anew by ticker."""
    inside = (F.col("lb") < F.col("wv")) & (F.col("wv") < F.col("ub"))
    tails = bounded.filter(~inside).withColumn("tail", (F.col("wv") == F.col("ub")) & (F.col("lb") < F.col("ub")))
    run, spent = [*side, "tail"], ["r_side", "lb", "ub", "wv"]
    dealt = positions(tails.drop(*spent), run, [F.col("ticker")], "k", {"n_run": F.count(F.lit(1))}, few=True)
    start = F.when(F.col("tail"), F.col("n_side") - F.col("n_run")).otherwise(0)
    return bounded.filter(inside).withColumn("rw", F.col("r_side")).drop(*spent).unionByName(dealt.withColumn("rw", start + F.col("k")).drop("tail", "k", "n_run"))


def _attach(df: DataFrame, group: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group statistics on every row, by partial aggregation and a broadcast of one row per peer group: metrics x years x sectors x dates, however many entities. They are written, so that each is taken once."""
    return df.join(F.broadcast(stored(_aggregated(df, group, aggs))), group)


def _aggregated(df: DataFrame, group: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*group).agg(*[a.alias(k) for k, a in aggs.items()])


def winsorize(df: DataFrame, group: list[str], value: str, key: str, lower: float, upper: float, turns: Sequence[DataFrame] = (), metrics: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Add ``winsorized``: the value clamped to two order statistics of its group.

    ``turns``: the rows of ``df`` in parts that hold whole groups. Then one part after another is placed and only its bounds are kept; ``df`` is read again for the values.
    ``metrics``: ``df`` is a wide panel with these columns, the group is (metric_key, year_index) and the result has a row per value, without the value itself. ``ordered``: see ``blocks.placed``.
    """
    if metrics:
        return _winsorized_wide(df, key, lower, upper, list(metrics), ordered)
    at = lambda p, f: f(F.lit(p) * (F.col("_n") - 1)) + 1
    bounds = {"_lb": F.max(F.when(F.col("_r") == at(lower, F.floor), F.col(value))), "_ub": F.max(F.when(F.col("_r") == at(upper, F.ceil), F.col(value)))}
    if turns:
        found = stored_alone(*[lambda part=part: _aggregated(_counted(part, group, value, key, TURN_SLICES), group, bounds) for part in turns])
        bounded = df.join(F.broadcast(found), group)
    else:
        bounded = _attach(_counted(df, group, value, key, SLICES), group, bounds).drop("_r", "_n")
    return bounded.withColumn("winsorized", clamp(value, "_lb", "_ub")).drop("_lb", "_ub")


def _winsorized_wide(wide: DataFrame, key: str, lower: float, upper: float, metrics: list[str], ordered: bool) -> DataFrame:
    """Bounds of all metrics, turn by turn from values in their order; then they are clamped in the wide rows, which become long last."""
    rows, years, n = _by_entity(wide, key), {}, turns_of(metrics)
    for k in range(n):
        found = stored_alone(lambda k=k: blocks.placed(rows, {i: F.col(metrics[i]) for i in range(k, len(metrics), n)}, (), [False] * len(metrics[k::n]), F.lit(""), k, ordered, keep_values=True))
        cells = blocks.sized(found)
        ends = {name: (math.floor(lower * (c.n - 1)), math.ceil(upper * (c.n - 1))) for name, c in cells.items()}
        held = blocks.values_at(found, cells, {name: sorted(set(e)) for name, e in ends.items()})
        for name, c in cells.items():
            bounds = years.setdefault(ast.literal_eval(name)[0], ([None] * len(metrics), [None] * len(metrics)))
            bounds[0][c.m], bounds[1][c.m] = (held[name, p] for p in ends[name])
        emptied(found)
    found = wide.sparkSession.createDataFrame([(y, *b) for y, b in years.items()], f"_y {wide.schema['year_index'].dataType.simpleString()}, _lb array<double>, _ub array<double>")
    bounded = wide.join(F.broadcast(found), F.col("year_index").eqNullSafe(F.col("_y")))  # a row per year
    cells = [clamp(finite(c), F.get("_lb", F.lit(i)), F.get("_ub", F.lit(i))).alias(c) for i, c in enumerate(metrics)]
    return bounded.select(key, "year_index", *cells).unpivot([key, "year_index"], metrics, "metric_key", "winsorized").filter("winsorized is not null")


def percentile_rank(df: DataFrame, group: list[str], value: str, key: str, turns: Sequence[DataFrame] = (), metrics: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Add ``percentile`` in [0, 1]: row position over n - 1, ties by key; a group of one scores 1.

    ``turns``: the rows of ``df`` in parts that hold whole groups. Then one part after another is placed, and only places are kept: ``df`` is not read, and the value is left out.
    ``metrics``: ``df`` is a wide panel with these columns, the group is (metric_key, year_index) and the result has a row per value, without the value itself. ``ordered``: see ``blocks.placed``.
    """
    if metrics:
        return _percentiles_wide(df, key, list(metrics), ordered)
    if turns:
        counted = stored_alone(*[lambda part=part: _counted(part, group, value, key, TURN_SLICES).drop(value) for part in turns])
    else:
        counted = _counted(df, group, value, key, SLICES)
    pct = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise((F.col("_r") - 1) / F.nullif((F.col("_n") - 1).cast("double"), F.lit(0.0)))
    return counted.withColumn("percentile", pct).drop("_r", "_n")


def _percentiles_wide(wide: DataFrame, key: str, metrics: list[str], ordered: bool) -> DataFrame:
    rows, n = _by_entity(wide, key), turns_of(metrics)
    found = stored_alone(*[lambda k=k: blocks.placed(rows, {i: F.col(metrics[i]) for i in range(k, len(metrics), n)}, (), [False] * len(metrics[k::n]), F.lit(""), k, ordered) for k in range(n)])
    if ordered:
        blocks.in_order(found)

    def make(header: pa.Table, cells: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for c, idx, place, _ in cells:
            at = pa.array(idx)
            columns = {k: header[k].combine_chunks().take(at) for k in ("ticker", "year_index")}
            name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(idx), np.int32)), pa.array([metrics[c.m]])).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns | {"metric_key": name, "percentile": np.ones(len(idx)) if c.n == 1 else (place - 1) / float(c.n - 1)})

    out = blocks.assembled(found, blocks.sized(found), None, make, f"{_kinds(rows, ['ticker', 'year_index'])}, metric_key string, percentile double")
    return out.withColumnRenamed("ticker", key)


def _by_entity(wide: DataFrame, key: str) -> DataFrame:
    return wide if key == "ticker" else wide.withColumnRenamed(key, "ticker")


def _counted(df: DataFrame, group: list[str], value: str, key: str, slices: int) -> DataFrame:
    return positions(df, group, [F.col(value), F.col(key)], "_r", {"_n": F.count(F.lit(1))}, few=True, slices=slices)


def zscore(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add ``zscore`` (population deviation, 0 in a constant group) and ``unit_score``, its logistic."""
    stats = {"_mu": F.avg(value), "_sd": F.stddev_pop(value), "_lo": F.min(value), "_hi": F.max(value)}
    z = F.when(_constant("_lo", "_hi"), F.lit(0.0)).otherwise((F.col(value) - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    return _attach(df, group, stats).withColumn("zscore", z).withColumn("unit_score", logistic("zscore")).drop(*stats)
