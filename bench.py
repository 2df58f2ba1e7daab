"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with warm wall seconds."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from balancebeam.operators import rollup, xs  # noqa: E402
from catalog import QUERIES  # noqa: E402
from catalog.base import companies, wide_panel  # noqa: E402
from catalog.ranking import REWEIGHT  # noqa: E402

HEADLINE = ("metric_panel_wide", "rank_end_to_end", "forensic_report", "capalloc_summary", "own_history_distribution", "scenario_sweep", "strategy_eval",
            "reverse_dcf_grid", "fact_tag_fallback", "pit_value_asof", "join_asof_backward", "join_nearest", "pit_rank_by_date", "sent_score_text", "mom_snapshot")


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    seconds: dict[str, float] = {}

    def measure(name, build) -> None:
        build_and_run = lambda: consume(build())
        build_and_run()
        t = time.time()
        build_and_run()
        seconds[name] = round(time.time() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    for name in HEADLINE:
        measure(name, lambda name=name: QUERIES[name](spark, sf_dir))
    # the reference's interactive case: unit scores are stored, only the weights change
    registry, config, everyone = xs.enabled_metrics(), xs.RankConfig(), companies(spark, sf_dir)
    xs.unit_scores(xs.values_from_wide(wide_panel(spark, sf_dir), config, registry), config, registry).write.parquet(f"{scratch}/unit_scores")
    stored = spark.read.parquet(f"{scratch}/unit_scores")
    measure("rank_reweight", lambda: rollup.aggregate_rankings(stored, everyone, REWEIGHT, registry))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
