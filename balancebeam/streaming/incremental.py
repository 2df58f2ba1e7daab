"""Incremental jobs as Structured Streaming pipelines and their batch equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from balancebeam.operators.sentiment import carry_forward
from balancebeam.session import ensure_checkpoint_dir
from balancebeam.sources.sinks import latest_per_key, overwrite_days
from balancebeam.sources.store import KeyedStore


def daily_quotes(ticks: DataFrame, lateness: str = "2 days") -> DataFrame:
    """One row per (entity, day), last write wins. On a stream the state per day is one struct and is dropped after the lateness; on a batch it is the same
    aggregate.

    ``ticks``: (entity, ts, event_id, value).
    """
    source = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    day = F.window("ts", "1 day")
    picked = source.groupBy("entity", day.alias("w")).agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    return picked.select("entity", F.to_date("w.start").alias("date"), F.col("r.value").alias("close"))


QUOTES = "entity bigint, date date, ts timestamp, event_id bigint, close double"


def quote_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    """Daily quotes by (entity, date), in buckets of days, so that a batch rewrites the days it touches."""
    return KeyedStore(spark, path, ["entity", "date"], QUOTES, buckets, ["date"])


def stream_daily(ticks: DataFrame, store: KeyedStore, checkpoint: str, lateness: str = "2 days") -> StreamingQuery:
    """Keep each day's last tick in the state store until the watermark passes the day; every batch puts the days that changed into ``store``.

    ``ticks``: a stream of (entity, ts, event_id, value). Last write wins by (ts, event_id), in whatever order ticks arrive. Late rows: a tick more than ``lateness`` behind the newest
    tick of earlier batches belongs to a closed day if the watermark has passed that day's end; it is then left out and the stored day stays (``upsert_daily`` repairs closed days).
    A run that is started again goes on from the checkpoint.
    """
    day = ticks.withWatermark("ts", lateness).groupBy("entity", F.window("ts", "1 day").alias("w")).agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    rows = day.select("entity", F.to_date("w.start").alias("date"), "r.ts", "r.event_id", F.col("r.value").alias("close"))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.checkpoint()  # the state is advanced once
        store.replace(number, rows, rows)

    ensure_checkpoint_dir(ticks.sparkSession)
    return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_daily(ticks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is available and replace the touched days: new quotes merged with the stored day, last write wins."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("entity", F.to_date("ts").alias("date"), "ts", "event_id", "value")
        days = rows.select("date").distinct()
        try:
            stored = spark.read.parquet(path).join(days, "date", "left_semi").select(*rows.columns)
            rows = rows.unionByName(stored)
        except Exception as e:  # first run: nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        merged = latest_per_key(rows, ["entity", "date"], ["ts", "event_id"])
        # written through the checkpoint, because the job replaces partitions it also reads
        overwrite_days(merged.checkpoint(), path)

    ensure_checkpoint_dir(ticks.sparkSession)
    return ticks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_append(changes: DataFrame, path: str, checkpoint: str, rank: Callable[[DataFrame], DataFrame], day: str = "date") -> StreamingQuery:
    """Keep each micro-batch's input by day and batch, then rank all input of the touched days and replace their snapshots.

    A day may span any number of batches; a batch that is replayed replaces its own input, so a rerun changes nothing. Inputs lie in ``path`` + "-input".
    """
    inputs = f"{path}-input"

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "_batch").parquet(inputs)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(inputs)
        overwrite_days(rank(stored.join(batch.select(day).distinct(), day, "left_semi").select(*batch.columns)), path, day)
        batch.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restatements(old: DataFrame, new: DataFrame) -> DataFrame:
    """Periods whose filing date advanced: the restatement signal."""
    o = old.select("ticker", "period_key", F.col("filed_at").alias("old_filed_at"))
    return new.select("ticker", "period_key", "filed_at").join(o, ["ticker", "period_key"]).filter("filed_at > old_filed_at")


def affected(table: DataFrame, changed: DataFrame) -> DataFrame:
    """Only refreshed entities have their metrics recomputed."""
    return table.join(changed.select("ticker").distinct(), "ticker", "left_semi")


def merge_sentiment(stored: DataFrame, fresh: DataFrame, fetched: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score the fetched headlines and carry the rest forward."""
    return carry_forward(stored, score(fresh), fetched)


def apply_fetch(batch: DataFrame, number: int, store: KeyedStore, score: Callable[[DataFrame], DataFrame], headline: str = "doc_id") -> None:
    """One batch of fetches into ``store``, keyed by (ticker, source): what a fetch returned replaces that source's headlines, even by none; other sources keep theirs.

    ``batch``: a row per headline with ``fetched_at``; a fetch that came back empty is a row without ``headline``. Of several fetches of a source the newest counts. Only fetched headlines
    are scored. Applied again under its number, the batch changes nothing.
    """
    batch = batch.persist()
    newest = batch.groupBy(*store.keys).agg(F.max("fetched_at").alias("fetched_at"))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in (*store.keys, "fetched_at")]
    rows = batch.filter(F.col(headline).isNotNull()).alias("b").join(newest.alias("n"), same, "left_semi")
    store.replace(number, newest, score(rows))
    batch.unpersist()


def refresh_sentiment(fetches: DataFrame, store: KeyedStore, score: Callable[[DataFrame], DataFrame], checkpoint: str, headline: str = "doc_id") -> StreamingQuery:
    """Apply the fetches that are available, batch by batch (``apply_fetch``)."""
    merge = lambda batch, number: apply_fetch(batch, number, store, score, headline)
    return fetches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
