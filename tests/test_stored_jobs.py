"""Stored, incremental jobs: replayed and failed batches, empty fetches, late rows; whole documents of facts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from balancebeam.operators import facts
from balancebeam.sources.store import KeyedStore
from balancebeam.streaming import incremental

HEADLINES = "doc_id bigint, ticker string, source string, title string, fetched_at int"


def rows_of(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_a_store_replaces_keys_and_only_their_buckets(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], "k string, v int", 8)
    put = lambda n, keys, rows: store.replace(n, spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame(rows, "v int, k string"))
    assert rows_of(store) == []
    put(0, "abc", [(1, "a"), (2, "a"), (3, "b")])
    assert rows_of(store) == [("a", 1), ("a", 2), ("b", 3)]
    put(1, ["a", "d"], [(9, "d")])  # a comes back empty
    assert rows_of(store) == [("b", 3), ("d", 9)]
    before = store.versions()
    put(2, ["b", None], [(4, "b"), (5, None)])
    now = store.versions()
    assert sum(now[b] == 2 for b in now) <= 2 and all(now[b] == v for b, v in before.items() if now[b] != 2)
    want = [(r.k, r.v) for r in store.read().orderBy("k").collect()]
    assert want == [(None, 5), ("b", 4), ("d", 9)]
    put(2, ["b", None], [(4, "b"), (5, None)])  # replayed
    assert [(r.k, r.v) for r in store.read().orderBy("k").collect()] == want
    put(3, [], [])
    assert [(r.k, r.v) for r in store.read().orderBy("k").collect()] == want


def test_a_batch_that_fails_before_its_manifest_changes_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], "k string, v int", 4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    store.replace(0, frame([("a", 1), ("b", 2)]), frame([("a", 1), ("b", 2)]))
    # files of a batch 1 that never wrote its manifest
    frame([("a", 7)]).withColumn("_version", F.lit(1).cast("bigint")).withColumn("_bucket", store._bucket()).write.mode("append").partitionBy("_version", "_bucket").parquet(f"{store.path}/data")
    assert rows_of(store) == [("a", 1), ("b", 2)]
    store.replace(1, frame([("a", 0)]), frame([("a", 5)]))
    assert rows_of(store) == [("a", 5), ("b", 2)]


def test_fetches_replace_their_source_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["ticker", "source"], "ticker string, source string, doc_id bigint, score double", 8)
    scored = []

    def score(df):
        scored.append(df.count())
        return df.withColumn("score", F.length("title").cast("double"))

    source, schema = str(tmp_path / "in"), HEADLINES
    stream = spark.readStream.schema(schema).parquet(f"{source}/*")
    batches = [
        [(1, "T", "a", "x", 0), (2, "T", "b", "xx", 0), (3, "U", "a", "xxx", 0)],
        [(4, "T", "a", "new", 2), (5, "T", "a", "older fetch", 1), (None, "U", "a", None, 2)],
        [(6, "V", None, "", 3), (7, "T", "b", None, 3)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(f"{source}/{k}")
        incremental.refresh_sentiment(stream, store, score, str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.ticker, r.source, r.doc_id) for r in store.read().collect()}
    assert got == {("T", "a", 4), ("V", None, 6), ("T", "b", 7)} and scored == [3, 1, 2]
    incremental.apply_fetch(spark.createDataFrame(batches[2], schema), 2, store, score)
    assert {(r.ticker, r.source, r.doc_id) for r in store.read().collect()} == got


def test_a_stream_of_quotes_takes_disorder_and_leaves_late_rows_out(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    batches = [
        [(1, at(1, 9), 1, 10.0), (1, at(1, 17), 2, 11.0), (2, at(2, 8), 3, 20.0)],
        [(1, at(1, 12), 4, 99.0), (1, at(1, 17), 5, 12.0), (1, at(9, 10), 6, 30.0)],  # disorder within the lateness; a tie in time goes to the larger event
        [(1, at(1, 23), 7, 77.0), (1, at(9, 9), 8, 31.0), (2, at(9, 9), 9, 21.0)],  # the first is late: its day is closed
    ]
    source = str(tmp_path / "in")
    stream = spark.readStream.schema("entity bigint, ts timestamp, event_id bigint, value double").parquet(f"{source}/*")
    store = incremental.quote_store(spark, str(tmp_path / "s"), 8)
    for k, rows in enumerate(batches):  # every run goes on from the checkpoint
        spark.createDataFrame(rows, "entity bigint, ts timestamp, event_id bigint, value double").write.parquet(f"{source}/{k}")
        incremental.stream_daily(stream, store, str(tmp_path / "ckpt"), "2 days").awaitTermination()
    got = sorted((r.entity, r.date.day, r.close) for r in store.read().collect())
    assert got == [(1, 1, 12.0), (1, 9, 30.0), (2, 2, 20.0), (2, 9, 21.0)]


def test_facts_of_a_whole_document(spark):
    fact = lambda v, **more: {"start": "2020-01-01", "end": "2020-12-31", "val": v, "fy": 2020, "fp": "FY", "form": "10-K", "filed": "2021-02-01", **more}
    doc = {"cik": 1, "facts": {
        "us-gaap": {
            "Assets": {"label": "x", "units": {"EUR": [fact(0)], "shares": [fact(3)], "USD": [fact(1), fact(2, fy=None, start=None, extra={"a": [1]}), fact("text", fy="no", end="2020-13-45")]}},
            "Empty": {"units": {"USD": []}}, "NoArray": {"units": {"USD": {"a": 1}, "shares": [fact(9)]}}, "Null": {"units": {"USD": None, "shares": [fact(9)]}}, "NoUnits": {"label": "x"}, "Odd": {"units": {"USD": [1, None]}}},
        "dei": {"Float": {"units": {"USD/shares": [fact(1.5)]}}}, "ifrs": {}}}
    texts = [(1, json.dumps(doc)), (2, "no json"), (3, None), (4, ""), (5, "[]"), (6, '{"facts": 3}'), (7, '{"facts": null}')]
    out = facts.explode_companyfacts(spark.createDataFrame(texts, "ticker int, json string"))
    got = sorted([(r.ticker, r.taxonomy, r.tag, r.unit, r.val, r.fy, r.fp, str(r.start_date), str(r.end_date)) for r in out.collect()], key=repr)
    one = (1, "us-gaap", "Assets", "USD")
    want = [(*one, 1.0, 2020, "FY", "2020-01-01", "2020-12-31"), (*one, 2.0, None, "FY", "None", "2020-12-31"), (*one, None, None, "FY", "2020-01-01", "None"), (1, "dei", "Float", "USD/shares", 1.5, 2020, "FY", "2020-01-01", "2020-12-31")]
    odd = [(1, "us-gaap", "Odd", "USD", None, None, None, "None", "None")] * 2
    assert got == sorted(want + odd, key=repr)


@pytest.mark.parametrize("facts_in", [1, 4000])
def test_facts_of_a_large_document(spark, facts_in):
    text = json.dumps({"facts": {"us-gaap": {f"T{k}": {"units": {"USD": [{"end": "2020-12-31", "val": k + j} for j in range(10)]}} for k in range(facts_in // 10 or 1)}}})
    out = facts.explode_companyfacts(spark.createDataFrame([(1, text)], "ticker int, json string"))
    assert out.count() == 10 * (facts_in // 10 or 1)
