"""Lexicon scoring of text, per-source summaries and their aggregate.

Scoring stays inside one row: a text becomes a token array and its matches are counted with array functions, so nothing is shuffled and a very long
text or a source with most of the headlines costs no more than its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancebeam.functions.lexicon import DEFAULT, Lexicon
from balancebeam.functions.scalars import score_display, sentiment_label

TOKEN = r"[a-z']+(?:-[a-z']+)?"
NEGATION_WINDOW = 3


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def explode_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(tokens(text)).alias("pos", "token"))


def score_text(df: DataFrame, text: str, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Add matched_positive, matched_negative and score in [-1, 1]; a match flips when a negation word is among the three tokens before it."""
    good, bad, no = sorted(lexicon.positive), sorted(lexicon.negative), sorted(lexicon.negation)
    t = F.col("_t")

    def polarity(word: Column, i: Column) -> Column:
        # +1, -1 or 0 for the word at zero-based i
        start = F.greatest(i - NEGATION_WINDOW + 1, F.lit(1))
        negated = F.exists(F.slice(t, start, F.least(i, F.lit(NEGATION_WINDOW))), lambda w: w.isin(no))
        # a negated match counts for the other side; a word on both lists counts as positive unless negated, and as positive when negated too
        return F.when(word.isin(good + bad), F.when(negated, F.when(word.isin(bad), 1).otherwise(-1)).otherwise(F.when(word.isin(good), 1).otherwise(-1))).otherwise(0)

    marks = F.transform(t, lambda w, i: polarity(w, i))
    out = df.withColumn("_t", tokens(text)).withColumn("_m", marks)
    out = out.withColumn("matched_positive", F.size(F.filter("_m", lambda x: x == 1))).withColumn("matched_negative", F.size(F.filter("_m", lambda x: x == -1)))
    total = F.col("matched_positive") + F.col("matched_negative")
    score = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("matched_positive") - F.col("matched_negative"), total))
    return out.withColumn("score", score).drop("_t", "_m")


def source_summary(headlines: DataFrame, keys: tuple[str, ...] = ("ticker", "source")) -> DataFrame:
    """Per entity and source: mean score on the display scale, article count, clear positives and negatives."""
    return headlines.groupBy(*keys).agg(score_display(F.avg("score")).alias("score"), F.count(F.lit(1)).alias("article_count"),
                                        F.count_if(F.col("score") > 0.15).alias("positive_count"), F.count_if(F.col("score") < -0.15).alias("negative_count"))


def aggregate(summary: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Article-weighted mean over the selected sources; an entity without articles has no row."""
    rows = summary if selected is None else summary.filter(F.col("source").isin(selected))
    raw = F.try_divide(F.sum((F.col("score") / 50 - 1) * F.col("article_count")), F.sum("article_count"))
    out = rows.groupBy("ticker").agg(raw.alias("_raw"), F.sum("article_count").alias("article_count"), F.sum("positive_count").alias("positive_count"),
                                     F.sum("negative_count").alias("negative_count")).filter("article_count > 0")
    return out.select("ticker", score_display("_raw").alias("score"), sentiment_label("_raw").alias("label"), "article_count", "positive_count", "negative_count")


def carry_forward(existing: DataFrame, fresh: DataFrame, fetched: DataFrame) -> DataFrame:
    """A fetched (ticker, source) replaces its headlines, even by none; the other sources keep theirs."""
    return existing.join(fetched.select("ticker", "source").distinct(), ["ticker", "source"], "left_anti").unionByName(fresh)


def headlines_recent(headlines: DataFrame) -> DataFrame:
    """Newest first within each entity: hash by (entity, source) would scatter them, so rows are range-partitioned on the whole order and a hot entity spans partitions."""
    return headlines.repartitionByRange("ticker", F.desc("published_order")).sortWithinPartitions("ticker", F.desc("published_order"))


def sentiment_rank(companies: DataFrame, effective: DataFrame, *, sectors: list[str] | None = None, label: str | None = None, text: str | None = None) -> DataFrame:
    """Scored entities by effective score, filtered; ``without_data`` repeats the count of entities without a score."""
    from balancebeam.operators.screens import no, text_search

    joined = companies.join(effective, "ticker", "left")
    missing = joined.agg(F.count_if(F.col("score").isNull()).alias("without_data"))
    out = joined.filter("score is not null")
    if sectors:
        out = out.filter(no(F.col("sector").isin(sectors)))
    if label:
        out = out.filter(F.col("label") == label)
    if text:
        out = text_search(out, text)
    return out.crossJoin(F.broadcast(missing)).orderBy(F.desc("score"), "ticker")
