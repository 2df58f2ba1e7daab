"""Source shapes: news feeds, constituent pages and filer profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancebeam.functions.scalars import compact_timestamp, decode_entities, fiscal_year_end_valid

HEADLINE = ("title", "publisher", "url", "published_at")


def _complete(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with a title, a link and a readable date."""
    filled = (F.col("title") != "") & (F.col("url") != "") & F.col("published_at").isNotNull()
    return df.filter(filled).select(*keep, *HEADLINE)


def headlines_search(df: DataFrame, keep: list[str]) -> DataFrame:
    """Quote-service news JSON: {"news": [{title, publisher, link, providerPublishTime}]}."""
    news = F.from_json("body", "news array<struct<title:string,publisher:string,link:string,providerPublishTime:bigint>>")["news"]
    rows = df.select(*keep, F.inline(news))
    rows = rows.select(*keep, "title", F.coalesce("publisher", F.lit("Unknown")).alias("publisher"), F.col("link").alias("url"), F.timestamp_seconds("providerPublishTime").alias("published_at"))
    return _complete(rows, keep)


def split_title(raw: Column) -> tuple[Column, Column]:
    """'Some title - Publisher' split at the last ' - ', if it is not at the start."""
    parts = F.regexp_extract(raw, r"(?s)^(.+) - (.*?)$", 1), F.regexp_extract(raw, r"(?s)^(.+) - (.*?)$", 2)
    split = F.regexp_like(raw, F.lit(r"(?s)^.+ - "))
    return F.when(split, parts[0]).otherwise(raw), F.when(split, parts[1])


FEED = "channel struct<item:array<struct<title:string,link:string,pubDate:string>>>, _corrupt string"


def strip(c) -> Column:
    """Without white space and control characters at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def headlines_rss(df: DataFrame, keep: list[str]) -> DataFrame:
    """RSS feeds: the items' title, link and pubDate, read by the XML parser. A feed that is not well-formed still gives its <item> blocks, their entities decoded one by one."""
    feed = df.select(*keep, "body", F.from_xml("body", FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_f"))
    tag = lambda x, t: decode_entities(F.regexp_extract(x, rf"(?s)<{t}>(.*?)</{t}>", 1))
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    salvaged = F.transform(blocks, lambda x: F.struct(tag(x, "title").alias("title"), tag(x, "link").alias("link"), tag(x, "pubDate").alias("pubDate")))
    whole = F.col("_f").isNotNull() & F.col("_f._corrupt").isNull()
    items = feed.select(*keep, F.inline(F.coalesce(F.when(whole, F.col("_f.channel.item")), salvaged)))
    # the weekday carries no information and Spark's parser does not read one
    when = F.regexp_replace(strip("pubDate"), r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(*[F.try_to_timestamp(when, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("z", "xx")])
    rows = items.select(*keep, strip("title").alias("_raw"), strip("link").alias("url"), at.alias("published_at"))
    title, publisher = split_title(F.col("_raw"))
    return _complete(rows.select("*", title.alias("title"), F.coalesce(publisher, F.lit("News search")).alias("publisher")), keep)


def headlines_articles(df: DataFrame, keep: list[str]) -> DataFrame:
    """Article-list JSON: {"articles": [{url, title, seendate, domain}]} with compact timestamps."""
    rows = df.select(*keep, F.inline(F.from_json("body", "articles array<struct<url:string,title:string,seendate:string,domain:string>>")["articles"]))
    rows = rows.select(*keep, "title", F.coalesce("domain", F.lit("Article list")).alias("publisher"), "url", compact_timestamp("seendate").alias("published_at"))
    return _complete(rows, keep)


MINIMUM = 400


def constituents(pages: DataFrame, pattern: str, minimum: int = MINIMUM, group: int = 1, table: str | None = None) -> DataFrame:
    """Symbols listed in the rows of a corpus of pages, without repeats, in one pass over the pages.

    A list of fewer than ``minimum`` symbols is an error, not a short list, and so is a corpus without any page that matches ``table`` (a pattern whose match is the part to read). Both
    are raised by the plan itself when it runs: symbols and their number come out of one aggregate, so nothing is counted first and computed again. The list is that of an index, some
    thousands of symbols, and is gathered in one row for that.
    """
    text = F.col("html") if table is None else F.regexp_extract("html", f"({table})", 1)
    rows = pages.select(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("s"), (F.lit(True) if table is None else text != "").alias("t"))
    symbols = rows.select(F.explode_outer("s").alias("symbol"), "t").groupBy("symbol").agg(F.max("t").alias("t"))
    all_of = symbols.agg(F.coalesce(F.max("t"), F.lit(table is None)).alias("t"), F.sort_array(F.collect_set(F.when(F.col("symbol") != "", F.col("symbol")))).alias("s"))
    short = F.concat(F.lit("only "), F.size("s").cast("string"), F.lit(f" symbols found, expected at least {minimum}: the page layout may have changed"))
    missing = F.raise_error(F.lit("the table of constituents was not found in any page")).cast("array<string>")
    checked = F.when(~F.col("t"), missing).when(F.size("s") < minimum, F.raise_error(short).cast("array<string>")).otherwise(F.col("s"))
    return all_of.select(F.explode(checked).alias("symbol"))


def blank_to_null(c) -> Column:
    c = F.trim(c)
    return F.when(c != "", c)


def filer_profile(df: DataFrame, states: DataFrame) -> DataFrame:
    """Blank to NULL; exchanges without case-insensitive repeats (first spelling kept); validated fiscal year end; headquarters text.

    ``states``: (code, name).
    """
    clean = F.filter(F.transform("exchanges", lambda x: blank_to_null(x)), lambda x: x.isNotNull())
    lowered = F.transform(F.col("_x"), lambda x: F.lower(x))
    firsts = F.filter(F.col("_x"), lambda x, i: F.array_position(F.col("_l"), F.lower(x)) == i + 1)
    out = df.withColumn("_x", clean).withColumn("_l", lowered).withColumn("exchange", F.when(F.size(firsts) > 0, F.array_join(firsts, ", ")))
    names = states.select(F.col("code").alias("_c"), F.col("name").alias("_n"))
    out = out.join(names, F.upper(F.trim("state")) == F.col("_c"), "left")
    place = F.coalesce("_n", blank_to_null("state"))
    city = F.regexp_replace(F.initcap(blank_to_null("city")), r"\s+", " ")
    hq = F.array_join(F.filter(F.array(city, place), lambda x: x.isNotNull()), ", ")
    return out.select("ticker", "exchange", fiscal_year_end_valid("fiscal_year_end").alias("fiscal_year_end"), blank_to_null("category").alias("filer_category"), F.when(hq != "", hq).alias("headquarters"))
