"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame expressions alone.

A rule is a regular expression over the host and path of a URL, with the literal tokens that any match must contain whole. How often each such token occurs in the
URLs decides which one indexes the rule. A URL's tokens fetch candidate rules by an equi-join, and only those run their expression. A rule without a whole literal
token is fetched by every URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    tokens: tuple[str, ...]
    action: str
    rank: int  # the highest rank among the rules that match decides


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``. Longer rules outrank shorter ones, and any outranks the patterns."""
    whole = re.findall(r"[A-Za-z0-9]+", host) + re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(host + path, r"^(?:[^/]*\.)?" + re.escape(host + path), tuple(whole), action, 1000 + len(host + path))


def word_rule(word: str) -> Rule:
    """Blocks hosts with ``word`` as a whole part between dots and hyphens."""
    return Rule(f"*{word}*", rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", tuple(re.findall(r"[A-Za-z0-9]+", word)), "block", 1)


#: The site rules of the query, and words of advertising, gambling, pharmacy and adult hosts.
SITE_RULES = (site_rule("allow", "org", "/"), site_rule("block", "example.org", "/es/"), site_rule("block", "example.org", "/en/1"), site_rule("allow", "com", "/fr/"), site_rule("block", "com", "/de/"))
WORDS = ("ads", "adserver", "adult", "bet", "bets", "betting", "casino", "casinos", "click", "gambling", "jackpot", "lottery", "payday", "pharmacy", "pills", "poker", "porn", "popup", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx")
DEFAULT_RULES = SITE_RULES + tuple(word_rule(w) for w in WORDS)


def split_url(url):
    """(host, path) expressions: host with A-Z lower-cased. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (the deciding rule's name, null where none matches), rank, verdict.

    A null or odd URL has an empty host and path and gets ``default`` unless a rule matches the empty string. Ties between rules go to the smaller name. Repeated pages
    are judged each. The rules are the caller's list, so the index is as large as that list and is broadcast; pages are shuffled once, a narrow row each. Other columns
    are not read.
    """
    host, path = split_url(F.col(url_col))
    sites = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    sites = sites.withColumn("site", F.concat("host", "path"))
    tokens = sites.withColumn("token", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split("site", "[^A-Za-z0-9]+")))))
    literal = sorted({t for r in rules for t in r.tokens})
    seen = {r["token"]: r["n"] for r in tokens.where(F.col("token").isin(literal)).groupBy("token").agg(F.count("*").alias("n")).collect()} if literal else {}
    key = {r: min(r.tokens, key=lambda t: (seen.get(t, 0), t), default="") for r in rules}
    entry = [F.struct(F.lit(key[r]).alias("token"), F.lit(r.regex).alias("regex"), F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action")).alias("rule")) for r in rules]
    index = pages.sparkSession.range(1).select(F.inline(F.array(*entry))) if entry else None
    if index is None:
        return sites.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("rank"), F.lit(default).alias("verdict"))
    met = tokens.join(F.broadcast(index), "token", "left").withColumn("hit", F.when(F.expr("site rlike regex"), F.col("rule")))
    rank = -F.col("hit.rank")
    best = met.groupBy("row", "page_id", "host", "path").agg(F.min(F.when(F.col("hit").isNotNull(), F.struct(rank.alias("minus"), F.col("hit.name").alias("name"), F.col("hit.action").alias("action")))).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.name").alias("rule"), (-F.col("best.minus")).alias("rank"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
