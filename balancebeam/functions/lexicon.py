"""Default headline lexicon. Callers may pass any other set of words."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    positive: frozenset[str]
    negative: frozenset[str]
    negation: frozenset[str]


DEFAULT = Lexicon(
    positive=frozenset("beat beats boost boosts gain gains growth profit profits record rise rises rally strong stronger surge surges upgrade upgraded win wins".split()),
    negative=frozenset("cut cuts decline declines downgrade downgraded drop drops fall falls fraud lawsuit loss losses miss misses probe recall slump weak weaker warning".split()),
    negation=frozenset("no not never without cannot isn't doesn't didn't won't hardly".split()),
)
