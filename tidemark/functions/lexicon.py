"""Word-list scores of short texts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists of the basic and of the extended score.
POSITIVE = ["beat", "beats", "surge", "surges", "rises", "gain", "gains", "profit", "record", "growth", "upgrade", "strong", "bullish", "rally", "outperform", "exceed", "exceeds", "positive", "up"]
NEGATIVE = ["miss", "misses", "fall", "falls", "drop", "drops", "loss", "losses", "decline", "declines", "downgrade", "weak", "bearish", "crash", "slump", "underperform", "below", "negative", "down", "risk", "risks", "cut", "cuts"]
MORE_POSITIVE = ["boost", "increase", "revenue", "buyback", "dividend", "expansion"]
MORE_NEGATIVE = ["lawsuit", "investigation", "recall"]


def lexicon_score(text: Column | str, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """(p - n) / (p + n) over the distinct words between white space; 0 without any listed word or text."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.array_distinct(F.split(F.lower(F.trim(F.coalesce(t, F.lit("")))), r"\s+"))
    p, n = (F.size(F.array_intersect(words, F.array(*map(F.lit, w)))) for w in (positive, negative))
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0))


def extended_score(text: Column | str) -> Column:
    return lexicon_score(text, POSITIVE + MORE_POSITIVE, NEGATIVE + MORE_NEGATIVE)
