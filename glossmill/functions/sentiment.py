"""Keyword sentiment, generic patterns and the scores made of them, in two profiles.

A keyword counts once if the lower-cased text holds it anywhere. Arithmetic is in doubles in the order in which it
is written here: some verdicts turn on the last bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import text as T

# The keyword lists of both profiles, whose results depend on every entry.
STRONG_POSITIVE = (
    "excellent", "amazing", "perfect", "love", "fantastic", "outstanding", "exceptional", "brilliant", "wonderful", "impressed", "exceeded",
    "superb", "flawless", "awesome",
)
POSITIVE_STRICT = (
    "great", "good", "helpful", "easy", "satisfied", "recommend", "useful", "efficient", "reliable", "solid", "happy", "pleased",
    "effective", "smooth", "clear", "fast", "simple",
)
POSITIVE_LENIENT = (*POSITIVE_STRICT, "works", "nice")
STRONG_NEGATIVE = (
    "terrible", "awful", "horrible", "hate", "worst", "useless", "garbage", "pathetic", "disappointing", "frustrated", "regret",
    "nightmare", "disaster", "broken", "failure",
)
NEGATIVE = (
    "poor", "bad", "difficult", "confusing", "complicated", "slow", "buggy", "lacking", "limited", "issues", "problems", "annoying",
    "clunky", "frustrating", "missing", "weak",
)
GENERIC_LENIENT = ("game changer", "life changing", "changed my life", "best thing ever", "total game changer")
GENERIC_STRICT = (*GENERIC_LENIENT, "absolutely perfect", "couldn't be happier", "exceeded all expectations")


@dataclass(frozen=True)
class Profile:
    """How strictly a text is held against its rating."""

    name: str
    base: tuple[float, float, float, float, float]  # threshold of alignment by rating
    base_default: float
    base_step: float  # it falls by so much an attempt
    base_floor: float
    strong_positive: tuple[str, ...]
    positive: tuple[str, ...]
    strong_negative: tuple[str, ...]
    negative: tuple[str, ...]
    margin: int  # polarity needs a lead of more than that
    sure: float  # a mismatch needs more confidence than that
    neutral_alignment: float
    phrases: tuple[str, ...]
    least_phrases: int
    repetition: float
    exclamation: float
    mismatch_weight: tuple[float, float, float]  # start, step, floor
    generic_weight: float
    repetition_weight: float
    reject: tuple[float, float, float]  # start, step, floor
    breaker_at: int
    breaker_score: float | None  # once the breaker is on: pass everything, or all but scores above this
    star_factors: tuple[float, float, float, float]  # alignment by difference of stars, for rating models
    star_mismatch: tuple[tuple[int, int, float], ...]  # least and most difference, confidence above


# Thresholds and weights of the two profiles.
LENIENT = Profile(
    "lenient", (0.15, 0.15, 0.10, 0.20, 0.25), 0.15, 0.10, 0.05, STRONG_POSITIVE, POSITIVE_LENIENT, STRONG_NEGATIVE, NEGATIVE, 0, 0.80, 0.6,
    GENERIC_LENIENT, 3, 0.7, 0.6, (0.5, 0.15, 0.2), 0.1, 0.05, (0.65, 0.10, 0.30), 3, None, (1.0, 0.85, 0.60, 0.35), ((4, 9, 0.85),),
)
STRICT = Profile(
    "strict", (0.25, 0.30, 0.20, 0.35, 0.40), 0.30, 0.05, 0.15, STRONG_POSITIVE, POSITIVE_STRICT, STRONG_NEGATIVE, NEGATIVE, 1, 0.70, 0.5,
    GENERIC_STRICT, 2, 0.5, 0.4, (0.6, 0.1, 0.4), 0.2, 0.1, (0.55, 0.05, 0.35), 5, 0.70, (1.0, 0.7, 0.4, 0.2), ((3, 9, 0.75), (2, 2, 0.85)),
)
PROFILES = {p.name: p for p in (LENIENT, STRICT)}


def falling(start: float, step: float, floor: float, attempt: Column) -> Column:
    return F.greatest(F.lit(start) - attempt * F.lit(step), F.lit(floor))


def alignment_threshold(rating: Column, attempt: Column, p: Profile) -> Column:
    base = F.lit(p.base_default)
    for r, x in enumerate(p.base, 1):
        base = F.when(rating == r, F.lit(x)).otherwise(base)
    return F.greatest(base - attempt * F.lit(p.base_step), F.lit(p.base_floor))


def expected(rating: Column) -> Column:
    return F.when(rating <= 2, "NEGATIVE").when(rating == 3, "NEUTRAL").otherwise("POSITIVE")


def polarity(text: Column, p: Profile) -> tuple[Column, Column]:
    """Points of the positive and the negative keywords."""
    low = F.lower(text)
    return T.contains_count(low, p.strong_positive, 2) + T.contains_count(low, p.positive), T.contains_count(low, p.strong_negative, 2) + T.contains_count(low, p.negative)


def sentiment(pos: Column, neg: Column, p: Profile) -> tuple[Column, Column]:
    """Sentiment and confidence from the points."""
    sure = lambda lead: F.least(F.lit(0.5) + lead * F.lit(0.08), F.lit(0.90))
    label = F.when(pos > neg + p.margin, "POSITIVE").when(neg > pos + p.margin, "NEGATIVE").otherwise("NEUTRAL")
    return label, F.when(pos > neg + p.margin, sure(pos - neg)).when(neg > pos + p.margin, sure(neg - pos)).otherwise(F.lit(0.45))


def alignment(label: Column, want: Column, confidence: Column, p: Profile) -> Column:
    return F.when(label == want, confidence).when(want == "NEUTRAL", F.lit(p.neutral_alignment)).otherwise(F.lit(1.0) - confidence)


def mismatch(rating: Column, label: Column, confidence: Column, aligned: Column, threshold: Column, p: Profile) -> Column:
    against = ((rating >= 4) & (label == "NEGATIVE")) | ((rating <= 2) & (label == "POSITIVE"))
    return against & (confidence > p.sure) & ~(aligned >= threshold)


def star_alignment(predicted: Column, rating: Column, confidence: Column, p: Profile) -> Column:
    d = F.abs(predicted - rating)
    f = p.star_factors
    return F.when(d == 0, confidence).when(d == 1, confidence * F.lit(f[1])).when(
        d == 2, confidence * F.lit(f[2])
    ).otherwise(confidence * F.lit(f[3]))


def star_mismatch(predicted: Column, rating: Column, confidence: Column, threshold: Column, p: Profile) -> Column:
    d = F.abs(predicted - rating)
    strong = F.lit(False)
    for least, most, above in p.star_mismatch:
        strong = strong | (d.between(least, most) & (confidence > above))
    return strong & ~(star_alignment(predicted, rating, confidence, p) >= threshold)


def repetition(sentences: Column) -> Column:
    """1 less the share of different beginnings (two words) among sentences of two words or more; 0 unless there are
    two such among more than one sentence. Case counts."""
    starts = F.filter(F.transform(sentences, lambda s: F.slice(T.words(s), 1, 2)), lambda w: F.size(w) >= 2)
    n = F.size(starts)
    return F.when(
        (F.size(sentences) > 1) & (n > 1), F.lit(1.0) - F.size(F.array_distinct(starts)) / F.greatest(n, F.lit(1))
    ).otherwise(F.lit(0.0))


def with_scores(df, p: Profile, text: str = "text", rating: str = "rating", attempt: str = "attempt"):
    """df and all the scores of a profile; each is a column of its own, so that nothing is computed twice."""
    r, a = F.col(rating), F.col(attempt)
    pos, neg = polarity(F.col(text), p)
    df = df.withColumns(
        {
            "pos_score": pos, "neg_score": neg, "_sentences": T.long_sentences(F.col(text)),
            "found_generic": T.contained(F.lower(F.col(text)), p.phrases),
        }
    )
    label, sure = sentiment(F.col("pos_score"), F.col("neg_score"), p)
    df = df.withColumns(
        {
            "sentiment": label, "confidence": sure, "expected_sentiment": expected(r), "sentiment_threshold": alignment_threshold(r, a, p),
            "repetition_score": repetition(F.col("_sentences")),
            "exclamation_ratio": T.exclamations(F.col(text)) / F.greatest(F.size("_sentences"), F.lit(1)),
            "generic_score": F.size("found_generic") / F.lit(float(len(p.phrases))),
        }
    )
    df = df.withColumns(
        {
            "alignment_score": alignment(F.col("sentiment"), F.col("expected_sentiment"), F.col("confidence"), p),
            "is_generic": (F.size("found_generic") >= p.least_phrases) | (
                (F.col("repetition_score") > p.repetition) & (F.col("exclamation_ratio") > p.exclamation)
            ),
        }
    )
    df = df.withColumn(
        "is_mismatch", mismatch(r, F.col("sentiment"), F.col("confidence"), F.col("alignment_score"), F.col("sentiment_threshold"), p)
    )
    score = F.when(F.col("is_mismatch"), falling(*p.mismatch_weight, a) * F.col("confidence")).otherwise(F.lit(0.0))
    score = score + F.when(F.col("is_generic"), F.lit(p.generic_weight) * F.col("generic_score")).otherwise(F.lit(0.0))
    score = score + F.when(F.col("repetition_score") > 0.4, F.lit(p.repetition_weight)).otherwise(F.lit(0.0))
    df = df.withColumns({"raw_unrealistic": score, "reject_threshold": falling(*p.reject, a)})
    return df.withColumns(
        {
            "unrealistic_score": F.least(F.col("raw_unrealistic"), F.lit(1.0)),
            "is_unrealistic": F.col("raw_unrealistic") > F.col("reject_threshold"),
        }
    ).drop("_sentences")
