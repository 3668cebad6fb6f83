"""Threshold gates with their reasons, classes of issues, and the decision about a candidate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import sentiment as S
from glossmill.functions import text as T


@dataclass(frozen=True)
class Thresholds:
    """Gates of a candidate; those of None are off."""

    min_length: int = 50
    max_length: int = 500
    min_unique_words: int = 20
    max_self_bleu: float = 0.5
    min_llm_judge_score: float = 0.7
    max_regeneration_attempts: int = 5
    min_realism_score: float | None = None
    min_diversity_score: float | None = None
    min_sentiment_alignment: float | None = None


HARD_RATINGS, HARD_ATTEMPTS = (1, 2, 3), 4
BORDERLINE = 0.25


def reasons(t: Thresholds, breaker: Column) -> Column:
    """Why a row with n_words, n_unique, self_bleu_diversity and scores fails, in the order of the gates."""
    c = F.col
    gates = [
        F.when(c("n_words") < t.min_length, F.format_string(f"Too short: %d words (min: {t.min_length})", c("n_words"))),
        F.when(c("n_words") > t.max_length, F.format_string(f"Too long: %d words (max: {t.max_length})", c("n_words"))),
        F.when(c("n_unique") < t.min_unique_words, F.format_string(f"Low vocabulary: %d unique words (min: {t.min_unique_words})", c("n_unique"))),
        F.when(c("self_bleu_diversity") < 1.0 - t.max_self_bleu, F.concat(F.lit("Too similar to existing reviews (diversity: "), T.fixed(c("self_bleu_diversity"), 2), F.lit(")"))),
        F.when((c("alignment_score") < c("sentiment_threshold")) & ~breaker, F.concat(F.lit("Sentiment-rating mismatch (alignment: "), T.fixed(c("alignment_score"), 2), F.lit(", threshold: "), T.fixed(c("sentiment_threshold"), 2), F.lit(")"))),
        F.when(c("is_unrealistic") & ~breaker, F.concat(F.lit("Unrealistic patterns (score: "), T.fixed(c("unrealistic_score"), 2), F.lit(")"))),
    ]
    if t.min_sentiment_alignment is not None:
        gates.append(
            F.when(
                c("alignment_score") < t.min_sentiment_alignment,
                F.concat(F.lit("Low sentiment alignment ("), T.fixed(c("alignment_score"), 2), F.lit(")")),
            )
        )
    if t.min_diversity_score is not None:
        gates.append(
            F.when(
                c("self_bleu_diversity") < t.min_diversity_score,
                F.concat(F.lit("Low diversity ("), T.fixed(c("self_bleu_diversity"), 2), F.lit(")")),
            )
        )
    if t.min_realism_score is not None:
        gates.append(
            F.when(c("realism_score") < t.min_realism_score, F.concat(F.lit("Low realism ("), T.fixed(c("realism_score"), 2), F.lit(")")))
        )
    return F.array_compact(F.array(*gates))


def scored(reviews: DataFrame, profile: S.Profile) -> DataFrame:
    """reviews (text, rating, attempt, self_bleu_diversity) with all scores that the gates ask for."""
    return S.with_scores(reviews, profile).withColumns(
        {"n_words": T.word_count(F.col("text")), "n_unique": T.unique_word_count(F.col("text"))}
    )


def gated(rows: DataFrame, t: Thresholds, breaker: Column | None = None) -> DataFrame:
    """rows of scored() with reasons and passed; breaker: whether the sentiment gates let a row pass."""
    return rows.withColumn("reasons", reasons(t, F.lit(False) if breaker is None else breaker)).withColumn("passed", F.size("reasons") == 0)


def check(reviews: DataFrame, t: Thresholds, profile: S.Profile, breaker: Column | None = None) -> DataFrame:
    """reviews with scores, reasons and passed."""
    return gated(scored(reviews, profile), t, breaker)


def issue_class(reason: Column) -> Column:
    """The class of a reason: the first whose words it holds."""
    low = F.lower(reason)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0]))
    out = None
    for name, words in ISSUES:
        out = F.when(has(*words), name) if out is None else out.when(has(*words), name)
    return out.otherwise("other")


#: Classes of issues and the words that tell them, in order.
ISSUES = (
    ("sentiment", ("sentiment", "mismatch")),
    ("unrealistic", ("unrealistic",)),
    ("length", ("short", "long")),
    ("vocabulary", ("vocabulary", "unique")),
    ("diversity", ("similar", "diversity")),
    ("llm_judge_error", ("llm judge", "evaluation", "api")),
    ("expertise", ("expertise", "technical")),
    ("authenticity", ("authenticity", "authentic")),
)
#: What marks a failure of the judge itself.
JUDGE_ERRORS = ("evaluation failed", "api issue", "parsing failed")


def is_judge_error(reasons: Column) -> Column:
    return F.exists(reasons, lambda r: F.greatest(*[F.contains(F.lower(r), F.lit(w)) for w in JUDGE_ERRORS]))


def history(reasons: Column, count: Column, before: Column) -> Column:
    """The classes of a candidate's failures so far, with those that this round adds: one for a failure of the judge,
    then the class of the first reason; rounds before the third add none."""
    own = F.array_compact(
        F.array(F.when(is_judge_error(reasons), "llm_judge_error"), F.when(F.size(reasons) > 0, issue_class(F.get(reasons, F.lit(0)))))
    )
    return F.when(count >= 2, F.concat(before, own)).otherwise(before)


def last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), n)


def decide(rows: DataFrame, t: Thresholds) -> DataFrame:
    """rows (reasons, count, rating, alignment_score, history) with decision, forced (whether a rule against loops made
    it) and the history that goes on.

    count is how often the candidate was generated again. In order: the judge failed in two of the last three
    rounds: accept; the same class three times: accept sentiment and unrealistic ones if the alignment is
    borderline, else reject, leave failures of the judge be; no reasons: accept; else again, up to the number of
    attempts, which is capped for hard ratings.
    """
    c = F.col
    most = F.when(
        c("rating").isin(*HARD_RATINGS), F.least(F.lit(t.max_regeneration_attempts), F.lit(HARD_ATTEMPTS))
    ).otherwise(F.lit(t.max_regeneration_attempts))
    error = is_judge_error(c("reasons")) & (c("count") >= 2)
    with_error = F.when(error, F.concat(c("history"), F.array(F.lit("llm_judge_error")))).otherwise(c("history"))
    rows = rows.withColumn("_e", with_error).withColumn("_h", history(c("reasons"), c("count"), c("history")))
    judge_loop = error & (F.size(F.filter(last(c("_e"), 3), lambda x: x == "llm_judge_error")) >= 2)
    stuck = F.when(
        (F.size("reasons") > 0) & (c("count") >= 2) & (F.size("_h") >= 3) & (F.size(F.array_distinct(last(c("_h"), 3))) == 1),
        F.element_at("_h", -1),
    )
    rows = rows.withColumns({"_loop": judge_loop, "_stuck": stuck})
    decision = (
        F.when(c("_loop"), "accept")
        .when(F.size("reasons") == 0, "accept")
        .when(c("_stuck").isin("sentiment", "unrealistic"), F.when(c("alignment_score") > BORDERLINE, "accept").otherwise("reject"))
        .when(c("_stuck").isNotNull() & (c("_stuck") != "llm_judge_error"), "reject")
        .when(c("count") < most, "regenerate")
        .otherwise("reject")
    )
    return rows.withColumns(
        {
            "decision": decision, "forced": c("_loop") | (c("_stuck").isNotNull() & (c("_stuck") != "llm_judge_error")),
            "history": F.when(c("_loop"), c("_e")).otherwise(c("_h")),
        }
    ).drop("_e", "_h", "_loop", "_stuck")


def settle(attempts: DataFrame, slot: str, order: str, t: Thresholds) -> DataFrame:
    """The attempts of each slot up to the one that settles it, with decision, forced and history: a state machine for each slot,
    whose state is how many attempts there were and the classes of their failures. It takes verdicts (reasons, rating,
    alignment_score) in order and ends with the first accept or reject; slots of any progress go side by side.

    Only the first attempts of a slot can count, so however many rows it has, those are all that its window gets.
    """
    w = Window.partitionBy(slot).orderBy(order)
    rows = attempts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= t.max_regeneration_attempts + 1)
    rows = rows.withColumn("count", F.col("_k") - 1)
    own = history(F.col("reasons"), F.col("count"), F.array().cast("array<string>"))
    before = F.flatten(F.collect_list(own).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    done = decide(rows.withColumn("history", before), t)
    settled = F.min(F.when(F.col("decision") != "regenerate", F.col("_k"))).over(Window.partitionBy(slot))
    return done.withColumn("_end", settled).filter(F.col("_end").isNull() | (F.col("_k") <= F.col("_end"))).drop("_k", "_end")


def feedback(retry: Column, judge_off: Column, reasons: Column, judge_feedback: Column) -> Column:
    """What a retry is told: the reasons, or the judge's words if there are any."""
    return F.when(
        retry > 0,
        F.when(judge_off, F.when(F.size(reasons) > 0, F.array_join(reasons, " | "))).otherwise(F.nullif(judge_feedback, F.lit(""))),
    )


def validate(reviews: DataFrame, profile: S.Profile) -> DataFrame:
    """The unified validator: fixed gates; reviews carry text, rating and self_bleu_diversity (1 without others)."""
    from glossmill.operators.realism import single_review

    c = F.col
    rows = single_review(S.with_scores(reviews.withColumn("attempt", F.lit(1)), profile))
    rows = rows.withColumns({"n_words": T.word_count(c("text")), "n_unique": T.unique_word_count(c("text"))})
    issues = [
        F.when(c("n_words") < 50, F.format_string("Too short: %d words", c("n_words"))),
        F.when(c("n_words") > 500, F.format_string("Too long: %d words", c("n_words"))),
        F.when(c("n_unique") < 20, F.format_string("Low vocabulary: %d unique words", c("n_unique"))),
        F.when(c("self_bleu_diversity") < 0.5, F.concat(F.lit("Too similar to existing reviews: "), T.fixed(c("self_bleu_diversity"), 2))),
        F.when(c("alignment_score") < 0.7, F.lit("Sentiment-rating mismatch")),
        F.when(c("is_unrealistic"), F.lit("Unrealistic patterns detected")),
        F.when(c("realism_score") < 0.7, F.concat(F.lit("Low realism score: "), T.fixed(c("realism_score"), 2))),
    ]
    return rows.withColumn("issues", F.array_compact(F.array(*issues))).withColumn("passed", F.size("issues") == 0)
