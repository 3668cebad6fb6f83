"""Corpus statistics, comparison of a corpus with a real one, and realism of single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as T


def text_metrics(reviews: DataFrame, text: str = "text") -> DataFrame:
    """reviews with n_words, n_unique, n_sentences, words_per_sentence and n_tech_terms."""
    t = F.col(text)
    return reviews.withColumns(
        {
            "n_words": T.word_count(t), "n_unique": T.unique_word_count(t), "n_sentences": T.sentence_count(t),
            "words_per_sentence": T.words_per_sentence(t), "n_tech_terms": T.tech_term_count(t),
        }
    )


def corpus_stats(reviews: DataFrame, text: str = "text") -> DataFrame:
    """One row: means over texts, the population deviation of lengths, and their range."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return text_metrics(reviews.select(F.col(text).alias("text"))).agg(
        zero(F.avg("n_words")).alias("avg_length"), zero(F.stddev_pop("n_words")).alias("std_length"), zero(F.avg("n_unique")).alias("avg_unique_words"),
        zero(F.avg("n_sentences")).alias("avg_sentences"), zero(F.avg("words_per_sentence")).alias("avg_words_per_sentence"), zero(F.avg("n_tech_terms")).alias("avg_tech_terms"),
        F.min("n_words").alias("min_length"), F.max("n_words").alias("max_length"),
    )


def compare(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """One row: relative differences (in percent), the realism score and its label; 0.5 without real texts.

    Both sides are rows of statistics; real ones can be kept and used again.
    """
    s = synthetic.select(*[F.col(c).alias(f"synthetic_{c}") for c in ("avg_length", "avg_unique_words", "avg_sentences")])
    r = real.select(
        *[F.col(c).alias(f"real_{c}") for c in ("avg_length", "avg_unique_words", "avg_sentences")],
        F.col("max_length").isNotNull().alias("any_real"),
    )
    one = s.crossJoin(r)
    diff = lambda c: F.try_divide(F.abs(F.col(f"synthetic_{c}") - F.col(f"real_{c}")), F.col(f"real_{c}"))
    one = one.withColumns({"d_length": diff("avg_length"), "d_unique": diff("avg_unique_words"), "d_sentences": diff("avg_sentences")})
    score = F.lit(1.0) - F.least(F.lit(1.0), (F.col("d_length") + F.col("d_unique") + F.col("d_sentences")) / 3)
    one = one.withColumn("realism_score", F.when(F.col("any_real"), score).otherwise(F.lit(0.5)))
    label = F.when(
        F.col("realism_score") > 0.9, "excellent"
    ).when(F.col("realism_score") > 0.8, "good").when(F.col("realism_score") > 0.7, "moderate").otherwise("needs_improvement")
    return one.select(
        *[f"{k}_{c}" for k in ("synthetic", "real") for c in ("avg_length", "avg_unique_words", "avg_sentences")],
        (F.col("d_length") * 100).alias("length_diff_pct"), (F.col("d_unique") * 100).alias("unique_words_diff_pct"),
        (F.col("d_sentences") * 100).alias("sentence_diff_pct"), "realism_score",
        F.when(F.col("any_real"), label).alias("comparison_quality"),
    )


def single_review(reviews: DataFrame, text: str = "text") -> DataFrame:
    """reviews with the three checks of one text and realism_score, the share of them that hold."""
    t = F.col(text)
    n = T.word_count(t)
    checks = {
        "length_reasonable": n.between(50, 500),
        "has_variation": F.coalesce(F.try_divide(T.unique_word_count(t).cast("double"), n.cast("double")) > 0.5, F.lit(False)),
        "sentence_structure": T.sentence_count(t).between(1, 20),
    }
    return reviews.withColumns(checks).withColumn("realism_score", sum((F.col(c).cast("int") for c in checks), F.lit(0)) / F.lit(3.0))


def character_length_check(reviews: DataFrame, text: str = "text", least: int = 50, most: int = 500, min_score: float = 0.5) -> DataFrame:
    """The older check: characters within bounds, then the realism score; reason names the first that fails."""
    n = F.length(text).cast("long")
    rows = single_review(reviews, text).withColumn("n_chars_checked", n)
    reason = F.when(n < least, F.format_string(f"Review too short: %d < {least}", n)).when(n > most, F.format_string(f"Review too long: %d > {most}", n)).when(
        F.col("realism_score") < min_score, F.concat(F.lit("Low realism score: "), T.fixed(F.col("realism_score"), 2))
    )
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())
