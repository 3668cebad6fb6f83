"""Judges: tolerant parsing of their replies, stand-ins when they fail, and what several criteria and judges agree on.

Replies are tall rows: review_id, judge, criterion, reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as T

CRITERIA = ("authenticity", "alignment", "expertise", "uniqueness")
OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
#: Words that speak for and against in a reply that holds no fields.
PASS_WORDS = ("pass", "good", "acceptable", "appropriate", "authentic", "correct")
FAIL_WORDS = ("fail", "poor", "inappropriate", "fake", "wrong", "mismatch")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fenced(text: Column, fence: str) -> Column:
    """What stands between the first such fence and the next fence."""
    after = F.get(F.split(text, fence, -1), F.lit(1))
    return stripped(F.get(F.split(after, "```", -1), F.lit(0)))


def parse(replies: DataFrame, reply: str = "reply", criterion: str = "criterion") -> DataFrame:
    """replies with score, decision, feedback, parse_strategy (1 to 6; null for an error) and parsing_failed.

    The ladder: the reply as JSON, in a JSON fence, in any fence, its first object; each must have the criterion's
    score and a decision. Then key and value pairs found by pattern (score 7 if there is no score), then the words
    of the reply (7 or 4). An empty reply is an error with score 0 and FAIL, which counts in means.
    """
    text = stripped(F.col(reply))
    rows = replies.withColumn("_t", F.when(F.length(F.col(reply)) > 0, text))
    t, key = F.col("_t"), F.concat(F.col(criterion), F.lit("_score"))
    tries = {
        "_1": t, "_2": F.when(F.contains(t, F.lit("```json")), fenced(t, "```json")),
        "_3": F.when(F.contains(t, F.lit("```")), fenced(t, "```")), "_4": F.nullif(F.regexp_extract(t, OBJECT, 0), F.lit("")),
    }
    as_map = lambda c: F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    rows = rows.withColumns({k: F.when(F.startswith(c, F.lit("{")) & F.try_parse_json(c).isNotNull(), as_map(c)) for k, c in tries.items()})
    whole = lambda k: F.map_contains_key(k, key) & F.map_contains_key(k, F.lit("decision"))
    rows = rows.withColumn(
        "_j",
        F.when(whole("_1"), F.struct(F.lit(1).alias("s"), F.col("_1").alias("m"))).when(whole("_2"), F.struct(F.lit(2).alias("s"), F.col("_2").alias("m"))).when(whole("_3"), F.struct(F.lit(3).alias("s"), F.col("_3").alias("m"))).when(
            whole("_4"), F.struct(F.lit(4).alias("s"), F.col("_4").alias("m"))
        ),
    )
    # strategy 5: pairs of any *_score; the last of a key counts; needs the criterion's score (or none at all) and a decision
    names = F.regexp_extract_all(t, F.lit(r'(?i)"?(\w+_score)"?\s*[:=]\s*(\d+\.?\d*)'), F.lit(1))
    values = F.regexp_extract_all(t, F.lit(r'(?i)"?(\w+_score)"?\s*[:=]\s*(\d+\.?\d*)'), F.lit(2))
    own = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: p["k"] == key)
    found = F.when(F.size(own) > 0, F.element_at(own, -1)["v"].cast("double")).when(
        F.size(F.filter(names, lambda n: F.endswith(n, F.lit("_score")))) == 0, F.lit(7.0)
    )
    said = F.upper(F.nullif(F.regexp_extract(t, r'(?i)"?decision"?\s*[:=]\s*"?(PASS|FAIL)"?', 1), F.lit("")))
    words = F.nullif(F.regexp_extract(t, r'(?i)"?feedback"?\s*[:=]\s*"([^"]+)"', 1), F.lit(""))
    rows = rows.withColumns({"_v": found, "_d": said, "_f": words})
    low = F.lower(t)
    favourable = T.contains_count(low, PASS_WORDS) > T.contains_count(low, FAIL_WORDS)
    pairs = F.col("_v").isNotNull() & F.col("_d").isNotNull()
    json, talk = F.col("_j").isNotNull(), t.isNotNull()
    rows = rows.withColumns(
        {
            "parse_strategy": F.when(json, F.col("_j.s")).when(pairs, 5).when(talk, 6),
            "score": F.when(json, F.element_at("_j.m", key).try_cast("double")).when(pairs, F.col("_v")).when(talk, F.when(favourable, 7.0).otherwise(4.0)).otherwise(F.lit(0.0)),
            "decision": F.when(json, F.element_at("_j.m", F.lit("decision"))).when(pairs, F.col("_d")).when(talk, F.when(favourable, "PASS").otherwise("FAIL")).otherwise("FAIL"),
            "feedback": F.when(json, F.element_at("_j.m", F.lit("feedback"))).when(pairs, F.col("_f")).when(talk, F.substring(t, 1, 200)).otherwise("Evaluation failed: empty response"),
            "parsing_failed": ~talk | t.isNull(),
        }
    )
    return rows.drop("_t", "_1", "_2", "_3", "_4", "_j", "_v", "_d", "_f")


# The words of the stand-ins.
SPECIFIC = ("we", "our", "i", "my", "team", "company", "project")
BALANCE = ("but", "however", "although", "though")
FALLBACK_POSITIVE = ("good", "great", "excellent", "helpful", "easy", "love", "recommend")
FALLBACK_NEGATIVE = ("bad", "poor", "difficult", "frustrating", "disappointed", "avoid")
FALLBACK_TECHNICAL = ("api", "integration", "deployment", "configuration", "workflow")


def authenticity_fallback(text: Column) -> dict[str, Column]:
    low, n = F.lower(text), T.word_count(text)
    sentences = F.size(F.filter(F.split(text, r"\.", -1), lambda s: F.length(stripped(s)) > 10))
    parts = {
        "natural_language": F.least(F.lit(9.0), F.lit(5.0) + n / F.lit(25.0)),
        "specific_details": F.least(F.lit(9.0), F.lit(4.0) + T.contains_count(low, SPECIFIC)),
        "balanced_perspective": F.when(T.contains_count(low, BALANCE) > 0, 8.0).otherwise(6.0),
        "emotional_consistency": F.lit(7.0),
        "writing_style": F.least(F.lit(9.0), F.lit(5.0) + sentences / F.lit(2.0)),
    }
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    return {**parts, "authenticity_score": total / F.lit(5.0)}


def alignment_fallback(text: Column, rating: Column) -> Column:
    low = F.lower(text)
    pos, neg = T.contains_count(low, FALLBACK_POSITIVE), T.contains_count(low, FALLBACK_NEGATIVE)
    return F.when((rating >= 4) & (pos > neg), F.least(F.lit(9), pos + 6)).when(
        (rating <= 2) & (neg > pos), F.least(F.lit(9), neg + 6)
    ).when(rating == 3, F.lit(7)).otherwise(F.lit(5)).cast("double")


def expertise_fallback(text: Column) -> dict[str, Column]:
    n = T.contains_count(F.lower(text), FALLBACK_TECHNICAL)
    return {
        "expertise_score": F.least(F.lit(9.0), F.lit(5.0) + n * F.lit(0.5)),
        "technical_accuracy": F.least(F.lit(9.0), F.lit(5.0) + n * F.lit(0.4)),
        "domain_knowledge": F.least(F.lit(9.0), F.lit(5.0) + n * F.lit(0.3)),
    }


def mean_overlap(words: Column, before: Column) -> Column:
    """The mean share of words that each of the texts before has too (all as distinct words); null if there is none,
    texts without words left out."""
    shares = F.transform(
        F.filter(before, lambda b: (F.size(b) > 0) & (F.size(words) > 0)), lambda b: F.size(F.array_intersect(words, b)) / F.size(words)
    )
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(before) == 0, F.lit(None)).when(F.size(shares) == 0, F.lit(0.0)).otherwise(total / F.size(shares))


def last_overlaps(reviews: DataFrame, by: list[str], order: str, k: int = 5) -> DataFrame:
    """reviews with avg_overlap: the mean share of a text's words that each of the k texts before it has too; null for
    the first. A frame of k rows is all that a row needs."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-k, -1)
    rows = reviews.withColumn(
        "_w", F.array_distinct(T.words(F.lower(F.col("text"))))
    ).withColumn("_before", F.collect_list("_w").over(frame))
    return rows.withColumn("avg_overlap", mean_overlap(F.col("_w"), F.col("_before"))).drop("_w", "_before")


def context(
    reviews: DataFrame, by: list[str], order: str, last: int = 10, shown: int = 3, chars: int = 200, out: str = "before"
) -> DataFrame:
    """reviews with the context of a uniqueness prompt: of the last texts before each, the first that are shown, each cut
    to chars. Texts are cut before the frame gathers them, so a row holds last * chars characters of others at most."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-last, -1)
    return reviews.withColumn(out, F.slice(F.collect_list(F.substring("text", 1, chars)).over(frame), 1, shown))


def uniqueness_fallback(avg_overlap: Column) -> Column:
    """9 for a first text, else less the more it shares."""
    return F.when(avg_overlap.isNull(), F.lit(9.0)).otherwise(F.greatest(F.lit(5.0), F.lit(10.0) - avg_overlap * F.lit(10.0)))


def verdicts(results: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """keys, overall_score, dimension_scores, all_passed, counts and final_decision from rows of criteria (score as
    text or number, decision, parsing_failed, fallback, llm_success).

    Scores that are no numbers are left out of the overall score and count 0.5 in their dimension; rows of errors
    have no say in all_passed, which holds for no rows. The mean is taken of the scores as given and then divided: sums of whole
    scores are exact, so that a mean on an edge (0.475, 0.6) doesn't depend on the order in which rows are added.
    """
    score = F.col("score").cast("string").try_cast("double")
    value = score / 10
    ok = ~F.coalesce(F.col("parsing_failed"), F.lit(False))
    per = results.groupBy(*keys).agg(
        F.coalesce(F.avg(score) / 10, F.lit(0.5)).alias("overall_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct(F.col("criterion"), F.coalesce(value, F.lit(0.5)).alias("v")))))).alias("dimension_scores"),
        F.coalesce(F.bool_and(F.when(ok, F.coalesce(F.col("decision") == "PASS", F.lit(False)))), F.lit(True)).alias("all_passed"),
        F.count_if(~ok).alias("errors_count"), F.count_if("fallback").alias("fallback_count"), F.count_if("llm_success").alias("llm_success_count"),
    )
    return per.withColumn("final_decision", F.when(F.col("all_passed") & (F.col("overall_score") >= least), "PASS").otherwise("FAIL"))


def consensus(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, agreement_rate, agreed_count, total_comparisons over criteria that both judges decided."""
    p = primary.select(*keys, "criterion", F.col("decision").alias("_p"))
    s = secondary.select(*keys, "criterion", F.col("decision").alias("_s"))
    both = p.join(s, [*keys, "criterion"]).filter(F.col("_p").isNotNull() & F.col("_s").isNotNull())
    return both.groupBy(*keys).agg(
        F.avg((F.col("_p") == F.col("_s")).cast("double")).alias("agreement_rate"),
        F.count_if(F.col("_p") == F.col("_s")).alias("agreed_count"), F.count("*").alias("total_comparisons"),
    )


def joined_feedback(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feedback of all criteria in their order, each with its decision and whether it is a stand-in's."""
    order = F.array_position(F.array(*[F.lit(c) for c in CRITERIA]), F.col("criterion"))
    said = F.concat(
        F.initcap("criterion"), F.lit(" ["), F.coalesce("decision", F.lit("UNKNOWN")), F.lit("]"),
        F.when(F.coalesce("fallback", F.lit(False)), F.lit(" [FALLBACK]")).otherwise(F.lit("")), F.lit(": "),
        F.coalesce("feedback", F.lit("No feedback")),
    )
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), said.alias("t"))))
    return results.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), " | ").alias("feedback"))


def gate(verdicts: DataFrame, min_score: float) -> DataFrame:
    """verdicts (with individual feedback by criterion in dimension_feedback, and feedback) with judge_reasons."""
    c = F.col
    low = F.filter(F.map_entries("dimension_scores"), lambda e: e["value"] < 0.6)
    detail = F.transform(
        low,
        lambda e: F.concat(
            e["key"], F.lit("("), T.fixed(e["value"], 1), F.lit("): "),
            F.coalesce(F.element_at("dimension_feedback", e["key"]), F.lit("Score too low")),
        ),
    )
    failed = F.when(
        c("final_decision") != "PASS",
        F.concat(
            F.lit("Failed LLM Judge: "),
            F.when(F.size(detail) > 0, F.array_join(detail, " | ")).otherwise(F.coalesce("feedback", F.lit("Overall score too low"))),
        ),
    )
    weak = F.when(
        (c("overall_score") < min_score) & (c("final_decision") != "PASS"),
        F.concat(F.lit("LLM Judge score too low: "), T.fixed(c("overall_score"), 2), F.lit(f" (min: {min_score})")),
    )
    errors = F.format_string("LLM Judge evaluation failed (%d errors) - possible API issue", c("errors_count"))
    return verdicts.withColumn(
        "judge_reasons", F.when(c("errors_count") >= 3, F.array(errors)).otherwise(F.array_compact(F.array(failed, weak)))
    )


def usable_score(skipped: Column, errors: Column, overall: Column) -> Column:
    """The judge's score where there is one: not if it was skipped, had errors, or gave no number."""
    return F.when(~F.coalesce(skipped, F.lit(False)) & (F.coalesce(errors, F.lit(0)) == 0), overall.cast("string").try_cast("double"))


def parse_simple(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The older judge's replies: everything from the first brace to the last as JSON: overall_score, passed, error."""
    body = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), F.col(reply))
    ok = F.try_parse_json(body).isNotNull()
    m = F.when(ok, F.from_json(body, "overall_score double, passed boolean"))
    return replies.withColumn("_m", m).withColumns(
        {
            "overall_score": F.col("_m.overall_score"), "passed": F.when(ok, F.col("_m.passed")).otherwise(F.lit(False)),
            "error": F.when(~F.coalesce(ok, F.lit(False)), "Failed to parse evaluation"),
        }
    ).drop("_m")
