"""Judging: a prompt for each criterion, the judges' replies parsed, stand-ins where they fail, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators import generate, judge
from glossmill.plans.staging import staged

SYSTEM = "You judge reviews strictly and fairly. Answer with one JSON object only."
ASK = {
    "authenticity": "Does this sound like a person's own experience, with natural language, details and balance?",
    "alignment": "Does the text's sentiment match its rating?",
    "expertise": "Does the text show knowledge of its domain, as its author's role suggests?",
    "uniqueness": "Does the text differ from the earlier ones in phrasing, content and structure?",
}
SECONDARY = ("authenticity", "alignment")
#: Characters of a text, and of each earlier one, that a prompt shows.
SHOWN, SHOWN_BEFORE = 1000, 200


def prompts(reviews: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """review_id, criterion and prompts; reviews: review_id, text, rating, persona, domain, before (earlier texts)."""
    asks = F.create_map(*[x for k in criteria for x in (F.lit(k), F.lit(ASK[k]))])
    rows = reviews.select("*", F.explode(F.array(*[F.lit(k) for k in criteria])).alias("criterion"))
    earlier = F.when(
        (F.col("criterion") == "uniqueness") & (F.size("before") > 0),
        F.concat(
            F.lit("\nEarlier texts:\n"),
            F.array_join(F.transform(F.slice("before", 1, 3), lambda b: F.substring(b, 1, SHOWN_BEFORE)), "\n"),
        ),
    ).otherwise("")
    role = F.when(
        F.col("criterion") == "expertise", F.concat(F.lit("\nDomain: "), F.col("domain"), F.lit("; role: "), F.col("persona"))
    ).otherwise("")
    body = F.concat(
        F.lit("Criterion: "), F.col("criterion"), F.lit("\n"), asks[F.col("criterion")], F.lit("\nRating: "),
        F.col("rating").cast("string"), role, earlier, F.lit("\nText:\n"), F.substring("text", 1, SHOWN), F.lit("\nGive "),
        F.col("criterion"), F.lit("_score (0 to 10), decision (PASS or FAIL) and feedback."),
    )
    return rows.select(
        "review_id", "criterion", F.lit(SYSTEM).alias("system_prompt"), body.alias("user_prompt"), F.lit(0.5).alias("temperature")
    )


def replies(reviews: DataFrame, make_provider, criteria: tuple[str, ...], fallback: bool = True) -> DataFrame:
    """review_id, criterion, score, decision, feedback, fallback, llm_success, parsing_failed of one judge.

    Replies are written before they are used. A call that failed, and a reply that can't be parsed, is a stand-in's
    row, or an error with score 0 where those are off.
    """
    answers = staged(generate.call(prompts(reviews, criteria), make_provider, ["review_id", "criterion"]), "replies")
    rows = judge.parse(answers.withColumn("reply", F.when(F.col("success"), F.col("text")).otherwise("")))
    facts = reviews.select(
        "review_id", judge.authenticity_fallback(F.col("text"))["authenticity_score"].alias("_a"),
        judge.alignment_fallback(F.col("text"), F.col("rating")).alias("_l"),
        judge.expertise_fallback(F.col("text"))["expertise_score"].alias("_e"), judge.uniqueness_fallback(F.col("avg_overlap")).alias("_u"),
    )
    rows = rows.select("review_id", "criterion", "score", "decision", "feedback", "parsing_failed").join(facts, "review_id")
    stand_in = F.when(
        F.col("criterion") == "authenticity", F.col("_a")
    ).when(F.col("criterion") == "alignment", F.col("_l")).when(F.col("criterion") == "expertise", F.col("_e")).otherwise(F.col("_u"))
    passes = F.when(stand_in >= F.when(F.col("criterion") == "expertise", 5.5).otherwise(6.0), "PASS").otherwise("FAIL")
    use = F.col("parsing_failed") & F.lit(fallback)
    return rows.select(
        "review_id", "criterion", F.when(use, stand_in).otherwise(F.col("score")).alias("score"), F.when(use, passes).otherwise(F.col("decision")).alias("decision"),
        F.when(use, F.concat(F.lit("Heuristic: "), F.round(stand_in, 1).cast("string"), F.lit("/10"))).otherwise(F.col("feedback")).alias("feedback"),
        use.alias("fallback"), (~F.col("parsing_failed")).alias("llm_success"), (F.col("parsing_failed") & ~F.lit(fallback)).alias("parsing_failed"),
    )


def evaluate(reviews: DataFrame, primary, secondary=None, fallback: bool = True) -> DataFrame:
    """review_id, the verdict of all criteria, joined feedback and that of each criterion (dimension_feedback), and the
    agreement with a second judge if there is one."""
    first = replies(reviews, primary, judge.CRITERIA, fallback)
    each = first.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "feedback"))).alias("dimension_feedback"))  # a row a criterion
    out = judge.verdicts(first, ["review_id"]).join(judge.joined_feedback(first, ["review_id"]), "review_id").join(each, "review_id")
    if secondary is None:
        return out.withColumn("agreement_rate", F.lit(None).cast("double"))
    second = replies(reviews, secondary, SECONDARY, fallback)
    return out.join(judge.consensus(first, second, ["review_id"]).select("review_id", "agreement_rate"), "review_id", "left")
