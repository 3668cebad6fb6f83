"""Generation in rounds: all pending candidates are generated, gated and decided at once, attempt after attempt."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions import sentiment as S
from glossmill.functions import text as T
from glossmill.operators import diversity, gates, generate, judge
from glossmill.plans import judging
from glossmill.plans.staging import staged
from glossmill.sources.io import Config

FINAL = [
    "seq", "review_id", "attempt", "rating", "persona", "model_key", "seed_words", "text", "time", "cost", "n_words", "n_unique",
    "self_bleu_diversity", "alignment_score", "breaker_open", "judge_score", "reasons", "decision",
]
#: Accepted texts that a judge's prompt on uniqueness draws from, and those that it shows; texts of the stand-in's overlap.
CONTEXT, SHOWN, OVERLAP = 10, 3, 5


class Breaker:
    """Failures by rating, cleared on the first check that comes more than an interval after the last clearing. The
    candidates of a round are checked at one time, in the order of their slots; from the failure that fills the
    count on, the sentiment gates of that rating let candidates pass (a strict profile's but those of very high scores)."""

    def __init__(self, trip_at: int = 3, seconds: float = 300, now: Callable[[], float] = time.time):
        self.trip_at, self.seconds, self.now = trip_at, seconds, now
        self.since, self.failures = now(), {}

    def open_for(self, rows: DataFrame) -> Column:
        """Whether it is open for each of rows (seq, rating, is_unrealistic), of which the failures are counted."""
        at = self.now()
        if at - self.since > self.seconds:
            self.since, self.failures = at, {}
        failed = rows.filter("is_unrealistic").select("rating", "seq")
        place = Window.partitionBy("rating").orderBy("seq")
        firsts = failed.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= self.trip_at).collect()  # trip_at rows a rating
        counts = {r["rating"]: r["count"] for r in failed.groupBy("rating").count().collect()}
        out = F.lit(False)
        for rating in {*counts, *self.failures}:
            before = self.failures.get(rating, 0)
            first = next((r["seq"] for r in firsts if r["rating"] == rating and before + r["k"] == self.trip_at), None)
            if before >= self.trip_at:
                out = out | (F.col("rating") == rating)
            elif first is not None:
                out = out | ((F.col("rating") == rating) & (F.col("seq") >= first))
            self.failures[rating] = before + counts.get(rating, 0)
        return out


def judged(rows: DataFrame, accepted: DataFrame | None, t: gates.Thresholds, domain: str, primary, secondary) -> DataFrame:
    """rows that pass the gates, with judge_score and with the judge's reasons; others aren't shown to a judge."""
    last = [] if accepted is None else [r["text"] for r in accepted.orderBy(F.desc("seq")).limit(CONTEXT).select("text").collect()][::-1]
    shown = F.array(*[F.substring(F.lit(x), 1, judging.SHOWN_BEFORE) for x in last[:SHOWN]]).cast("array<string>")
    sets = F.array(*[F.array_distinct(T.words(F.lower(F.lit(x)))) for x in last[-OVERLAP:]]).cast("array<array<string>>")
    own = F.array_distinct(T.words(F.lower(F.col("text"))))
    asked = rows.filter("passed").select(
        F.col("seq").alias("review_id"), "text", "rating", "persona", F.lit(domain).alias("domain"), shown.alias("before"),
        judge.mean_overlap(own, sets).alias("avg_overlap"),
    )
    verdict = judge.gate(judging.evaluate(asked, primary, secondary), t.min_llm_judge_score)
    verdict = verdict.select(
        F.col("review_id").alias("_of"), "judge_reasons",
        judge.usable_score(F.lit(False), F.col("errors_count"), F.col("overall_score")).alias("judge_score"),
    )
    out = rows.join(verdict, rows["seq"] == F.col("_of"), "left")
    return out.withColumn(
        "reasons", F.when(F.size("judge_reasons") > 0, F.col("judge_reasons")).otherwise(F.col("reasons"))
    ).drop("_of", "judge_reasons")


def run(
    spark: SparkSession, config: Config, make_provider, thresholds: gates.Thresholds | None = None, profile: S.Profile = S.LENIENT,
    seed: int = 42, slots: tuple[int, int] | None = None, accepted: DataFrame | None = None, primary=None, secondary=None,
    breaker: Breaker | None = None,
) -> DataFrame:
    """One row for each slot (1 to the target, or first to last): its accepted or rejected candidate after at most
    max_regeneration_attempts + 1 attempts.

    A round's calls are written before they are used, so a lost executor repeats calls of that round at most.
    Candidates are held against each other within a round and against those accepted before, as one corpus. Those that
    pass the gates go to the judge, if there is a primary one; the breaker of the sentiment gates goes on from
    round to round (and, if it is given, from run to run).
    """
    t = thresholds or gates.Thresholds(**{k: v for k, v in config.thresholds.items() if k in gates.Thresholds.__dataclass_fields__})
    breaker = breaker or Breaker(profile.breaker_at)
    first, last_slot = slots or (1, config.target_samples)
    pending = spark.range(first, last_slot + 1).select(
        F.col("id").alias("seq"), F.array().cast("array<string>").alias("history"), F.lit(None).cast("string").alias("feedback")
    )
    done: DataFrame | None = None
    for retry in range(t.max_regeneration_attempts + 1):
        spec = generate.specs(
            pending.withColumns({"retry": F.lit(retry), "_key": F.concat_ws("/", F.col("seq"), F.lit(retry))}), "_key", config.personas,
            config.ratings, config.models, seed,
        )
        # a slot keeps its rating and persona through its attempts
        spec = spec.withColumns(
            {
                "rating": generate.weighted(F.col("seq"), "rating", seed, list(enumerate(config.ratings, 1))),
                "persona": generate.weighted(F.col("seq"), "persona", seed, config.personas),
            }
        )
        prompts = spec.withColumns(
            {
                "system_prompt": generate.system_prompt(F.lit(config.domain)), "user_prompt": generate.user_prompt(),
                "temperature": generate.retry_temperature(F.lit(retry)),
            }
        )
        results = staged(generate.call(prompts, make_provider, ["seq"]), "generated")
        rows = spec.select("seq", "history", "rating", "persona", "model_key", "seed_words").join(
            results.select("seq", F.coalesce("text", F.lit("")).alias("text"), "time", "cost"), "seq"
        )
        good = accepted
        if done is not None:
            now = done.filter("decision = 'accept'").select("seq", "text")
            good = now if accepted is None else accepted.select("seq", "text").unionByName(now)
        corpus = rows.select("seq", "text")
        if good is not None:
            corpus = corpus.unionByName(good.select("seq", "text"))
        bleu = diversity.self_bleu_docs(corpus).select("seq", (F.lit(1.0) - F.col("bleu")).alias("self_bleu_diversity"))
        scored = staged(gates.scored(rows.join(bleu, "seq").withColumn("attempt", F.lit(retry + 1)), profile), "scored")
        checked = scored.withColumn("breaker_open", breaker.open_for(scored))
        lenient = F.lit(True) if profile.breaker_score is None else F.col("unrealistic_score") <= profile.breaker_score
        checked = gates.gated(checked, t, F.col("breaker_open") & lenient)
        if primary is None:
            checked = checked.withColumn("judge_score", F.lit(None).cast("double"))
        else:
            checked = judged(checked, good, t, config.domain, primary, secondary)
        decided = staged(
            gates.decide(checked.withColumn("count", F.lit(retry)), t).withColumn(
                "review_id", generate.review_id(F.col("seq"))
            ).select(*FINAL, "history"),
            "decided",
        )
        last = decided.filter("decision <> 'regenerate'").select(*FINAL)
        done = last if done is None else done.unionByName(last)
        pending = decided.filter("decision = 'regenerate'").select("seq", "history", F.array_join("reasons", " | ").alias("feedback"))
        if pending.isEmpty():
            break
    return done


#: Candidates in all, by the target; and rejections without an acceptance between them after which a run gives up.
MOST_CANDIDATES, MOST_FAILURES = 10, 20


def fill(
    spark: SparkSession, config: Config, make_provider, thresholds: gates.Thresholds | None = None, profile: S.Profile = S.LENIENT,
    seed: int = 42, primary=None, secondary=None, breaker: Breaker | None = None,
) -> DataFrame:
    """Rows of run() in waves of new slots, until the target is accepted, candidates run out, or a whole wave of
    MOST_FAILURES or more is rejected."""
    out: DataFrame | None = None
    slot, have = 0, 0
    breaker = breaker or Breaker(profile.breaker_at)
    while have < config.target_samples and slot < MOST_CANDIDATES * config.target_samples:
        missing = min(config.target_samples - have, MOST_CANDIDATES * config.target_samples - slot)
        wave = max(missing, min(MOST_FAILURES, MOST_CANDIDATES * config.target_samples - slot))
        before = None if out is None else out.filter("decision = 'accept'")
        rows = staged(
            run(spark, config, make_provider, thresholds, profile, seed, (slot + 1, slot + wave), before, primary, secondary, breaker),
            "wave",
        )
        good = rows.filter("decision = 'accept'").count()
        out = rows if out is None else out.unionByName(rows)
        slot, have = slot + wave, have + good
        if not good and wave >= MOST_FAILURES:
            break
    # a last wave may bring more than were missing: the first ones count
    extra = have - config.target_samples
    if extra > 0:
        late = rows.filter("decision = 'accept'").orderBy(F.desc("seq")).limit(extra).agg(F.min("seq")).first()[0]
        out = out.filter((F.col("decision") != "accept") | (F.col("seq") < late))
    return out
