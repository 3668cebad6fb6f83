"""Generation specs: draws that depend on a row's key only, prompts, and the provider plug-in.

Draws are hashes of (seed, salt, key), so that a row gets the same ones whatever the partitions, and a lost task
repeats them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the draws choose from.
TONES = ("enthusiastic", "balanced", "critical", "neutral", "frustrated", "satisfied", "impressed", "disappointed")
STYLES = ("technical", "casual", "professional", "storytelling", "analytical", "conversational", "formal", "informal")
FOCUS_AREAS = (
    "performance", "ui/ux", "pricing", "support", "documentation", "integrations", "reliability", "scalability", "security", "ease of use",
    "features", "updates", "community",
)
SCENARIOS = (
    "daily workflow", "team collaboration", "client projects", "personal projects", "enterprise deployment", "testing phase",
    "production use", "evaluation period", "migration from another tool",
)
COMPANY_TYPES = ("startup", "mid-size", "enterprise", "consulting", "agency")
TECHNICAL_DOMAINS = ("developer tools", "devtools", "saas", "software")

# Stand-ins of our own for vocabularies that come with a library elsewhere; all of them are parameters.
SEED_WORDS = (
    "anchor", "bridge", "canvas", "delta", "ember", "fabric", "garden", "harbor", "island", "journey", "kernel", "ladder", "meadow",
    "needle", "orbit", "pillar", "quarry", "ribbon", "signal", "timber", "umbrella", "valley", "window", "yonder",
)
NAMES = ("Alex Moreau", "Bao Lindqvist", "Casey Okafor", "Devi Santos", "Emery Novak", "Fen Castellan", "Gray Ibarra", "Hollis Tanaka")
JOBS = (
    "platform engineer", "data analyst", "product manager", "support lead", "security engineer", "designer", "researcher",
    "release manager",
)
USE_CASES = (
    "streamlined release checks", "shared customer insight", "automated nightly exports", "self-service dashboards", "faster onboarding"
)
PAIN_POINTS = ("aligning scattered tools", "untangling slow hand-offs", "tracking hidden costs", "keeping configuration honest")


def unit(key: Column, salt: str, seed: int) -> Column:
    """A number from 0 up to but not 1, fixed by key, salt and seed (52 bits of an MD5, which other engines have too)."""
    bits = F.conv(
        F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(salt), key.cast("string")).cast("binary")), 1, 13), 16, 10
    ).cast("bigint")
    return bits.cast("double") / F.lit(float(1 << 52))


def choose(key: Column, salt: str, seed: int, options: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(unit(key, salt, seed) * len(options)) + 1).cast("int"))


def weighted(key: Column, salt: str, seed: int, options: Sequence[tuple[object, float]]) -> Column:
    """An option by its weight: the first whose cumulative share lies above the draw."""
    total, so_far = float(sum(w for _, w in options)), 0.0
    u, out = unit(key, salt, seed), None
    for value, w in options[:-1]:
        so_far += w
        hit = u < so_far / total
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(options[-1][0]) if out is None else out.otherwise(F.lit(options[-1][0]))


def whole(key: Column, salt: str, seed: int, low: int, high: int) -> Column:
    return (F.floor(unit(key, salt, seed) * (high - low + 1)) + low).cast("int")


def several(key: Column, salt: str, seed: int, options: Sequence[str], n: int) -> Column:
    """n different options: those of the smallest draws."""
    ranked = F.array_sort(
        F.array(*[F.struct(unit(key, f"{salt}{i}", seed).alias("u"), F.lit(o).alias("o")) for i, o in enumerate(options)])
    )
    return F.slice(F.transform(ranked, lambda r: r["o"]), 1, min(n, len(options)))


def specs(
    rows: DataFrame, key: str, personas: Sequence[tuple[str, float]], ratings: Sequence[float], models: Sequence[tuple[str, float]],
    seed: int = 42, seed_words: int = 10, vocabulary: Sequence[str] = SEED_WORDS,
) -> DataFrame:
    """rows with a drawn persona, rating, model, seed words (with repetition), lengths, tone, style, scenario, focus
    areas and the persona's variations."""
    k = F.col(key)
    return rows.withColumns(
        {
            "persona": weighted(k, "persona", seed, personas), "rating": weighted(k, "rating", seed, list(enumerate(ratings, 1))), "model_key": weighted(k, "model", seed, models),
            "seed_words": F.array(*[choose(k, f"word{i}", seed, vocabulary) for i in range(seed_words)]),
            "min_words": whole(k, "least", seed, 50, 100), "max_words": whole(k, "most", seed, 150, 500),
            "tone": choose(k, "tone", seed, TONES), "style": choose(k, "style", seed, STYLES), "scenario": choose(k, "scenario", seed, SCENARIOS), "focus_areas": several(k, "focus", seed, FOCUS_AREAS, 3),
            "random_name": choose(k, "name", seed, NAMES), "random_job": choose(k, "job", seed, JOBS), "random_company_type": choose(k, "company", seed, COMPANY_TYPES), "random_use_case": choose(k, "use", seed, USE_CASES), "random_pain_point": choose(k, "pain", seed, PAIN_POINTS),
        }
    )


def review_id(seq: Column) -> Column:
    return F.format_string("rev_%04d", seq)


def retry_temperature(retry: Column) -> Column:
    return F.least(F.lit(1.0) + F.lit(0.1) * retry, F.lit(1.5))


GUIDANCE = {
    1: "a very bad experience with serious faults; be clearly dissatisfied", 2: "a poor experience with notable problems; be dissatisfied",
    3: "a mixed experience; weigh good against bad, leaning critical",
    4: "a good experience with small flaws; be satisfied, with fair criticism", 5: "an excellent experience; be warmly satisfied",
}
POSITIVE_BLOCK = "\n\nSentiment: keep the language positive and appreciative; put weaknesses constructively."
NEGATIVE_BLOCK = "\n\nSentiment: keep the language critical; name the problems and what they cost."
NEUTRAL_BLOCK = "\n\nSentiment: give strengths and weaknesses the same room; neither gushing nor harsh."
TECHNICAL_BLOCK = "\n\nTechnical depth: name features, interfaces, figures and trade-offs that someone in the role would know."
FEEDBACK_BLOCK = "\n\nThe previous attempt was rejected. Address this, and change the approach:\n"


def system_prompt(domain: Column) -> Column:
    """The prompt of a spec (with retry and feedback): guidance and sentiment by rating, a technical block for technical
    domains, and a block of feedback on a retry that has any. Only five seed words enter."""
    c = F.col
    guide = F.lit("a balanced assessment")
    for r, text in GUIDANCE.items():
        guide = F.when(c("rating") == r, text).otherwise(guide)
    mood = F.when(c("rating") >= 4, POSITIVE_BLOCK).when(c("rating") <= 2, NEGATIVE_BLOCK).otherwise(NEUTRAL_BLOCK)
    technical = F.when(F.lower(domain).isin(*TECHNICAL_DOMAINS), TECHNICAL_BLOCK).otherwise("")
    told = F.when(
        (F.coalesce(c("feedback"), F.lit("")) != "") & (c("retry") > 0), F.concat(F.lit(FEEDBACK_BLOCK), c("feedback"))
    ).otherwise("")
    lines = [
        F.concat(F.lit("Write an authentic "), domain, F.lit(" review as "), c("persona"), F.lit(".")),
        F.concat(F.lit("Role: "), c("random_job"), F.lit("; company: "), c("random_company_type"), F.lit("; use: "), c("random_use_case"), F.lit(".")),
        F.concat(F.lit("Rating: "), c("rating").cast("string"), F.lit("/5, "), guide, F.lit(".")),
        F.concat(F.lit("Tone: "), c("tone"), F.lit("; style: "), c("style"), F.lit("; scenario: "), c("scenario"), F.lit("; focus: "), F.array_join("focus_areas", ", "), F.lit(".")),
        F.concat(F.lit("Work in these words: "), F.array_join(F.slice("seed_words", 1, 5), ", "), F.lit(".")),
    ]
    return F.concat(F.concat_ws("\n", *lines), mood, technical, told)


def user_prompt() -> Column:
    """The request: stars, length, and what to stress, told from the feedback; the first that fits counts."""
    c, low = F.col, F.lower(F.col("feedback"))
    stress = F.when(
        F.contains(low, F.lit("technical")) | F.contains(low, F.lit("expertise")), "\n\nStress: specific technical detail."
    ).when(F.contains(low, F.lit("unique")), "\n\nStress: other examples and structure.").when(F.contains(low, F.lit("authentic")), "\n\nStress: personal experience.").otherwise("")
    return F.concat(F.format_string("Write a %d-star review of %d to %d words.", c("rating"), c("min_words"), c("max_words")), stress)


class Provider(Protocol):
    """A source of texts. Calls never raise: a failure is a result with success False and its error."""

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict: ...


RESULT = "text string, time double, cost double, input_tokens long, output_tokens long, success boolean, error string"


def call(prompts: DataFrame, make_provider, keys: Sequence[str], max_tokens: int = 1024) -> DataFrame:
    """keys and a result for each row (system_prompt, user_prompt, temperature).

    make_provider() is called once a task, and the provider closed at its end, if it can be; write the outcome before using it twice, for calls cost money and a
    repeated stage repeats them. A quota has to be shared out among the tasks by the provider.
    """
    fields = [
        ("text", pa.string()), ("time", pa.float64()), ("cost", pa.float64()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()),
        ("success", pa.bool_()), ("error", pa.string()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = None
        try:
            for b in batches:
                provider = provider or make_provider()
                out = []
                for s, u, t in zip(*(b.column(c).to_pylist() for c in ("system_prompt", "user_prompt", "temperature"))):
                    r = provider.generate(s, u, temperature=t, max_tokens=max_tokens)
                    tokens = r.get("tokens") or {}
                    took, cost = float(r.get("time") or 0), float(r.get("cost") or 0)
                    out.append(
                        (r.get("text"), took, cost, tokens.get("input"), tokens.get("output"), bool(r.get("success")), r.get("error"))
                    )
                made = list(zip(*out)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in keys), *(pa.array(m, t) for m, (_, t) in zip(made, fields))],
                    names=[*keys, *(n for n, _ in fields)],
                )
        finally:
            if hasattr(provider, "close"):
                provider.close()

    ddl = "".join(f"`{k}` {prompts.schema[k].dataType.simpleString()}, " for k in keys)
    return prompts.select(*keys, "system_prompt", "user_prompt", "temperature").mapInArrow(run, ddl + RESULT)
