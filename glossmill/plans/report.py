"""The quality report: small aggregates in, Markdown out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame


def _tick(good: bool) -> str:
    return "✓" if good else "✗"


def markdown(
    overall: dict, cosine: dict, models: list[dict], totals: dict, ratings: list[dict], realism: dict, reasons: list[dict], judge: dict,
    target: int, at: datetime | None = None,
) -> str:
    """The report of a run. Sections without data say so instead of failing."""
    minutes = (totals.get("total_time") or 0.0) / 60
    accepted = totals.get("total_accepted") or 0
    per_minute = accepted / minutes if minutes else 0.0
    out = [
        "# Dataset Quality Report", "", f"Generated: {(at or datetime.now()):%Y-%m-%d %H:%M:%S}", "", "## Generation", "",
        f"- Target: {target}", f"- Generated: {totals.get('total_generated', 0)}", f"- Accepted: {accepted} ({(totals.get('success_rate') or 0) * 100:.1f}%)", f"- Rejected: {totals.get('total_rejected', 0)}", f"- Time: {minutes:.1f} min", f"- Cost: ${totals.get('total_cost') or 0:.2f}", "",
        "## Models", "", "| Model | Samples | Accepted | Rate | Quality | Judge | Time | Cost | Cost/sample |", "|-|-|-|-|-|-|-|-|-|",
    ]
    for m in models:
        out.append(
            f"| {m['model']} | {m['samples_generated']} | {m['samples_accepted']} | {m['acceptance_rate'] * 100:.1f}% | {m['avg_quality_score']:.2f} | {m['avg_llm_judge_score']:.2f} | {m['avg_time_per_sample']:.2f}s | ${m['total_cost']:.2f} | ${m['cost_per_sample']:.3f} |"
        )
    out += ["", "## Diversity", ""]
    out += [
        f"- Overall: {overall['overall_score']:.3f} {_tick(overall['overall_score'] > 0.6)}",
        f"- Self-BLEU diversity: {overall['self_bleu_diversity']:.3f}", f"- Semantic diversity: {overall['semantic_diversity']:.3f}",
        f"- Vocabulary: {overall['vocabulary_size']}", f"- TTR: {overall['ttr']:.3f}", f"- MATTR: {overall['mattr']:.3f}",
        f"- Bigrams: {overall['bigram_diversity']:.3f}", f"- Trigrams: {overall['trigram_diversity']:.3f}",
    ]
    out += [
        f"- Cosine: mean {cosine['avg_similarity']:.3f} {_tick(cosine['avg_similarity'] < 0.7)}, largest {cosine.get('max_similarity') or 0:.3f}, smallest {cosine.get('min_similarity') or 0:.3f}",
        "", "## Judges", "", f"- Pass rate: {judge.get('pass_rate', 0) * 100:.1f}%",
        f"- Agreement: {judge.get('agreement_rate', 0) * 100:.1f}%", f"- Evaluations: {judge.get('evaluations', 0)}", "", "## Ratings", "",
    ]
    out += [f"- {r['rating']}-star: {r['n']} ({r['pct']:.1f}%)" for r in ratings]
    out += [
        "", "## Synthetic and real texts", "",
        f"- Realism: {realism['realism_score']:.2f} {_tick(realism['realism_score'] > 0.7)} ({realism.get('comparison_quality') or 'no real texts'})",
    ]
    if realism.get("length_diff_pct") is not None:
        out += ["", "| Measure | Synthetic | Real | Difference |", "|-|-|-|-|"]
        for label, c, d in (
            ("Words", "avg_length", "length_diff_pct"), ("Different words", "avg_unique_words", "unique_words_diff_pct"),
            ("Sentences", "avg_sentences", "sentence_diff_pct"),
        ):
            out.append(f"| {label} | {realism[f'synthetic_{c}']:.1f} | {realism[f'real_{c}']:.1f} | {realism[d]:.1f}% |")
    out += ["", "## Rejections", "", f"Rejected: {totals.get('total_rejected', 0)}", ""]
    out += [f"- {r['reason']}: {r['n']} ({r['pct']:.1f}%)" for r in reasons]
    paid = [m for m in models if m["samples_accepted"] > 0]
    out += ["", "## Cost and speed", "", f"- Throughput: {per_minute:.1f} accepted a minute"]
    if paid:
        best = min(paid, key=lambda m: (m["cost_per_sample"], m["model"]))
        out.append(f"- Cheapest: {best['model']} at ${best['cost_per_sample']:.4f} a sample")
    return "\n".join(out) + "\n"


def one(df: DataFrame) -> dict:
    return df.first().asDict()


def write(df_text: DataFrame, path: str) -> None:
    """A one-row DataFrame of text as a file."""
    df_text.coalesce(1).write.mode("overwrite").text(path)
