"""Roll-ups of a run: models, totals, histograms, running means, shares, costs and joins of batch results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.operators.prefix import bucket_of, cuts_of, order_value, running
from glossmill.operators.scan import SEGMENT_ROWS, integer_fold
from glossmill.plans.staging import staged


def exact_sum(column: str) -> Column:
    """The sum of amounts to ten places, which doesn't depend on the order of addition."""
    return F.sum(F.col(column).cast("decimal(28,10)")).cast("double")


def model_rollup(rows: DataFrame) -> DataFrame:
    """model, counts, sums and means; rows: model, accepted, time, cost, quality_score, judge_score.

    Means are of accepted rows whose score isn't null; rates, times and costs are per generated row.
    """
    ok = F.col("accepted")
    per = rows.groupBy("model").agg(
        F.count("*").alias("samples_generated"), F.count_if(ok).alias("samples_accepted"), exact_sum("time").alias("total_time"), exact_sum("cost").alias("total_cost"),
        F.coalesce(F.avg(F.when(ok, F.col("quality_score"))), F.lit(0.0)).alias("avg_quality_score"), F.coalesce(F.avg(F.when(ok, F.col("judge_score"))), F.lit(0.0)).alias("avg_llm_judge_score"),
    )
    each = lambda c: F.coalesce(F.try_divide(c, F.col("samples_generated").cast("double")), F.lit(0.0))
    return per.withColumns(
        {
            "acceptance_rate": each(F.col("samples_accepted").cast("double")), "avg_time_per_sample": each(F.col("total_time")),
            "cost_per_sample": each(F.col("total_cost")),
        }
    )


def totals(rows: DataFrame) -> DataFrame:
    """One row for the whole run."""
    return rows.agg(
        F.count("*").alias("total_generated"), F.count_if("accepted").alias("total_accepted"),
        F.count_if(~F.col("accepted")).alias("total_rejected"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("time"), F.lit(0.0)).alias("total_time"),
    ).withColumn("success_rate", F.coalesce(F.try_divide(F.col("total_accepted").cast("double"), F.col("total_generated").cast("double")), F.lit(0.0)))


def best_model(rollup: DataFrame) -> DataFrame:
    """The model of least cost a sample, to nine places; those without an accepted row come last, ties go by name."""
    cost = F.when(F.col("samples_accepted") > 0, F.round("cost_per_sample", 9)).otherwise(F.lit(float("inf")))
    return rollup.select("model", "cost_per_sample", cost.alias("_c")).orderBy("_c", "model").limit(1).drop("_c")


def reason_histogram(rows: DataFrame, order: str = "seq") -> DataFrame:
    """reason, n, first_seen (the least order) of arrays of reasons."""
    return rows.select(order, F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count("*").alias("n"), F.min(order).alias("first_seen")
    )


def frequent(values: DataFrame, k: int, counters: int = 1000, most: int = 1 << 20) -> DataFrame:
    """value, n: the k most frequent values (or more) of one column, exactly, without a histogram of all of them.

    Each task keeps so many counters: where it has more, all go down by as much as brings it back to that number, and it
    remembers by how much they went (Misra and Gries). No value has more rows than its counters and these amounts
    together, so those that could be among the first k are counted exactly, in a second pass, and the k-th count
    proves that nothing else reaches it. Where it doesn't, there are four times as many counters; from the most on, all values
    are counted.
    """
    one = values.select(F.col(values.columns[0]).cast("string").alias("value")).filter("value is not null")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        lost = 0
        for batch in batches:
            for pair in batch.column("value").value_counts().to_pylist():
                counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
            if len(counts) > counters:
                down = sorted(counts.values(), reverse=True)[counters]
                counts, lost = {v: n - down for v, n in counts.items() if n > down}, lost + down
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), lost], pa.int64())], names=["value", "n"])

    while counters < most:
        sketch = staged(one.mapInArrow(kept, "value string, n long").groupBy("value").agg(F.sum("n").alias("n")), "counters")
        lost = (sketch.filter("value is null").agg(F.sum("n").alias("n")).first().n) or 0
        least = sketch.filter("value is not null").orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count("*").alias("k")).first()
        floor = least.n if least.k == k else 0
        candidates = sketch.filter(F.col("value").isNotNull() & (F.col("n") + lost >= floor)).select("value")
        if not lost:
            return sketch.filter("value is not null")  # nothing went down: the counters are the counts
        if candidates.count() <= 4 * counters:
            exact = staged(one.join(F.broadcast(candidates), "value", "left_semi").groupBy("value").agg(F.count("*").alias("n")), "frequent")
            kth = exact.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count("*").alias("k")).first()
            if kth.k == k and kth.n > lost:  # what isn't a candidate has that many rows at most
                return exact
        counters *= 4
    return one.groupBy("value").agg(F.count("*").alias("n"))


def top_reasons(rows: DataFrame, order: str = "seq", k: int = 10, counters: int = 1000) -> DataFrame:
    """reason, n, first_seen, pct: the k most frequent reasons of rows (order, reasons), earlier ones first among equals, with
    their percentage of the rows that have reasons."""
    rejected = rows.filter(F.size("reasons") > 0)
    each = rejected.select(order, F.explode("reasons").alias("reason"))
    total = rejected.count()
    often = frequent(each.select("reason"), k, counters)
    least = often.orderBy(F.desc("n")).limit(k).agg(F.coalesce(F.min("n"), F.lit(0)).alias("n")).first().n
    # as frequent as the k-th are as many as tie with it: their first places decide
    tied = often.filter(F.col("n") >= least).select(F.col("value").alias("reason"))
    seen = each.join(tied, "reason", "left_semi").groupBy("reason").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return seen.orderBy(F.desc("n"), "first_seen", "reason").limit(k).withColumn("pct", F.col("n") / F.lit(float(max(total, 1))) * 100)


def rating_distribution(rows: DataFrame) -> DataFrame:
    """rating 1 to 5, n, pct; ratings without rows have zeros."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col("rating").alias("_r")).agg(F.count("*").alias("n"))
    stars = spark.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    total = rows.agg(F.count("*").alias("total"))
    joined = stars.join(counts, stars["rating"] == counts["_r"], "left").crossJoin(total)
    return joined.select(
        "rating", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double") * 100, F.col("total").cast("double")), F.lit(0.0)).alias("pct"),
    )


def distribution_check(weights: DataFrame, low: float = 0.99, high: float = 1.01) -> DataFrame:
    """weights (name, weight) with share_pct, and whether all of them sum to 1, within the load's and the exact bounds.
    A distribution has a row a category."""
    total = weights.agg(F.sum("weight").alias("total"))
    return weights.crossJoin(F.broadcast(total)).select(
        "name", "weight", F.coalesce(F.try_divide(F.col("weight") * 100, F.col("total")), F.lit(0.0)).alias("share_pct"),
        F.col("total").between(low, high).alias("loads"), (F.abs(F.col("total") - 1) < 1e-6).alias("exact"),
    )


def running_means(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """order and the mean so far of each column, nulls left out."""
    sums = {f"s_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in columns} | {f"n_{c}": F.col(c).isNotNull().cast("long") for c in columns}
    done = running(rows, order, sums)
    return done.select(order, *[F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}").cast("double")).alias(f"avg_{c}") for c in columns])


def pass_rate_parity(passes: DataFrame, by: str, order: str, flag: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """by, rate_parity, rate: the rate as an update in place gives it, which only changes with a pass and cuts its count
    to a whole number, and the mean. order tells a run's (a value of by) rows apart.

    The first depends on the order. Its state is the whole number behind a pass, of so many rows so far; rows between passes
    only move the place of the next. Segments of a run are followed side by side from the states that they may begin with.
    """
    rows = passes.select(F.col(by).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(flag), F.lit(False)).alias("passed"))
    rows = rows.withColumn("b", bucket_of(order_value(rows, "o"), cuts_of(rows, "o", segment_rows)))
    so_far = Window.partitionBy("k", "b").orderBy("o")
    rows = rows.withColumn("place", F.row_number().over(so_far).cast("long"))
    hits = F.col("passed").cast("int")
    parts = rows.groupBy("k", "b").agg(F.count("*").alias("n"), F.sum(hits).alias("hits"), F.max(F.when(F.col("passed"), F.col("place"))).alias("last"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    parts = parts.withColumn("past", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.withColumns({"hits_past": F.coalesce(F.sum("hits").over(before), F.lit(0)), "at": F.col("past") + F.col("last")})
    parts = staged(parts.withColumn("since", F.coalesce(F.last("at", ignorenulls=True).over(before), F.lit(1))), "segments")
    same = F.col("k").eqNullSafe(F.col("k0")) & (F.col("b") == F.col("b0"))
    offsets = parts.select(F.col("k").alias("k0"), F.col("b").alias("b0"), "past", "since")
    hit = rows.filter("passed").join(offsets, same).select("k", "b", (F.col("place") + F.col("past")).alias("place"), "since")

    def walk(table: pa.Table, states: np.ndarray) -> np.ndarray:
        rate = states / float(table.column("since")[0].as_py())
        for n in np.sort(table.column("place").to_numpy()).tolist():
            states = np.floor(rate * (n - 1)) + 1
            rate = states / n
        return states

    guesses = parts.filter("hits > 0").select("k", "b", F.col("hits_past").cast("long").alias("guess"), F.col("since").cast("long").alias("most"))
    ends = integer_fold(hit, ["place", "since"], guesses, walk)
    means = parts.groupBy("k").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.max("at").alias("at"))
    rate = F.when(F.col("at").isNull(), F.lit(0.0)).otherwise(F.col("state") / F.col("at").cast("double"))
    return means.join(ends.withColumnRenamed("k", "k0"), F.col("k").eqNullSafe(F.col("k0")), "left").select(
        F.col("k").alias(by), rate.alias("rate_parity"), (F.col("hits") / F.col("n")).alias("rate")
    )


#: Prices of models (input, output), and those of a family's unknown models.
PER_THOUSAND = {
    "gpt-4": (0.03, 0.06), "gpt-4-turbo": (0.01, 0.03), "gpt-3.5-turbo": (0.0015, 0.002), "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
}
PER_THOUSAND_DEFAULT, BATCH_FACTOR = (0.01, 0.03), 0.5
PER_MILLION = {"gemini-2.0-flash-exp": (0.0, 0.0), "gemini-pro": (0.5, 1.5)}
PER_MILLION_DEFAULT = (0.5, 1.5)
GROQ_PER_TOKEN, ROUTER_INPUT, ROUTER_OUTPUT = 1e-7, 0.0001, 0.0003


def price(model: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float], side: int) -> Column:
    out = F.lit(default[side])
    for name, p in prices.items():
        out = F.when(model == name, F.lit(p[side])).otherwise(out)
    return out


def cost(provider: Column, model: Column, tokens_in: Column, tokens_out: Column, batch: Column, reported: Column | None = None) -> Column:
    """Cost of a call: by thousand tokens (half in a batch), by million, by token, or a router's own figure or estimate."""
    openai = (tokens_in / F.lit(1000.0)) * price(model, PER_THOUSAND, PER_THOUSAND_DEFAULT, 0) + (tokens_out / F.lit(1000.0)) * price(
        model, PER_THOUSAND, PER_THOUSAND_DEFAULT, 1
    )
    gemini = (tokens_in / F.lit(1_000_000.0)) * price(model, PER_MILLION, PER_MILLION_DEFAULT, 0) + (tokens_out / F.lit(1_000_000.0)) * price(
        model, PER_MILLION, PER_MILLION_DEFAULT, 1
    )
    router = F.when(F.contains(model, F.lit(":free")), F.lit(0.0)).otherwise(
        (tokens_in * F.lit(ROUTER_INPUT) + tokens_out * F.lit(ROUTER_OUTPUT)) / F.lit(1000.0)
    )
    if reported is not None:
        router = F.coalesce(reported, router)
    return F.when(
        provider == "openai", openai * F.when(batch, F.lit(BATCH_FACTOR)).otherwise(F.lit(1.0))
    ).when(provider == "gemini", gemini).when(provider == "groq", (tokens_in + tokens_out) * F.lit(GROQ_PER_TOKEN)).when(provider == "openrouter", router).otherwise(F.lit(0.0))


def batch_results(requests: DataFrame, results: DataFrame, model: str) -> DataFrame:
    """requests (custom_id) with text, cost, tokens, success and error from results (custom_id, status_code, content,
    prompt_tokens, completion_tokens, error); requests without a result get an error row."""
    r = results.select(F.col("custom_id").alias("_id"), "status_code", "content", "prompt_tokens", "completion_tokens", "error")
    rows = requests.join(r, requests["custom_id"] == r["_id"], "left")
    ok = F.coalesce(F.col("status_code") == 200, F.lit(False))
    paid = cost(F.lit("openai"), F.lit(model), F.col("prompt_tokens"), F.col("completion_tokens"), F.lit(True))
    why = F.when(F.col("_id").isNull(), "Result not found in batch output").when(~ok, F.coalesce("error", F.lit("Unknown error")))
    return rows.select(
        *requests.columns, F.when(ok, F.col("content")).alias("text"), F.lit(model).alias("model"),
        F.when(ok, paid).otherwise(F.lit(0.0)).alias("cost"),
        F.when(ok, F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), ok.alias("success"), why.alias("error"),
        F.lit(True).alias("batch_mode"),
    )
