"""Ordered operators over attempts and events: loops, runs of failures, rates and circuit breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.operators.scan import since_reset


def three_identical(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with stuck: whether this value and the two before it are equal."""
    w = Window.partitionBy(*by).orderBy(*order)
    v = F.col(value)
    return rows.withColumn("stuck", F.coalesce((F.lag(v, 1).over(w) == v) & (F.lag(v, 2).over(w) == v), F.lit(False)))


def two_of_three(rows: DataFrame, by: list[str], order: list[str], hit: Column) -> DataFrame:
    """rows with tripped: whether two of this and the two rows before it hit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-2, 0)
    return rows.withColumn("tripped", F.sum(hit.cast("int")).over(w) >= 2)


def failure_runs(rows: DataFrame, by: list[str], order: list[str], failed: Column, stop_at: int = 20) -> DataFrame:
    """rows with run_length (failures in a row up to this one) and stopped (from stop_at on)."""
    hit = F.coalesce(failed, F.lit(False))
    done = since_reset(rows, by, order, ~hit, hit.cast("long"), "run_length", "_before")
    return done.drop("_before").withColumn("stopped", F.col("run_length") >= stop_at)


def rate_window(rows: DataFrame, ts: str, amount: Column, seconds: int = 60, slot: int = 3600) -> DataFrame:
    """rows with requests and amount_in_window over the last `seconds`, this row's second included.

    The order is that of the whole table, but a row needs only the rows shortly before it: time is cut into slots,
    rows near a slot's end go to the next one too, and slots are windows of their own.
    """
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")
    cut = rows.withColumns({"_s": at, "_a": amount})
    home = F.floor(F.col("_s") / slot)
    reach = F.floor((F.col("_s") + seconds - 1) / slot)
    spread = cut.withColumn("_slot", F.explode(F.sequence(home, reach)))
    w = Window.partitionBy("_slot").orderBy("_s").rangeBetween(-(seconds - 1), 0)
    done = spread.withColumns({"requests": F.count("*").over(w), "amount_in_window": F.sum("_a").over(w)})
    return done.filter(F.col("_slot") == home).drop("_s", "_a", "_slot")


def breaker_windows(events: DataFrame, by: list[str], ts: str, failed: Column, seconds: int = 300, trip_at: int = 3) -> DataFrame:
    """by, window_start, failures, tripped: failures counted in windows that start anew every `seconds`.

    Counting by window is what a stored table can tell; the breaker that starts anew when it is looked at is in
    glossmill.streaming.breaker.
    """
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    counts = events.filter(failed).groupBy(*by, w.alias("w")).agg(F.count("*").alias("failures"))
    return counts.select(*by, F.col("w.start").alias("window_start"), "failures", (F.col("failures") >= trip_at).alias("tripped"))
