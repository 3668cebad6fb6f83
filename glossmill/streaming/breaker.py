"""Circuit breakers as state: failures of a key, cleared when an event comes later than an interval after the last clearing.

The clearing happens on access, so the state follows the events' order. A stream keeps it in a state store; over a stored
table it is a scan in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossmill.operators import scan
from glossmill.plans.staging import shared_path

OUTPUT = "key string, ts timestamp, failures_so_far long, active boolean"


def batch(events: DataFrame, key: str, ts: str, failed: str, seconds: int = 300, trip_at: int = 3, segment_rows: int | None = None) -> DataFrame:
    """key, ts, failures_so_far, active for stored events. Events of one time count with those that passed first; those without
    a time come first of all and clear nothing.

    When the next clearing comes is a function of this one's time, so clearings are an orbit, found across segments of a key's
    events; the failures since are a scan that begins anew at each of them."""
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"),
        F.coalesce(F.col(failed).cast("boolean"), F.lit(False)).alias("failed"),
    )
    times = rows.select(F.col("key").alias("k"), F.unix_micros("ts").alias("t"))
    resets = scan.restarts(times, seconds * 1_000_000, segment_rows or scan.SEGMENT_ROWS)
    marks = resets.select(F.col("k").alias("key"), F.timestamp_micros("t").alias("ts"), F.lit(False).alias("failed"), F.lit(0).alias("turn"))
    every = marks.unionByName(rows.withColumn("turn", F.lit(1)))
    done = scan.since_reset(every, ["key"], ["ts", "turn", "failed"], F.col("turn") == 0, F.col("failed").cast("long"), "failures_so_far", "_before", segment_rows)
    return done.filter("turn = 1").select("key", "ts", "failures_so_far", (F.col("failures_so_far") >= trip_at).alias("active"))


def in_time(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A trigger's rows of a key, in order. How many they are at most is for the source to say (maxFilesPerTrigger)."""
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class OnAccess(StatefulProcessor):
    """The time of a key's last clearing and the failures since, as value state. A timer of event time drops the state once
    the next event must clear it anyway, so keys that have gone quiet take no room."""

    def __init__(self, seconds: int, trip_at: int):
        self.width, self.trip_at = seconds * 1_000_000, trip_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("since", "at long, n long")

    def drop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  named by Spark
        pdf = in_time(rows, ["ts", "failed"])
        at, n = self.state.get() if self.state.exists() else (None, 0)
        counts = []
        for t, failed in zip(micros(pdf["ts"]), pdf["failed"].tolist()):
            if at is None:
                at = t
            elif t - at > self.width:
                at, n = t, 0
            n += bool(failed)
            counts.append(n)
        self.state.update((at, n))
        self.drop_timers()
        self.handle.registerTimer((at + self.width) // 1000 + 1)  # a time after the interval, in milliseconds
        yield pd.DataFrame(
            {"key": key[0], "ts": pdf["ts"].to_numpy(), "failures_so_far": counts, "active": [x >= self.trip_at for x in counts]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class InARow(StatefulProcessor):
    """The failures that have followed on each other, as value state."""

    def __init__(self, trip_at: int):
        self.trip_at = trip_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = in_time(rows, ["o"])
        n = self.state.get()[0] if self.state.exists() else 0
        failures, fallback = [], []
        for failed in pdf["failed"].tolist():
            fallback.append(n >= self.trip_at)
            n = 0 if fallback[-1] or not failed else n + 1
            failures.append(n)
        self.state.update((n,))
        yield pd.DataFrame({"key": key[0], "o": pdf["o"].to_numpy(), "failures": failures, "fallback": fallback})

    def close(self) -> None:
        pass


class LastCalls(StatefulProcessor):
    """A key's calls of the last interval, as list state: their times and amounts."""

    def __init__(self, seconds: int):
        self.width = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getListState("calls", "t long, amount long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = in_time(rows, ["ts"])
        kept = list(self.calls.get()) if self.calls.exists() else []
        t = np.array([c[0] for c in kept] + micros(pdf["ts"]), np.int64)
        amount = np.array([c[1] for c in kept] + pdf["amount"].tolist(), np.int64)
        total = np.concatenate([[0], np.cumsum(amount)])
        first, last = np.searchsorted(t, t - self.width, side="right"), np.searchsorted(t, t, side="right")
        new = slice(len(kept), None)
        alive = int(first[-1])
        self.calls.put(list(zip(t[alive:].tolist(), amount[alive:].tolist())))
        yield pd.DataFrame(
            {"key": key[0], "ts": pdf["ts"].to_numpy(), "requests": (last - first)[new], "amount_in_window": (total[last] - total[first])[new]}
        )

    def close(self) -> None:
        pass


def stream(events: DataFrame, key: str, ts: str, failed: str, seconds: int = 300, trip_at: int = 3, late: str = "0 seconds") -> DataFrame:
    """What batch() gives, over a stream whose events come in the order of time, give or take those of a trigger."""
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"),
        F.coalesce(F.col(failed).cast("boolean"), F.lit(False)).alias("failed"),
    ).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(OnAccess(seconds, trip_at), OUTPUT, "append", "EventTime")


def consecutive_stream(events: DataFrame, key: str, order: str, failed: str, trip_at: int = 5) -> DataFrame:
    """What consecutive() gives, over a stream whose calls come in order, give or take those of a trigger."""
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("o"),
        F.coalesce(F.col(failed).cast("boolean"), F.lit(False)).alias("failed"),
    )
    return rows.groupBy("key").transformWithStateInPandas(InARow(trip_at), "key string, o long, failures long, fallback boolean", "append", "None")


def rate_stream(events: DataFrame, key: str, ts: str, amount: str, seconds: int = 60) -> DataFrame:
    """key, ts, requests, amount_in_window: the calls of a key, and their amounts, in the interval that ends with each."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(amount).cast("long").alias("amount"))
    return rows.groupBy("key").transformWithStateInPandas(
        LastCalls(seconds), "key string, ts timestamp, requests long, amount_in_window long", "append", "None"
    )


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application for streams with state of several kinds. The caller's keeps its settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def drained(make, source: str, schema, out: str, checkpoint: str, spark: SparkSession) -> None:
    """Runs make(stream of the Parquet files in a folder) over all files that are there and not yet taken, on from the
    checkpoint, and appends what it gives to the files of out."""
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    run = make(files).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    run.awaitTermination()


def replayed(events: DataFrame, ts: str, make, cuts: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The result of a stream over a stored table, whose rows arrive in slices of time (cut at these quantiles). After each slice
    the stream stops, and the next run goes on from its checkpoint."""
    spark = events.sparkSession
    own, source, out, checkpoint = stateful(spark), *(shared_path(spark, x) for x in ("arrivals", "streamed", "stream-state"))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    edges = events.select(at.cast("double").alias("t")).approxQuantile("t", list(cuts), 0.001)
    for i in range(len(edges) + 1):
        mine = events.filter((at > edges[i - 1] if i else F.lit(True)) & (at <= edges[i] if i < len(edges) else F.lit(True)))
        mine.write.parquet(f"{source}/slice={i}")
        drained(make, source, events.schema, out, checkpoint, own)
    return spark.read.parquet(out)


def rolling_failures(events: DataFrame, ts: str, by: str, late: str = "10 minutes", width: str = "300 seconds") -> DataFrame:
    """Failures by window of event time, with a watermark for late ones: by, window_start, failures."""
    w = F.window("ts", width)
    rows = events.select(F.col(by).alias("by"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("by", w.alias("w")).agg(F.count("*").alias("failures")).select(
        "by", F.col("w.start").alias("window_start"), "failures"
    )


def consecutive(events: DataFrame, key: str, order: str, failed: str, trip_at: int = 5, segment_rows: int | None = None) -> DataFrame:
    """key, o, failures, fallback for calls in order (which tells a key's calls apart): once trip_at failures have followed on
    each other, the next call is a stand-in's and the count starts anew; a success clears it too.

    The count is one of trip_at + 1 states. A success leads every state to 0, a failure each to the next one around: so the state
    is the failures since the last success, by scan, modulo their number."""
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("o"),
        F.coalesce(F.col(failed).cast("boolean"), F.lit(False)).alias("failed"),
    )
    done = scan.since_reset(rows, ["key"], ["o"], ~F.col("failed"), F.col("failed").cast("long"), "run", "run_before", segment_rows)
    states = F.lit(trip_at + 1)
    return done.select("key", "o", (F.col("run") % states).alias("failures"), (F.col("run_before") % states == trip_at).alias("fallback"))


def append_log(events: DataFrame, path: str, checkpoint: str):
    """A stream of event rows appended to a log as JSON lines, each batch once; returns the running query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")  # a batch that is repeated replaces itself

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
