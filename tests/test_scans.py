"""Folds in order as parallel scans, against plain loops: one key with all rows, many segments, ties, nulls, streams."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glossmill.operators import metrics, scan, windows
from glossmill.streaming import breaker

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def apart(spark):
    """Partitions stay as they are, so that tasks can be told."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def in_a_row(flags, trip_at):
    n, out = 0, []
    for failed in flags:
        skip = n >= trip_at
        n = 0 if skip or not failed else n + 1
        out.append((n, skip))
    return out


@pytest.mark.parametrize("trip_at, share", [(5, 0.9), (1, 0.5), (3, 1.0), (5, 0.0)])
def test_failures_in_a_row_of_one_key(spark, apart, trip_at, share):
    rng = random.Random(trip_at)
    rows = [("hot", i * 3, rng.random() < share) for i in range(900)] + [(None, i * 5, rng.random() < share) for i in range(40)] + [("one", 7, True)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i long, f boolean")
    done = breaker.consecutive(df, "k", "i", "f", trip_at, segment_rows=50).withColumn("task", F.spark_partition_id()).collect()
    for key in ("hot", None, "one"):
        mine = sorted((r for r in done if r.key == key), key=lambda r: r.o)
        assert [(r.failures, r.fallback) for r in mine] == in_a_row([f for k, _, f in rows if k == key], trip_at)
    assert len({r.task for r in done if r.key == "hot"}) > 1  # a hot key isn't one task's
    assert breaker.consecutive(df.limit(0), "k", "i", "f").count() == 0


def on_access(events, seconds):
    at, n, out = None, 0, []
    for t, failed in sorted(events, key=lambda e: (e[0] is not None, e[0] or START, e[1])):
        if at is None:
            at = t
        elif t is not None and (t - at).total_seconds() > seconds:
            at, n = t, 0
        n += failed
        out.append((t, n))
    return out


def plain_time(t):
    return t and t.replace(tzinfo=timezone.utc)


@pytest.mark.parametrize("step, jitter, segment", [(20, 19, 60), (400, 500, 60), (100, 0, 1000), (301, 0, 30), (300, 0, 30)])
def test_clearings_of_one_key(spark, apart, step, jitter, segment):
    rng = random.Random(step + jitter)
    times = [START + timedelta(seconds=i * step + rng.randint(0, jitter), microseconds=rng.choice([0, 1]) if jitter else 0) for i in range(700)]
    rows = {"hot": [(t, rng.random() < 0.4) for t in times] + [(None, True), (None, False), (times[9], True), (times[9], True)], None: [(t, True) for t in times[::40]], "one": [(START, True)], "never": [(None, True)] * 3}
    table = [(k, t, f) for k, v in rows.items() for t, f in v]
    df = spark.createDataFrame(rng.sample(table, len(table)), "k string, ts timestamp, f boolean")
    done = breaker.batch(df, "k", "ts", "f", segment_rows=segment).withColumn("task", F.spark_partition_id()).collect()
    for key, events in rows.items():
        got = [(plain_time(r.ts), r.failures_so_far) for r in done if r.key == key]
        order = lambda x: (x[0] is not None, x[0] or START, x[1])
        assert sorted(got, key=order) == sorted(on_access(events, 300), key=order), key
    assert all(r.active == (r.failures_so_far >= 3) for r in done)
    if segment < 100:
        assert len({r.task for r in done if r.key == "hot"}) > 1
    assert breaker.batch(df.limit(0), "k", "ts", "f").count() == 0


def test_orbits_double(spark):
    n = 1000
    jumps = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") + 3 < n, F.col("id") + 3).alias("to"))
    first = spark.createDataFrame([("a", 1)], "k string, t long")
    assert sorted(r.t for r in scan.orbit(first, jumps).collect()) == list(range(1, n, 3))


def in_place(flags):
    rate = 0.0
    for n, ok in enumerate(flags, 1):
        rate = (int(rate * (n - 1)) + 1) / n if ok else rate
    return rate


@pytest.mark.parametrize("share, band", [(0.7, 64), (0.1, 1), (1.0, 3), (0.5, 0)])
def test_pass_rates_of_one_run(spark, monkeypatch, share, band):
    monkeypatch.setattr(scan, "BAND", band)  # narrow ones are missed, and walked again
    rng = random.Random(band)
    runs = {"hot": [rng.random() < share for _ in range(1500)], None: [rng.random() < share for _ in range(90)], "one": [True], "none": [False] * 3}
    rows = [(k, i * 2, f) for k, flags in runs.items() for i, f in enumerate(flags)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "s string, i long, f boolean")
    got = {r.s: r for r in metrics.pass_rate_parity(df, "s", "i", "f", segment_rows=150).collect()}
    for k, flags in runs.items():
        assert got[k].rate_parity == in_place(flags) and got[k].rate == pytest.approx(sum(flags) / len(flags)), k
    assert metrics.pass_rate_parity(df.limit(0), "s", "i", "f").count() == 0


def test_maps_of_segments_need_few_rounds(spark, monkeypatch):
    """Guesses get better for all segments at once, not for one a round."""
    rounds, keep = [], scan.staged
    monkeypatch.setattr(scan, "staged", lambda df, name: rounds.append(name) or keep(df, name))
    rng = random.Random(3)
    flags = [rng.random() < 0.6 for _ in range(4000)]
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "s string, i long, f boolean")
    assert metrics.pass_rate_parity(df, "s", "i", "f", segment_rows=100).first().rate_parity == in_place(flags)
    assert rounds.count("segment-maps") <= 4


def test_runs_of_failures_in_segments(spark, monkeypatch):
    from glossmill.operators import prefix

    monkeypatch.setattr(prefix, "BUCKET_ROWS", 40)
    rng = random.Random(8)
    rows = [("a", i, rng.random() < 0.97) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i long, f boolean")
    got = {r.i: (r.run_length, r.stopped) for r in windows.failure_runs(df, ["k"], ["i"], F.col("f"), 20).collect()}
    n, want = 0, {}
    for _, i, f in rows:
        n = n + 1 if f else 0
        want[i] = (n, n >= 20)
    assert got == want


def streamed_rows(rng, n=60):
    return [(rng.choice("ab"), START + timedelta(seconds=i * 37 + rng.randint(0, 30)), rng.random() < 0.5, i) for i in range(n)]


def test_streams_equal_tables_after_a_stop(spark):
    rng = random.Random(5)
    rows = streamed_rows(rng)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, ts timestamp, f boolean, i long")
    got = breaker.replayed(df, "ts", lambda s: breaker.stream(s, "k", "ts", "f", seconds=200), (0.3, 0.6)).collect()
    for key in "ab":
        mine = sorted((plain_time(r.ts), r.failures_so_far, r.active) for r in got if r.key == key)
        assert mine == [(t, n, n >= 3) for t, n in on_access([(t, f) for k, t, f, _ in rows if k == key], 200)]
    ran = breaker.replayed(df, "ts", lambda s: breaker.consecutive_stream(s, "k", "i", "f", 2)).collect()
    for key in "ab":
        assert [(r.failures, r.fallback) for r in sorted((r for r in ran if r.key == key), key=lambda r: r.o)] == in_a_row([f for k, _, f, _ in rows if k == key], 2)
    last = breaker.replayed(df, "ts", lambda s: breaker.rate_stream(s, "k", "ts", "i", 100)).collect()
    for r in last:
        t = plain_time(r.ts)
        near = [i for k, u, _, i in rows if k == r.key and timedelta(0) <= t - u < timedelta(seconds=100)]
        assert (r.requests, r.amount_in_window) == (len(near), sum(near))
    assert len(last) == len(rows)


def test_quiet_keys_leave_the_state(spark, tmp_path):
    """A timer drops what the next event would clear."""
    schema = "k string, ts timestamp, f boolean"
    at = lambda s: START + timedelta(seconds=s)
    own, out = breaker.stateful(spark), str(tmp_path / "out")
    for i, rows in enumerate(([("quiet", at(0), True), ("busy", at(0), True)], [("busy", at(100), True)], [("busy", at(900), True)], [("quiet", at(950), True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        breaker.drained(lambda s: breaker.stream(s, "k", "ts", "f"), str(tmp_path / "in"), spark.createDataFrame([], schema).schema, out, str(tmp_path / "state"), own)
    got = {(r.key, plain_time(r.ts)): r.failures_so_far for r in spark.read.parquet(out).collect()}
    assert got == {("quiet", at(0)): 1, ("busy", at(0)): 1, ("busy", at(100)): 2, ("busy", at(900)): 1, ("quiet", at(950)): 1}
    kept = own.read.format("statestore").option("stateVarName", "since").load(str(tmp_path / "state"))
    assert {r.key.key for r in kept.select("key").collect()} <= {"busy", "quiet"}


def test_small_keys_are_not_cut_into_segments(spark, monkeypatch):
    """A key of many events beside many of few: only the large one goes by segments, and all restart as a walk does."""
    rng = random.Random(12)
    times = {"large": sorted(rng.randrange(5000) for _ in range(400)), None: [5, 5, 30, 90]}
    times |= {f"k{i}": [rng.randrange(300) for _ in range(rng.randrange(1, 9))] for i in range(120)}
    want = set()
    for k, t in times.items():
        at = min(t)
        for x in sorted(t):
            if x - at > 20:
                want.add((k, x))
                at = x
    seen, by_segments = [], scan.restarts_of_large
    monkeypatch.setattr(scan, "restarts_of_large", lambda some, *rest: seen.extend(r.k for r in some.select("k").distinct().collect()) or by_segments(some, *rest))
    df = spark.createDataFrame([(k, t) for k, all_ in times.items() for t in all_] + [("none", None)], "k string, t long")
    got = [tuple(r) for r in scan.restarts(df, 20, 50).collect()]
    assert seen == ["large"] and set(got) == want and len(got) == len(want)
