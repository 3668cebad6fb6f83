"""URL filters by host and path, as a sort-merge range join.

A key is a host with its labels reversed, "/", and a path: com.example.www//en/. All urls under a rule's host and path
have keys that begin with the rule's, which makes the rule an interval of keys. Intervals of rules are nested or apart.
A url is a point for each host that its own host lies in (com, com.example, ...). Points and both ends of the intervals are sorted
together, and a sweep keeps a stack of the rules that are open: its depth is a running sum of +1 and -1, and the
entry at each depth the last rule that was opened there. The top of the stack at a point is the longest rule for
that host; the longest of a url's points wins.

Keys go no further than rules do: labels beyond the longest rule host's and paths beyond the longest rule path can't
matter and are cut, and equal keys are swept once. The sweep runs in buckets of key ranges, whose bounds are
quantiles of a bounded sample (results don't depend on it); a rule is in each bucket that its interval meets.
DataFrame functions only.

Defined results: the longest rule is that of most characters in host and path, of those as long the one with the longer
host. Of rules with equal host and path, one that blocks wins. Rules without a host, path or verdict (null) don't count; an empty
rule host fits empty hosts and, as its subdomains, hosts that end in a dot. A null url, or one without "://", has an empty host and path. Rows repeat as often as
they are there; without rules every url gets the default; an empty table gives an empty result. Columns of any
other name may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.common import staged

#: The rules (host, path, verdict) that the query applies.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
#: Points of a bucket on average; buckets at most (a square, as bounds are looked up in two steps); sampled keys of a
#: bucket, and bytes of them that count.
POINTS, SIDE, SAMPLE, BOUND_BYTES = 1024, 64, 16, 256
#: Keys that are broadcast with their verdicts at most, and their bytes; rows of a key from which it is salted.
BROADCAST_KEYS, BROADCAST_BYTES, HOT = 100_000, 8 << 20, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_of(spark: SparkSession, rules=RULES) -> DataFrame:
    names = ("host", "path", "verdict")
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    """The labels of a host, last one first."""
    return F.reverse(F.split(host, r"\.", -1))


def key(host: Column, path: Column) -> Column:
    """Bytes that sort as hosts and paths do; "/" is in no host."""
    return F.concat(host, F.lit("/"), path).cast("binary")


def intervals(rules: DataFrame) -> DataFrame:
    """One row a host and path: labels, path, since and until (the bounds of its keys), and the rule. No byte of UTF-8 is FF."""
    host = F.translate("host", UPPER, LOWER)
    each = rules.dropna(subset=["host", "path", "verdict"]).groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    size = (F.length("host") + F.length("path")).alias("size")
    rule = F.struct(size, F.length("host").alias("of_host"), F.concat("host", "path").alias("rule"), "verdict")
    since = key(F.concat_ws(".", labels(F.col("host"))), F.col("path"))
    return each.select(
        F.size(labels(F.col("host"))).alias("labels"), "path", since.alias("since"), F.concat(since, F.lit(b"\xff")).alias("until"), rule.alias("rule")
    )


def bucket(at: Column, bounds: list[bytes]) -> Column:
    """How many bounds aren't above a key: first among every 64th, then among the 64 that follow."""
    if not bounds:
        return F.lit(0)
    below = lambda some: F.size(F.filter(some, lambda b: b <= at))
    rows = [bounds[i : i + SIDE] for i in range(0, len(bounds), SIDE)]
    first = below(F.array(*[F.lit(r[0]) for r in rows]))
    within = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    return F.when(first == 0, 0).otherwise((first - 1) * SIDE + below(F.element_at(within, F.greatest(first, F.lit(1)))))


def bounds_of(keys: DataFrame, n: int) -> list[bytes]:
    """Bounds of buckets of about POINTS keys (at): quantiles of a sample, by hash, of bounded size."""
    buckets = min(SIDE * SIDE, -(-n // POINTS))
    if buckets < 2:
        return []
    share = min(1.0, SAMPLE * buckets / n)
    some = keys.filter(F.pmod(F.xxhash64("at"), F.lit(1 << 30)) < int((1 << 30) * share))
    sample = [bytes(r[0]) for r in some.select(F.substring("at", 1, BOUND_BYTES).alias("at")).orderBy("at").limit(2 * SAMPLE * buckets).collect()]
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []


def swept(points: DataFrame, rules: DataFrame, bounds: list[bytes]) -> DataFrame:
    """The columns of points (at, and others) and rule: the innermost interval of rules (since, until, rule) around at."""
    mine = [c for c in points.columns if c != "at"]
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in mine]
    event = lambda at, kind, step, rule: [at.alias("at"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), rule.alias("rule")]
    over = rules.withColumn("bucket", F.explode(F.sequence(bucket(F.col("since"), bounds), bucket(F.col("until"), bounds))))
    none = F.lit(None).cast(rules.schema["rule"].dataType)
    events = (
        over.select("bucket", *event(F.col("since"), 0, 1, F.col("rule")), *nothing)
        .unionByName(points.select(bucket(F.col("at"), bounds).alias("bucket"), *event(F.col("at"), 1, 0, none), *mine))
        .unionByName(over.select("bucket", *event(F.col("until"), 2, -1, none), *nothing))
    )
    until_here = lambda *by: Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth, stack = F.sum("step").over(until_here("bucket")), until_here("bucket", "depth")
    top = F.when(F.col("depth") > 0, F.last("rule", ignorenulls=True).over(stack))
    return events.withColumn("depth", depth).withColumn("top", top).filter("kind = 1").select(*mine, F.col("top").alias("rule"))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", key_column: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of each row of pages. rules: host, path, verdict."""
    host, path = parts(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")))
    rows = pages.select(F.col(f"`{key_column}`").alias("page_id"), host.alias("host"), path.alias("path"))
    ranges = staged(intervals(rules), "url-rules")
    reach = ranges.agg(F.max("labels").alias("labels"), F.max(F.length("path")).alias("path")).first()
    if reach.labels is None:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("near", F.concat_ws(".", F.slice(labels(F.col("host")), 1, reach.labels))).withColumn("onset", F.substring("path", 1, reach.path))
    # every key once, with the number of its rows
    keys = staged(rows.groupBy("near", "onset").agg(F.count("*").alias("copies")), "url-keys")
    size = keys.agg(F.count("*").alias("n"), F.sum("copies").alias("rows"), F.sum(F.octet_length("near") + F.octet_length("onset")).alias("bytes")).first()
    names = F.split("near", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat_ws(".", F.slice(names, 1, i)))
    points = keys.withColumn("of", F.explode(hosts)).select("near", "onset", "copies", key(F.col("of"), F.col("onset")).alias("at"))
    every = points.select("at").unionByName(ranges.select(F.col("since").alias("at")))
    best = swept(points, ranges, bounds_of(every, every.count())).groupBy("near", "onset", "copies").agg(F.max("rule").alias("rule"))
    found = best.select("near", "onset", "copies", "rule.rule", F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))
    return with_verdicts(rows, staged(found, "url-verdicts"), size).select("page_id", "host", "path", "rule", "verdict")


def with_verdicts(rows: DataFrame, found: DataFrame, size) -> DataFrame:
    """rows with the verdicts of their keys: broadcast if those are few, else joined by key, keys of many rows salted."""
    if size["n"] <= BROADCAST_KEYS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found.drop("copies")), ["near", "onset"])
    hot = max(HOT, size["rows"] // 100_000)  # so that no more than 100,000 keys are
    often = found.filter(F.col("copies") > hot).select("near", "onset", F.ceil(F.col("copies") / hot).cast("int").alias("salts"))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "host", "path"), F.col("salts")).cast("int"))
    salted = rows.join(F.broadcast(often), ["near", "onset"], "left").withColumn("salt", salt)
    repeats = F.sequence(F.lit(0), F.when(F.col("copies") > hot, F.ceil(F.col("copies") / hot) - 1).otherwise(F.lit(0)).cast("int"))
    return salted.join(found.withColumn("salt", F.explode(repeats)).drop("copies"), ["near", "onset", "salt"])
