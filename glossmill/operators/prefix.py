"""Running sums and ranks over a global order, without a task that gets all rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about; and buckets at most, whose sums one task adds up.
BUCKET_ROWS, BUCKETS = 50_000, 8192
#: Cuts that a value is held against at once.
GROUP = 128


def below(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below x: whole groups by their last ones, then those of one group."""
    groups = [cuts[i : i + GROUP] for i in range(0, len(cuts), GROUP)]
    read = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)
    whole = F.size(F.filter(read([g[-1] for g in groups], "array<double>"), lambda c: c < x))
    part = F.coalesce(F.get(read(groups, "array<array<double>>"), whole), F.array().cast("array<double>"))
    return F.when(x.isNotNull(), F.least(whole * GROUP + F.size(F.filter(part, lambda c: c < x)), F.lit(len(cuts))))


def cuts_of(df: DataFrame, order: str, bucket_rows: int | None = None) -> list[float]:
    """Where buckets of the order end: quantiles of its values, so that buckets hold about as many rows each however the
    values lie, and rows of one value share one."""
    buckets = int(min(BUCKETS, max(1, df.count() // (bucket_rows or BUCKET_ROWS))))
    if buckets == 1:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.select(order_value(df, order).alias("o")).approxQuantile("o", probabilities, 0.25 / buckets)))


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """The bucket of a value: 0 and up, -1 for nulls."""
    return F.coalesce(below(value, cuts), F.lit(-1)) if cuts else F.lit(0)


def order_value(df: DataFrame, order: str) -> Column:
    """The order's column as a double: numbers as they are, times in microseconds."""
    kind = dict(df.dtypes)[order]
    return (F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else F.col(order)).cast("double")


def running(df: DataFrame, order: str, sums: dict[str, Column], tie: list[str] | None = None, bucket_rows: int | None = None) -> DataFrame:
    """df and, for each name in sums, the sum of its column over all rows up to this one, by order (then tie).

    Rows go to buckets between quantiles of the order's values, so that they hold about as many rows each however the
    values lie (those of one value share a bucket); sums run within a bucket, and the sums of the buckets before it, of
    which there are BUCKETS at most, are added. Nulls come first. Wide rows are better off in smaller buckets (bucket_rows).
    """
    bucket = bucket_of(order_value(df, order), cuts_of(df, order, bucket_rows))
    rows = df.withColumns({"_bucket": bucket, **{f"_v_{k}": v for k, v in sums.items()}})
    totals = rows.groupBy("_bucket").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    offsets = totals.select(
        F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )
    within = Window.partitionBy("_bucket").orderBy(order, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(within) for k in sums})
    rows = rows.join(F.broadcast(offsets), rows["_bucket"] == offsets["_b"])
    return rows.select(*[F.col(c) for c in df.columns], *[(F.col(f"_r_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])
