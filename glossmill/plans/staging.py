"""Tables that cut lineage, in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a write's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where the session names none, a temporary
    one serves if all of Spark is one process (master local, as in tests); on a cluster that is an error."""
    sc = spark.sparkContext
    before = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (before.get() if before.isDefined() else None)
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="glossmill-")
    if not before.isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options) -> DataFrame:
    """df written as a table and read again."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors don't matter."""
    return written(df, shared_path(df.sparkSession, name))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What staged() is, for tables that nothing reads after the block: they are deleted at its end."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(shared_path(spark, name))
        return written(df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            removed(spark, path)


@contextmanager
def shedding(spark: SparkSession) -> Iterator[None]:
    """Within the block the shuffle files of a write go as it ends; the session's setting is put back after it."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)


def in_shares(spark: SparkSession, make: Callable[[int], DataFrame], shares: int, name: str) -> DataFrame:
    """All rows of make(0) to make(shares - 1), each of which is written before the next begins, so that the shuffle files of one
    share are there at a time. One share is left to be planned with what follows."""
    if shares == 1:
        return make(0)
    with shedding(spark):
        parts = [staged(make(share), name) for share in range(shares)]
    return reduce(DataFrame.unionByName, parts)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are fewer than those; larger inputs have more parts and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
