"""Connected components of links that stay distributed, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import removed, shared_path, staged, written

ROUNDS = 60


def components(links: DataFrame, keep=staged) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of links (a, b); those of no link are left out.

    Large star: each node's larger neighbours go to its smallest one; small star: its smaller neighbours and the
    node itself do. Both keep the components, and end in stars when nothing changes any more, after a number of
    rounds that grows with the logarithm of the size. Minima are aggregated before they are shuffled; the join
    that sends them to the links of a node is one that adaptive execution splits where a node has very many. Each
    round's links are written to the shared folder, and those of the round before deleted; keep stages the result.
    """
    spark = links.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "links")
        return written(df, path), path

    now, at = kept(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large, large_at = kept(
            both.filter(F.col("b") > F.col("a")).join(least, "a").select(
                F.col("b").alias("a"), F.col("m").alias("b")
            ).filter("a != b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        old = at
        now, at = kept(
            large.join(least, "a").select(
                F.col("b").alias("a"), F.col("m").alias("b")
            ).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        )
        removed(spark, old)
        removed(spark, large_at)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links haven't come to rest in {ROUNDS} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
    out = keep(stars, "components")
    removed(spark, at)
    return out
