"""Sharding by a hierarchical weighted hash tree.

A row descends from region to rack to shard. At each node every child draws ln(u) / weight, u being a uniform
hash of (child's path, key), and the largest draw wins, so a child gets rows in proportion to its weight. A draw
depends on nothing but the key and that child: where a child's weight changes, rows move into or out of that
child's subtree only, and a new region takes rows only into itself.

Defined results: a null key is hashed as the empty text, a null text has size 1 and the checksum of the empty
text; rows with equal keys share a shard; rows equal in key, size and checksum are interchangeable; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of the slot numbering holds on average, at most.
BUCKET_ROWS = 50_000
#: Equal rows that one task writes at once.
CHUNK = 1 << 20
SEED = "glossmill-shards"


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; leaves carry a shard number and a weight, others the sum of their children's."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def topology(regions: int, racks: int, shards: int) -> Node:
    """An even tree; shard numbers run from 0 through regions and racks."""
    at = iter(range(regions * racks * shards))
    return Node(
        "root",
        tuple(
            Node(
                f"region{r}",
                tuple(Node(f"rack{k}", tuple(Node(f"shard{s}", shard=next(at)) for s in range(shards))) for k in range(racks)),
            ) for r in range(regions)
        ),
    )


def with_region(tree: Node, weights: list[float]) -> Node:
    """The tree and one more region, of one rack with a shard for each weight; rows move only into it."""
    first = sum(1 for _ in leaves(tree))
    rack = Node("rack0", tuple(Node(f"shard{i}", shard=first + i, leaf_weight=w) for i, w in enumerate(weights)))
    return replace(tree, children=(*tree.children, Node(f"region{len(tree.children)}", (rack,))))


def leaves(tree: Node):
    for c in tree.children:
        yield from leaves(c) if c.children else (c,)


def draw(key: Column, path: str, weight: float) -> Column:
    """ln(u) / weight; u comes from 52 bits of an MD5, so that any SQL engine can draw the same."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}/{path}/"), key).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)


def descended(df: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """df with the shard of each row: one column a level, so that a level is drawn once."""
    at = [("", tree)]
    done = df.withColumn(out, F.lit(""))
    k = F.col(key)
    while any(n.children for _, n in at):
        pick = None
        for path, n in at:
            live = [c for c in n.children if c.weight > 0]
            best = F.array_max(
                F.array(
                    *[F.struct(draw(k, f"{path}/{c.name}", c.weight).alias("draw"), F.lit(f"{path}/{c.name}").alias("name")) for c in live]
                )
            )["name"] if len(live) > 1 else F.lit(f"{path}/{live[0].name}")
            pick = F.when(F.col(out) == path, best) if pick is None else pick.when(F.col(out) == path, best)
        done = done.withColumn(out, pick)
        at = [(f"{p}/{c.name}", c) for p, n in at for c in n.children if c.weight > 0]
    number = None
    for path, n in at:
        number = F.when(F.col(out) == path, F.lit(n.shard)) if number is None else number.when(F.col(out) == path, F.lit(n.shard))
    return done.withColumn(out, number)


def shard(docs: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of each row.

    Slots count from 0 in each shard, by the MD5 of key, checksum and size. Rows that are equal in these are one row
    with a count, summed task by task before it moves, so that no number of them is a task's; different rows of
    one key have different hashes. Rows are numbered in buckets of the hash, after the buckets' offsets by a sum of
    their counts; at last the counts become rows again, CHUNK at once, chunks being dealt anew.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
    )
    rows = rows.groupBy("key", "id", "size", "crc").agg(F.count("*").alias("copies"))
    n = docs.count()
    shards = len(list(leaves(tree)))
    digits = max(2, math.ceil(math.log(max(1, n / BUCKET_ROWS / shards), 16)) + 1)
    rows = rows.withColumn(
        "md5", F.md5(F.concat_ws("/", "id", "crc", "size").cast("binary"))
    ).withColumn("bucket", F.substring("md5", 1, digits))
    rows = descended(rows, "id", tree, "shard")
    rows = descended(rows, "id", grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    if shards * 16**digits <= 1 << 16:  # the bound of the offsets, whatever the input
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("shard", "bucket").orderBy("md5", "key", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(
        offsets, (F.col("shard") == F.col("of_shard")) & (F.col("bucket") == F.col("of_bucket")), "left"
    )
    placed = placed.withColumn("first", F.col("first") + F.col("offset"))
    each = lambda df: df.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    few, many = placed.filter(F.col("copies") <= CHUNK), placed.filter(F.col("copies") > CHUNK)
    chunk = many.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    chunk = chunk.withColumns(
        {"first": F.col("first") + F.col("at"), "copies": F.least(F.lit(CHUNK).cast("long"), F.col("copies") - F.col("at"))}
    ).drop("at").repartition("first")
    out = each(few).unionByName(each(chunk))
    return out.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


#: Production topology: 8 shards; the ninth comes as a region of its own.
TREE = topology(2, 2, 2)
GROWN = with_region(TREE, [1.0])
