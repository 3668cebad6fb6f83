"""Hard negatives by bit-sliced integer products.

Components are integers. Less their smallest possible value they are sums of bit-planes, most significant first, so that a
score (the inner product with an anchor) is known after some planes but for an interval: the planes that are left add
at least the anchor's negative components times what they can hold, and at most its positive ones times it. With each plane the
intervals halve. A candidate goes as soon as its interval can't qualify: for positives, if it ends below as many
candidates as are wanted; for negatives, if it misses every positive's range, or ends below three that are surely
in it. Survivors end with exact scores.

Anchors are the queries. They and all rows are cut into blocks, and each pair of blocks is a task's group: anchors at a
time and rows of a block are bounded, and a block gives a few rows an anchor, which Spark ranks. First come the
positives, then, with their scores, the negatives.

Defined results: rows with a null label, or a vector that is null, empty, of another length than most or holds a
null or non-finite component, take no part. Rows equal in id, label and vector are one; rows that share an id only are rows of
their own, an anchor each if its id says so. Ties go to the smaller id, a null id last, and then by a hash of label and vector.
An anchor without positives, and a positive without negatives, give no rows; an empty table gives an empty result.
Columns of any name may be there. Scores must be exact: vectors for which a score could reach 2**51 (with 64 components: one of
23,000 or more) are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import passing, staged
from glossmill.llm.vectors import integers, matrix

#: Anchors of a block, rows of a block, and anchors that are held against a block at once.
ANCHORS, ROWS, AT_ONCE = 8192, 16_384, 64
#: Share of pairs from which the remaining planes are added pair by pair; pairs that are gathered at once.
SPARSE, GATHERED = 1 / 16, 1 << 16
#: Planes that are left when intervals are first looked at: with more of them an interval is wider than all scores.
FIRST = 4


class Block:
    """Rows of a block as bit-planes."""

    def __init__(self, x: np.ndarray):
        most = int(np.abs(x.astype(float)).max(initial=0))
        if 4 * most * most * x.shape[1] >= 1 << 53:
            raise ValueError("components are too large for exact scores")
        self.planes = max(1, most.bit_length() + 1)
        self.base = -(1 << (self.planes - 1))
        self.y = (x - self.base).astype(np.int32)

    def products(self, anchors: np.ndarray, left: int, rows=slice(None)) -> np.ndarray:
        """Scores as far as the planes above the last ones are known, those that are left taken as zeros."""
        exact = np.float32 if np.abs(anchors).sum(1).max(initial=0) << (self.planes - left) < 1 << 24 else np.float64
        top = (self.y[rows] >> left).astype(exact)
        return (anchors.astype(exact) @ top.T).astype(np.float64) * (1 << left) + self.base * anchors.sum(1)[:, None]

    def plane(self, anchors: np.ndarray, a: np.ndarray, r: np.ndarray, at: int) -> np.ndarray:
        """What plane at adds to the scores of the pairs (a, r)."""
        out = np.empty(len(a))
        for i in range(0, len(a), GATHERED):
            s = slice(i, i + GATHERED)
            out[s] = np.einsum("ij,ij->i", anchors[a[s]], (self.y[r[s]] >> at) & 1)
        return out * (1 << at)


def survivors(block: Block, rows: np.ndarray, anchors: np.ndarray, dropped) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row of the block, score) of those rows that dropped leaves. It is called with known scores, the least
    and the most that is to come for each anchor, and says which pairs can't qualify; as a matrix, then as lists with the
    pairs' anchors."""
    low, high = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
    left = min(FIRST, block.planes - 1)
    while True:
        known = block.products(anchors, left, rows)
        keep = ~dropped(known, low * ((1 << left) - 1), high * ((1 << left) - 1), None)
        if not left or keep.mean() <= SPARSE:
            break
        left -= 1
    a, at = np.nonzero(keep)
    scores, r = known[a, at], rows[at]
    while left and len(a):
        left -= 1
        scores = scores + block.plane(anchors, a, r, left)
        keep = ~dropped(scores, low * ((1 << left) - 1), high * ((1 << left) - 1), a)
        a, r, scores = a[keep], r[keep], scores[keep]
    return a, r, scores.astype(np.int64)


def greatest(values: np.ndarray, k: int, a: np.ndarray | None, m: int) -> np.ndarray:
    """The k-th greatest value of each of m anchors, minus infinity if there are fewer. a: the anchors of values in a list."""
    if a is None:
        return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(m, -np.inf)
    order = np.lexsort((-values, a))
    starts, out = np.searchsorted(a[order], np.arange(m + 1)), np.full(m, -np.inf)
    there = starts[:-1] + k <= starts[1:]
    out[there] = values[order][starts[:-1][there] + k - 1]
    return out


def ranked(a: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the first k of each a by the keys of order."""
    by = np.lexsort((*order[::-1], a))
    first = np.searchsorted(a[by], a[by])
    return by[np.arange(len(by)) - first < k]


def best_of(block: Block, rows: np.ndarray, anchors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with scores among which the k best rows of each anchor are."""

    def dropped(known, least, most, a):
        reach, floor = (most, least) if a is None else (most[a], least[a])
        if a is None:
            return known + reach[:, None] < greatest(known + floor[:, None], k, None, len(anchors))[:, None]
        return known + reach < greatest(known + floor, k, a, len(anchors))[a]

    return survivors(block, rows, anchors, dropped)


def banded(block: Block, rows: np.ndarray, anchors: np.ndarray, own: np.ndarray, bands: np.ndarray, k: int):
    """Pairs with scores among which the first k rows of each anchor's bands are. own: whether a row has the anchor's label;
    bands: for each anchor and positive the least and the greatest score, the least above the greatest if there is none."""

    def dropped(known, least, most, a):
        each = (lambda v: v[:, None]) if a is None else (lambda v: v[a])
        lo, hi = known + each(least), known + each(most)
        out = np.ones(known.shape, bool)
        mine = own[:, rows] if a is None else None
        if a is None:  # in lists, rows of the anchor's label have gone already
            lo, hi = np.where(mine, np.inf, lo), np.where(mine, np.inf, hi)
        for j in range(bands.shape[1]):
            bottom, top = each(bands[:, j, 0]), each(bands[:, j, 1])
            sure = np.where((lo >= bottom) & (hi <= top), lo, -np.inf)
            floor = np.maximum(bands[:, j, 0], greatest(sure, k, a, len(anchors)))
            out &= (lo > top) | (hi < each(floor)) | (bottom > top)
        return out

    return survivors(block, rows, anchors, dropped)


def blocks(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, run, schema: str) -> DataFrame:
    """run for each pair of a block of anchors and a block of rows, each dealt by a hash of its row."""
    wide, tall = -(-n_anchors // ANCHORS), -(-n // max(512, min(ROWS, n // 32)))
    deal = lambda of: F.pmod(F.xxhash64(F.lit(7), "id", "row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.withColumn("asks", F.lit(False)).withColumn("tall", deal(tall)).withColumn("wide", every(wide))
    right = anchors.withColumn("asks", F.lit(True)).withColumn("wide", deal(wide)).withColumn("tall", every(tall))
    both = left.unionByName(right, allowMissingColumns=True).groupBy("tall", "wide")
    return both.applyInArrow(lambda t: run(t.filter(pc.invert(t.column("asks"))), t.filter(t.column("asks"))), schema)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """Whether an id is null, and the id."""
    return np.array(column.is_null().to_pylist(), bool), numbers(column.fill_null(0)).astype(np.int64)


def chunks(table: pa.Table) -> Iterator[pa.Table]:
    for i in range(0, table.num_rows, AT_ONCE):
        yield table.slice(i, AT_ONCE)


FOUND = "anchor long, anchor_row long, id long, row long, label int, score long"


def positives(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, d: int, k: int) -> DataFrame:
    """anchor, anchor_row, id, row, label, score, rank: the first k other rows of each anchor's label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block, labels = Block(matrix(left.column("x"), d)), numbers(left.column("label"))
            (no_id, own), key = ids(left.column("id")), numbers(left.column("row"))
            for part in chunks(right.sort_by("label")):
                (_, a_id), a_row, a_label, x = ids(part.column("id")), numbers(part.column("row")), numbers(part.column("label")), matrix(part.column("x"), d)
                for label in np.unique(a_label):
                    some, here = np.flatnonzero(a_label == label), np.flatnonzero(labels == label)
                    if not len(here):
                        continue
                    a, r, score = best_of(block, here, x[some].astype(np.int64), k + 1)  # itself may be among them
                    a = some[a]
                    other = (own[r] != a_id[a]) | (key[r] != a_row[a]) | no_id[r]
                    a, r, score = a[other], r[other], score[other]
                    first = ranked(a, (-score, no_id[r], own[r], key[r]), k)
                    out.append((a_id[a[first]], a_row[a[first]], r[first], score[first]))
        return result(out, left)

    found = blocks(rows, anchors, n, n_anchors, run, FOUND)
    return first_of(found, Window.partitionBy("anchor", "anchor_row"), k)


def result(out: list, left: pa.Table) -> pa.Table:
    """Pairs (anchor, its row, place, score) with the columns of the rows at these places."""
    a, a_row, r, score = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4))
    at = left.take(pa.array(r))
    return pa.table({"anchor": a, "anchor_row": a_row, "id": at.column("id"), "row": at.column("row"), "label": at.column("label"), "score": score})


def first_of(found: DataFrame, by, k: int) -> DataFrame:
    order = by.orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def negatives(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, d: int, k: int, percent: tuple[int, int]) -> DataFrame:
    """anchor, anchor_row, place (of the positive), id, row, label, score, rank. anchors have goals: their positives' scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block, labels = Block(matrix(left.column("x"), d)), numbers(left.column("label"))
            (no_id, own), key = ids(left.column("id")), numbers(left.column("row"))
            for part in chunks(right):
                (_, a_id), a_row, x = ids(part.column("id")), numbers(part.column("row")), matrix(part.column("x"), d)
                same = numbers(part.column("label"))[:, None] == labels
                goals = part.column("goals").to_pylist()
                bands = np.full((len(goals), max(map(len, goals)), 2), (0, -1), np.int64)
                for i, goal in enumerate(goals):
                    for j, p in enumerate(goal):
                        bands[i, j] = -(-percent[0] * p // 100), percent[1] * p // 100
                a, r, score = banded(block, np.arange(left.num_rows), x.astype(np.int64), same, bands, k)
                for j in range(bands.shape[1]):
                    inside = (score >= bands[a, j, 0]) & (score <= bands[a, j, 1])
                    b, s, score_j = a[inside], r[inside], score[inside]
                    first = ranked(b, (-score_j, no_id[s], own[s], key[s]), k)
                    out.append((a_id[b[first]], a_row[b[first]], s[first], score_j[first], np.full(len(first), j)))
        place = np.concatenate([o[4] for o in out]) if out else np.zeros(0, np.int64)
        return result([o[:4] for o in out], left).append_column("place", pa.array(place, pa.int32()))

    found = blocks(rows, anchors, n, n_anchors, run, f"{FOUND}, place int")
    return first_of(found, Window.partitionBy("anchor", "anchor_row", "place"), k)


def mined(
    embeddings: DataFrame, anchor: Column, label: Column, vector: str = "embedding", key: str = "vec_id",
    n_positives: int = 5, n_negatives: int = 3, percent: tuple[int, int] = (50, 95),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows where that column is
    true; a null id never is) and each of its first positives, the first rows of other labels whose scores are within these
    percentages of the positive's. label: an expression over embeddings; rows where it is null take no part."""
    keep = {"id": F.col(f"`{key}`").cast("long"), "label": label.cast("int"), "anchor": F.coalesce(anchor, F.lit(False))}
    plain, d = integers(embeddings, vector, keep)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    plain = plain.filter("label is not null").withColumn("anchor", F.col("anchor") & F.col("id").isNotNull()).distinct()
    with passing(embeddings.sparkSession) as keep_until:
        rows = keep_until(plain.withColumn("row", F.xxhash64("label", "x")), "vectors")
        n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
        if not n_anchors:
            return embeddings.sparkSession.createDataFrame([], empty)
        asked, rows = rows.filter("anchor").drop("anchor"), rows.drop("anchor")
        near = staged(positives(rows, asked, n, n_anchors, d, n_positives).drop("label"), "positives")
        goals = near.groupBy("anchor", "anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("goals"))  # n_positives at most
        aims = asked.join(
            goals.select(F.col("anchor").alias("id"), F.col("anchor_row").alias("row"), F.col("goals.score").alias("goals")), ["id", "row"]
        )
        far = staged(negatives(rows, aims, n, n_anchors, d, n_negatives, percent), "negatives")
    one = near.select("anchor", "anchor_row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    two = far.select("anchor", "anchor_row", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return one.join(two, ["anchor", "anchor_row", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
