"""SimHash near-duplicates: exact links of fingerprints in a distributed vantage-point tree.

Equal fingerprints are one point. A vantage-point tree over a bounded sample cuts the points into shards: at each
node a point goes to the side that its distance from the vantage point says, and where the triangle inequality
lets a link cross the radius, it visits the other side as a query too. A shard builds a tree of its own and prunes
it by the same bounds, so that every pair within the limit is compared where its tree path leads, and no other
need be. Each shard gives a spanning star of each of its components instead of its pairs, so that a group of any
size costs a row a point; components of all shards are joined by distributed stars.

Defined results: null texts and texts without words have the fingerprint zero and are linked like any other; texts
of fewer words than a shingle are one shingle; equal texts and repeated rows share a component; a component's id is
its smallest doc_id, nulls left out (null if there is no other); an empty table gives an empty result. Columns of any
other name may be there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import few, fresh, identity, passing, placed, slices, staged
from glossmill.llm.components import components

SEED = 42
#: Shards of so many points each, up to so many shards; of the next size from there on. Fewer and larger ones mean fewer
#: visits: in 8 shards a point is sent some 2 times, in 64 some 4 to 6 times. The last size holds for any more points.
SHARDS = ((1 << 13, 8), (1 << 17, 64), (1 << 22, None))
#: Points sampled for the tree by shard, and in all (16 MB); times the mean of a shard's points that a part asks for at most.
SAMPLE, SAMPLED, ASKED = 512, 2_000_000, 2
#: Points that are routed at once.
ROUTED = 65_536
#: Points that are compared with each other at once; and points from which a cluster too dense for the tree's
#: bounds is searched by looking up each fingerprint's neighbours.
LEAF, DENSE = 256, 150_000
#: Copies of a fingerprint from which its rows aren't shuffled by it.
HOT = 10_000


def fingerprint(text: str, width: int = 3, seed: int = SEED) -> int:
    """Bit i is set if it is in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # A-Z and the ASCII spaces only, as these are bytes
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, max(1, len(words) - width + 1))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, and fp (the fingerprint as a signed 64-bit integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(fps)], names=[*keep, "fp"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}fp long")


def distance(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ other).astype(np.int16)


def vantage(points: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The point and radius, of some drawn, with fewest points within reach of the radius and the most even sides; None if
    no point parts them."""
    best = None
    some = points if len(points) <= 4096 else rng.choice(points, 4096)
    for v in rng.choice(points, min(12, len(points)), replace=False):
        below = np.cumsum(np.bincount(distance(some, v), minlength=65)) / len(some)
        for r in range(64):
            if 0.2 <= below[r] <= 0.8:
                near = below[min(64, r + limit)] - (below[r - limit] if r >= limit else 0) + abs(below[r] - 0.5)
                if best is None or near < best[0]:
                    best = (near, v, r)
    return best and (np.uint64(best[1]), int(best[2]))


def grow(sample: np.ndarray, shards: int, limit: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer) of a tree whose largest leaf is cut until there are so many; a child below 0
    is shard -1 - child."""
    rng = np.random.default_rng(7)
    nodes: list[list[int]] = []
    leaves, whole, n = [(-len(sample), 0, None, sample)], [], 1  # (size, number, its node and side, points)
    while leaves and len(leaves) + len(whole) < shards:
        _, _, at, points = heapq.heappop(leaves)
        cut = vantage(points, limit, rng) if len(points) >= 8 else None
        if cut is None:
            whole.append(at)
            continue
        v, r = cut
        if at:
            nodes[at[0]][at[1]] = len(nodes)
        nodes.append([int(v), r, 0, 0])
        inner = distance(points, v) <= r
        for side, mine in ((2, points[inner]), (3, points[~inner])):
            heapq.heappush(leaves, (-len(mine), n, (len(nodes) - 1, side), mine))
            n += 1
    for shard, at in enumerate([*whole, *(leaf[2] for leaf in leaves)]):
        if at:
            nodes[at[0]][at[1]] = -1 - shard
    return [(v, r, inner, outer) for v, r, inner, outer in nodes]


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of the points: each point's own (home), and those that it visits.

    A link across a radius is found by its inner point's visit, so a point at home visits outwards only; a visitor
    goes wherever the bounds let it.
    """
    if not nodes:
        return np.zeros(len(points), np.int32), points, np.ones(len(points), bool)
    out: list[tuple[int, np.ndarray, bool]] = []
    todo = [(0, points, True)]
    while todo:
        at, mine, home = todo.pop()
        if not len(mine):
            continue
        if at < 0:
            out.append((-1 - at, mine, home))
            continue
        v, r, inner, outer = nodes[at]
        d = distance(mine, np.uint64(v))
        if home:
            todo += [(inner, mine[d <= r], True), (outer, mine[d > r], True), (outer, mine[(d <= r) & (d > r - limit)], False)]
        else:
            todo += [(inner, mine[d <= r + limit], False), (outer, mine[d > r - limit], False)]
    return np.concatenate(
        [np.full(len(p), s, np.int32) for s, p, _ in out]
    ), np.concatenate([p for _, p, _ in out]), np.concatenate([np.full(len(p), h, bool) for _, p, h in out])


class Stars:
    """Components of the points of one shard, as far as pairs have been linked."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]


def search(points: np.ndarray, home: np.ndarray, limit: int, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of the pairs within the limit of a point at home and one that asks (all do,
    if asks isn't given)."""
    stars, rng = Stars(len(points)), np.random.default_rng(11)

    def compare(members: np.ndarray, queries: np.ndarray) -> None:
        for i in range(0, len(members), LEAF):
            m = members[i : i + LEAF]
            for j in range(0, len(queries), 4096):
                q = queries[j : j + 4096]
                a, b = np.nonzero(np.bitwise_count(points[m][:, None] ^ points[q][None, :]) <= limit)
                stars.link(m[a], q[b])

    def look_up(members: np.ndarray, queries: np.ndarray) -> None:
        """For clusters in which the bounds prune nothing: the neighbours of each query are looked up."""
        order = members[np.argsort(points[members])]
        known = points[order]
        bits = [np.uint64(1 << i) for i in range(64)]
        flips = [np.uint64(0), *bits, *(bits[i] | bits[j] for i in range(64) for j in range(i))]
        for f in flips:
            want = points[queries] ^ f
            at = np.minimum(np.searchsorted(known, want), len(known) - 1)
            hit = known[at] == want
            stars.link(order[at[hit]], queries[hit])

    todo = [(np.flatnonzero(home), np.arange(len(points)) if asks is None else np.flatnonzero(asks))]
    while todo:
        members, queries = todo.pop()
        if not len(members) or not len(queries):
            continue
        cut = vantage(points[members], limit, rng) if len(members) > LEAF else None
        if cut is None:
            compare(members, queries)
            continue
        v, r = cut
        m, q = distance(points[members], v), distance(points[queries], v)
        inner, outer = queries[q <= r + limit], queries[q > r - limit]
        if len(inner) + len(outer) > 1.9 * len(queries):  # the bounds prune next to nothing
            (look_up if limit == 2 and len(members) > DENSE else compare)(members, queries)
            continue
        todo += [(members[m <= r], inner), (members[m > r], outer)]
    linked = np.flatnonzero(stars.label != np.arange(len(points)))
    return points[linked], points[stars.label[linked]]


def n_shards(n: int) -> int:
    """How many shards n points have."""
    return max(1, *(n // size if most is None else min(most, n // size) for size, most in SHARDS))


def parts_of(nodes: list[tuple[int, int, int, int]], sample: np.ndarray, limit: int) -> np.ndarray:
    """How many parts each shard is dealt to, by the rows that the sample sends there. Results don't depend on it."""
    shard, _, _ = route(nodes, sample, limit)
    rows = np.bincount(shard)
    return np.maximum(1, np.ceil(rows * len(rows) / (ASKED * max(1, len(sample))))).astype(np.int32)


def dealt(points: np.ndarray, nodes: list[tuple[int, int, int, int]], parts: np.ndarray, limit: int) -> dict[str, np.ndarray]:
    """What is sent for points: shard, part, fp, home, asks. A point at home goes to all parts and asks in one of them."""
    shard, fp, home = route(nodes, points, limit)
    most = parts[shard] if len(parts) else np.ones(len(shard), np.int32)
    own = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % most.astype(np.uint64)
    again = np.where(home, most, 1)
    at = np.repeat(np.arange(len(shard)), again)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(again) - again, again)
    part = np.where(home[at], turn, own[at]).astype(np.int32)
    return {"shard": shard[at], "part": part, "fp": fp[at].view(np.int64), "home": home[at], "asks": part == own[at].astype(np.int32)}


def links(points: DataFrame, n: int, limit: int) -> DataFrame:
    """a, b: links that span the components of the distinct points (fp); n is how many there are."""
    shards = n_shards(n)
    nodes: list[tuple[int, int, int, int]] = []
    parts = np.ones(0, np.int32)
    if shards > 1:
        most = min(SAMPLE * shards, SAMPLED)
        share = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n))
        sample = np.array([r.fp for r in points.filter(share).orderBy("fp").limit(2 * most).collect()], np.int64).view(np.uint64)  # the tree's only
        nodes = grow(sample, shards, limit)
        parts = parts_of(nodes, sample, limit)

    def sent(points: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in dealt(points, nodes, parts, limit).items()})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(batch.column("fp").to_numpy().view(np.uint64).copy())
            if sum(map(len, waiting)) >= ROUTED:
                yield sent(np.concatenate(waiting))
                waiting.clear()
        if waiting:
            yield sent(np.concatenate(waiting))

    def within(table: pa.Table) -> pa.Table:
        fp, home, asks = (table.column(c).to_numpy() for c in ("fp", "home", "asks"))
        a, b = search(fp.view(np.uint64), home, limit, asks)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = points.select("fp").mapInArrow(send, "shard int, part int, fp long, home boolean, asks boolean")
    return rows.groupBy("shard", "part").applyInArrow(within, "a long, b long")


def linked_classes(rows: DataFrame, least, limit: int, keep=staged) -> tuple[DataFrame, DataFrame, int]:
    """The distinct fingerprints of rows (fp, least, copies); those that have links, with the root of their component
    (fp, root); and how many rows there are."""
    classes = keep(rows.groupBy("fp").agg(least.alias("least"), F.count("*").alias("copies")), "classes")
    size = classes.agg(F.count("*").alias("points"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    of = components(links(classes, size["points"], limit), keep).withColumnRenamed("node", "fp")
    return classes, of, size["rows"]


def near_duplicates(docs: DataFrame, limit: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    rows = staged(fingerprints(docs), "fingerprints")
    classes, of, n = linked_classes(rows, F.min("doc_id"), limit)
    named = classes.join(of, "fp")  # classes that have links
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(ids, "root").select("fp", "component_id", "copies")
    alone = classes.join(of.select("fp"), "fp", "left_anti").filter("copies > 1").select(
        "fp", F.col("least").alias("component_id"), "copies"
    )
    table = staged(known.unionByName(alone), "classes")
    # a fingerprint of very many rows is joined by broadcast: of those there are rows / hot at most, 100,000
    hot = max(HOT, n // 100_000)
    often = F.broadcast(table.filter(F.col("copies") > hot).select("fp", "component_id"))
    most = rows.join(often.select("fp"), "fp", "left_anti").join(
        table.filter(F.col("copies") <= hot).select("fp", "component_id"), "fp", "left"
    )
    most = most.select(
        "doc_id", "fp", F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return most.unionByName(rows.join(often, "fp").select("doc_id", "fp", "component_id"))


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def first_of_each(docs: DataFrame, limit: int = 2) -> DataFrame:
    """One row of each component, columns as they were: the one of the smallest doc_id (rows without an id come last),
    then of the smallest fingerprint and hash of its columns. Rows are told apart by all their columns and not by
    doc_id, so texts that share an id but no component both stay; rows that are equal in every column are one.

    Rows are known by their places in files, so that numbers decide who goes: texts stay where they are, as long as those
    that go are few enough to be broadcast as places."""
    docs, file, index = placed(docs)
    a, b = identity(docs)
    keyed = docs.select("doc_id", "text", a.alias("a"), b.alias("b"), file.alias("file"), index.alias("at"))
    with passing(docs.sparkSession) as keep:
        rows = keep(fingerprints(keyed, ("doc_id", "a", "b", "file", "at")), "fingerprints")
        first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "fp", "a", "b", "file", "at"))
        classes, of, _ = linked_classes(rows, first, limit, keep)
        linked = classes.join(of, "fp").groupBy("root").agg(F.min("least").alias("least")).select("least.file", "least.at")
        alone = classes.join(of.select("fp"), "fp", "left_anti").select("least.file", "least.at")
        gone = staged(rows.select("file", "at").join(linked.unionByName(alone), ["file", "at"], "left_anti"), "gone")
    x, y = fresh(docs, "file"), fresh(docs, "at")
    gone = gone.select(F.col("file").alias(x), F.col("at").alias(y))
    return docs.withColumns({x: file, y: index}).join(few(gone), [x, y], "left_anti").drop(x, y)
