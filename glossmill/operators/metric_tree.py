"""A tree of nodes around centres, by the angle between vectors, which is a metric.

It is grown on the driver from a bounded sample: the leaf with most of the sample is cut around centres that lie far from each other,
until there are as many leaves as the table needs blocks. Then each vector goes down to the nearest centres, and tasks tell for every
node how far its vectors reach from its centre, how many they are, and their least and greatest keys. With that, pairs of nodes are
cut level by level: what no vector of one can have with one of the other needs none of the pairs below them.

Leaves are numbered in the order of the tree, and TILE of them that follow each other make a tile: vectors are sent to tiles, and
compared leaf by leaf where the tree leaves a pair. So a vector is copied for as many tiles as there are left at most, a TILE-th of
the leaves, even where (for vectors that lie evenly in many dimensions) nothing can be cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leaves at most (the driver may hold a number for each two of them); children of a node; vectors of the sample by leaf; leaves of a tile.
LEAVES, BRANCH, SAMPLE, TILE = 2048, 8, 32, 4
#: What is added to reaches, for rounding.
HAIR = 1e-7


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles between rows of the same place."""
    return np.arccos(np.clip((x * y).sum(1), -1, 1))


@dataclass
class Tree:
    """Nodes by number: centre, parent and children (none for a leaf), and what stats() found below them. leaf: numbers of leaves
    by node, in the order of the tree."""

    centres: np.ndarray
    parent: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))
    greatest: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def leaves(self) -> np.ndarray:
        """The nodes that are leaves, by leaf number."""
        nodes = np.flatnonzero(self.leaf >= 0)
        return nodes[np.argsort(self.leaf[nodes])]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of each vector: the nearest child's, from level to level."""
        at, todo = np.zeros(len(x), np.int64), [0]
        while todo:
            node = todo.pop()
            below = self.children[node]
            mine = np.flatnonzero(at == node)
            if len(below) and len(mine):
                at[mine] = below[(x[mine] @ self.centres[below].T).argmax(1)]
                todo += below.tolist()
        return at


def grown(sample: np.ndarray, leaves: int) -> Tree:
    """The tree of a sample of unit vectors. Vectors that are all the same aren't cut."""
    rng = np.random.default_rng(5)
    centres, parent, children = [sample[0]], [-1], [np.zeros(0, np.int64)]
    heap, n_leaves, last = [(-len(sample), 0, sample)], 1, 0
    while heap and n_leaves < leaves:
        _, node, mine = heapq.heappop(heap)
        far = [mine[rng.integers(len(mine))]]
        near = mine @ far[0]
        while len(far) < min(BRANCH, leaves - n_leaves + 1) and near.min() < 1 - 1e-12:
            far.append(mine[near.argmin()])
            near = np.maximum(near, mine @ far[-1])
        if len(far) < 2:
            continue
        of = (mine @ np.array(far).T).argmax(1)
        below = []
        for i, c in enumerate(far):
            last += 1
            below.append(last)
            centres.append(c)
            parent.append(node)
            children.append(np.zeros(0, np.int64))
            heapq.heappush(heap, (-int((of == i).sum()), last, mine[of == i]))
        children[node] = np.array(below)
        n_leaves += len(far) - 1
    number, leaf, todo = 0, np.full(len(centres), -1), [0]
    while todo:
        node = todo.pop()
        if len(children[node]):
            todo += children[node].tolist()[::-1]
        else:
            leaf[node], number = number, number + 1
    return Tree(np.array(centres), np.array(parent), children, leaf)


def stats(tree: Tree, rows: DataFrame) -> None:
    """Puts into the tree what rows (k, v, leaf) say of its nodes. A task gives a row a node, the driver gets as many."""
    nodes, parent, centres = tree.leaves, tree.parent, tree.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, count = np.full(len(parent), -1.0), np.zeros(len(parent), np.int64)
        least, greatest = np.full(len(parent), np.iinfo(np.int64).max), np.full(len(parent), np.iinfo(np.int64).min)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, k = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1), batch.column("k").to_numpy()
            at = nodes[batch.column("leaf").to_numpy()]
            while (at >= 0).any():
                up = at >= 0
                np.maximum.at(reach, at[up], angles(x[up], centres[at[up]]))
                np.minimum.at(least, at[up], k[up])
                np.maximum.at(greatest, at[up], k[up])
                np.add.at(count, at[up], 1)
                at = np.where(up, parent[at], -1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.arange(len(parent)), reach, count, least, greatest)], names=["node", "reach", "n", "least", "greatest"])

    found = rows.select(F.col("k").cast("long").alias("k"), "v", "leaf").mapInArrow(run, "node long, reach double, n long, least long, greatest long")
    tree.reach, tree.count = np.full(len(parent), -1.0), np.zeros(len(parent), np.int64)
    tree.least, tree.greatest = np.full(len(parent), np.inf), np.full(len(parent), -np.inf)
    for r in found.groupBy("node").agg(F.max("reach").alias("reach"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).collect():
        tree.reach[r.node], tree.count[r.node], tree.least[r.node], tree.greatest[r.node] = r.reach, r.n, r.least, r.greatest


def widest(tree: Tree) -> float:
    """The smallest cosine between centres of different leaves, which were drawn from the vectors."""
    centres = tree.centres[tree.leaves]
    return float((centres @ centres.T).min()) if len(centres) > 1 else np.inf


def left_over(tree: Tree, may: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], ordered: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Leaf numbers (i, j) of the pairs that may leaves, with i <= j unless they are ordered pairs; and the share of all pairs of
    leaves that they are. may(i, j, nearest, furthest): for pairs of nodes, and the least and greatest angles between vectors of
    both, which pairs are to be looked into. What it cuts must hold nothing below either."""
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(i):
        there = (tree.count[i] > 0) & (tree.count[j] > 0)
        i, j = i[there], j[there]
        apart, reach = angles(tree.centres[i], tree.centres[j]), tree.reach[i] + tree.reach[j] + HAIR
        keep = may(i, j, np.maximum(0, apart - reach), np.minimum(np.pi, apart + reach))
        i, j = i[keep], j[keep]
        ends = (tree.leaf[i] >= 0) & (tree.leaf[j] >= 0)
        done.append((tree.leaf[i[ends]], tree.leaf[j[ends]]))
        left, right = [], []
        for a, b in zip(i[~ends].tolist(), j[~ends].tolist()):
            x = tree.children[a] if len(tree.children[a]) else np.array([a])
            y = tree.children[b] if len(tree.children[b]) else np.array([b])
            p, q = (g.ravel() for g in np.meshgrid(x, y, indexing="ij"))
            some = slice(None) if ordered or a != b else np.flatnonzero(p <= q)
            left.append(p[some])
            right.append(q[some])
        i, j = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
    i, j = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    if not ordered:
        i, j = np.minimum(i, j), np.maximum(i, j)
    n = int((tree.count[tree.leaves] > 0).sum())
    return i, j, len(i) / max(1, n * n if ordered else n * (n + 1) // 2)


def by_tile(i: np.ndarray, j: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The pairs of leaves of each pair of tiles."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in zip(i.tolist(), j.tolist()):
        out.setdefault((a // TILE, b // TILE), []).append((a, b))
    return out


def in_leaves(vectors: DataFrame, key: str, vector: str, block_rows: int, keep) -> tuple[DataFrame, Tree | None, dict[int, int]]:
    """k, v (of length 1, zero vectors left out), leaf, tile, part of each vector, staged by keep; the tree; and how many parts, by a
    hash of k, the rows of each tile are dealt to."""
    kept = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    kept = kept.filter(F.exists("v", lambda x: x != 0))
    n = kept.count()
    if not n:
        return kept, None, {}
    leaves = min(LEAVES, -(-n // block_rows))
    want = SAMPLE * leaves
    share = F.pmod(F.xxhash64(F.lit(3), "k"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / n) + 1)
    drawn = kept.filter(share).limit(2 * want).collect() or kept.limit(1).collect()  # the tree's only
    tree = grown(unit_rows(np.array([r.v for r in drawn], np.float64)), leaves)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1))
                leaf = tree.leaf[tree.place(x)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(list(x), pa.list_(pa.float64())), pa.array(leaf)], names=["k", "v", "leaf"])

    rows = keep(kept.mapInArrow(placed, "k long, v array<double>, leaf int"), "vectors-in-leaves")
    stats(tree, rows)
    sizes = np.zeros(-(-len(tree.leaves) // TILE), np.int64)
    np.add.at(sizes, np.arange(len(tree.leaves)) // TILE, tree.count[tree.leaves])
    parts = {t: max(1, -(-int(s) // (TILE * block_rows))) for t, s in enumerate(sizes)}
    tile = F.floor(F.col("leaf") / TILE).cast("int")
    of = F.element_at(F.array(*[F.lit(parts[t]) for t in range(len(parts))]), tile + 1)
    return rows.select("k", "v", "leaf", tile.alias("tile"), F.pmod(F.xxhash64("k"), of).cast("int").alias("part")), tree, parts


def leaves_of(table: pa.Table) -> dict[int, np.ndarray]:
    """The places of each leaf's rows."""
    leaf = table.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    cut = np.flatnonzero(np.diff(leaf[order])) + 1
    return {int(leaf[p[0]]): p for p in np.split(order, cut) if len(p)}


def rows_of(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
