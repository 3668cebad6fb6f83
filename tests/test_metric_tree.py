"""The tree of vectors: exact extremes and closest earlier vectors, and how little of it is visited."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.operators import diversity, metric_tree

KINDS = ("clusters", "uniform", "line", "copies", "zeros", "near zero")


def vectors_of(kind, n=240):
    rng = np.random.default_rng(6)
    if kind == "clusters":
        return np.repeat(rng.normal(size=(12, 6)), n // 12, axis=0) + 0.02 * rng.normal(size=(n, 6))
    if kind == "line":
        return np.stack([np.cos(np.arange(n) / 40), np.sin(np.arange(n) / 40)], 1)
    if kind == "copies":
        return np.concatenate([np.tile(rng.normal(size=6), (n // 2, 1)), rng.normal(size=(n // 2, 6))])
    if kind == "zeros":
        return np.where(np.arange(n)[:, None] % 5 == 2, 0.0, rng.normal(size=(n, 6)))
    return rng.normal(size=(n, 6)) * (1e-8 if kind == "near zero" else 1)


def table(spark, x):
    rows = [(3 * i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None)]
    return spark.createDataFrame(np.random.default_rng(1).permutation(np.array(rows, object)).tolist(), "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("kind, block, leaves", [*((k, 10, 2048) for k in KINDS), ("clusters", 25, 5), ("copies", 25, 5)])
def test_vectors_in_a_tree(spark, monkeypatch, kind, block, leaves):
    monkeypatch.setattr(metric_tree, "LEAVES", leaves)
    monkeypatch.setattr(metric_tree, "BRANCH", 3)
    x = vectors_of(kind)
    u = metric_tree.unit_rows(x)
    c = u @ u.T
    df = table(spark, x)
    e = diversity.cosine_extremes(df, block_rows=block).first()
    pairs = c[np.triu_indices(len(x), 1)]
    assert (e.max_similarity, e.min_similarity) == (pytest.approx(pairs.max(), abs=1e-12), pytest.approx(pairs.min(), abs=1e-12))
    got = {r.vec_id: r.max_similarity for r in diversity.max_similarity_before(df, block_rows=block).collect()}
    assert got == {3 * i: pytest.approx(c[i, :i].max(), abs=1e-12) if i else None for i in range(len(x))}


def test_few_vectors(spark):
    df = table(spark, vectors_of("uniform"))
    for n, want in ((0, (None, None)), (1, (None, None))):
        e = diversity.cosine_extremes(df.filter(F.col("vec_id") < n)).first()
        assert (e.max_similarity, e.min_similarity) == want
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert tuple(diversity.cosine_extremes(zeros).first()) == (0.0, 0.0)
    assert {r.vec_id: r.max_similarity for r in diversity.max_similarity_before(zeros).collect()} == {1: None, 2: 0.0}
    assert diversity.max_similarity_before(zeros.limit(0)).count() == 0


def grown_tree(x, leaves):
    tree = metric_tree.grown(x, leaves)
    at = tree.place(x)
    n = len(tree.parent)
    tree.reach, tree.count, tree.least, tree.greatest = np.full(n, -1.0), np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
    for k, (v, node) in enumerate(zip(x, at)):
        while node >= 0:
            tree.reach[node] = max(tree.reach[node], metric_tree.angles(v[None], tree.centres[node][None])[0])
            tree.count[node] += 1
            tree.least[node], tree.greatest[node] = min(tree.least[node], k), max(tree.greatest[node], k)
            node = tree.parent[node]
    return tree, tree.leaf[at]


def share_left(x, leaves=64):
    tree, leaf = grown_tree(x, leaves)
    c = x @ x.T
    np.fill_diagonal(c, 0)
    same = leaf[:, None] == leaf[None, :]
    high, low = c[same].max(), min(c[same].min(), metric_tree.widest(tree))
    asked = []

    def may(i, j, nearest, furthest):
        asked.append(len(i))
        return (np.cos(nearest) > high) | (np.cos(furthest) < low)

    i, j, share = metric_tree.left_over(tree, may, ordered=False)
    kept = set(zip(i.tolist(), j.tolist()))
    beats = np.argwhere(np.triu((c > high) | (c < low), 1))
    assert all((min(leaf[a], leaf[b]), max(leaf[a], leaf[b])) in kept for a, b in beats)  # nothing that counts is cut
    return share, sum(asked)


def test_pairs_of_nodes_are_cut_level_by_level():
    """Of clustered vectors few pairs of leaves are left, and most were cut above the leaves; of uniform ones all may be."""
    rng = np.random.default_rng(2)
    clustered = metric_tree.unit_rows(np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + 0.01 * rng.normal(size=(2000, 16)))
    uniform = metric_tree.unit_rows(rng.normal(size=(2000, 16)))
    share, visits = share_left(clustered)
    assert share < 0.1 and visits < 64 * 65 / 2
    assert share < share_left(uniform)[0] <= 1.0


def test_copies_of_a_vector_are_bounded_by_tiles(spark):
    """Also where nothing can be cut, a vector is sent to a tile and not to a leaf or a part of it."""
    rng = np.random.default_rng(3)
    df = table(spark, rng.normal(size=(400, 24)))
    kept = []
    rows, tree, parts = metric_tree.in_leaves(df, "vec_id", "embedding", 10, lambda d, n: kept.append(d) or d)
    assert len(tree.leaves) > 30 and len(parts) == -(-len(tree.leaves) // metric_tree.TILE) and rows.count() == 400
    assert max(parts.values()) <= 4  # about as many rows a tile as its leaves have blocks
