"""Whitening of embeddings by a tall and skinny QR (TSQR), without a covariance matrix.

Vectors become exact integers. The fit list is each distinct vector once; its sums are exact, and centre the rows. Every
partition of the fit list is reduced to a triangular factor R, a batch at a time; R factors are stacked and reduced again
in a tree of groups of eight, so that no task holds more than eight of them. The right singular vectors of the last R are the
components, its singular values the deviations along them: each row is projected and divided by those. The covariance of
the whitened fit list is measured afterwards.

Defined results: rows whose vector is null, empty, of another length than most, or holds a null or non-finite component
are left out. Repeated rows and rows without an id stay, each with its values; equal vectors count once in the fit.
Components along which the fit list doesn't vary (a singular value under 1e-12 of the largest) aren't there: a table of
one distinct vector, like an empty one, gives no rows. Equal eigenvalues leave their components to the factorisation; the
sign of a component makes its largest entry positive. A deviation beyond 63 bits is null. Columns of any name may be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import staged
from glossmill.llm.vectors import integers, matrix

#: R factors that a task of the tree merges; rows that are factorised at once; share of the largest singular value
#: under which one counts as zero.
FAN, BLOCK, ZERO = 8, 4096, 1e-12


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with these exact sums; unit components as rows, and their eigenvalues; the sum of all eigenvalues."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as 64-bit integers, or Python's where those are too small."""
        most = self.n * max(1, int(np.abs(x.astype(float)).max(initial=0))) + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.axes.T / np.sqrt(self.values)


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = matrix(batch.column("x"), d)
        for i in range(0, len(x), BLOCK):
            yield x[i : i + BLOCK]


def exact_sums(fit: DataFrame, d: int) -> list[int]:
    """The sum of each dimension. What comes to the driver are d numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for x in blocks(batches, d):
            wide = x.astype(object) if np.abs(x.astype(float)).max(initial=0) * len(x) >= 1 << 62 else x
            total = [a + int(b) for a, b in zip(total, wide.sum(0))]
        parts = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), parts], names=["at", "part"])

    rows = fit.mapInArrow(run, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("s")).collect()
    by = {r["at"]: int(r["s"]) for r in rows}
    return [by.get(i, 0) for i in range(d)]


def reduced(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangle(fit: DataFrame, d: int, of: Whitening) -> np.ndarray:
    """R of the centred fit list, whose rows never meet: partitions are reduced where they are, their factors in a tree."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for x in blocks(batches, d):
            r = reduced(np.vstack([r, (of.centred(x) / of.n).astype(float)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()])], names=["node", "r"])

    def merged(table: pa.Table) -> pa.Table:
        r = np.vstack([np.frombuffer(b.as_py()).reshape(-1, d) for b in table.column("r")])
        return pa.table({"node": pa.array([table.column("node")[0].as_py() // FAN], pa.int32()), "r": pa.array([reduced(r).tobytes()])})

    tree, width = fit.select("x").mapInArrow(factor, "node int, r binary"), fit.rdd.getNumPartitions()
    while width > 1:
        tree = tree.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(merged, "node int, r binary")
        width = -(-width // FAN)
    top = tree.first()
    return np.frombuffer(top.r).reshape(-1, d)


def fitted(fit: DataFrame, d: int, most: int | None = None) -> Whitening | None:
    """The whitening of distinct vectors, of the first components (all, if most is None); None if they don't vary."""
    n = fit.count()
    if not n:
        return None
    sums = tuple(exact_sums(fit, d))
    _, s, vt = np.linalg.svd(triangle(fit, d, Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)), full_matrices=False)
    k = int((s > ZERO * s[0]).sum()) if s[0] > 0 else 0
    k = min(k, k if most is None else most)
    if not k:
        return None
    axes = vt[:k] * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(1)])[:, None]
    return Whitening(n, sums, axes, s[:k] ** 2 / n, float((s**2).sum() / n))


def identity_error(fit: DataFrame, d: int, of: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity, in size; centred by Spark's aggregate."""
    k = len(of.values)
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks(batches, d):
            w = of.project(of.centred(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], names=names)

    rows = fit.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = rows.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int | None = 4) -> DataFrame:
    """For each row that has a vector, and each of the first components: key, component (from 1), n (vectors of the fit),
    deviation (sum of squares of n * x - sums), whitened, explained (the eigenvalue's share) and identity_error."""
    rows, d = integers(embeddings, vector, {"key": F.col(f"`{key}`")})
    kind = embeddings.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = staged(rows.select("x").distinct(), "distinct-vectors")
    model = fitted(fit, d, most)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], out)
    error, k, share = identity_error(fit, d, model), len(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                c = model.centred(matrix(part.column("x"), d))
                small = c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * d < 1 << 62
                squares = (c * c).sum(1) if small else [sum(int(v) ** 2 for v in row) for row in c]
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in squares], pa.int64())
                m, of = len(c), np.repeat(np.arange(len(c)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        deviation.take(pa.array(of)), pa.array(model.project(c).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, out)
