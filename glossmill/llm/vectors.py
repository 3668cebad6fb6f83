"""Embeddings as vectors of exact integers, which operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: str) -> Column:
    """True where the vector is there and all of its components are finite numbers."""
    inside = F.forall(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return F.coalesce(inside, F.lit(False))


def integers(table: DataFrame, vector: str, keep: dict[str, Column]) -> tuple[DataFrame, int]:
    """keep, and x (array of long): floor(256 * c) of each component c as double; and how many components there are.

    Rows are left out whose vector is null, empty, or holds a null or non-finite component. So are those whose vector
    isn't as long as most are (of lengths as frequent the longest): they are no points of the same space.
    """
    good = table.filter(usable(vector) & (F.size(F.col(f"`{vector}`")) > 0))
    most = good.groupBy(F.size(F.col(f"`{vector}`")).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    x = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long"))
    return good.filter(F.size(F.col(f"`{vector}`")) == d).select(*[c.alias(n) for n, c in keep.items()], x.alias("x")), d


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """The rows of a column of arrays of d numbers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
