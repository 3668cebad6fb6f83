"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.plans.staging import passing, removed, shared_path, staged, written

__all__ = ["FEW", "few", "fresh", "held_out", "identity", "passing", "placed", "read", "removed", "shared_path", "slices", "staged", "written"]

#: Rows of two numbers that are broadcast at most (some 60 bytes each, 30 MB).
FEW = 500_000
#: Rows of a batch that Python takes at once; Spark cuts batches by bytes before (64 MB by default).
SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that few texts are Python objects at once. No setting of the session changes."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identity(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """128 bits in two columns that tell rows apart by their columns (all that can be hashed, or those named), nulls
    too. They depend on nothing but the row, so a repeated task gives them again."""
    kinds = dict(df.dtypes)
    names = [n for n in (df.columns if columns is None else columns) if "map<" not in kinds[n] and "variant" not in kinds[n]]
    every = [x for n in names for x in (F.col(f"`{n}`"), F.isnull(F.col(f"`{n}`")))]
    return [F.xxhash64(F.lit(f"identity {i}"), *every) for i in (1, 2)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model is fitted on: crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def few(table: DataFrame, most: int | None = None) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast if it has few; a larger one is joined by merging, at any size."""
    return F.broadcast(table) if table.count() <= (FEW if most is None else most) else table.hint("merge")


def placed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs from files, and where a row stands: a hash of its file's path, and its place in the file. Rows that don't come
    from Parquet files are staged first."""
    at = lambda df: df.metadataColumn("_metadata")
    try:
        docs.select(at(docs)["row_index"]).schema  # noqa: B018  is there such a column?
    except AnalysisException:
        docs = staged(docs, "rows")
    return docs, F.xxhash64(at(docs)["file_path"]), at(docs)["row_index"]
