"""Tables that batches are appended to, each batch once.

A batch is written to a folder of its own, by Spark's writer and so whole or not at all, and then entered in the table's list under its
number: an empty file whose name says which folder it is, made only if the number isn't there yet. What isn't listed isn't read. So a
batch that is written twice, whose job failed half way, or that two drivers write, leaves one copy; folders that lost go with clean().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Table:
    """Rows of one schema, as JSON lines or Parquet."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "json"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def at(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def names(self, folder: str) -> list[str]:
        files, at = self.at(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []

    def batches(self) -> dict[int, str]:
        """The folder of each batch that is in the table. The first entry of a number counts."""
        out: dict[int, str] = {}
        for name in self.names("batches"):
            number, folder = name.split("=", 1)
            out.setdefault(int(number), folder)
        return out

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Appends a batch; False if its number is in the table already, which then stays as it is."""
        if batch in self.batches():
            return False
        folder = uuid.uuid4().hex
        rows.write.format(self.kind).save(f"{self.path}/rows/{folder}")
        files, lock = self.at(f"numbers/{batch}")
        files.mkdirs(lock.getParent())
        try:
            files.create(lock, False).close()  # by one writer only
        except Exception:
            if batch in self.batches():
                return False
            # the writer that made it first has ended without an entry: this batch's rows are as good
        files, entry = self.at(f"batches/{batch}={folder}")
        files.create(entry, True).close()
        return self.batches()[batch] == folder

    def read(self, schema: str) -> DataFrame:
        folders = [f"{self.path}/rows/{f}" for f in self.batches().values()]
        return self.spark.read.schema(schema).format(self.kind).load(folders) if folders else self.spark.createDataFrame([], schema)

    def clean(self) -> list[str]:
        """Deletes folders that no batch of the table has; while nobody writes."""
        lost = sorted(set(self.names("rows")) - set(self.batches().values()))
        for folder in lost:
            files, at = self.at(f"rows/{folder}")
            files.delete(at, True)
        return lost
