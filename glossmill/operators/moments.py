"""Statistics of a collection of files as stored moments, of which a comparison needs no scan.

For each version of a file (its path, length and time) the state has one row: of every measure the count, mean, sum of squared
deviations, least and greatest. New and changed files are read once; what moves are their moments. Rows of several files are merged by
the parallel formula of variance, so the statistics of any set of files follow from their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.realism import text_metrics

MEASURES = ("n_words", "n_unique", "n_sentences", "words_per_sentence", "n_tech_terms")
PARTS = ("n", "mean", "m2", "least", "greatest")
SCHEMA = "file string, length long, changed long, " + ", ".join(f"{p}_{m} {'long' if p == 'n' else 'double'}" for m in MEASURES for p in PARTS)


def moments(measure: str) -> list[Column]:
    x = F.col(measure).cast("double")
    n = F.count(x)
    made = (n, F.avg(x), F.coalesce(F.var_pop(x), F.lit(0.0)) * n, F.min(x), F.max(x))
    return [c.alias(f"{p}_{measure}") for p, c in zip(PARTS, made)]


class Stored:
    """The state of one collection, in a folder of its own. Scans that break off have added nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def listed(self, source: str) -> list[tuple[str, int, int]]:
        """Path, length and time of the Parquet files of a folder, or of the one file."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(source)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(at, True)
        out = []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return out

    def state(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def current(self, source: str) -> tuple[DataFrame, DataFrame]:
        """The state's rows of files as they are now; and the files that it lacks."""
        files = self.spark.createDataFrame(self.listed(source), "file string, length long, changed long")
        state, key = self.state(), ["file", "length", "changed"]
        return state.join(F.broadcast(files), key, "left_semi").dropDuplicates(key), files.join(state.select(*key), key, "left_anti")

    def refresh(self, source: str, text: str = "text") -> list[str]:
        """Reads the files that are new or have changed, and returns their paths."""
        lacking = self.current(source)[1].collect()  # names of files
        if lacking:
            rows = self.spark.read.parquet(*[r.file for r in lacking])
            rows = text_metrics(rows.select(F.col(text).alias("text"), F.col("_metadata.file_path").alias("read")))
            sums = rows.groupBy("read").agg(*[c for m in MEASURES for c in moments(m)])
            names = self.spark.createDataFrame(lacking, "file string, length long, changed long")
            plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")  # noqa: E731  file:/a and file:///a are one
            every = names.join(sums, plain(F.col("file")) == plain(F.col("read")), "left").drop("read")
            every.select(*[F.coalesce(c, F.lit(0)).alias(c) if c.startswith("n_") else F.col(c) for c in every.columns]).coalesce(1).write.mode("append").parquet(self.path)
        return [r.file for r in lacking]

    def stats(self, source: str) -> DataFrame:
        """What realism.corpus_stats() gives, from the state alone."""
        rows = self.current(source)[0]
        total = lambda m: F.sum(f"n_{m}")
        mean = lambda m: F.try_divide(F.sum(F.col(f"mean_{m}") * F.col(f"n_{m}")), total(m).cast("double"))
        one = rows.agg(*[mean(m).alias(f"avg_{m}") for m in MEASURES], F.min("least_n_words").cast("long").alias("min_length"), F.max("greatest_n_words").cast("long").alias("max_length"))
        apart = F.col("mean_n_words") - F.col("avg_n_words")
        spread = rows.crossJoin(F.broadcast(one.select("avg_n_words"))).agg(
            F.sqrt(F.try_divide(F.sum(F.col("m2_n_words") + F.col("n_n_words") * apart * apart), F.sum("n_n_words").cast("double"))).alias("std_length")
        )
        zero = lambda c, name: F.coalesce(F.col(c), F.lit(0.0)).alias(name)
        return one.crossJoin(spread).select(
            zero("avg_n_words", "avg_length"), zero("std_length", "std_length"), zero("avg_n_unique", "avg_unique_words"), zero("avg_n_sentences", "avg_sentences"),
            zero("avg_words_per_sentence", "avg_words_per_sentence"), zero("avg_n_tech_terms", "avg_tech_terms"), "min_length", "max_length",
        )
