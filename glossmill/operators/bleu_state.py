"""Self-BLEU of a corpus that grows, as a stored state that a batch of texts changes only where it must.

The state are two tables of rows by version, which is the batch's number:

* n-grams: the two largest counts and who holds the largest. What matters of a count is whether it is among the two, so these
  rows are merged by taking the two largest of both sides; of an n-gram the row of the latest version counts.
* texts: the length, and the matches that a text lacks, which are the leads that it holds. A batch writes differences, so a
  text's matches are sums over versions.

A batch counts its own n-grams, looks those up, and writes the rows that change and the differences of their old and new
holders: nothing else of the corpus is touched. N-grams of a large batch are taken in shares of their hashes, and what is only
needed for a share goes with it, so the disk holds the state and one share. Rows of a version count once its marker is there, which is written last. A batch
that is repeated, or was broken off, leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators.diversity import bleu_of, leaders, mean_diversity, shares_of, with_references
from glossmill.plans.staging import passing, shedding

GRAMS = "a long, b long, n int, seq long, c1 long, c2 long"
TEXTS = "seq long, len long, l1 long, l2 long, l3 long, l4 long"
GRAM = ["a", "b", "n"]
#: N-grams of a batch up to which they are broadcast to be looked up (some 60 bytes each).
LOOKED_UP = 500_000


class Corpus:
    """Texts (seq, text) appended in batches; a text's seq is its own. A null text has no words."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> list[int]:
        """Batches that are whole."""
        files, folder = self.at("whole")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(folder)) if files.exists(folder) else []

    def table(self, name: str, schema: str) -> DataFrame:
        """The rows of whole batches, and their version."""
        paths = [f"{self.path}/{name}/version={v}" for v in self.versions()]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, version int")
        return self.spark.read.schema(f"{schema}, version int").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def append(self, reviews: DataFrame, batch: int) -> None:
        """Takes in a batch; one that has been taken in already changes nothing."""
        if batch in self.versions():
            return
        docs = reviews.select(F.col("seq").cast("long").alias("seq"), T.words(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
        docs = docs.repartition("seq")  # a text's n-grams are counted where it is
        shares = shares_of(reviews)
        self.drop(f"ngrams/version={batch}")  # of a batch that was broken off
        with shedding(self.spark), passing(self.spark) as keep:
            lost = [f"l{n}" for n in range(1, 5)]
            rows = docs.select("seq", F.size("w").cast("long").alias("len"), *[F.lit(0).cast("long").alias(x) for x in lost])
            for share in range(shares):
                rows = rows.unionByName(self.share(docs, batch, share, shares, keep))
            texts = rows.groupBy("seq").agg(F.max("len").alias("len"), *[F.sum(x).alias(x) for x in lost])
            texts = texts.filter("len is not null or l1 <> 0 or l2 <> 0 or l3 <> 0 or l4 <> 0")
            texts.write.mode("overwrite").parquet(f"{self.path}/texts/version={batch}")
        files, marker = self.at(f"whole/{batch}")
        files.create(marker, True).close()

    def share(self, docs: DataFrame, batch: int, share: int, shares: int, stay: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """Writes the rows of a share of the n-grams that the batch changes; seq, len (null), l1..l4: what texts lose or gain by them."""
        with passing(self.spark) as keep:
            new = keep(leaders(docs, (share, shares)), "batch-ngrams")
            keys = new.select(*GRAM)
            old = self.table("ngrams", GRAMS)
            if shares > 1:  # the same n-grams, however many shares the batches before were taken in
                old = old.filter(F.pmod(F.col("a"), F.lit(shares)) == share)
            old = old.join(F.broadcast(keys) if new.count() <= LOOKED_UP else keys, GRAM, "left_semi")
            old = old.groupBy(*GRAM).agg(F.max_by(F.struct("seq", "c1", "c2"), "version").alias("o"))
            both = new.join(old, GRAM, "left").select(*GRAM, F.struct("seq", "c1", "c2").alias("x"), "o")
            o1, o2 = F.coalesce("o.c1", F.lit(0)), F.coalesce("o.c2", F.lit(0))
            c1, c2 = F.greatest("x.c1", o1), F.greatest(F.least("x.c1", o1), "x.c2", o2)
            holder = F.when(F.col("x.c1") > o1, F.col("x.seq")).otherwise(F.col("o.seq"))
            merged = keep(both.select(*GRAM, holder.alias("seq"), c1.alias("c1"), c2.alias("c2"), "o").filter(
                F.col("o").isNull() | (F.col("c1") != F.col("o.c1")) | (F.col("c2") != F.col("o.c2"))
            ), "changed-ngrams")
            merged.drop("o").write.mode("append").parquet(f"{self.path}/ngrams/version={batch}")
            change = lambda seq, lead: F.struct(seq.alias("seq"), lead.alias("d"))
            leads = F.array(change(F.col("seq"), F.col("c1") - F.col("c2")), change(F.col("o.seq"), F.col("o.c2") - F.col("o.c1")))
            moved = merged.select("n", F.explode(leads).alias("e")).filter("e.seq is not null and e.d <> 0")
            sums = moved.groupBy("e.seq").agg(*[F.sum(F.when(F.col("n") == n, F.col("e.d")).otherwise(0)).alias(f"l{n}") for n in range(1, 5)])
            rows = sums.select("seq", F.lit(None).cast("long").alias("len"), *[f"l{n}" for n in range(1, 5)])
            return stay(rows, "moved-leads")

    def drop(self, path: str) -> None:
        files, folder = self.at(path)
        files.delete(folder, True)

    def texts(self) -> DataFrame:
        """seq, len, l1..l4 of every text."""
        return self.table("texts", TEXTS).groupBy("seq").agg(F.max("len").alias("len"), *[F.sum(f"l{n}").alias(f"l{n}") for n in range(1, 5)])

    def scores(self) -> DataFrame:
        """seq, bleu of each text against all others."""
        return bleu_of(with_references(self.texts()))

    def diversity(self) -> DataFrame:
        return mean_diversity(self.scores())
