"""Diversity of a growing corpus: for each text, 1 less the mean BLEU of all texts so far, it among them.

A new text changes the clipped counts of earlier ones, but only where an n-gram's two largest counts change: its first
holder matches all but its lead over the second. So the corpus isn't folded in order. For each n-gram the texts that
change its two largest counts are found by running maxima, and give events: from the time of that text on, its
holder loses or gains so many matches. A text's reference length changes only where a length comes that is closer than
all before. Events of a text in the order of time give its scores, and the changes of all scores, summed by time, the mean.

No task gets a run. Texts are dealt in buckets of the order, in which most rows of an n-gram fall away: a count that
isn't above the second largest one of its bucket changes nothing anywhere. What is left of a frequent n-gram is a few
rows a bucket. Lengths are looked at by their first texts only, in buckets of length. N-grams of a large corpus are taken in shares
of their hashes, one after the other, as in Self-BLEU.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import packed
from glossmill.operators.diversity import PACKED_SHARES, TEXTS_A_PART, ngram_rows, shares_for
from glossmill.operators.prefix import BUCKETS, below, bucket_of, cuts_of
from glossmill.plans.staging import in_shares, passing, shedding, staged

EPSILON = 0.1
#: Texts of a bucket, about.
BUCKET_TEXTS = 1024
#: Different lengths of a bucket, about.
LENGTHS = 20_000
SIZES = (1, 2, 3, 4)


def lead_changes(grams: DataFrame) -> DataFrame:
    """r, doc, t, n, d: by how much the matches that doc lacks change as the text t comes. grams: r, o, bucket, n, a, b
    and c, how often text o holds the n-gram."""

    def leading(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
        """rows with the largest count before (m1) and its earliest text (holder), and the second largest (m2)."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("top", F.max(F.struct("c", (-F.col("o")).alias("o"))).over(before))
        rows = rows.withColumns({"m1": F.col("top.c"), "holder": -F.col("top.o")}).withColumn(
            "q", F.when(F.col("m1").isNotNull(), F.least("c", "m1"))
        )
        return rows.withColumn("m2", F.coalesce(F.max("q").over(before), F.lit(0)))

    gram = ["r", "n", "a", "b"]
    some = leading(grams, ["bucket", *gram], F.col("o")).filter(F.col("m1").isNull() | (F.col("c") > F.col("m2"))).select(*gram, "o", "c")
    now = leading(some, gram, F.col("o")).filter(F.col("m1").isNull() | (F.col("c") > F.col("m2")))
    event = lambda doc, d: F.struct(doc.alias("doc"), d.cast("long").alias("d"))
    c, o, m1, m2, holder = (F.col(x) for x in ("c", "o", "m1", "m2", "holder"))
    made = F.when(m1.isNull(), F.array(event(o, c))).when(
        c > m1, F.array(event(holder, m2 - m1), event(o, c - m1))
    ).otherwise(F.array(event(holder, m2 - c)))
    return now.select("r", F.col("o").alias("t"), "n", F.explode(made).alias("e")).select("r", "e.doc", "t", "n", "e.d")


def firsts_of_lengths(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sizes (r, o, bucket, len): r, len, first, second (the first two texts of a length; null if there is one); and the rows
    of texts whose length another had before them. Within a bucket of the order rows of a length are few; buckets of a length meet
    by the first two of each."""
    here = Window.partitionBy("r", "bucket", "len").orderBy("o")
    ranked = sizes.withColumn("rank", F.row_number().over(here))
    parts = ranked.filter("rank <= 2").groupBy("r", "len", "bucket").agg(
        F.min("o").alias("o1"), F.max(F.when(F.col("rank") == 2, F.col("o"))).alias("o2")
    )
    parts = parts.withColumn("past", F.min("o1").over(Window.partitionBy("r", "len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    two = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array("o1", "o2"))))), 1, 2)  # two a bucket at most
    firsts = parts.groupBy("r", "len").agg(two.alias("two")).select("r", "len", F.get("two", F.lit(0)).alias("first"), F.get("two", F.lit(1)).alias("second"))
    same = F.col("r").eqNullSafe(F.col("r0")) & (F.col("len") == F.col("len0")) & (F.col("bucket") == F.col("bucket0"))
    known = parts.select(F.col("r").alias("r0"), F.col("len").alias("len0"), F.col("bucket").alias("bucket0"), "past")
    later = ranked.join(known, same).filter((F.col("rank") > 1) | F.col("past").isNotNull()).select("r", "o", "len")
    return firsts, later


def closest_lengths(sizes: DataFrame, bucket_lengths: int = LENGTHS) -> DataFrame:
    """r, doc, t, ref: from the text t on, ref is the length of another text that is closest to doc's, the shorter of
    two. sizes: r, o, bucket, len. Texts whose length another had before them keep that; the first of each length gets closer ones
    as they come.

    Lengths of a run lie in buckets of length. Seen from outside, only those of a bucket matter that came before all that lie
    nearer: its envelope, from either side. So a bucket gets its own lengths and the envelopes of the others.
    """
    firsts, later = firsts_of_lengths(sizes)
    firsts = staged(firsts, "first-lengths")
    cuts = cuts_of(firsts, "len", bucket_lengths)
    firsts = firsts.withColumn("b", bucket_of(F.col("len").cast("double"), cuts))
    kinds = "r string, b int, len long, first long, second long, own boolean"

    def envelope(table: pa.Table) -> pa.Table:
        """The lengths that came before all larger ones of the bucket (as those above see them), and before all smaller ones."""
        table = table.sort_by("len")
        first = table.column("first").to_numpy()
        below = np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(first)[:-1]])
        above = np.concatenate([np.minimum.accumulate(first[::-1])[::-1][1:], [np.iinfo(np.int64).max]])
        sides = []
        for up, keep in ((True, first < above), (False, first < below)):
            part = table.filter(pa.array(keep)).select(["r", "b", "len", "first"])
            sides.append(part.append_column("up", pa.array([up] * part.num_rows)))
        return pa.concat_tables(sides)

    def walk(table: pa.Table) -> pa.Table:
        """From each length of the bucket outwards, as long as closer ones came later."""
        table = table.sort_by("len")
        size, first, second, own = (table.column(c).to_pylist() for c in ("len", "first", "second", "own"))
        doc, time, ref = [], [], []

        def outwards(i: int) -> Iterator[int]:
            lo, hi = i - 1, i + 1
            while lo >= 0 or hi < len(size):
                if hi >= len(size) or lo >= 0 and size[i] - size[lo] <= size[hi] - size[i]:
                    yield lo
                    lo -= 1
                else:
                    yield hi
                    hi += 1

        for i, (s, o, again) in enumerate(zip(size, first, second)):
            if not own[i]:
                continue
            least = float("inf") if again is None else again
            if again is not None:
                doc.append(o)
                time.append(again)
                ref.append(s)
            for j in outwards(i):
                if first[j] < least:
                    least = first[j]
                    doc.append(o)
                    time.append(max(least, o))
                    ref.append(size[j])
                    if least < o:
                        break
        r = table.column("r")[0].as_py() if table.num_rows else None
        return pa.table(
            {
                "r": pa.array([r] * len(doc), pa.string()), "doc": pa.array(doc, pa.int64()), "t": pa.array(time, pa.int64()),
                "ref": pa.array(ref, pa.int64()),
            }
        )

    rows = firsts.select("r", "b", "len", "first", "second", F.lit(True).alias("own"))
    if cuts:
        edges = firsts.select("r", "b", "len", "first").groupBy("r", "b").applyInArrow(envelope, "r string, b int, len long, first long, up boolean")
        up, down = F.sequence(F.col("b") + 1, F.lit(len(cuts))), F.sequence(F.lit(0), F.col("b") - 1)
        none = F.array().cast("array<int>")
        to = F.when(F.col("up"), F.when(F.col("b") < len(cuts), up).otherwise(none)).otherwise(F.when(F.col("b") > 0, down).otherwise(none))
        rows = rows.unionByName(
            edges.select("r", F.explode(to).alias("b"), "len", "first", F.lit(None).cast("long").alias("second"), F.lit(False).alias("own"))
        )
    closer = rows.select([k.split()[0] for k in kinds.split(", ")]).groupBy("r", "b").applyInArrow(walk, "r string, doc long, t long, ref long")
    return closer.unionByName(later.select("r", F.col("o").alias("doc"), F.col("o").alias("t"), F.col("len").alias("ref")))


def bleu(length: Column, ref: Column, lost: dict[int, Column]) -> Column:
    """The score of a text of which so many n-grams (lost) have no match; 0 without another text, or a matching word."""
    log, total = F.lit(0.0), {n: F.greatest(length - (n - 1), F.lit(0)) for n in SIZES}
    for n in SIZES:
        m, t = (total[n] - lost[n]).cast("double"), F.greatest(total[n], F.lit(1)).cast("double")
        log = log + F.lit(0.25) * F.log(F.when(m == 0, F.lit(EPSILON)).otherwise(m) / t)
    brevity = F.when(length > ref, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - ref / length.cast("double")))
    return F.when(ref.isNull() | (total[1] - lost[1] == 0), F.lit(0.0)).otherwise(brevity * F.exp(log))


def plain_changes(dealt: DataFrame, share: tuple[int, int]) -> DataFrame:
    """r, doc, t, d1..d4 of a share of the n-grams, row by row."""
    grams = ngram_rows(dealt, ["r", "o", "bucket"], SIZES, share=share)
    grams = grams.groupBy("bucket", "r", "o", "n", "a", "b").agg(F.count("*").alias("c"))
    return lead_changes(grams).groupBy("r", "doc", "t").agg(
        *[F.sum(F.when(F.col("n") == k, F.col("d")).otherwise(0)).alias(f"d{k}") for k in SIZES]
    )


def prefix_diversity(reviews: DataFrame, run: str, order: str, text: str = "text", bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """run, order, self_bleu_diversity of each text among those of its run up to it; 1 for the first. The order tells a
    run's texts apart; a null text has no words."""
    docs = reviews.select(
        F.col(run).cast("string").alias("r"), F.col(order).cast("long").alias("o"), T.words(F.coalesce(F.col(text), F.lit(""))).alias("w")
    )
    n = docs.count()
    buckets = int(min(BUCKETS, max(1, n // bucket_texts)))
    cuts = sorted(
        set(docs.select(F.col("o").cast("double").alias("o")).approxQuantile("o", [i / buckets for i in range(1, buckets)], 0.25 / buckets))
    ) if buckets > 1 else []
    bucket = lambda c: below(F.col(c).cast("double"), cuts) if cuts else F.lit(0)
    there = reviews.agg(F.sum(F.length(text)).alias("chars")).first()
    shares = shares_for(there["chars"] or 0)
    ids = docs.groupBy("r", "o").agg(F.count("*").alias("k")).agg(F.max("k").alias("k"), F.count_if(F.col("o").isNull()).alias("none")).first()
    dealt = docs.withColumn("bucket", bucket("o")).repartition("bucket")  # a text's n-grams are counted where it is
    if ids["k"] == 1 and not ids["none"]:
        shares = min(PACKED_SHARES, shares)
        rows = reviews.select(F.col(run).cast("string").alias("r"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"))
        hashes = packed.hashed(rows, ["o", F.xxhash64("r").alias("rh")], "t")
        buckets, parts = packed.buckets_of(there["chars"] or 0, shares), int(min(1 << 16, 8 + n // TEXTS_A_PART))
        runs = docs.select("r", F.xxhash64("r").alias("rh")).distinct()
        with shedding(reviews.sparkSession), passing(reviews.sparkSession) as keep:
            known = keep(hashes, "word-hashes") if shares > 1 else hashes
            changes = in_shares(reviews.sparkSession, lambda share: packed.lead_changes(known, (share, shares), buckets, parts), shares, "lead-changes")
        changes = changes.join(runs, "rh").select("r", "doc", "t", *[f"d{k}" for k in SIZES])
    else:  # texts of one place in a run are one text of several pieces
        changes = in_shares(reviews.sparkSession, lambda share: plain_changes(dealt, (share, shares)), shares, "lead-changes")
    sizes = staged(docs.select("r", "o", bucket("o").alias("bucket"), F.size("w").cast("long").alias("len")), "lengths")
    nothing = {f"d{k}": F.lit(0).cast("long") for k in SIZES}
    none = lambda name: F.lit(None).cast("long").alias(name)
    columns = ["r", "doc", "t", *nothing, "ref", "len"]
    events = changes.select("*", none("ref"), none("len")).select(columns)
    events = events.unionByName(closest_lengths(sizes).withColumns(nothing).select("*", none("len")).select(columns))
    events = events.unionByName(
        sizes.select("r", F.col("o").alias("doc"), F.col("o").alias("t"), "len", none("ref")).withColumns(nothing).select(columns)
    )
    at = events.groupBy("r", "doc", "t").agg(*[F.sum(d).alias(d) for d in nothing], F.max("ref").alias("ref"), F.max("len").alias("len"))
    so_far = Window.partitionBy("r", "doc").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    state = at.select(
        "r", "doc", "t", *[F.sum(d).over(so_far).alias(d) for d in nothing], F.last("ref", True).over(so_far).alias("ref"),
        F.max("len").over(so_far).alias("len"),
    )
    scored = state.withColumn("score", bleu(F.col("len"), F.col("ref"), {k: F.col(f"d{k}") for k in SIZES}))
    by_text = Window.partitionBy("r", "doc").orderBy("t")
    change = scored.select("r", "t", (F.col("score") - F.coalesce(F.lag("score").over(by_text), F.lit(0.0))).alias("change"))
    # the mean so far: sums within buckets of the order, and those of the buckets before, a row a run and bucket
    with shedding(reviews.sparkSession):
        times = staged(change.groupBy("r", "t").agg(F.sum("change").alias("change")).withColumn("bucket", bucket("t")), "score-changes")
    before = Window.partitionBy("r").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = times.groupBy("r", "bucket").agg(F.sum("change").alias("s"), F.count("*").alias("k"))
    offsets = totals.select(
        F.col("r").alias("_r"), F.col("bucket").alias("_b"),
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in ("s", "k")],
    )
    within = Window.partitionBy("r", "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = times.withColumns({"s": F.sum("change").over(within), "k": F.count("*").over(within)})
    rows = rows.join(offsets, F.col("r").eqNullSafe(F.col("_r")) & (F.col("bucket") == F.col("_b")))
    total, texts = F.col("s") + F.col("s0"), F.col("k") + F.col("k0")
    diversity = F.when(texts == 1, F.lit(1.0)).otherwise(F.lit(1.0) - total / texts)
    return rows.select(F.col("r").alias(run), F.col("t").alias(order), diversity.alias("self_bleu_diversity"))
