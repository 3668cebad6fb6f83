"""Corpus diversity: Self-BLEU, type-token ratios, moving windows, n-gram diversity and cosine similarity.

Nothing here compares texts in pairs but the extremes of cosine similarity, which need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import metric_tree, packed
from glossmill.operators.prefix import running
from glossmill.plans.staging import in_shares, passing, shedding, staged

EPSILON = 0.1  # what smoothing puts for no match
MATTR_WINDOW, MATTR_STRIDE = 100, 50
#: Windows of a chunk of places.
CHUNK_WINDOWS = 2000
#: Characters of a corpus for each share that its n-grams are taken in, and shares at most: a share reads all texts, and holds on
#: disk what it shuffles of them, some 15 times the texts over all shares. Packed n-grams are smaller, so theirs are fewer.
SHARE_CHARS, SHARES, PACKED_SHARES = 5_000_000, 16, 8
#: Texts of a group that sums the leads of texts, about.
TEXTS_A_PART = 20_000
#: Texts of a bucket of running sums: rows carry their words.
TEXT_ROWS = 1000
#: Weights of the overall score.
WEIGHTS = {"self_bleu": 0.3, "semantic": 0.3, "ttr": 0.2, "bigram": 0.1, "trigram": 0.1}


def shares_of(docs: DataFrame, text: str = "text") -> int:
    """In how many shares of hashes n-grams of so many texts are taken."""
    return shares_for(docs.agg(F.sum(F.length(text))).first()[0] or 0)


def shares_for(chars: int) -> int:
    return int(min(SHARES, 1 + chars // SHARE_CHARS))


def ngram_rows(docs: DataFrame, keep: list[str], sizes: tuple[int, ...], words: str = "w", share: tuple[int, int] = (0, 1)) -> DataFrame:
    """keep, n and 128 bits (a, b) of each n-gram of the words, n being any of sizes; share: k and m, for those of which a is k
    modulo m.

    Positions are exploded and hashed within generated code, which functions over arrays would leave; rows of hashes are
    what is shuffled, not the words. The second hash is taken of the n-grams of the share only.
    """
    w, at = F.col(words), F.col("at")
    least, (k, m) = min(sizes), share
    places = F.when(F.size(w) >= least, F.sequence(F.lit(0), F.size(w) - least))
    gram = lambda n: [F.get(w, at + i) for i in range(n)]
    one = lambda n: F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *gram(n)).alias("a"))
    rows = docs.select(*keep, words, F.explode(places).alias("at"))
    rows = rows.select(*keep, words, "at", F.explode(F.array(*[one(n) for n in sizes])).alias("g"))
    rows = rows.filter(F.col("g.n") <= F.size(w) - at)
    if m > 1:
        rows = rows.filter(F.pmod(F.col("g.a"), F.lit(m)) == k)
    b = None
    for n in sizes:
        b = F.when(F.col("g.n") == n, F.xxhash64(F.lit(-n - 1), *gram(n))) if b is None else b.when(F.col("g.n") == n, F.xxhash64(F.lit(-n - 1), *gram(n)))
    return rows.select(*keep, "g.n", "g.a", b.alias("b"))


def leaders(docs: DataFrame, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """a, b, n, and for each n-gram of docs (seq, w) its largest count (c1), the first text that has it (seq), and its second
    largest (c2; 0 if there is none), of a share of the n-grams. A task sends two rows an n-gram at most."""
    rows = ngram_rows(docs, ["seq"], (1, 2, 3, 4), share=share).groupBy("seq", "a", "b", "n").agg(F.count("*").alias("c"))
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b", "n").orderBy(F.desc("c"), "seq"))).filter("rank <= 2")
    first, second = F.col("rank") == 1, F.col("rank") == 2
    return top.groupBy("a", "b", "n").agg(
        F.max(F.when(first, F.col("seq"))).alias("seq"), F.max(F.when(first, F.col("c"))).alias("c1"),
        F.coalesce(F.max(F.when(second, F.col("c"))), F.lit(0)).alias("c2"),
    )


def bleu_parts(reviews: DataFrame) -> DataFrame:
    """seq, len, ref, and for n = 1 to 4 the n-grams (t1..t4) and those of them that another text has too (m1..m4).

    A text's n-gram counts are clipped by the largest count in any other text. That is its own count or more for
    all texts but the one with the largest, which keeps the second largest. So only the two largest counts of an
    n-gram matter, and only the first loses matches: a text's matches are its n-grams less the leads that it has.
    A text's n-grams are counted where it is, as packed hashes; one shuffle of these finds the largest two, another sums the
    leads of a text. Nothing is joined back. N-grams of a large corpus are taken in shares, one after the other: words are
    hashed once, only one share's shuffle files are on disk, and sums a text are what stays.
    """
    there = reviews.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"), F.count("seq").alias("known"), F.count_distinct("seq").alias("ids")).first()
    shares = min(PACKED_SHARES, shares_for(there["chars"] or 0))
    sizes = reviews.select("seq", F.size(T.words(F.col("text"))).cast("long").alias("len"))
    if there["n"] == there["known"] == there["ids"] and dict(reviews.dtypes)["seq"] in ("int", "bigint"):
        hashes = packed.hashed(reviews.select(F.col("seq").cast("long").alias("seq"), "text"), ["seq"])
        buckets, parts = packed.buckets_of(there["chars"] or 0, shares), int(min(1 << 16, 8 + there["n"] // TEXTS_A_PART))
        if shares == 1:
            return with_references(sizes.join(packed.lost_matches(hashes, (0, 1), buckets, parts), "seq", "left"))
        with shedding(reviews.sparkSession), passing(reviews.sparkSession) as keep:
            known = keep(hashes, "word-hashes")
            every = in_shares(reviews.sparkSession, lambda share: packed.lost_matches(known, (share, shares), buckets, parts), shares, "leads")
    else:  # texts of one id are one text of several pieces
        docs = reviews.select("seq", "text").repartition("seq").select("seq", T.words(F.col("text")).alias("w"))

        def lost(share: int) -> DataFrame:
            leads = leaders(docs, (share, shares)).select("seq", "n", (F.col("c1") - F.col("c2")).alias("lead")).filter("lead > 0")
            return leads.groupBy("seq").agg(
                *[F.coalesce(F.sum(F.when(F.col("n") == n, F.col("lead"))), F.lit(0)).alias(f"l{n}") for n in range(1, 5)]
            )

        every = in_shares(reviews.sparkSession, lost, shares, "leads")
    if shares > 1:
        every = every.groupBy("seq").agg(*[F.sum(f"l{n}").alias(f"l{n}") for n in range(1, 5)])
    return with_references(sizes.join(every, "seq", "left"))


def with_references(texts: DataFrame) -> DataFrame:
    """seq, len, ref (the closest length of another text, the shorter of two), t1..t4 and m1..m4 of all texts (seq, len, and
    l1..l4, the matches that they lack)."""
    per = texts.groupBy("len").agg(F.count("*").alias("k"))
    by = Window.orderBy("len")  # a row for each different length
    near = per.select(F.col("len").alias("_len"), "k", F.lag("len").over(by).alias("lo"), F.lead("len").over(by).alias("hi"))
    ref = F.when(F.col("k") > 1, F.col("_len")).when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(
        F.col("hi") - F.col("_len") < F.col("_len") - F.col("lo"), F.col("hi")
    ).otherwise(F.col("lo"))
    refs = near.select("_len", ref.alias("ref"))
    out = texts.join(refs, texts["len"] == refs["_len"]).drop("_len")
    total = {f"t{n}": F.greatest(F.col("len") - (n - 1), F.lit(0)) for n in range(1, 5)}
    return out.select(
        "seq", "len", "ref", *[t.alias(k) for k, t in total.items()],
        *[(total[f"t{n}"] - F.coalesce(f"l{n}", F.lit(0))).alias(f"m{n}") for n in range(1, 5)],
    )


def self_bleu_docs(reviews: DataFrame) -> DataFrame:
    """seq, bleu of each text (seq, text) against all others; 0 where there is no other."""
    return bleu_of(bleu_parts(reviews))


def bleu_of(parts: DataFrame) -> DataFrame:
    """seq, bleu of texts with their n-grams (t1..t4), matches (m1..m4), length and reference."""
    log = F.lit(0.0)
    for n in range(1, 5):
        m, t = F.col(f"m{n}").cast("double"), F.greatest(F.col(f"t{n}"), F.lit(1)).cast("double")
        log = log + F.lit(0.25) * F.log(F.when(m == 0, F.lit(EPSILON) / t).otherwise(m / t))
    brevity = F.when(F.col("len") > F.col("ref"), F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - F.col("ref") / F.col("len").cast("double")))
    bleu = F.when(F.col("m1") == 0, F.lit(0.0)).when(F.col("ref").isNull(), F.lit(0.0)).otherwise(brevity * F.exp(log))
    return parts.select("seq", bleu.alias("bleu"))


def self_bleu_diversity(reviews: DataFrame) -> DataFrame:
    """One row: 1 less the mean BLEU; 0 with fewer than two texts."""
    return mean_diversity(self_bleu_docs(reviews))


def mean_diversity(scores: DataFrame) -> DataFrame:
    return scores.agg(F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.lit(1.0) - F.avg("bleu")).alias("self_bleu_diversity"))


def tokens(reviews: DataFrame) -> DataFrame:
    return reviews.select(F.explode(T.words(F.lower(F.col("text")))).alias("w"))


def type_token(reviews: DataFrame) -> DataFrame:
    """One row: total_words, vocabulary_size, ttr. Words are counted in parts first: one row a word and task moves."""
    counts = tokens(reviews).groupBy("w").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count("*").alias("vocabulary_size")).withColumn(
        "ttr", F.coalesce(F.try_divide(F.col("vocabulary_size").cast("double"), F.col("total_words").cast("double")), F.lit(0.0))
    )


def mattr(reviews: DataFrame, window: int = MATTR_WINDOW, stride: int = MATTR_STRIDE) -> DataFrame:
    """One row: the mean type-token ratio of windows over all texts' words in the order of seq, each stride words further; that
    of all words if they don't fill a window.

    A window's different words are those whose earlier place lies before it. So a word counts in a range of windows: from the
    first that begins behind its earlier place, and reaches it, to the last that has begun. The sum of these ranges is what all
    windows hold; no window is gathered. Earlier places further back than a window don't matter, so words are dealt in chunks of
    places, with a window's words before them. Words are packed hashes; chunks of a large corpus are taken in shares.
    """
    hashes, shares = packed.hashed(reviews, ["seq"], lower=True), shares_of(reviews)
    with shedding(reviews.sparkSession), passing(reviews.sparkSession) as keep:
        one = windows_of(keep(hashes, "word-hashes") if shares > 1 else hashes, window, stride, min(PACKED_SHARES, shares), keep)
    return one if one is not None else type_token(reviews).select(F.col("ttr").alias("mattr"))


def windows_of(hashes: DataFrame, window: int, stride: int, shares: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame | None:
    """mattr of texts (seq, h); None if all words don't fill a window."""
    total = hashes.agg(F.sum(F.size("h"))).first()[0] or 0
    if total < window:
        return None
    docs = hashes.withColumn("n", F.size("h").cast("long"))
    placed = running(docs, "seq", {"end": F.col("n")}, bucket_rows=TEXT_ROWS).select((F.col("end") - F.col("n")).alias("begin"), "end", "h")
    size = CHUNK_WINDOWS * window
    chunks, windows = total // size + 1, (total - window) // stride + 1

    def held(texts: DataFrame, share: int) -> DataFrame:
        """What the windows hold by the words of a share of the chunks."""
        some, behind = share * chunks // shares, (share + 1) * chunks // shares
        near = texts.filter((F.col("begin") < behind * size) & (F.col("end") > some * size - window))
        return packed.held_by_windows(near.select("begin", "h"), window, stride, size, windows, (some, behind)).agg(F.sum("held").alias("held"))

    there = keep(placed, "placed-words") if shares > 1 else placed
    parts = in_shares(hashes.sparkSession, lambda share: held(there, share), shares, "windows")
    return parts.agg((F.sum("held") / F.lit(float(windows * window))).alias("mattr"))


def ngram_diversity(reviews: DataFrame, n: int) -> DataFrame:
    """One row: distinct over all n-grams, which don't cross texts; 0 without any."""
    hashes = packed.hashed(reviews, [], lower=True)
    chars = reviews.agg(F.sum(F.length("text"))).first()[0] or 0
    with shedding(reviews.sparkSession), passing(reviews.sparkSession) as keep:
        every = ngram_counts(keep(hashes, "word-hashes") if shares_for(chars) > 1 else hashes, (n,), chars)
    return every.select("total", "unique_ngrams", ratio("unique_ngrams", "total").alias("diversity"))


def ratio(part: str, of: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of).cast("double")), F.lit(0.0))


def ngram_counts(hashes: DataFrame, sizes: tuple[int, ...], chars: int) -> DataFrame:
    """One row: total and unique_ngrams of the size; of several sizes, total1, unique_ngrams1 and so on."""
    shares = min(PACKED_SHARES, shares_for(chars))
    buckets = packed.buckets_of(chars, shares)
    every = in_shares(hashes.sparkSession, lambda share: packed.distinct_counts(hashes, sizes, (share, shares), buckets), shares, "ngram-counts")
    return every.agg(
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.col(x))), F.lit(0)).alias(x if len(sizes) == 1 else f"{x}{n}") for n in sizes for x in ("total", "unique_ngrams")]
    )


def unit(vectors: DataFrame, vector: str) -> DataFrame:
    """Vectors of length 1; a zero vector stays zero."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn(vector, F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))


def cosine_moments(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: pairs, avg and population deviation of all pairwise cosines, without any pair.

    With unit rows X, the sum of the cosines follows from the length of their sum, and the sum of their squares
    from XᵀX; a task adds up both for its rows, and d * d numbers a task are what moves.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own, fourth, s, gram = 0, 0.0, 0.0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, -1)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(size > 0, size, 1)
            sq = (x * x).sum(1)
            n, own, fourth = n + len(x), own + sq.sum(), fourth + (sq * sq).sum()
            s, gram = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), gram + x.T @ x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n], pa.int64()), pa.array([own]), pa.array([fourth]), pa.array([s.tolist()], pa.list_(pa.float64())),
                    pa.array([gram.ravel().tolist()], pa.list_(pa.float64())),
                ],
                names=["n", "own", "fourth", "s", "g"],
            )

    part = vectors.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        parts, "n long, own double, fourth double, s array<double>, g array<double>"
    )
    add = lambda c: part.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(
        F.sum(F.col("x") * F.col("x")).alias(c)
    )
    one = part.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("own").alias("own"), F.sum("fourth").alias("fourth")
    ).crossJoin(add("s")).crossJoin(add("g"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.try_divide((F.col("s") - F.col("own")) / 2, pairs)
    square = F.try_divide((F.col("g") - F.col("fourth")) / 2, pairs)
    return one.select(
        pairs.cast("long").alias("pairs"), F.coalesce(mean, F.lit(0.0)).alias("avg_similarity"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_similarity"),
    )


def span(x: np.ndarray, y: np.ndarray | None = None) -> tuple[float, float]:
    """The largest and smallest cosine between rows of x and of y, or between two rows of x, in parts of bounded size."""
    hi, lo = -np.inf, np.inf
    for i in range(0, len(x), 512):
        c = x[i : i + 512] @ (x if y is None else y).T
        if y is None:
            c = c[np.arange(len(x)) > np.arange(i, i + len(c))[:, None]]
        if c.size:
            hi, lo = max(hi, float(c.max())), min(lo, float(c.min()))
    return hi, lo


def extremes_table(hi: float, lo: float) -> pa.Table:
    return pa.table({"hi": pa.array([hi] if hi > -np.inf else [], pa.float64()), "lo": pa.array([lo] if hi > -np.inf else [], pa.float64())})


def cosine_extremes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """One row: largest and smallest cosine of any two vectors.

    Few vectors are one block. More lie in the leaves of a metric tree: extremes within leaves and between their centres are known
    first, and only pairs of leaves that the tree can't cut by these are compared, as matrices, a task for each two tiles of them. No
    pair becomes a row. Zero vectors have no angle: their cosines are 0.
    """
    spark = vectors.sparkSession
    there = vectors.filter(F.col(vector).isNotNull())
    size = there.agg(F.count("*").alias("n"), F.count_if(~F.exists(F.col(vector), lambda x: x != 0)).alias("zeros")).first()
    zero = [(0.0, 0.0)] if size["zeros"] and size["n"] > 1 else []
    if size["n"] - size["zeros"] <= block_rows:
        some = there.filter(F.exists(F.col(vector), lambda x: x != 0)).select(F.col(vector).cast("array<double>").alias("v"), F.lit(0).alias("all"))
        every = some.groupBy("all").applyInArrow(lambda t: extremes_table(*span(metric_tree.unit_rows(metric_tree.rows_of(t)))), "hi double, lo double")
    else:
        rows, tree, parts = metric_tree.in_leaves(vectors, key, vector, block_rows, staged)
        inside = rows.groupBy("leaf", "part").applyInArrow(lambda t: extremes_table(*span(metric_tree.rows_of(t))), "hi double, lo double")
        known = inside.agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).first()
        high, low = (known["hi"], known["lo"]) if known["hi"] is not None else (-np.inf, np.inf)
        low = min(low, metric_tree.widest(tree))  # centres are vectors of the table
        may = lambda i, j, nearest, furthest: (np.cos(nearest) > high) | (np.cos(furthest) < low)
        i, j, _ = metric_tree.left_over(tree, may, ordered=False)
        pairs = metric_tree.by_tile(i, j)

        def meet(table: pa.Table) -> pa.Table:
            one = table.filter(table.column("left"))
            other = table.filter(pc.invert(table.column("left")))
            x, y, mine, theirs = metric_tree.rows_of(one), metric_tree.rows_of(other), metric_tree.leaves_of(one), metric_tree.leaves_of(other)
            t, u, p, q = (table.column(c)[0].as_py() for c in ("t", "u", "p", "q"))
            hi, lo = -np.inf, np.inf
            for a, b in pairs[t, u]:
                ways = [(a, b)] if t != u or p == q or a == b else [(a, b), (b, a)]  # parts of one tile meet once
                for m, n in ways:
                    if m in mine and n in theirs and not (m == n and p == q):
                        most, least = span(x[mine[m]], y[theirs[n]])
                        hi, lo = max(hi, most), min(lo, least)
            return extremes_table(hi, lo)

        meets = [(t, u, p, q) for t, u in pairs for p in range(parts[t]) for q in range(parts[u]) if t != u or p <= q]
        table = F.broadcast(spark.createDataFrame(meets, "t int, u int, p int, q int"))  # tiles, not rows, count
        columns = ["v", "leaf", "t", "u", "p", "q"]
        left = rows.join(table, (F.col("tile") == F.col("t")) & (F.col("part") == F.col("p"))).select(*columns, F.lit(True).alias("left"))
        right = rows.join(table, (F.col("tile") == F.col("u")) & (F.col("part") == F.col("q"))).select(*columns, F.lit(False).alias("left"))
        every = left.unionByName(right).groupBy("t", "u", "p", "q").applyInArrow(meet, "hi double, lo double")
        zero += [(float(x), float(x)) for x in (high, low) if np.isfinite(x)]
    if zero:
        every = every.unionByName(spark.createDataFrame(zero, "hi double, lo double"))
    return every.agg(F.max("hi").alias("max_similarity"), F.min("lo").alias("min_similarity"))


def overall(reviews: DataFrame, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: each measure and their weighted sum. Each is written before the next begins, and its shuffle files go. Lower-case
    words are hashed once for all that counts them."""
    chars = reviews.agg(F.sum(F.length("text"))).first()[0] or 0
    with shedding(reviews.sparkSession), passing(reviews.sparkSession) as keep:
        words = keep(packed.hashed(reviews, ["seq"], lower=True), "word-hashes")
        counts = staged(ngram_counts(words, (1, 2, 3), chars), "measure").select(
            F.col("total1").alias("total_words"), F.col("unique_ngrams1").alias("vocabulary_size"), ratio("unique_ngrams1", "total1").alias("ttr"),
            ratio("unique_ngrams2", "total2").alias("bigram_diversity"), ratio("unique_ngrams3", "total3").alias("trigram_diversity"),
        )
        moving = windows_of(words, MATTR_WINDOW, MATTR_STRIDE, min(PACKED_SHARES, shares_for(chars)), keep)
        moving = counts.select(F.col("ttr").alias("mattr")) if moving is None else staged(moving, "measure")
        measures = [staged(m, "measure") for m in (self_bleu_diversity(reviews), cosine_moments(vectors, vector).select("avg_similarity"))]
        one = reduce(DataFrame.crossJoin, [*measures, counts, moving])
    one = one.withColumn("semantic_diversity", F.lit(1.0) - F.col("avg_similarity"))
    w = WEIGHTS
    score = F.lit(w["self_bleu"]) * F.col("self_bleu_diversity") + F.lit(w["semantic"]) * F.col("semantic_diversity") + F.lit(w["ttr"]) * F.col("ttr") + F.lit(w["bigram"]) * F.col("bigram_diversity") + F.lit(w["trigram"]) * F.col("trigram_diversity")
    return one.withColumn("overall_score", F.when(F.col("total_words") > 0, score).otherwise(F.lit(0.0)))


def max_similarity_before(vectors: DataFrame, order: str = "vec_id", vector: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """order, max_similarity: the largest cosine with any vector before it; null for the first.

    Vectors lie in the leaves of a metric tree, of which every node knows its least and greatest order. Each vector is held against
    the earlier ones of its leaf first. Pairs of nodes are cut where nothing below one is earlier than anything below the other, or nothing
    is near enough to beat what all of its vectors have; then a vector goes to the tiles in which a leaf that is left could still beat what
    it has itself. Tiles that many ask are copied for parts of the questions.
    """
    rows, tree, parts = metric_tree.in_leaves(vectors, order, vector, block_rows, staged)
    there = vectors.filter(F.col(vector).isNotNull()).withColumn("k", F.col(order).cast("long"))
    none = ~F.exists(F.col(vector), lambda x: x != 0)
    ends = there.agg(F.min("k").alias("first"), F.min(F.when(none, F.col("k"))).alias("zero")).first()
    after = lambda key: F.lit(False) if key is None else F.col("k") > key
    alone = there.filter(none).select("k", F.when(after(ends["first"]), F.lit(0.0)).alias("best"))
    if tree is None:
        return alone.select(F.col("k").alias(order), F.col("best").alias("max_similarity"))

    def earlier(x: np.ndarray, k: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The largest cosine of each x with a y of a smaller key, in parts of bounded size."""
        out = [
            np.where(j[None, :] < k[i : i + 512, None], x[i : i + 512] @ y.T, -np.inf).max(1) for i in range(0, len(x), 512)
        ] if len(y) else []
        return np.concatenate(out) if out else np.full(len(x), -np.inf)

    def own(table: pa.Table) -> pa.Table:
        x, k = metric_tree.rows_of(table), table.column("k").to_numpy()
        return table.select(["k", "v", "leaf", "tile", "part"]).append_column("best", pa.array(earlier(x, k, x, k)))

    found = staged(rows.groupBy("leaf", "part").applyInArrow(own, "k long, v array<double>, leaf int, tile int, part int, best double"), "cosines-in-leaves")
    # what the vectors of a node have at least, and where a leaf's parts haven't met yet
    worst = np.full(len(tree.parent), np.inf)
    for r in found.groupBy("leaf").agg(F.min("best").alias("best")).collect():  # a row a leaf
        node = tree.leaves[r.leaf]
        while node >= 0:
            worst[node], node = min(worst[node], r.best), tree.parent[node]
    split = np.array([parts[leaf // metric_tree.TILE] > 1 for leaf in range(len(tree.leaves))])
    cut = lambda i, j: (tree.leaf[i] >= 0) & (i == j) & ~split[np.maximum(tree.leaf[i], 0)]  # noqa: E731  a leaf that has met itself
    may = lambda i, j, nearest, furthest: (np.cos(nearest) > worst[i]) & (tree.least[j] < tree.greatest[i]) & ~cut(i, j)
    i, j, _ = metric_tree.left_over(tree, may, ordered=True)
    to = {int(a): j[i == a] for a in np.unique(i)}
    nodes = tree.leaves
    centres, reach, least = tree.centres[nodes], tree.reach[nodes], tree.least[nodes]

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles to which each vector goes, by its own angle to the centres of the leaves that are left for its leaf."""
        for batch in batches:
            goals: list[list[int]] = [[] for _ in range(batch.num_rows)]
            x, k = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1), batch.column("k").to_numpy()
            best, leaf = batch.column("best").to_numpy(), batch.column("leaf").to_numpy()
            for a in np.unique(leaf):
                mine, there = np.flatnonzero(leaf == a), to.get(int(a), np.zeros(0, np.int64))
                for s in range(0, len(mine) if len(there) else 0, 512):
                    some = mine[s : s + 512]
                    near = np.maximum(0, np.arccos(np.clip(x[some] @ centres[there].T, -1, 1)) - reach[there] - metric_tree.HAIR)
                    hits = (np.cos(near) > best[some][:, None]) & (least[there] < k[some][:, None])
                    for r, row in zip(some.tolist(), hits):
                        goals[r] = np.unique(there[row] // metric_tree.TILE).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "v", "leaf", "best")), pa.array(goals, pa.list_(pa.int32()))], names=["k", "v", "leaf", "best", "to"])

    asked = found.mapInArrow(aim, "k long, v array<double>, leaf int, best double, to array<int>").select("k", "v", "leaf", "best", F.explode("to").alias("q"))
    asked = staged(asked, "questions")
    times = {r.q: r.n for r in asked.groupBy("q").agg(F.count("*").alias("n")).collect()}  # a row a tile
    spark = vectors.sparkSession
    known = [(int(q), parts[q], -(-n // (16 * block_rows))) for q, n in times.items()]
    copies = F.broadcast(spark.createDataFrame(known, "_q int, parts int, copies int"))
    asks = asked.join(copies, F.col("q") == F.col("_q")).select(
        "k", "v", "leaf", "best", "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), F.pmod(F.xxhash64("k"), F.col("copies")).cast("int").alias("c"), F.lit(True).alias("asks")
    )
    holds = rows.join(copies, F.col("tile") == F.col("_q")).select(
        "k", "v", "leaf", F.lit(0.0).alias("best"), F.col("tile").alias("q"), F.col("part").alias("s"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("c"), F.lit(False).alias("asks")
    )

    def others(table: pa.Table) -> pa.Table:
        one, other = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks")))
        x, y, mine, theirs = metric_tree.rows_of(one), metric_tree.rows_of(other), metric_tree.leaves_of(one), metric_tree.leaves_of(other)
        k, j, best = one.column("k").to_numpy(), other.column("k").to_numpy(), one.column("best").to_numpy().copy()
        for a, places in mine.items():
            for b in to[a]:
                if int(b) in theirs:
                    there = theirs[int(b)]
                    best[places] = np.maximum(best[places], earlier(x[places], k[places], y[there], j[there]))
        return pa.table({"k": one.column("k"), "best": pa.array(best)})

    every = found.select("k", "best").unionByName(
        asks.unionByName(holds).groupBy("q", "s", "c").applyInArrow(others, "k long, best double")
    )
    best = every.groupBy("k").agg(F.max("best").alias("best")).select("k", F.when(F.col("best") > -2, F.col("best")).alias("best"))
    best = best.withColumn("best", F.when(after(ends["zero"]), F.greatest("best", F.lit(0.0))).otherwise(F.col("best")))
    return best.unionByName(alone).select(F.col("k").alias(order), F.col("best").alias("max_similarity"))


def history_check(
    reviews: DataFrame, vectors: DataFrame, order: str = "seq", min_unique: int = 50, max_similarity: float = 0.8
) -> DataFrame:
    """order, n_unique, max_similarity, reason, passed: enough different words, and not too close to any earlier text
    (failed ones too). vectors: order and embedding of each text."""
    near = max_similarity_before(vectors, order)
    rows = reviews.withColumn("n_unique", T.unique_word_count(F.col("text"))).join(near, order, "left")
    close = F.when(
        F.col("max_similarity") > max_similarity,
        F.concat(F.lit("Too similar to previous reviews: "), T.fixed(F.col("max_similarity"), 2), F.lit(f" > {max_similarity}")),
    )
    few = F.when(F.col("n_unique") < min_unique, F.format_string(f"Insufficient unique words: %d < {min_unique}", F.col("n_unique")))
    rows = rows.withColumn("reason", F.coalesce(close, few))
    return rows.select(order, "n_unique", "max_similarity", "reason", F.col("reason").isNull().alias("passed"))


def validate_dataset(
    reviews: DataFrame, vectors: DataFrame, target: dict[int, float] | None = None, critical: float = 9.488, least: float = 0.6
) -> DataFrame:
    """One row: dataset_size, overall_score, chi2 of the ratings against a target distribution, is_biased, passed.

    chi2 is held against the 5 % point of 4 degrees of freedom; without a target nothing is biased.
    """
    counts = reviews.agg(F.count("*").alias("dataset_size"), *[F.count_if(F.col("rating") == r).alias(f"n{r}") for r in range(1, 6)])
    chi2 = F.lit(0.0)
    for r, share in (target or {}).items():
        want = F.col("dataset_size") * F.lit(float(share))
        chi2 = chi2 + F.coalesce(F.try_divide((F.col(f"n{r}") - want) * (F.col(f"n{r}") - want), want), F.lit(0.0))
    one = counts.withColumn("chi2", chi2).crossJoin(overall(reviews, vectors).select("overall_score"))
    return one.select(
        "dataset_size", "overall_score", "chi2", (F.col("chi2") > critical).alias("is_biased"),
        ((F.col("chi2") <= critical) & (F.col("overall_score") > least)).alias("passed"),
    )
