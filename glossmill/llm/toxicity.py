"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (of 3 to 5 characters) of lower-cased words with their edges marked, hashed; a feature is
present in a text or not. From the labelled sample come document counts per class, their log-count ratio r, and the
FEATURES with the largest r in standard errors; a ridge logistic regression is fitted on presence times r, with rows
weighted so that both classes weigh the same: a score is the probability for a text that is as likely toxic as not.

The fit sees at most SAMPLE rows a class, drawn by a hash of the id, so its cost doesn't grow; counting labels
and scoring cover everything. Texts are scored whole; n-grams of a word are looked up once and remembered.

Defined results: null and empty texts get the score of a text without features; null labels are left out; an id that
is labelled twice counts once, as toxic if it ever is; of documents that share a labelled id the fit sees the text that
sorts first; with no toxic or no other labelled rows there is nothing to learn, and the score is the share of toxic
ones (0 without labels); repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import held_out, passing, slices

#: Labelled rows of a class, features, hash buckets of n-grams, and rows in which a feature must be.
SAMPLE, FEATURES, BUCKETS, LEAST_ROWS = 4000, 2048, 1 << 22, 5
SIZES = (3, 4, 5)
ALPHA, RIDGE, STEPS = 1.0, 1e-5, 800
THRESHOLD = 0.7
#: Words remembered at most, and their length.
WORDS, WORD_CHARS = 600_000, 64


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def grams(word: str) -> set[str]:
    """The n-grams of a word."""
    w = f"<{word}>"
    return {w[i : i + n] for n in SIZES for i in range(len(w) - n + 1)}


class Scorer:
    """Finds the features of texts. weights: by n-gram."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.known: dict[str, tuple[str, ...]] = {}

    def of_word(self, word: str) -> tuple[str, ...]:
        w, weights = f"<{word}>", self.weights
        size = len(w) + 1
        return tuple({g for n in SIZES for i in range(size - n) if (g := w[i : i + n]) in weights})

    def features(self, text: str) -> set[str]:
        words = set(text.lower().split())
        known = self.known
        found: set[str] = set()
        if len(known) > WORDS:
            known.clear()
        for w in words.difference(known):
            mine = self.of_word(w)
            if len(w) <= WORD_CHARS:
                known[w] = mine
            found.update(mine)
        for mine in map(known.get, words):
            if mine:
                found.update(mine)
        return found

    def score(self, text: str) -> float:
        z = self.intercept + math.fsum(map(self.weights.__getitem__, self.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, pos, neg: in how many rows of each class an n-gram is."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            every = set(map(bucket, set().union(*map(grams, set((text or "").lower().split())))))
            counts[toxic][np.fromiter(every, np.int64, len(every))] += 1
    some = np.flatnonzero(counts.any(0))
    for i in range(0, len(some), 1 << 16):
        b = some[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.astype(np.int32)), pa.array(counts[1][b].astype(np.int64)), pa.array(counts[0][b].astype(np.int64))],
            names=["bucket", "pos", "neg"],
        )


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression in which both classes weigh the same, by accelerated gradient steps."""
    n, k = x.shape
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).astype(np.float32)
    u = np.ones(k, np.float32)
    for _ in range(30):  # the largest curvature, by power iteration
        u = x.T @ (weight * (x @ u)) / n
        u /= max(1e-12, float(np.linalg.norm(u)))
    step = 1 / (0.3 * (float((weight * (x @ u) ** 2).sum()) / n + 1) + RIDGE)
    w, b = np.zeros(k, np.float32), 0.0
    v, c = w.copy(), b
    loss_before, momentum = np.inf, 1.0
    for _ in range(STEPS):
        z = x @ v + c
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        e = (weight * (p - y)).astype(np.float32)
        w2, b2 = v - step * (x.T @ e / n + RIDGE * v), c - step * float(e.mean())
        loss = float(np.mean(weight * (np.logaddexp(0, z) - y * z)) + RIDGE / 2 * float(v @ v))
        if loss > loss_before:
            momentum = 1.0
        m2 = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        v, c = w2 + (momentum - 1) / m2 * (w2 - w), b2 + (momentum - 1) / m2 * (b2 - b)
        w, b, momentum, loss_before = w2, b2, m2, loss
    return w, b


def fit(docs: DataFrame, labels: DataFrame, seed: int = 1) -> tuple[dict[str, float], float]:
    """Weights by n-gram, and the intercept. Rows that are held out aren't seen."""
    with passing(docs.sparkSession) as keep:
        return fitted(docs, labels, seed, keep)


def fitted(docs: DataFrame, labels: DataFrame, seed: int, keep) -> tuple[dict[str, float], float]:
    """What fit gives; keep stages its sample."""
    mine = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = {r["toxic"]: r["n"] for r in mine.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = count.get(1, 0), count.get(0, 0)
    if not pos or not neg:
        share = pos / (pos + neg) if pos + neg else 0.0
        return {}, 500.0 if share == 1 else -500.0
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    drawn = [
        mine.filter(
            (F.col("toxic") == t) & (draw < int((1 << 30) * min(1.0, SAMPLE / n)))
        ).orderBy("doc_id").limit(2 * SAMPLE) for t, n in count.items()
    ]
    ids = drawn[0].unionByName(drawn[1])
    # one text an id, found task by task before texts move, however often an id is repeated: 4 * SAMPLE rows at most
    once = docs.select(
        "doc_id", F.col("text").cast("string").alias("text")
    ).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = keep(once.select("text", "toxic").repartition(8), "toxicity-sample")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:  # labels of documents that aren't there
        return {}, -500.0
    totals = rows.mapInArrow(class_counts, "bucket int, pos long, neg long").groupBy("bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    ).filter(F.col("pos") + F.col("neg") >= LEAST_ROWS)
    p, q = (F.col("pos") + ALPHA) / (size[1] + 2 * ALPHA), (F.col("neg") + ALPHA) / (size[0] + 2 * ALPHA)
    error = F.sqrt(1 / (F.col("pos") + ALPHA) + 1 / (F.col("neg") + ALPHA))
    top = totals.select(
        "bucket", F.log(p / q).alias("r"), error.alias("e")
    ).orderBy(F.desc(F.abs(F.col("r")) / F.col("e")), "bucket").limit(FEATURES).collect()
    if not top:
        return {}, math.log(pos / neg)
    kept = {r["bucket"] for r in top}

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of the buckets that were kept; few share one."""
        seen: set[str] = set()
        found: set[str] = set()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                new = set((text or "").lower().split()) - seen
                seen |= new
                found.update(g for w in new for g in grams(w) if bucket(g) in kept)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["gram"])

    place = {r["bucket"]: i for i, r in enumerate(top)}
    at = {r["gram"]: place[bucket(r["gram"])] for r in rows.mapInArrow(names, "gram string").distinct().collect()}  # of the sample's, FEATURES buckets'
    ratio = np.array([r["r"] for r in top], np.float32)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(at, 0.0)
        for batch in slices(batches):
            bits = []
            for text in batch.column("text").to_pylist():
                row = np.zeros(FEATURES, bool)
                row[[at[g] for g in scorer.features(text or "")]] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column("toxic")], names=["bits", "toxic"])

    table = rows.mapInArrow(present, "bits binary, toxic int").orderBy("toxic", "bits").toArrow()  # FEATURES / 8 bytes a row of the sample
    y = table.column("toxic").to_numpy().astype(np.float32)
    x = np.stack(
        [np.unpackbits(np.frombuffer(b, np.uint8)) for b in table.column("bits").to_pylist()]
    )[:, : len(top)].astype(np.float32) * ratio
    w, b = logistic(x, y)
    return {gram: float(w[i] * ratio[i]) for gram, i in at.items() if w[i]}, b


def scores(docs: DataFrame, model: tuple[dict[int, float], float]) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([scorer.score(t or "") for t in batch.column("text").to_pylist()], pa.float64())],
                names=["doc_id", "score"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    )


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
