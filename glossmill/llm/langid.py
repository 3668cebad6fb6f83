"""Language ID by nearest centroids.

A text is the TF-IDF vector of its hashed character n-grams (1 to 3 letters of lower-cased text, other characters
being spaces), scaled to length 1. Each language has a few centroids, clustered by cosine among a sample of its
texts; a text gets the language of the nearest centroid, and is rejected as being of none if it is further from it
than texts of that language are, by a margin.

The fit sees about SAMPLE texts a language, of LANGUAGES languages at most, drawn by a hash of the id and the text;
scoring covers everything. Clusters are found on the executors, a language a task, from its texts in sorted order, so
a fit gives the same model each time; the driver gets one vector of counts a partition of the sample, and the centroids.

Defined results: null texts and texts without a letter are `und` with score 0 (and rejected); null languages are
not learned; with nothing to learn from, every text is `und`; ties go to the language that sorts first; texts are
read whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import held_out, passing, slices

#: Texts of a language, centroids of a language, and buckets of n-grams (a power of two).
SAMPLE, CENTROIDS, BUCKETS = 600, 3, 4096
#: Languages learned at most, those of most texts: a bound of the fit, should the column hold something else.
LANGUAGES = 1000
#: A text is rejected below this part of the cosine that all but a hundredth of the language's sample reach: the first
#: for texts of few letters, whose vectors are rough, the second for those of many, and in between by their letters.
MARGIN, LONG_MARGIN, FEW, MANY = 0.35, 0.8, 50, 150
CHUNK = 1 << 20
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter, by the language's own table of characters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams are in the text; None without a letter."""
    out, some = np.zeros(BUCKETS, np.float64), False
    low = text.lower()
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for i in range(0, max(1, len(low)), CHUNK):  # n-grams over the cut are left to the next part
        c = np.frombuffer(low[max(0, i - 2) : i + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = letters()[c]
        if not letter.any():
            continue
        some = True
        c = np.where(letter, c, np.uint32(32)).astype(np.uint32)
        new = slice(2 if i else 0, None)
        one = (c * np.uint32(0x9E3779B1))[new][letter[new]]
        two = (c[:-1] * np.uint32(0x85EBCA6B) ^ c[1:] * np.uint32(0xC2B2AE35) + np.uint32(1))[1 if i else 0 :]
        three = c[:-2] * np.uint32(0x27D4EB2F) ^ c[1:-1] * np.uint32(0x165667B1) ^ c[2:] * np.uint32(0xD3A2646C) + np.uint32(2)
        two, three = two[(letter[:-1] | letter[1:])[1 if i else 0 :]], three[letter[1:-1]]
        for h in (one, two, three):
            h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            out += np.bincount(h >> shift, minlength=BUCKETS)
    return out if some else None


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    c = counts(text) if text else None
    if c is None:
        return None
    v = (np.sqrt(c) * idf).astype(np.float32)
    return v / max(1e-12, float(np.sqrt(v @ v)))


def clustered(v: np.ndarray, k: int) -> np.ndarray:
    """Centroids of length 1, from the vectors furthest from each other, by ten rounds of spherical k-means."""
    at = [int(np.argmax(v @ v.mean(0)))]
    while len(at) < min(k, len(v)):
        at.append(int(np.argmin((v @ v[at].T).max(1))))
    c = v[at]
    for _ in range(10):
        near = (v @ c.T).argmax(1)
        c = np.stack([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
    return c


def fit(docs: DataFrame, seed: int = 3) -> dict:
    """The model: idf, languages, and for each centroid its vector, language and least cosine."""
    with passing(docs.sparkSession) as keep:
        return fitted(docs, seed, keep)


def fitted(docs: DataFrame, seed: int, keep) -> dict:
    """What fit gives; keep stages its sample."""
    mine = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    each = {
        r["lang"]: r["n"] for r in mine.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    }
    empty = {
        "idf": np.zeros(BUCKETS, np.float32), "langs": [], "vectors": np.zeros((0, BUCKETS), np.float32), "of": np.zeros(0, int),
        "least": np.zeros(0),
    }
    if not each:
        return empty
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in each.items() for x in (lang, int((1 << 30) * min(1.0, SAMPLE / n)))])
    sample = keep(mine.filter(draw < share[F.col("lang")]).select("lang", "text").distinct().repartition(8), "language-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if (c := counts(text)) is not None:
                    n, df = n + 1, df + (c > 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])

    parts = sample.mapInArrow(frequencies, "n long, df binary").collect()  # a vector for each of 8 partitions
    n, df = sum(r["n"] for r in parts), sum((np.frombuffer(r["df"]) for r in parts), np.zeros(BUCKETS))
    if not n:
        return empty
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(table: pa.Table) -> pa.Table:
        v = [x for t in sorted(table.column("text").to_pylist()) if (x := vector(t, idf)) is not None]
        if not v:
            return pa.table({"lang": pa.array([], pa.string()), "vector": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        v = np.stack(v)
        c = clustered(v, CENTROIDS)
        least = float(np.quantile((v @ c.T).max(1), 0.01))
        return pa.table(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * len(c), pa.string()),
                "vector": pa.array([x.tobytes() for x in c], pa.binary()), "least": pa.array([least] * len(c), pa.float64()),
            }
        )

    found = sorted(  # CENTROIDS rows a language
        (
            (r["lang"], r["vector"], r["least"]) for r in sample.groupBy("lang").applyInArrow(
                cluster, "lang string, vector binary, least double"
            ).collect()
        ),
        key=lambda r: (r[0], bytes(r[1])),
    )
    langs = sorted({r[0] for r in found})
    return {
        "idf": idf, "langs": langs, "vectors": np.stack([np.frombuffer(r[1], np.float32) for r in found]),
        "of": np.array([langs.index(r[0]) for r in found]), "least": np.array([r[2] for r in found]),
    }


def margin(text: str) -> float:
    long = (sum(map(str.isalpha, text)) - FEW) / (MANY - FEW)
    return MARGIN + (LONG_MARGIN - MARGIN) * min(1.0, max(0.0, long))


def judged(text: str | None, m: dict) -> tuple[str, float, bool]:
    """Language, score and whether the text is rejected."""
    v = vector(text, m["idf"]) if m["langs"] else None
    if v is None:
        return UNKNOWN, 0.0, True
    near = m["vectors"] @ v
    at = int(near.argmax())
    score = min(1.0, max(0.0, float(near[at])))
    rejected = score < LONG_MARGIN * m["least"][at] and score < margin(text) * m["least"][at]  # few texts' letters need be counted
    return m["langs"][m["of"][at]], score, bool(rejected)


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, rejected = zip(
                *(judged(t, shared.value) for t in batch.column("text").to_pylist())
            ) if len(batch) else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    )


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    return predicted(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, columns as they were. The texts are judged where they are read: rows
    pass through the workers whole, and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("boolean")
    def near(texts: pd.Series) -> pd.Series:
        return pd.Series([not judged(t, shared.value)[2] for t in texts], dtype=bool)

    return docs.filter(near(F.col("text").cast("string")))
