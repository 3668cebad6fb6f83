"""Models of texts as stages: embeddings and star ratings, by plug-ins that a task loads once, with stand-ins that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions import sentiment as S
from glossmill.functions import text as T

#: Texts that a model gets at once.
BATCH = 64
#: Words of a text go to so many places of the stand-in's vectors.
DIMENSIONS = 64


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class StarModel(Protocol):
    def stars(self, texts: list[str]) -> list[tuple[int, float]]: ...


def encode(
    reviews: DataFrame, make_encoder: Callable[[], Encoder], keys: list[str], text: str = "text", out: str = "embedding"
) -> DataFrame:
    """keys and the vector of each text by an encoder, which is made once a task; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                model = model or make_encoder()
                made = np.asarray(model.encode([t or "" for t in part.column("_t").to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.array(made.tolist(), pa.list_(pa.float32()))], names=[*keys, out]
                )

    ddl = "".join(f"`{k}` {reviews.schema[k].dataType.simpleString()}, " for k in keys)
    return reviews.select(*keys, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"{ddl}`{out}` array<float>")


def hashed_vectors(
    reviews: DataFrame, keys: list[str], text: str = "text", dimensions: int = DIMENSIONS, out: str = "embedding"
) -> DataFrame:
    """keys and the stand-in for an encoder's vector of each text: how often its lower-cased words fall to each place, by
    the first 32 bits of their MD5. Words are counted by place before they move: a text is dimensions numbers at most."""
    words = F.explode_outer(T.words(F.lower(F.coalesce(F.col(text), F.lit("")))))
    place = (F.conv(F.substring(F.md5(F.col("_w").cast("binary")), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")
    counts = reviews.select(*keys, words.alias("_w")).withColumn("_p", place)
    sums = counts.groupBy(*keys).agg(*[F.count_if(F.col("_p") == d).cast("double").alias(f"_{d}") for d in range(dimensions)])
    return sums.select(*keys, F.array(*[F.col(f"_{d}") for d in range(dimensions)]).alias(out))


class LexiconStars:
    """A star model that works offline: 3 stars, more or fewer by the words for and against, surer the more there are."""

    def __init__(self, profile: S.Profile = S.LENIENT):
        self.p = profile

    def stars(self, texts: list[str]) -> list[tuple[int, float]]:
        out = []
        for t in texts:
            low = t.lower()
            lead = sum(k in low for k in self.p.positive) - sum(k in low for k in self.p.negative)
            out.append((max(1, min(5, 3 + lead)), min(0.95, 0.5 + 0.1 * abs(lead))))
        return out


def star_sentiment(
    reviews: DataFrame, make_model: Callable[[], StarModel], profile: S.Profile = S.LENIENT, text: str = "text", rating: str = "rating",
    attempt: str = "attempt",
) -> DataFrame:
    """reviews (of keyword scores) with predicted_stars, star_confidence, and the alignment and mismatch that follow from
    them. Where the model fails, both are null and the keyword scores stand."""
    scored = S.with_scores(reviews, profile, text, rating, attempt)
    kept = [f for f in scored.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                model = model or make_model()
                texts = [t or "" for t in part.column(text).to_pylist()]
                try:
                    made = model.stars(texts)
                except Exception:  # one by one, so that a text that fails fails alone
                    made = []
                    for t in texts:
                        try:
                            made += model.stars([t])
                        except Exception:
                            made.append((None, None))
                stars, sure = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), part.column(text), pa.array(stars, pa.int32()), pa.array(sure, pa.float64())],
                    names=[*(f.name for f in kept), text, "predicted_stars", "star_confidence"],
                )

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    rows = scored.mapInArrow(run, f"{ddl}`{text}` string, predicted_stars int, star_confidence double")
    known = F.col("predicted_stars").isNotNull()
    aligned = S.star_alignment(F.col("predicted_stars"), F.col(rating), F.col("star_confidence"), profile)
    wrong = S.star_mismatch(F.col("predicted_stars"), F.col(rating), F.col("star_confidence"), F.col("sentiment_threshold"), profile)
    return rows.withColumns(
        {
            "alignment_score": F.when(known, aligned).otherwise(F.col("alignment_score")),
            "is_mismatch": F.when(known, wrong).otherwise(F.col("is_mismatch")), "method": F.when(known, "stars").otherwise("keywords"),
        }
    )
