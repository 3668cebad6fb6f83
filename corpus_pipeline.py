"""A corpus pipeline of five stages, each of which calls one operator on all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of docs, whatever their
names. Each row stays or goes by its own columns: texts that share a doc_id are texts of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm import bpe, decontam, langid, secret_scan, simhash
from glossmill.llm.common import read, removed, shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: without a letter, or far from every language."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id."""
    return simhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts that hold any, and n_chars follows the text."""
    return secret_scan.redacted(docs, secret_scan.scanned(docs.select("doc_id", "text")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether they decode to its bytes."""
    return bpe.encoded(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_bpe),
]

#: A classifier and the merges of a tokeniser aren't SQL's to express; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again; what was read goes then."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
