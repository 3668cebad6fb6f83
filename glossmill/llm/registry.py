"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import binary_out, bpe, decontam, langid, negatives, quality, secret_scan, sharding, simhash, sql, token_edits, toxicity, url_filter, whitening
from glossmill.llm.common import read, shared_path, written
from glossmill.plans.staging import spread


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cleaned(spread(read(spark, sf_dir, "documents"))).drop("cleaned")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = token_edits.build_state(spread(read(spark, sf_dir, "documents")))
    kept = written(built, shared_path(spark, "token-trees"), compression="zstd")
    edited = token_edits.apply_listed(token_edits.sample_edits(spread(kept)))
    return edited.select(
        "doc_id", "n_edits", "n_before", "n_tokens", "n_pieces", "n_reencoded", F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(spread(read(spark, sf_dir, "documents")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digested(docs, secret_scan.scanned(docs))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(spread(read(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read(spark, sf_dir, "documents"), sharding.TREE, sharding.GROWN)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(spread(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_out.written_order(spread(read(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spread(read(spark, sf_dir, "embeddings")))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), url_filter.rules_of(spark))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(spread(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secret_scans": op5_secret_scans,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_training_order": op10_training_order,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_url_filters": op12_url_filters,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

SQL: dict[str, str] = sql.SQL
