"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, dac, embeddings, exact, negatives, packing, repeats, secrets, simhash, token_counts, toxicity, warc
from .common import documents

JSON = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path(JSON))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_files(documents(spark, sf_dir), public_tokenizers.path(JSON))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(JSON))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_strings(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned_tokens(documents(spark, sf_dir), public_tokenizers.path(JSON), public_tokenizers.path(PIECES))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, id_ = F.col("label"), F.col("vec_id")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(vectors, id_ % 100 == 0)


OPERATORS = (
    op1_secret_scan, op2_exact_dedup, op3_toxicity, op4_best_fit_packing, op5_embedding_near_dedup, op6_token_files, op7_token_counts, op8_repeated_strings, op9_byte_bpe,
    op10_simhash, op11_warc, op12_cross_tokenizer_alignment, op13_hard_negatives,
)


def queries() -> dict:
    import corpus_pipeline  # stands beside the package, and comes and goes with this folder

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact.ORACLE, "op5_embedding_near_dedup": embeddings.ORACLE, "op11_warc": warc.ORACLE, "op13_hard_negatives": negatives.ORACLE}
