"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scans, best-fit packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import exact, packing, secrets, simhash, toxicity
from tallgrass.llm.common import clear_scratch, scratch_mark, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the cut."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of equal texts."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked fingerprints."""
    return simhash.near_dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in a text replaced by a mark."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the learned scores nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again as the next one's input.

    Null texts count as empty, rows that repeat are copies of each other, an
    empty table gives no pieces, and columns beside doc_id and text are carried
    up to the last stage; see the stages' operators.  What a stage has written
    on its way is removed when its result stands.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, mark = scratch_path(spark, "pipeline"), scratch_mark(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear_scratch(spark, mark)
    return docs
