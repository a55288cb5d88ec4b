"""Token counts behind a digest cache.

The cache is a table (digest, tokenizer, n_tokens): digests of the content and
of the tokenizer's file.  Documents are joined to it by digest; only distinct
missing texts are encoded, and what they give is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exists, in_batches, scratch_path, stash
from .segments import SLICE_BYTES, shared_encoder

CACHE = "digest binary, tokenizer string, n_tokens long"


def content(text: Column) -> Column:
    """The content that is counted: null is empty; nothing else may change, as every byte can change the tokens."""
    return F.coalesce(text, F.lit(""))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _piece_counts(path: str, texts: pa.Array) -> np.ndarray:
    import sentencepiece

    model = _MODELS.setdefault(path, sentencepiece.SentencePieceProcessor(model_file=path))
    return np.array([len(model.encode(t or "", num_threads=1)) for t in texts.to_pylist()], np.int64)


_MODELS: dict[str, object] = {}


def count_tokens(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text: by the tokenizers library for .json (by segments if it is byte-level), by sentencepiece for .model."""
    if path.endswith(".model"):
        return _piece_counts(path, texts)
    if _byte_level(path):
        return shared_encoder(path).batch(texts)[1]
    from tokenizers import Tokenizer

    tokenizer = _MODELS.setdefault(path, Tokenizer.from_file(path))
    return np.array([len(e.ids) for e in tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)], np.int64)


_LEVELS: dict[str, bool] = {}


def _byte_level(path: str) -> bool:
    if path not in _LEVELS:
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        _LEVELS[path] = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and len(spec.get("added_tokens") or []) <= 1
    return _LEVELS[path]


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    cache: folder of the cache table, made if missing and kept for later calls;
    None: one for this call alone.  Null and empty texts have 0 tokens; repeated
    rows and ids stay; an empty table gives none; other columns are ignored.
    A digest that stands in the cache twice counts once.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    cache = cache or scratch_path(spark, "counts")
    if not exists(spark, cache):
        spark.createDataFrame([], CACHE).write.parquet(cache)
    # Whoever appends a digest twice does no harm.
    known = lambda: spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    text = docs.select("doc_id", content(F.col("text")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count_tokens(tokenizer, batch.column("text")))], names=["digest", "n_tokens"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, SLICE_BYTES)

    # Digests meet the cache first, so that texts which have a count aren't moved.  Of each digest that is missing one
    # id is chosen before any text is: copies of a hot text differ by id, and so go to different tasks.
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    missing = text.groupBy("digest").agg(F.min(own).alias("own")).join(known(), "digest", "left_anti")
    missing = stash(missing.select("digest", "own"), "missing")
    texts = text.select("digest", own.alias("own"), "text").join(missing, ["digest", "own"], "left_semi").dropDuplicates(["digest", "own"])
    counted = texts.mapInArrow(encode, "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    rows = text.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return rows.join(known(), "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
