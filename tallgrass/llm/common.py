"""Shared parts: scratch tables in the cluster's shared folder, tiles of hot groups, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path

#: Folders of tables that this process has written, by the session's application.
_WRITTEN: dict[str, list[str]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    path = shared_path(spark, name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it again, so that a lost executor costs no more than the step at hand.

    The tables stay for as long as results may be read from them; see clear_scratch.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark(spark: SparkSession) -> int:
    """A mark for clear_scratch: what is written from now on."""
    return len(_WRITTEN.setdefault(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, since: int = 0, but: str | None = None) -> int:
    """Removes the intermediate tables that this process has written since a mark, but for those in a folder, and says how many.

    Results that rest on them and aren't written elsewhere are lost.
    """
    held = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    gone = [p for p in held[since:] if not but or not p.startswith(but)]
    held[since:] = [p for p in held[since:] if p not in gone]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 200_000, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole key groups of at least `least` rows (but the last) from batches that are sorted by integer keys.

    most: a group of at least so many rows comes in parts, each a table of its own.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        cut = 0
        marks = np.zeros(rows - 1, bool)
        for k in keys:
            v = table[k].to_numpy()
            marks |= v[1:] != v[:-1]
        at = np.flatnonzero(marks)
        if len(at):
            cut = int(at[-1]) + 1
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows -= cut
        if most and rows >= most:
            yield table.slice(cut)
            held, rows = [], 0
    if held and rows:
        yield pa.Table.from_batches(held)


def tiled(df: DataFrame, keys: list[str], member: Column, size: int, only: Column | None = None) -> DataFrame:
    """Deals each key group into tiles of about `size` rows and repeats a row for every pair of tiles that holds its own.

    Adds tile, lo and hi: rows of one (keys, lo, hi) are at most about twice
    `size`, whatever a group holds, and two rows of a group meet where lo and hi
    are their tiles.  Groups of one row, and those failing `only` (a condition
    on sums over the group), go.  member decides the tile.
    """
    spark = df.sparkSession
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *([only.alias("_only")] if only is not None else []))
    counts = counts.filter("_n > 1 AND _only" if only is not None else "_n > 1").select(*keys, "_n")
    counts = stash(counts, "counts")
    dealt = df.join(counts, keys).withColumn("_t", F.ceil(F.col("_n") / F.lit(size)).cast("int"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(member, F.lit("tile")), F.col("_t")).cast("int"))
    pairs = dealt.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    return pairs.withColumns({"lo": F.least("tile", "_u"), "hi": F.greatest("tile", "_u")}).drop("_n", "_t", "_u")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that span what the links a[i] - b[i] connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = np.minimum(new, new[label])
        while (deeper := new[new]).tolist() != new.tolist():
            new = deeper
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of long ids: rows (node, component), the smallest id reachable; nodes without links are absent.

    Alternates large-star and small-star steps.  Each step takes minima by
    pre-aggregated sums and joins them back, so a node with very many links is
    split by the skew join and never gathered; every step is a written table.
    Null ids and self links are ignored.
    """
    spark = edges.sparkSession
    up = lambda a, b: F.when(F.col(a) > F.col(b), F.struct(F.col(a).alias("u"), F.col(b).alias("v"))).otherwise(F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    now = stash(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(up("a", "b").alias("e")).select("e.u", "e.v").distinct(), "edges")
    while True:
        counts = now.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("nodes")).first()
        # Done when only stars are left: every node has one link, to a node that has none of its own.
        if counts.n == counts.nodes and now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stash(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def keep_one(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of documents that a table of decisions keeps, with all their columns.

    decided: id, key and kept for each row of docs, in any order.  All rows of
    one doc_id and key (a digest of the text) have one fate; of those that are
    kept one row stays.  A null doc_id is an id like any other.
    """
    own = "_key_of_tallgrass"  # stands beside columns of any names
    keys = decided.groupBy("id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    keys = stash(keys.filter("NOT kept OR rows > 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "kept"), "decided")
    marked = docs.withColumn(own, key)

    def without(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return df.join(some, df["doc_id"].eqNullSafe(some["_id"]) & (df[own] == some["_key"]), how)

    left = without(marked, keys.filter("NOT kept").drop("kept"), "left_anti")
    twice = keys.filter("kept").drop("kept")
    if twice.isEmpty():
        return left.drop(own)
    once = without(left, twice, "left_semi").dropDuplicates(["doc_id", own])
    return without(left, twice, "left_anti").unionByName(once).drop(own)


def in_batches(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Applies work to runs of rows of about `most` bytes of a column."""
    from .segments import byte_slices

    for batch in batches:
        at = 0
        for piece in byte_slices(batch.column(column), most):
            yield work(batch.slice(at, len(piece)))
            at += len(piece)
