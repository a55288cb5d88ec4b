"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into two segments.  Two fingerprints that differ in four
(or five) bits at most differ in two bits at most in one of them, so the Hamming
balls of radius one around both values of that segment meet.  Every fingerprint
is entered in each segment's table under all values of its ball; what meets in
an entry is a candidate, and complete distances decide.  Entries of 32 bits
keep chance candidates few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import components, forest, in_batches, keep_one, runs, stash, tiled
from .segments import SLICE_BYTES

#: Bits of the segments, lowest first.
SEGMENTS = (32, 32)
#: Rows of a tile of one table entry.
TILE = 1024
SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash: a bit is one if it is in over half of the shingles' XXH64 values, repeats included; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - ends[0] if len(found) == 1 else np.concatenate(([0], ends[:-1])))
    if len(found) < words:
        return xxhash.xxh64_intdigest(whole, SEED)
    digest = xxhash.xxh64_intdigest
    values = np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64, len(found) - words + 1)
    ones = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """All columns of documents but text, and fp (the fingerprint's 64 bits as a long); null and empty texts: 0. Rows that repeat stay; an empty table gives none."""
    rest = [c for c in docs.columns if c != "text"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        values = np.array([fingerprint(t or b"", words) for t in texts], np.uint64)
        return pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(values.view(np.int64))], names=[*rest, "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, SLICE_BYTES)

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in rest), StructField("fp", LongType())]))


def _entries(classes: DataFrame) -> DataFrame:
    """Rows (seg, value, fp, node): each class under every value of the ball of radius one around each of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1 << 15):
                part = batch.slice(at, 1 << 15)
                fp, low = part.column("fp").to_numpy().view(np.uint64), 0
                for seg, bits in enumerate(SEGMENTS):
                    value = ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    low += bits
                    for flip in (0, *(1 << bit for bit in range(bits))):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), seg, np.int32)), pa.array(value ^ flip), part.column("fp"), part.column("node")], names=["seg", "value", "fp", "node"])

    return classes.select("fp", "node").mapInArrow(run, "seg int, value long, fp long, node long")


def _spanning(keys: list[np.ndarray], fp: np.ndarray, node: np.ndarray, radius: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links between rows of one key (rows stand sorted by keys): each row meets the next, the one after and so on.

    apart: only rows whose values of it differ meet.
    """
    new = np.zeros(len(fp), bool)
    new[:1] = True
    for c in keys:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(fp)))
    left = np.repeat(first + size, size) - np.arange(len(fp)) - 1  # rows of the group behind each
    rows, a, b, found, step = np.flatnonzero(left), [node[:0]], [node[:0]], 0, 1
    while len(rows):
        near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius
        if apart is not None:
            near &= apart[rows] != apart[rows + step]
        hit = rows[near]
        a.append(node[hit])
        b.append(node[hit + step])
        found += len(hit)
        if found > 2_000_000:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, found = [x], [y], len(x)
        step += 1
        rows = rows[left[rows] >= step]
    return forest(np.concatenate(a), np.concatenate(b)) if found else (node[:0], node[:0])


def _links(entries: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that span the links found within each table entry.

    One shuffle brings an entry's rows together.  As a class has one row at most
    in an entry and some in 65 others, an entry can't hold over a sixty-sixth of
    all rows; those of more rows than a tile are passed on, as they stream by,
    to be dealt in tiles.
    """
    keys = ["seg", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, seg, value, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(seg), pa.array(value), pa.array(a), pa.array(b)], names=["kind", "seg", "value", "a", "b"])

        large = None  # the entry whose rows are being passed on
        for table in runs(batches, keys, most=max(1 << 18, tile + 1)):
            seg, value, fp, node = (table[c].to_numpy() for c in ("seg", "value", "fp", "node"))
            new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (value[1:] != value[:-1]))))
            size = np.diff(np.append(new, len(seg)))
            size[0] += tile * ((seg[0], value[0]) == large)
            whole = np.repeat(size <= tile, np.diff(np.append(new, len(seg))))
            large = None if whole[-1] else (seg[-1], value[-1])
            a, b = _spanning([seg[whole], value[whole]], fp[whole].view(np.uint64), node[whole], radius)
            yield out(0, np.zeros(len(a), np.int32), np.zeros(len(a), np.int64), a, b)
            if not whole.all():
                yield out(1, seg[~whole], value[~whole], fp[~whole], node[~whole])

    sorted_ = entries.repartition(*keys).sortWithinPartitions(*keys)
    found = stash(sorted_.mapInArrow(run, "kind int, seg int, value long, a long, b long"), "entries")
    edges, large = found.filter("kind = 0").select("a", "b"), found.filter("kind = 1")
    if large.isEmpty():
        return edges
    return edges.unionByName(_in_tiles(large.select("seg", "value", F.col("a").alias("fp"), F.col("b").alias("node")), radius, tile))


def _in_tiles(entries: DataFrame, radius: int, tile: int) -> DataFrame:
    """The same for entries of many rows: every pair of tiles is a group of its own."""
    keys = ["seg", "value", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            cols = [table[k].to_numpy() for k in keys]
            fp, node, own = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy(), table["tile"].to_numpy()
            for cross in (False, True):  # in the pair of two tiles only rows of different tiles meet
                some = (cols[2] != cols[3]) == cross
                a, b = _spanning([c[some] for c in cols], fp[some], node[some], radius, own[some] if cross else None)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = tiled(entries, ["seg", "value"], F.col("fp"), tile)
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id reachable by links of at most radius bits).

    radius is 5 at most (two bits in one of two segments).  Documents without
    words have fingerprint zero and link like any other.  Documents of one
    fingerprint are one class, whatever their number.  A null doc_id takes part
    in nothing and is its own null component; rows that repeat a doc_id stay.
    """
    if radius > 3 * len(SEGMENTS) - 1:
        raise ValueError("the segments don't bound so large a radius")
    marked = stash(fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    named = _components(marked, radius)
    joined = marked.join(named, marked["fp"] == named["_fp"], "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """_fp and _component of each fingerprint that has a doc_id."""
    classes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"), "classes")
    found = components(_links(_entries(classes), radius))
    # Few classes have links: most keep their own smallest doc_id.
    named = classes.join(found, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("_component"))
    return stash(named, "named")


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group, the smallest doc_id, with all its columns.

    Rows are decided by id and text: of several rows of that id in a group the
    one of the smallest fingerprint stays, once; an id that stands on several
    texts loses only those that are copies.  A row with a null doc_id goes where
    a row with an id has its fingerprint; else one row of each such text stays.
    """
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    marked = stash(fingerprints(docs.select("doc_id", key.alias("key"), "text"), words), "fingerprints")
    named = _components(marked, radius)
    joined = marked.join(named, marked["fp"] == named["_fp"], "left")
    own = joined.filter(F.col("doc_id") == F.col("_component"))
    # Ids are seldom repeated: few groups have several texts of their smallest id.
    many = own.groupBy(F.col("doc_id").alias("_first")).agg(F.min(F.struct("fp", "key")).alias("_least"), F.max(F.struct("fp", "key")).alias("_most")).filter("_least <> _most")
    decided = joined.join(stash(many.select("_first", "_least"), "many"), F.col("doc_id") == F.col("_first"), "left")
    same = F.coalesce(F.struct("fp", "key") == F.col("_least"), F.lit(True))
    kept = F.when(F.col("doc_id").isNull(), F.col("_component").isNull()).otherwise((F.col("doc_id") == F.col("_component")) & same)
    return keep_one(docs, key, decided.select(F.col("doc_id").alias("id"), "key", kept.alias("kept")))
