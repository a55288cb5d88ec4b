"""Token-id files of directly addressable codes.

Ids are split into chunks of 8 bits.  Level 0 holds the lowest chunk of every
id; its continuation bitmap says which ids go on, and level 1 holds their next
chunk, and so on.  A rank directory over each bitmap finds an id's place on the
next level, so that any id is read without decoding those before it.

A file: 8 bytes of magic, a little-endian header of 64-bit numbers (documents,
ids, levels, bytes of each level), document ids, a byte for each that is null,
ids before each document, then for each level its chunks, bitmap and directory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stash
from .segments import byte_slices, shared_encoder

MAGIC = b"TGDAC\x00\x01\x00"
#: Bits of a bitmap that one entry of its rank directory covers.
BLOCK = 512
#: Ids after which a file is closed.
FILE_IDS = 4_000_000
#: Ids that are read back at a time.
RUN_IDS = 500_000

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap, directory); the last level's bitmap is all zero."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & 0xFF).astype(np.uint8)
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.append(bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8))
        ones = _ONES[bitmap].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        levels.append((chunks, bitmap, (np.cumsum(ones) - ones).astype(np.uint32)))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


class Codes:
    """Random access to packed ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place, by the directory and the bytes of one block."""
        _, bitmap, directory = self.levels[level]
        if not len(directory):
            return np.zeros(len(at), np.int64)
        block = np.minimum(at // BLOCK, len(directory) - 1)
        out = directory[block].astype(np.int64)
        byte = at >> 3
        for k in range(BLOCK // 8):
            b = block * (BLOCK // 8) + k
            out += np.where(b < byte, _ONES[bitmap[b]], 0)
        inside = byte < len(bitmap)
        part = np.where(inside, bitmap[np.minimum(byte, len(bitmap) - 1)], 0)
        return out + _ONES[part & ((1 << (at & 7)) - 1).astype(np.uint8)]

    def _rank_one(self, level: int, at: int) -> int:
        _, bitmap, directory = self.levels[level]
        if not len(directory):
            return 0
        block, byte = min(at // BLOCK, len(directory) - 1), at >> 3
        inside = int(_ONES[bitmap[block * (BLOCK // 8) : byte]].sum())
        part = int(bitmap[byte]) & ((1 << (at & 7)) - 1) if byte < len(bitmap) else 0
        return int(directory[block]) + inside + part.bit_count()

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        at = np.asarray(at, np.int64)
        out, own, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[own] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            more = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            own, at, shift = own[more], self._rank(level, at[more]), shift + 8
            if not len(own):
                break
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop: one rank for each level, then straight on."""
        out, own, shift = np.zeros(stop - start, np.uint32), None, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if own is None:
                out |= part
            else:
                out[own] |= part
            bits = np.unpackbits(bitmap[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            count = int(bits.sum())
            if not count:
                break
            own = np.flatnonzero(bits) if own is None else own[bits]
            start = self._rank_one(level, start)
            stop, shift = start + count, shift + 8
        return out


def to_bytes(doc_ids: np.ndarray, null: np.ndarray, before: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack(ids)
    sizes = [len(part) * part.itemsize for level in levels for part in level]
    header = np.array([len(doc_ids), len(ids), len(levels), *sizes], "<u8").tobytes()
    parts = [doc_ids.astype("<i8"), null.astype(np.uint8), before.astype("<u8"), *(p for level in levels for p in level)]
    return b"".join([MAGIC, header, *(np.ascontiguousarray(p).tobytes() for p in parts)])


class TokenFile:
    """A file's documents (doc_ids, null, before: ids before each) and its ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, self.total, levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        sizes = np.frombuffer(data, "<u8", 3 * levels, 32).astype(np.int64).tolist()
        at = 32 + 24 * levels
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.null = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
        self.before = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        parts = []
        for i, n in enumerate(sizes):
            kind = "<u4" if i % 3 == 2 else np.uint8
            parts.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
            at += n
        self.codes = Codes([tuple(parts[i : i + 3]) for i in range(0, len(parts), 3)])

    def document(self, i: int) -> np.ndarray:
        stop = self.before[i + 1] if i + 1 < len(self.before) else self.total
        return self.codes.slice(int(self.before[i]), int(stop))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of documents (doc_id, text) in ascending doc_id order (nulls first) and returns the manifest.

    manifest: path, part and number (together the order of files), docs, ids.
    Each attempt of a task writes files of its own names; the manifest lists
    those of the attempt that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        part, own, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal number, held
            doc_ids = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            name = f"part-{part:06d}-{own}-{number:04d}.tok"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(to_bytes(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_null().to_numpy(zero_copy_only=False), np.cumsum(counts) - counts, ids))
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["path", "part", "number", "docs", "ids"])
            number, held = number + 1, []
            return row

        for batch in batches:
            at = 0
            for texts in byte_slices(batch.column("text")):
                ids, counts = shared_encoder(tokenizer).batch(texts)
                held.append((batch.column("doc_id").slice(at, len(texts)), counts + 1, np.insert(ids, np.cumsum(counts), end_id).astype(np.uint16 if int(ids.max(initial=0)) < 1 << 16 else np.uint32)))
                at += len(texts)
                if sum(len(h[2]) for h in held) >= file_ids:
                    yield close()
        if held:
            yield close()

    # A range of ids for each task; rows of one id, whose order is free, are told apart by their texts, so that they can be split.
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    return stash(ordered.mapInArrow(write, "path string, part int, number int, docs long, ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _open(row["path"])
                with store.open_input_stream(path) as f:
                    tokens = TokenFile(f.read())
                counts = np.diff(np.append(tokens.before, tokens.total))
                crc, run = [], 0
                while run < len(counts):  # documents of some hundred thousand ids at a time
                    stop = max(run + 1, int(np.searchsorted(tokens.before, tokens.before[run] + RUN_IDS)))
                    ends = np.append(tokens.before, tokens.total)[run : stop + 1].tolist()
                    raw = memoryview(tokens.codes.slice(ends[0], ends[-1]).astype("<u4").tobytes())
                    crc += [zlib.crc32(raw[4 * (a - ends[0]) : 4 * (b - ends[0])]) for a, b in zip(ends, ends[1:])]
                    run = stop
                yield pa.RecordBatch.from_arrays([pa.array(tokens.doc_ids.astype(np.int64), mask=tokens.null), pa.array(tokens.before + row["first"]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Ids before a file: those of the ranges before, a row each, and those of its range's files before.
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(Window.orderBy("part")).alias("ahead"))
    files = manifest.withColumn("within", before(Window.partitionBy("part").orderBy("number"))).join(ranges, "part")
    files = files.select("path", (F.col("ahead") + F.col("within")).alias("first"))
    tasks = min(20_000, max(1, manifest.count()))  # a file each, but for very many
    return files.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes all documents to token files and reads them back: see write_tokens and read_tokens.

    Null and empty texts hold the end id alone; rows that repeat a doc_id stand
    side by side in any order; an empty table gives none.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id))
