"""Alignment of two tokenizers' tokens by shared bytes, and how often their tokens meet in a corpus.

Texts are encoded in runs.  A run's pair-document records (B id, A id,
document, links) are dealt by the low bits of the B id, sorted, and kept as
zstd frames.  The runs of a part are merged by a heap of frames, in order of B
ids, so that a B id's highest count is known when its last pair has passed.
Many runs are merged in rounds of bounded width.  A last pass over each run's
records adds every document's contributions up, part by part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stash
from .segments import ragged_take, shared_encoder

#: Parts by the low bits of B ids; bytes of text in a run; records in a frame; runs that one task merges.
PARTS, RUN_BYTES, FRAME, WIDTH = 32, 4 << 20, 1 << 14, 256
#: Bits of an A id in a pair's key.
A_BITS = 24


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id: byte-level names decoded for a .json file, pieces in UTF-8 for a .model."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        return [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # A byte that prints stands for itself; the others are numbered on from 256.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    value = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
    return out


class Side:
    """Ids and bytes of one tokenizer's tokens."""

    def __init__(self, path: str):
        tokens = byte_tokens(path)
        self.encoder = shared_encoder(path, plain=True)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        return ragged_take(self.data, self.start[ids], self.size[ids])


_SIDES: dict[str, Side] = {}


def side(path: str) -> Side:
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.concatenate(([0], np.cumsum(counts)))
    return total[ends[1:]] - total[ends[:-1]]


class _Decimals:
    """Ids from 0 on in decimal, each with room for a mark (a byte) behind it."""

    def __init__(self, n: int):
        ids = np.arange(n)
        width = len(str(n - 1))
        digits = np.column_stack([ids // 10**p % 10 for p in range(width - 1, -1, -1)] + [np.zeros(n, int)])
        self.cells = (digits + 48).astype(np.uint8)
        self.size = 1 + np.fromiter(map(len, map(str, range(n))), np.int64, n)
        self.shown = np.arange(width + 1) > width - self.size[:, None]

    def joined(self, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        cells = self.cells[ids]
        cells[:, -1] = marks
        return cells[self.shown[ids]]


_DECIMALS: dict[int, _Decimals] = {}


def _decimals(n: int) -> _Decimals:
    if n not in _DECIMALS:
        _DECIMALS[n] = _Decimals(n)
    return _DECIMALS[n]


class Aligned:
    """The tokens of a run of texts by two tokenizers, their groups and links.

    rows: places of the texts that have tokens.  Texts that are null or empty,
    or whose tokens don't spell a space and the text, have none.
    """

    def __init__(self, texts: pa.Array, a: Side, b: Side):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        found = [s.encoder.batch(spaced) for s in (a, b)]
        want = np.frombuffer(spaced.buffers()[2] or b"", np.uint8) if len(spaced) else np.empty(0, np.uint8)
        edges = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].astype(np.int64) if len(spaced) else np.zeros(1, np.int64)
        size = np.diff(edges)
        sound = size > 1
        for s, (ids, n) in zip((a, b), found):
            sound &= _sums(s.size[ids], n) == size
        # Bytes are compared where the lengths agree.
        for s, (ids, n) in zip((a, b), found):
            ids, n = ids[np.repeat(sound, n)], n[sound]
            same = s.spelt(ids) == ragged_take(want, edges[:-1][sound], size[sound])
            sound[np.flatnonzero(sound)[_sums(same, size[sound]) != size[sound]]] = False
        self.n_texts, self.rows, self.size = len(texts), np.flatnonzero(sound), size[sound]
        self.vocabulary = max(len(a.size), len(b.size))
        self.a, self.b = (ids[np.repeat(sound, n)].astype(np.int32) for ids, n in found)
        self.n_a, self.n_b = (n[sound] for _, n in found)
        # Marks of bytes with which a token ends, over all texts one after another; both sides end with each text.
        total = int(self.size.sum())
        ends_a, ends_b = np.zeros(total, bool), np.zeros(total, bool)
        ends_a[np.cumsum(a.size[self.a]) - 1] = True
        ends_b[np.cumsum(b.size[self.b]) - 1] = True
        # Each stretch between neighbouring ends is the overlap of one A and one B token.
        stretches = np.flatnonzero(ends_a | ends_b)
        self.in_a, self.in_b = ends_a[stretches], ends_b[stretches]
        before = lambda marks: np.cumsum(marks, dtype=np.int32) - marks
        self.at_a, self.at_b, cut = before(self.in_a), before(self.in_b), self.in_a & self.in_b
        self.group = before(cut)
        self.link_a, self.link_b = self.a[self.at_a], self.b[self.at_b]
        upto = np.concatenate(([0], np.searchsorted(stretches, np.cumsum(self.size))))
        self.n_links = np.diff(upto)
        self.n_groups = np.diff(np.concatenate(([0], np.cumsum(cut)))[upto])
        self.link_text = np.repeat(np.arange(len(self.rows), dtype=np.int32), self.n_links)

    def digests(self) -> list[str]:
        """For each of rows the SHA-256 of its groups, a1,a2|b1;a3|b2,b3."""
        # A token stands behind its own side's tokens before it and the other side's of all groups before (A) or up to its own (B).
        group_a, group_b = self.group[self.in_a], self.group[self.in_b]
        closes = self.in_a & self.in_b
        b_before = np.concatenate(([0], self.at_b[closes] + 1))
        a_upto = self.at_a[closes] + 1
        n = len(self.a) + len(self.b)
        ids, marks = np.empty(n, np.int32), np.full(n, ord(","), np.uint8)
        to_a = np.arange(len(self.a)) + b_before[group_a]
        to_b = np.arange(len(self.b)) + a_upto[group_b]
        ids[to_a], ids[to_b] = self.a, self.b
        marks[to_a[a_upto - 1]] = ord("|")
        marks[to_b[b_before[1:] - 1]] = ord(";")
        table = _decimals(self.vocabulary)
        data = table.joined(ids, marks)
        ends = np.cumsum(_sums(table.size[ids], self.n_a + self.n_b))
        view = memoryview(np.ascontiguousarray(data))
        starts = np.concatenate(([0], ends[:-1])).tolist() if len(ends) else []
        return [hashlib.sha256(view[i : j - 1]).hexdigest() for i, j in zip(starts, ends.tolist())]  # the last mark goes


def packed(*columns: np.ndarray) -> bytes:
    """A frame of integer columns of one length; the first is ascending and kept as differences."""
    n = len(columns[0])
    first = np.diff(columns[0], prepend=0)
    out = [np.array([n], np.int64).tobytes()]
    for c in (first, *columns[1:]):
        kind = np.uint8 if (top := int(c.max(initial=0))) < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64
        out += [np.array([np.dtype(kind).itemsize], np.int64).tobytes(), c.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(frame: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    while at < len(data):
        width = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width], n, at + 8).astype(np.int64))
        at += 8 + n * width
    out[0] = np.cumsum(out[0])
    return out


def frames(*columns: np.ndarray) -> list[bytes]:
    return [packed(*(c[i : i + FRAME] for c in columns)) for i in range(0, len(columns[0]), FRAME)]


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys in order, each once, and their sums, from runs of frames (keys, counts) that are sorted by key.

    A heap holds one open frame of each run by its last key: what is up to the
    least of these can't change any more.
    """
    opened = lambda k, it: None if (f := next(it, None)) is None else (c := unpacked(f)) and (int(c[0][-1]), k, c[0], c[1], it)
    heap = [x for k, run in enumerate(runs) if (x := opened(k, iter(run)))]
    heapq.heapify(heap)
    while heap:
        top = heap[0][0]
        parts, later = [], []
        while heap:
            # Frames that begin behind the mark still hold the runs' places in the heap.
            last, k, keys, counts, it = heapq.heappop(heap)
            cut = int(np.searchsorted(keys, top, side="right"))
            if cut:
                parts.append((keys[:cut], counts[:cut]))
            if cut < len(keys):
                later.append((last, k, keys[cut:], counts[cut:], it))
            elif x := opened(k, it):
                later.append(x)
        heap = later
        heapq.heapify(heap)
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        yield keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def with_best(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds whether a pair's count is the highest of its B id; a B id's pairs come one after another, in one or several parts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def closed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = keys >> A_BITS
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        most = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(b))))
        return keys, counts, counts == most

    for part in parts:
        held.append(part)
        keys, counts = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(keys, keys[-1] >> A_BITS << A_BITS))  # the last B id may go on
        if cut:
            yield closed(keys[:cut], counts[:cut])
        held = [(keys[cut:], counts[cut:])]
    if held:
        yield closed(*held[0])


RUN = "run long, part int, pairs array<binary>, records array<binary>, place int, id long, n_a long, n_b long, n_groups long, n_links long, sha string"


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}


def _columns(n: int, **given) -> pa.RecordBatch:
    """A batch of RUN's columns; those not given are null."""
    fields = [c.split() for c in RUN.split(", ")]
    whole = lambda v, kind: v.cast(kind) if isinstance(v, pa.Array) else pa.array(v, kind)
    return pa.RecordBatch.from_arrays([whole(given[c], KINDS[k]) if c in given else pa.nulls(n, KINDS[k]) for c, k in fields], names=[c for c, _ in fields])


def _records(x: Aligned, size_a: int, size_b: int) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """part, frames (pair, links) and frames (pair, document, links), each sorted."""
    bits_a, bits_b, bits_text = ((n - 1).bit_length() for n in (size_a, size_b, x.n_texts + 1))
    low = (PARTS - 1).bit_length()
    if bits_a + max(bits_b, low) + bits_text > 63:
        raise ValueError("vocabularies of over 40 bits together")
    # Part first, then the rest of the B id, the A id and the document, in one number.
    link_b = x.link_b.astype(np.int64)
    turned = (link_b % PARTS) << max(bits_b - low, 0) | link_b >> low
    codes = (turned << bits_a | x.link_a) << bits_text | x.rows[x.link_text]
    codes.sort()
    at = np.flatnonzero(np.concatenate((np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1])))
    codes, links = codes[at], np.diff(np.append(at, len(codes)))
    text, a, turned = codes & ((1 << bits_text) - 1), codes >> bits_text & ((1 << bits_a) - 1), codes >> bits_text + bits_a
    part = turned >> max(bits_b - low, 0)
    pair = ((turned & ((1 << max(bits_b - low, 0)) - 1)) << low | part) << A_BITS | a
    edges = np.searchsorted(part, np.arange(PARTS + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        k, t, m = (c[edges[p] : edges[p + 1]] for c in (pair, text, links))
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        yield p, frames(k[first], np.add.reduceat(m, first)), frames(k, t, m)


def _runs(docs: DataFrame, path_a: str, path_b: str, run_bytes: int) -> DataFrame:
    """Two kinds of rows: a document's (place is not null), and a run's records of one part."""

    def work(batch: pa.RecordBatch, run: int) -> Iterator[pa.RecordBatch]:
        x = Aligned(batch.column("text"), side(path_a), side(path_b))
        n = x.n_texts
        wide = lambda v: pa.array(np.bincount(x.rows, v, n).astype(np.int64))
        shas = np.full(n, "", object)
        shas[x.rows] = x.digests()
        yield _columns(n, run=np.full(n, run), place=np.arange(n), id=batch.column("id"), n_a=wide(x.n_a), n_b=wide(x.n_b), n_groups=wide(x.n_groups), n_links=wide(x.n_links), sha=shas)
        rows = list(_records(x, len(side(path_a).size), len(side(path_b).size)))
        if rows:
            part, pairs, records = zip(*rows)
            yield _columns(len(rows), run=np.full(len(rows), run), part=part, pairs=pairs, records=records)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 32  # the table is written once, so a number stays with its run
        for piece in in_batches(_gathered(batches, run_bytes), lambda b: b, run_bytes):
            yield from work(piece, run)
            run += 1

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, RUN)


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many bytes (but the last)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _merge_round(runs: DataFrame, groups: int) -> DataFrame:
    """Merges runs (run, part, pairs) to one for each part and group of runs."""

    def merge(table: pa.Table) -> pa.Table:
        out = [f for keys, counts in merged(table["pairs"].to_pylist()) for f in frames(keys, counts)]
        return pa.table({"run": table["group"][:1], "part": table["part"][:1], "pairs": pa.array([out], pa.list_(pa.binary()))})

    return runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups))).groupBy("part", "group").applyInArrow(merge, "run long, part int, pairs array<binary>")


def pair_counts(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """part, pairs: frames (pair, count, whether it is the highest of its B id) of all runs (run, part, pairs), merged `width` at a time."""
    n = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    while n > width:
        # Hashes deal runs unevenly; twice as many groups keep tasks near the width.
        groups = -(-2 * n // width)
        runs = stash(_merge_round(runs, groups), "merged")
        n = groups

    def close(table: pa.Table) -> pa.Table:
        out = [f for columns in with_best(merged(table["pairs"].to_pylist())) for f in frames(*columns)]
        return pa.table({"part": table["part"][:1], "counts": pa.array([out], pa.list_(pa.binary()))})

    return stash(runs.groupBy("part").applyInArrow(close, "part int, counts array<binary>"), "counts")


def _contributions(runs: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """run, place, best, total of each document and part, from each run's records and the counts of its part."""
    n = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-2 * n // width))
    left = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int")).select("part", "group", "run", "records")
    right = counts.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("part", "group", "counts")

    def add(_: tuple, records: pa.Table, known: pa.Table) -> pa.Table:
        keys, total, best = (np.concatenate(c) for c in zip(*(unpacked(f) for f in known["counts"][0].as_py())))
        out = []
        for run, blobs in zip(records["run"].to_pylist(), records["records"]):
            pair, text, links = (np.concatenate(c) for c in zip(*(unpacked(f.as_py()) for f in blobs)))
            at = np.searchsorted(keys, pair)
            # Sums of integers in integers: a pair's count may pass what doubles hold.
            order = np.argsort(text, kind="stable")
            text, at, links = text[order], at[order], links[order]
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            out.append((run, text[first], np.add.reduceat(links * best[at], first), np.add.reduceat(links * total[at], first)))
        runs_ = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
        cells = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in (1, 2, 3)]
        return pa.table({"run": runs_, "place": cells[0].astype(np.int32), "best": cells[1], "total": cells[2]})

    return left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInArrow(add, "run long, place int, best long, total long")


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, run_bytes: int = RUN_BYTES, width: int = WIDTH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of (doc_id, text).

    path_a: a byte-level .json file; path_b: a sentencepiece .model that puts a
    space before texts.  Groups end where tokens of both end; links join
    tokens that share bytes.  A pair's count is the number of links of its two
    ids in all rows; n_best sums links whose count is the highest of their B
    id, count_sum sums the counts of links.  Null and empty texts, and texts
    that the tokens don't spell, have zeros and an empty digest.  Repeated rows
    and ids stay, and count each; null ids stay null; an empty table gives
    none; other columns are ignored.
    """
    table = stash(_runs(docs, path_a, path_b, run_bytes), "runs")
    runs = table.filter("part IS NOT NULL")
    counts = pair_counts(runs.select("run", "part", "pairs"), width)
    sums = _contributions(runs, counts, width).groupBy("run", "place").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    rows = table.filter("place IS NOT NULL").drop("part", "pairs", "records")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(sums, ["run", "place"], "left").select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero("best").alias("n_best"), zero("total").alias("count_sum"), F.col("sha").alias("groups_sha256"))


def pair_table(docs: DataFrame, path_a: str, path_b: str, run_bytes: int = RUN_BYTES, width: int = WIDTH) -> DataFrame:
    """b_id, a_id, count, best: every pair of ids that is linked somewhere; best marks the highest of a B id, ties included.

    Nulls, empties and repeats count as in aligned_tokens.
    """
    runs = stash(_runs(docs, path_a, path_b, run_bytes), "runs").filter("part IS NOT NULL")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs in batch.column("counts"):
                for f in blobs:
                    pair, n, best = unpacked(f.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(pair >> A_BITS), pa.array(pair & ((1 << A_BITS) - 1)), pa.array(n), pa.array(best.astype(bool))], names=["b_id", "a_id", "count", "best"])

    return pair_counts(runs.select("run", "part", "pairs"), width).select("counts").mapInArrow(rows, "b_id long, a_id long, count long, best boolean")
