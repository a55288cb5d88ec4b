"""Byte-level BPE over numpy matrices.

Words of like length are rows of one padded matrix of token ids.  In each round
every row merges its leftmost pair of the smallest rank: pairs are looked up in
a hash table, the row's minimum is taken, and the row is compacted by one.
Rows without a pair in the vocabulary are done and leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches
from .segments import SLICE_BYTES, SegmentEncoder, ragged_take

#: Fixed value: white space as the reference encoder's \s has it; Python's own also takes U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
_NONE = np.int32(np.iinfo(np.int32).max)
#: Words of more bytes are merged by themselves: a round of a row costs its width, and it has as many rounds as merges.
LONG = 2048


class PairTable:
    """Hash table from pairs of ids to the id of their joined bytes, which is the rank of the merge."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):  # linear probing: one key wins each free slot, the rest moves on
            self.probes += 1
            free = self.keys[at] == np.iinfo(np.uint64).max
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE for pairs that don't merge and for padding (negative ids)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != np.iinfo(np.uint64).max))
        at = at[open_]
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (found != np.iinfo(np.uint64).max)
            open_, at = open_[go], at[go]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class MatrixBPE:
    """Encoder and decoder for a .tiktoken file of ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = PairTable(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")).findall

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat in their order, and their number for each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = self.single[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        flats, placed, lens = [], [], np.zeros(len(words), np.int64)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, len(words))
        done = np.flatnonzero(whole >= 0)  # a word that is a token stays whole
        flats.append(whole[done])
        placed.append(done)
        lens[done] = 1
        rest = np.flatnonzero(whole < 0)
        for i in rest[sizes[rest] > LONG].tolist():
            flats.append(self._long(raw[starts[i] : starts[i] + sizes[i]]))
            placed.append(np.array([i]))
            lens[i] = len(flats[-1])
        rest = rest[sizes[rest] <= LONG]
        width = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(1, sizes[rest]))).astype(np.int64))
        for w in np.unique(width):
            rows = rest[width == w]
            for i in range(0, len(rows), max(1, (1 << 21) // int(w))):
                part = rows[i : i + max(1, (1 << 21) // int(w))]
                flat, n = self._matrix(raw, starts[part], sizes[part], int(w))
                flats.append(flat)
                placed.append(part)
                lens[part] = n
        placed = np.concatenate(placed)
        at = np.empty(len(words), np.int64)
        at[placed] = np.cumsum(lens[placed]) - lens[placed]
        return ragged_take(np.concatenate(flats), at, lens), lens

    def _matrix(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        columns = np.arange(width)
        inside = columns < sizes[:, None]
        ids = np.where(inside, raw[np.minimum(starts[:, None] + columns, len(raw) - 1)], np.int32(-1))
        ranks = self.table.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        n, row = sizes.copy(), np.arange(len(ids))
        out = ids.copy()
        while len(row):
            at = ranks.argmin(axis=1)
            each = np.arange(len(row))
            best = ranks[each, at]
            go = best != _NONE
            if not go.all():
                out[row[~go]], row = ids[~go], row[go]
                ids, ranks, at, best = ids[go], ranks[go], at[go], best[go]
                each = np.arange(len(row))
            if not len(row):
                break
            ids[each, at] = best
            # Compaction: what stands behind the merged pair moves one to the left.
            take = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ids[:, -1] = -1
            shift = np.minimum(np.arange(width - 1) + (np.arange(width - 1) > at[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, shift, axis=1)
            ranks[:, -1] = _NONE
            n[row] -= 1
            # Only the pairs to both sides of the new token change.
            before = np.maximum(at - 1, 0)
            fresh = self.table.ranks(ids[each, before], ids[each, at])
            fresh = np.where(at > 0, fresh, ranks[each, before])
            after = np.minimum(at + 1, width - 1)
            right = np.where(at < width - 1, self.table.ranks(ids[each, at], ids[each, after]), _NONE)
            ranks[each, before] = np.where(at > 0, fresh, ranks[each, before])
            inner = at < width - 1
            ranks[each[inner], at[inner]] = right[inner]
        return out[columns < n[:, None]], n

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one long word: each round merges all pairs of the smallest rank, from the left.

        A round ends early behind a merge that makes a pair of a smaller rank,
        which is next then.  Pairs wait in lists by rank, so that a round costs
        no more than what it merges.
        """
        n = len(raw)
        ids, after, before = np.append(raw, np.int32(-1)), np.arange(1, n + 2), np.arange(-1, n)  # -1 at the end merges with nothing
        after[n] = n
        rank = np.append(self.table.ranks(ids[:-1], ids[1:]), _NONE)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(part)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(lists.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Of pairs that overlap in a row, every other one.
            row = np.append(True, after[at[:-1]] != at[1:])
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(row, np.arange(len(at)), 0))) % 2 == 0]
            behind = after[after[at]]
            left = np.where(np.append(False, behind[:-1] == at[1:]), r, ids[before[at]]).astype(np.int32)
            left[before[at] < 0] = -1
            token = np.full(len(at), r, np.int32)
            smaller = np.flatnonzero((self.table.ranks(token, ids[behind]) < r) | (self.table.ranks(left, token) < r))
            rest = at[:0]
            if len(smaller):
                rest, at = at[smaller[0] + 1 :], at[: smaller[0] + 1]
                behind = behind[: len(at)]
            rank[after[at]] = _NONE
            ids[at], after[at] = r, behind
            before[behind] = at
            fresh = np.unique(np.concatenate((at, before[at])))
            fresh = fresh[fresh >= 0]
            rank[fresh] = self.table.ranks(ids[fresh], ids[after[fresh]])
            wait(np.concatenate((fresh, rest)))
        out, i = [], 0
        while i < n:
            out.append(i)
            i = int(after[i])
        return ids[np.array(out, np.int64)]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment: the matches of the pattern, each merged by itself, each distinct one once."""
        found = [self.words(s) for s in segments]
        slot: dict[str, int] = {}
        order = np.fromiter((slot.setdefault(w, len(slot)) for f in found for w in f), np.int64)
        ids, lens = self.merge([w.encode() for w in slot])
        per = np.fromiter(map(len, found), np.int64, len(found))
        starts = np.cumsum(lens) - lens
        flat = ragged_take(ids, starts[order], lens[order])
        ends = np.concatenate(([0], np.cumsum(lens[order])))
        return flat.astype(np.uint32), np.diff(ends[np.concatenate(([0], np.cumsum(per)))])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODERS: dict[tuple[str, str], tuple[MatrixBPE, SegmentEncoder]] = {}


def coder(path: str, pattern: str) -> tuple[MatrixBPE, SegmentEncoder]:
    """This worker's coder for a file, and the memo of segments before it."""
    if (path, pattern) not in _CODERS:
        bpe = MatrixBPE(path, pattern)
        _CODERS[path, pattern] = bpe, SegmentEncoder(bpe.encode)
    return _CODERS[path, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds ids array<int> to documents (doc_id, text).

    Null and empty texts have none; repeated rows and null ids stay; an empty
    table gives none; other columns go.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = coder(ranks, pattern)[1].batch(batch.column("text"))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, SLICE_BYTES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 (bytes decoded from the ids).

    A null text counts as empty; repeated rows stay; an empty table gives none.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, memo = coder(ranks, pattern)
        ids, counts = memo.batch(batch.column("text"))
        ends = np.cumsum(counts).tolist()
        names = decimal(len(bpe.bytes_of))
        rows, at = [], 0
        for end in ends:
            own = ids[at:end].tolist()
            rows.append((hashlib.sha256(b" ".join(map(names.__getitem__, own))).hexdigest(), hashlib.sha256(bpe.decode(own)).hexdigest()))
            at = end
        first, second = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, SLICE_BYTES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_DECIMAL: dict[int, list[bytes]] = {}


def decimal(n: int) -> list[bytes]:
    if n not in _DECIMAL:
        _DECIMAL[n] = [b"%d" % i for i in range(n)]
    return _DECIMAL[n]
