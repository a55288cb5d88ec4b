"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

1. Search.  Of equal texts only the first goes on; the others are repeats as a
   whole.  Every window of `length` bytes picks the gram of the smallest hash
   inside it, so equal windows pick equal grams at equal places.  A run of
   windows that pick one gram is cut into pieces of at most BLOCKS[0] windows at
   fixed places about the gram; what all windows of such a block share is its
   core.  Pieces are dealt by the hash of their core, and those whose core
   stands alone go: equal windows have equal cores, so they always meet.
2. Transforms.  The bytes of the pieces that are left are dealt by core.  Each
   task spreads different pieces over shards and sorts the suffixes of each
   shard by itself.  A shard's transform holds, in suffix order, the symbol (STEP bytes)
   before each suffix and the place of the suffix that begins with it.
3. Merge.  The transforms of all shards are interleaved by refinement: places
   start in blocks of equal first bytes, and each pass puts one more symbol in
   front of every suffix, block by block, so that it sorts by one more symbol
   without a look at the texts.  A place alone in its block has its common
   prefix and leaves.  Blocks that are left when a pass reaches `length` are the
   repeated strings; the earliest window of each stays.
4. A core of more than PART pieces is dealt in parts, each merged by itself.
   The pieces that a part leaves are cut into shorter blocks (BLOCKS), whose
   longer cores split them up, and merged again; blocks of one window need no
   merge, as their core is the window.
5. Removal.  The intervals found are gathered by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, runs, stash

#: Bytes of a gram.
GRAM = 32
#: Windows that are searched at a time, so few that they stay in the processor's cache; their places fit in the low bits of a key.
PLACES = 15
#: Windows of a block on each level of merging.
BLOCKS = (35, 5, 1)
#: Pieces of one core that one merge takes, where they are short; those of more are dealt in parts.
PART = 1 << 13
#: Bytes that are merged at a time, but for a core's or part's that are more, and shards that they are spread over.
MERGE, SHARDS = 1 << 18, 8
#: Bytes of a symbol of the transforms, which are named by numbers.
STEP = 10
#: Bits of a place, a name or a block's number; three fit in one number.
_BITS = 21

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: A number of 64 bits for each byte, by a rule.
_BYTE = ((np.arange(1, 257, dtype=np.uint64) * _FACTOR) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))) * _MIX
#: How start, gram's place and number of windows stand in one number, and where its flags begin.
_START, _REL, _FLAG = 16, 8, 60


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all strings of `size` bytes, by doubling."""
    part, have, factor = _BYTE[data], 1, int(_FACTOR)
    out, out_have = None, 0
    while True:
        if size & have:
            if out is None:
                out, out_have = part, have
            else:  # what is at hand, then `part` behind it
                n = min(len(out), len(part) - out_have)
                out = out[:n] * np.uint64(pow(factor, have, 1 << 64)) + part[out_have : out_have + n]
                out_have += have
        if out_have == size:
            return out
        n = len(part) - have
        part = part[:n] * np.uint64(pow(factor, have, 1 << 64)) + part[have : have + n]
        have *= 2


def _sliding_min(keys: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (size - have)], keys[size - have :]) if have < size else keys


def pieces(data: np.ndarray, ends: np.ndarray, length: int, block: int) -> dict[str, np.ndarray]:
    """Runs of at most `block` windows of one gram over texts laid end to end: text, start (in its text), n windows, rel (gram's place from start), core (hash)."""
    low = np.uint64((1 << PLACES + 1) - 1)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    firsts, picks, numbers, cores, last = [], [], [], [], (-1, -1)
    for at in range(0, len(data) - length + 1, 1 << PLACES):
        part = data[at : at + (1 << PLACES) + length - 1]
        grams, core = _hashes(part, GRAM), _hashes(part, length - block + 1)
        keys = (((grams ^ (grams >> np.uint64(31))) * _MIX) & ~low) | np.arange(len(grams), dtype=np.uint64)
        pick = (_sliding_min(keys, length - GRAM + 1) & low).astype(np.int64)
        number = (pick - np.arange(len(pick))) // block  # of the block about the gram
        new = np.empty(len(pick), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (number[1:] != number[:-1])
        new[0] = (pick[0] + at, number[0]) != last
        last = int(pick[-1]) + at, int(number[-1])
        new[starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(pick))] - at] = True
        first = np.flatnonzero(new)
        firsts.append(first + at)
        picks.append(pick[first] + at)
        numbers.append(number[first])
        cores.append(_marked(core[pick[first] - number[first] * block], number[first]))
    if not firsts:
        return {k: np.empty(0, np.int64) for k in ("text", "start", "n", "rel")} | {"core": np.empty(0, np.uint64)}
    first, pick, core = np.concatenate(firsts), np.concatenate(picks), np.concatenate(cores)
    # A piece ends before the next one or the first window that leaves its text.
    text = np.searchsorted(ends, first, side="right")
    stop = np.minimum(np.append(first[1:], len(data)), ends[text] - length + 1)
    valid = stop > first
    first, pick, core, text, stop = (x[valid] for x in (first, pick, core, text, stop))
    return {"text": text, "start": first - starts[text], "n": stop - first, "rel": pick - first, "core": core}


def _marked(core: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (core + number.astype(np.uint64) * _MIX) * _FACTOR


def _cores(data: np.ndarray, gram: np.ndarray, number: np.ndarray, length: int, block: int) -> np.ndarray:
    """Hash of what all windows of a gram's block share: the bytes from its last window's start to its first window's end."""
    return _marked(_hashes(data, length - block + 1)[gram - number * block], number)


def _sorted_keys(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of (key, place), and which of them begin and which end a run of equal keys. One number holds both, as numbers sort faster than their order is found."""
    both = (key.astype(np.uint64) << np.uint64(_BITS)) | place.astype(np.uint64)
    both.sort()
    place, key = (both & np.uint64((1 << _BITS) - 1)).astype(np.int64), both >> np.uint64(_BITS)
    edge = np.ones(len(key) + 1, bool)
    edge[1:-1] = key[1:] != key[:-1]
    return place, edge[:-1], edge[1:]


def names(data: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """The rank, from 1 on, of the first `size` bytes (at most 10) of the suffix at each place among those of all; strings that end sooner count as followed by zeros."""
    half = min(size, 5)
    word = _five(data)
    word >>= np.uint64(8 * (5 - half))
    short = left < half
    word[short] &= ~np.uint64(0) << ((half - left[short]) * 8).astype(np.uint64)
    name = _named(word)
    if size == half:
        return name
    ahead = np.where(left > size - half, np.append(name[size - half :], np.zeros(size - half, np.int64)), 0)
    return _named((name.astype(np.uint64) << np.uint64(_BITS)) | ahead.astype(np.uint64))


def _five(data: np.ndarray) -> np.ndarray:
    """The five bytes from each place on as one number, zeros behind the end."""
    n, word = len(data), np.zeros(len(data), np.uint64)
    for k in range(5):
        word <<= np.uint64(8)
        word[: n - k] |= data[k:]
    return word


def _named(key: np.ndarray) -> np.ndarray:
    place, new, _ = _sorted_keys(key, np.arange(len(key)))
    name = np.empty(len(key), np.int64)
    name[place] = np.cumsum(new)
    return name


def transform(name: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in order of their first `length` bytes, and each one's number in it, equal for equal ones.

    name: of the first STEP bytes of each; left: bytes to the string's end.  By
    doubling of the compared length; only what stands together still is compared again.
    """
    n = len(name)
    place, new, end = _sorted_keys(name, np.arange(n))
    rank = np.empty(n, np.int64)
    rank[place] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied, have = place[~(new & end)], STEP
    while have < length and len(tied):
        step = min(have, length - have)
        ahead = np.where(left[tied] > step, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        old = rank[tied]
        tied, new, end = _sorted_keys((old << _BITS) | ahead, tied)
        old, at = rank[tied], np.arange(len(tied))
        group = np.append(True, old[1:] != old[:-1])
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        tied = tied[~(new & end)]
        have += step
    order, _, _ = _sorted_keys(rank, np.arange(n))
    return order, rank[order]


def interleave(first: np.ndarray, symbol: np.ndarray, before: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms that stand one after the other, by refinement of their interleave.

    Of each place: the name of its suffix's first `depth` bytes (0: it is
    shorter), the symbol before it (the name of STEP bytes) and the place of the
    suffix that begins with that (-1: none).  Returns the places whose suffixes
    share `length` bytes with another's, in order, which of them begin a block of
    equal ones, and each place's common prefix with its neighbours as the last
    pass knew it.
    """
    common = np.zeros(len(first), np.int32)
    place = np.flatnonzero(first)
    place, new, end = _sorted_keys(first[place], place)
    while True:
        keep = ~(new & end)
        block, place, new = np.cumsum(new)[keep], place[keep], new[keep]
        common[place] = depth
        if depth >= length:
            return place, new, common
        keep = before[place] >= 0
        block, place = block[keep], place[keep]
        place, new, end = _sorted_keys((symbol[place] << _BITS) | block, before[place])
        depth += STEP


def _later(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which rows of the runs that begin at `new` aren't of the run's least order."""
    if not len(order):
        return new
    first = np.flatnonzero(new)
    return order != np.repeat(np.minimum.reduceat(order, first), np.diff(np.append(first, len(order))))


def repeated_windows(data: np.ndarray, sizes: np.ndarray, order: np.ndarray, length: int, shards: int = SHARDS) -> tuple[np.ndarray, int]:
    """Which places of strings laid end to end begin a window that equals one of lower order, and how many of them a shard's own sort knew.

    order: a number for each place, equal only where the same place of a text
    stands twice.  Strings go to the shards in turn.
    """
    if len(data) >= 1 << _BITS:
        raise ValueError("the strings are too many for a place's bits")
    ends, string = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    left = ends[string] - np.arange(len(data))
    name, window = names(data, left, STEP), left >= length
    again, turn, parts, alone = np.zeros(len(data), bool), string % shards, [], 0
    for shard in range(min(shards, len(sizes))):
        at = np.flatnonzero(turn == shard)
        bwt, rank = transform(name[at], left[at], length)
        spot = at[bwt]  # places in suffix order
        full = window[spot]
        own, rank = spot[full], rank[full]
        later = own[_later(order[own], np.append(True, rank[1:] != rank[:-1])[: len(rank)])]
        again[later] = True
        alone += len(later)
        # Strings of which no window is left leave the shard; the order of the others stands.
        kept = np.zeros(len(sizes), bool)
        kept[string[own[~again[own]]]] = True
        parts.append(spot[kept[string[spot]]])
    spot = np.concatenate(parts)
    place = np.full(len(data), -1)
    place[spot] = np.arange(len(spot))
    back = np.maximum(spot - STEP, 0)
    before = np.where((spot >= STEP) & (string[back] == string[spot]), place[back], -1)
    depth = (length - 1) % STEP + 1
    first = np.where(left[spot] >= depth, (name if depth == STEP else names(data, left, depth))[spot], 0)
    found, new, _ = interleave(first, name[back], before, depth, length)
    at = spot[found]
    again[at[_later(order[at], new)]] = True
    return again, alone


def _texts(docs: DataFrame) -> DataFrame:
    """Documents with the order of their ids, nulls first (_d, then the text's hash _x), and a hash of both (_u) by which their candidates find them."""
    text = F.coalesce("text", F.lit(""))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.xxhash64(d, text).alias("_u"), d.alias("_d"), F.xxhash64(text).alias("_x"), "doc_id", text.alias("text"))


def _binary(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array laid end to end, and the ends."""
    raw = column.cast(pa.large_binary())
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _search(rows: DataFrame, length: int, block: int) -> DataFrame:
    """Pieces (core, u, place); flag 1 in place: the first of several of its core in the same slice of the search, flag 2: the others."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = pieces(*_binary(batch.column("text")), length, block)
        order = np.argsort(f["core"], kind="stable")
        core = f["core"][order]
        same = core[1:] == core[:-1]
        flag = np.zeros(len(core), np.int64)
        flag[:-1] += same
        flag[1:] = np.where(same, 2, flag[1:])
        place = ((f["start"] << _START) | (f["rel"] << _REL) | f["n"])[order] | (flag << _FLAG)
        return pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(batch.column("_u").to_numpy()[f["text"][order]]), pa.array(place)], names=["core", "u", "place"])

    return rows.select("_u", "text").mapInArrow(lambda batches: in_batches(batches, work, 4 << 20), "core long, u long, place long")


def _shared(found: DataFrame) -> DataFrame:
    """The pieces whose core has several.

    What a slice knows to be shared is spread by document, so that a core's rows
    in one task are at most one for each slice; rows stream by, one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            core = batch.column("core").to_numpy()
            same = core[1:] == core[:-1]
            keep = batch.column("place").to_numpy() >> _FLAG > 0
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= last == core[0]
            yield batch.slice(0, len(batch) - 1).filter(pa.array(keep[:-1]))
            last, held, tail = core[-2] if len(core) > 1 else last, batch.slice(len(batch) - 1), bool(keep[-1])
        if held is not None and tail:
            yield held

    spread = F.when(F.shiftright("place", _FLAG) == 2, F.col("u")).otherwise(F.col("core"))
    return found.repartition(spread).sortWithinPartitions("core").mapInArrow(run, found.schema)


def part_size(length: int) -> int:
    """Pieces that one merge takes: so many that places of about twice their bytes still fit in _BITS."""
    return max(1, min(PART, (1 << _BITS) * 10 // 19 // (BLOCKS[0] + length - 1)))


def _dealt(found: DataFrame, length: int) -> DataFrame:
    """Pieces with the key of their merge (group): the core, or a part of it where it has more than part_size; flag 1 in place marks those."""
    most = part_size(length)
    counts = found.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most)
    crowded = stash(counts.select(F.col("core").alias("_core"), F.ceil(F.col("c") / most).alias("_parts")), "crowded")
    plain = F.col("place").bitwiseAND(F.lit((1 << _FLAG) - 1))
    if crowded.isEmpty():
        return found.withColumns({"group": F.col("core"), "place": plain})
    joined = found.join(crowded, F.col("core") == F.col("_core"), "left")
    part = F.xxhash64("core", F.pmod(F.xxhash64(*[c for c in found.columns if c != "core"]), F.col("_parts")))
    return joined.withColumns({"group": F.when(F.col("_parts").isNull(), F.col("core")).otherwise(part), "place": F.when(F.col("_parts").isNull(), plain).otherwise(plain.bitwiseOR(F.lit(1 << _FLAG)))}).drop("_core", "_parts")


_STRINGS = "group long, d long, x long, place long, bytes binary"


def _strings(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bytes of pieces. Documents of one _u, if there are, get each other's candidates, which does no harm."""
    spots = found.groupBy(F.col("u").alias("_u")).agg(F.collect_set(F.struct("group", "place")).alias("spots"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spots")
        flat = own.flatten()
        group, place = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        start = (place & ((1 << _FLAG) - 1)) >> _START
        stop = start + (place & ((1 << _REL) - 1)) + length - 1
        row = np.repeat(np.arange(len(batch)), np.diff(own.offsets.to_numpy()))
        taken = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]
        size = np.fromiter(map(len, taken), np.int64, len(taken))
        cols = [group, *(batch.column(k).to_numpy()[row] for k in ("_d", "_x")), place]
        out = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(taken, pa.binary())], names=["group", "d", "x", "place", "bytes"])
        fit = size == stop - start  # not the candidates of a shorter text
        return out if fit.all() else out.filter(pa.array(fit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, 2 << 20)

    return texts.join(spots, "_u").select("_d", "_x", "text", "spots").mapInArrow(run, _STRINGS)


def _portions(table: pa.Table, key: str, size: np.ndarray, most: int) -> Iterator[pa.Table]:
    """Cuts a table sorted by an integer key between keys into parts of at most `most` by size, or of one key."""
    value = table[key].to_numpy()
    if not len(value):
        return
    edge = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), len(value))
    total = np.append(0, np.cumsum(size))[edge]
    at = 0
    while at < len(edge) - 1:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield table.slice(edge[at], edge[to] - edge[at])
        at = to


def _different(table: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are the earliest of their group's rows of the same bytes, rows that are later than those, and rows whose group has several of the first kind.

    A row of the same order as the earliest is that row once more, and neither.
    """
    seen: dict[tuple[int, bytes], int] = {}
    group = table["group"].to_numpy()
    own = np.fromiter((seen.setdefault(k, len(seen)) for k in zip(group.tolist(), table["bytes"].to_pylist())), np.int64, len(table))
    by = np.lexsort((np.arange(len(own)), order, own))
    first = np.zeros(len(own), bool)
    begins = np.append(True, own[by][1:] != own[by][:-1])[: len(own)]
    first[by[begins]] = True
    later = np.empty(len(own), bool)
    later[by] = _later(order[by], begins)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return first, later, np.repeat(np.add.reduceat(first.astype(np.int64), edge) > 1, np.diff(np.append(edge, len(group))))


def _merged(strings: DataFrame, length: int) -> DataFrame:
    """Kind 1: runs of windows (d, x, place) that stand earlier, too; kind 0: the pieces of parts of a core that have windows left, with their bytes.

    Of pieces of the same bytes the earliest goes into the merge; where a core
    has but one, there is nothing to merge.
    """

    def merge(table: pa.Table, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, ends = _binary(table["bytes"])
        sizes = np.diff(ends, prepend=0)
        d, x, place = (table[k].to_numpy() for k in ("d", "x", "place"))
        start, begin = (place & ((1 << _FLAG) - 1)) >> _START, ends - sizes
        again, _ = repeated_windows(data, sizes, np.arange(len(data)) + np.repeat(order - begin, sizes), length)
        edge = np.diff(np.concatenate(([0], again.view(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        string = np.searchsorted(ends, a, side="right")
        yield _rows(1, d[string], x[string], ((start[string] + a - begin[string]) << _START) | (b - a), pa.nulls(len(a), pa.binary()))
        alive = np.add.reduceat(again.astype(np.int64), begin) < sizes - length + 1
        alive &= place >> _FLAG > 0
        if alive.any():
            yield _rows(0, d[alive], x[alive], place[alive] & ((1 << _FLAG) - 1), table["bytes"].filter(pa.array(alive)).combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["group"], least=part_size(length)):
            table = table.combine_chunks()
            d, x, place = (table[k].to_numpy() for k in ("d", "x", "place"))
            plain, by = place & ((1 << _FLAG) - 1), np.lexsort((x, d))
            document = np.empty(len(d), np.int64)
            document[by] = np.cumsum(np.append(False, (d[by][1:] != d[by][:-1]) | (x[by][1:] != x[by][:-1])))
            order = (document << 40) | (plain >> _START)
            first, later, several = _different(table, order)
            yield _rows(1, d[later], x[later], plain[later], pa.nulls(int(later.sum()), pa.binary()))
            rest = np.flatnonzero(first & (several | (place >> _FLAG > 0)))
            table, order = table.take(pa.array(rest)).combine_chunks(), order[rest]
            at = 0
            for part in _portions(table, "group", (table["place"].to_numpy() & ((1 << _REL) - 1)) + length - 1, MERGE):
                yield from merge(part, order[at : at + len(part)])
                at += len(part)

    return strings.repartition("group").sortWithinPartitions("group").mapInArrow(run, "kind int, " + _STRINGS.partition(", ")[2])


def _rows(kind: int, d, x, place, taken: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), kind, np.int32)), *map(pa.array, (d, x, place)), taken], names=["kind", "d", "x", "place", "bytes"])


def _cut_finer(strings: DataFrame, length: int, block: int) -> DataFrame:
    """Pieces of shorter blocks: core and the columns of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, ends = _binary(batch.column("bytes"))
            place = batch.column("place").to_numpy()
            n, rel, begin = place & ((1 << _REL) - 1), (place >> _REL) & ((1 << _REL) - 1), ends - np.diff(ends, prepend=0)
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            number = (rel[row] - offset) // block
            first = np.flatnonzero((offset == 0) | (np.diff(number, prepend=-1) != 0))
            row, offset, number, n = row[first], offset[first], number[first], np.diff(np.append(first, len(number)))
            core = _cores(data, begin[row] + rel[row], number, length, block)
            taken = pa.array([data[a : a + b].tobytes() for a, b in zip((begin[row] + offset).tolist(), (n + length - 1).tolist())], pa.binary())
            fresh = (((place[row] >> _START) + offset) << _START) | ((rel[row] - offset) << _REL) | n
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), *(pa.array(batch.column(k).to_numpy()[row]) for k in ("d", "x")), pa.array(fresh), taken], names=["core", "d", "x", "place", "bytes"])

    return strings.select("d", "x", "place", "bytes").mapInArrow(run, "core" + _STRINGS.partition("group")[2])


def _repeats(texts: DataFrame, length: int) -> DataFrame:
    """Runs (d, x, start, stop) of bytes that repeated windows cover, texts being different from each other."""
    blocks = [min(b, length - GRAM + 1) for b in BLOCKS]
    found = stash(_shared(_search(texts, length, blocks[0])), "pieces")
    merged = stash(_merged(_strings(texts, _dealt(found, length), length), length), "merged")
    start = F.shiftright("place", _START)
    out, rest = merged.filter("kind = 1"), merged.filter("kind = 0")
    for block in blocks[1:]:
        if rest.isEmpty():
            break
        finer = stash(_cut_finer(rest, length, block), "pieces")
        if block == 1:
            first = finer.groupBy("bytes").agg(F.min(F.struct("d", "x", start.alias("s"))).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
            later = finer.join(stash(first, "windows"), "bytes").filter(F.struct("d", "x", start.alias("s")) != F.col("first"))
            out = out.unionByName(later.select(F.lit(1).alias("kind"), "d", "x", "place", F.lit(None).cast("binary").alias("bytes")))
        else:
            merged = stash(_merged(_dealt(finer, length).select(*[c.split()[0] for c in _STRINGS.split(", ")]), length), "merged")
            out, rest = out.unionByName(merged.filter("kind = 1")), merged.filter("kind = 0")
    n = F.col("place").bitwiseAND(F.lit((1 << _REL) - 1))
    return out.select("d", "x", start.alias("start"), (start + n + (length - 1)).alias("stop"))


def _cut(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, given intervals (d, x, start, stop)."""
    lists = spans.groupBy(F.col("d").alias("_d"), F.col("x").alias("_x")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, out = batch.column("text").cast(pa.binary()).to_pylist(), []
            for text, own in zip(texts, batch.column("spans"), strict=True):
                removed = count = 0
                if own.is_valid:
                    a, b = (own.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                    lo, hi = a[new], b[np.append(new[1:], len(a)) - 1]
                    removed, count = int((hi - lo).sum()), len(lo)
                    edges = [0, *np.column_stack((lo, hi)).ravel().tolist(), len(text)]
                    kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                else:
                    kept = text
                out.append((len(text), removed, count, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return in_batches(batches, work, 8 << 20)

    return rows.join(lists, ["_d", "_x"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_strings(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 after removal of repeated strings.

    A byte goes if a string of `length` bytes that covers it also starts
    earlier: in a smaller doc_id, or earlier in the same document.  Matches
    never cross documents.  Null and empty texts have no bytes; a null doc_id
    comes before all others; rows that repeat both doc_id and text count as one
    document and each get its result.
    """
    if length < GRAM:
        raise ValueError("the length is under a gram's")
    if length - GRAM >= 1 << _REL:
        raise ValueError("the length is too long for a place's bits")
    texts = _texts(docs)
    # Of equal texts the first goes on; rows that repeat id and text are one document.
    digests = texts.filter(F.octet_length("text") >= length).select(F.unhex(F.sha2("text", 256)).alias("_sha"), "_d", "_x", F.octet_length("text").cast("long").alias("_size"))
    groups = digests.groupBy("_sha").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last")).filter("_first <> _last").select("_sha", "_first")
    copies = stash(digests.join(stash(groups, "groups"), "_sha").filter("_d <> _first").select("_d", "_x", "_size").distinct(), "copies")
    spans = _repeats(texts.join(copies.select("_d", "_x"), ["_d", "_x"], "left_anti"), length)
    whole = copies.select(F.col("_d").alias("d"), F.col("_x").alias("x"), F.lit(0).cast("long").alias("start"), F.col("_size").alias("stop"))
    return _cut(texts, spans.unionByName(whole))
