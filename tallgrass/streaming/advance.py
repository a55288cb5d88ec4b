"""States of targets and deadlines of observations as streams with timers.

Events arrive in any order within a delay.  What isn't older than the watermark
waits in a store; a timer at the earliest of it folds all that has become final,
in the order of time.  Only the state stays.  Deadlines wait likewise until the
watermark reaches them.

A store keeps what it holds of a bucket of keys as arrays, read and written once
a batch: calls to the store grow with batches and buckets, not with rows.  Rows
come to it in packs of a bucket, as each row of a stateful operator costs a Python
object for each column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.lifecycle import FIRST, steps

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADVANCED = "target long, state string, n long, moved_at timestamp, late long"
DUE = "business long, observation long, deadline timestamp"
#: Stands for a null key, which groups of a stream can't have; its rows only move the watermark.
NOBODY = -(1 << 63)
#: Parts into which keys are dealt by hash; each is a group of the stream.
BUCKETS = 512
#: Rows that a task gathers before it makes packs of them.
PACKED = 1 << 17
KNOWN = np.dtype([("target", "i8"), ("state", "i4"), ("n", "i8"), ("moved_at", "i8"), ("last_ts", "i8"), ("last_id", "i8"), ("late", "i8")])
WAITING = np.dtype([("target", "i8"), ("ts", "i8"), ("event_id", "i8"), ("ask", "i4")])
OPEN = np.dtype([("business", "i8"), ("observation", "i8"), ("ts", "i8"), ("deadline", "i8")])


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _array(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for name, values in zip(kind.names, columns, strict=True):
        out[name] = values
    return out


def _unpacked(part: pd.DataFrame, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(pack, kind) for pack in part["pack"]]


class Advance(StatefulProcessor):
    """Folds the events (target, ts, event_id, asked) of a bucket's targets, or packs of them, into their states."""

    def init(self, handle) -> None:
        self.handle = handle
        self.store = handle.getValueState("targets", "known binary, waiting binary")
        self.names, table = steps()
        self.table = table.tolist()

    def _fold(self, fresh: np.ndarray, mark: int) -> Iterator[pd.DataFrame]:
        """Takes in what is older than the mark (milliseconds); the rest waits for a timer at the earliest of it."""
        stored = self.store.get() if self.store.exists() else (b"", b"")
        known, held = np.frombuffer(stored[0], KNOWN), np.frombuffer(stored[1], WAITING)
        # What is older than the mark, or than something that is folded already, can't have its turn any more.
        at = np.searchsorted(known["target"], fresh["target"])
        last = known[np.minimum(at, len(known) - 1)] if len(known) else np.zeros(len(fresh), KNOWN)
        seen = (last["target"] == fresh["target"]) & (len(known) > 0)
        late = (fresh["ts"] < mark * 1000) | seen & ((fresh["ts"] < last["last_ts"]) | (fresh["ts"] == last["last_ts"]) & (fresh["event_id"] <= last["last_id"]))
        rows = np.concatenate((held, fresh[~late]))
        ready = rows["ts"] < mark * 1000
        final, later = rows[ready], rows[~ready]
        if len(later):
            self.handle.registerTimer(int(later["ts"].min()) // 1000 + 1)
        moved = np.unique(np.concatenate((final["target"], fresh["target"][late])))
        if len(moved):
            known = self._added(known, moved)
            place = np.searchsorted(known["target"], moved)
            known["late"] += np.bincount(np.searchsorted(known["target"], fresh["target"][late]), minlength=len(known))
            self._apply(known, final[np.lexsort([final[c] for c in ("ask", "event_id", "ts", "target")])])
        if len(moved) or len(fresh) > late.sum():
            self.store.update((known.tobytes(), later.tobytes()))
        if len(moved):
            k = known[place]
            yield pd.DataFrame({"target": k["target"], "state": [self.names[i] for i in k["state"]], "n": k["n"], "moved_at": k["moved_at"].astype("datetime64[us]"), "late": k["late"]})

    def _added(self, known: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """What is known, in the order of targets, with those that are new."""
        new = np.zeros(len(add := np.setdiff1d(targets, known["target"])), KNOWN)
        new["target"], new["state"], new["last_ts"] = add, self.names.index(FIRST), -(1 << 62)
        both = np.concatenate((known, new))
        return both[np.argsort(both["target"], kind="stable")]

    def _apply(self, known: np.ndarray, final: np.ndarray) -> None:
        """Folds events, in the order of target and time, into known."""
        at = np.searchsorted(known["target"], final["target"])
        state, moved = known["state"].tolist(), known["moved_at"].tolist()
        for i, ts, ask in zip(at.tolist(), final["ts"].tolist(), final["ask"].tolist()):
            now = self.table[ask][state[i]]
            if now != state[i]:
                state[i], moved[i] = now, ts
        known["state"], known["moved_at"] = state, moved
        known["n"] += np.bincount(at, minlength=len(known))
        ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else at
        known["last_ts"][at[ends]], known["last_id"][at[ends]] = final["ts"][ends], final["event_id"][ends]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        code = {s: k for k, s in enumerate(self.names)}
        fresh = [np.empty(0, WAITING)]
        for part in rows:
            if "pack" in part:
                fresh += _unpacked(part, WAITING)
                continue
            part = part[part["target"] != NOBODY]
            ask = np.fromiter((code.get(a, len(self.names)) for a in part["asked"]), np.int32, len(part))
            fresh.append(_array(WAITING, part["target"], _micros(part["ts"]), part["event_id"], ask))
        if any(map(len, fresh)):
            yield from self._fold(np.concatenate(fresh), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(np.empty(0, WAITING), timerValues.getCurrentWatermarkInMs())


class Due(StatefulProcessor):
    """Says once of each deadline of an observation (business, observation, ts, deadline; or packs of these) that it has come.

    A later row of one observation replaces its deadline, unless that came
    before; a row older than the one known is ignored.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.store = handle.getValueState("deadlines", "open binary")

    def _ripe(self, fresh: np.ndarray, mark: int) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(self.store.get()[0], OPEN) if self.store.exists() else np.empty(0, OPEN)
        rows, new = np.concatenate((held, fresh)), np.arange(len(held) + len(fresh)) >= len(held)
        order = np.lexsort((rows["deadline"], new, rows["ts"], rows["observation"], rows["business"]))
        rows, new = rows[order], new[order]
        same = (rows["business"][1:] == rows["business"][:-1]) & (rows["observation"][1:] == rows["observation"][:-1])
        # Rows of an observation that stand before the known one are older than it.
        group = np.cumsum(np.append(True, ~same)[: len(rows)]) - 1
        known = np.zeros(int(group[-1]) + 1 if len(rows) else 0, np.int64)
        known[group[~new]] = np.flatnonzero(~new)
        stays = np.arange(len(rows)) >= known[group]
        rows, group = rows[stays], group[stays]
        replaced = np.append(group[1:] == group[:-1], False)[: len(rows)]
        after = np.append(rows["ts"][1:], 0)[: len(rows)]
        past = replaced & (rows["deadline"] <= after)  # it had come before the observation was seen anew
        ripe = ~replaced & (rows["deadline"] < mark * 1000)
        rest = rows[~replaced & ~ripe]
        if len(rest):
            self.handle.registerTimer(int(rest["deadline"].min()) // 1000 + 1)
            if len(fresh) or ripe.any():
                self.store.update((rest.tobytes(),))
        elif len(held):
            self.store.clear()
        for found in (rows[past], rows[ripe]):
            if len(found):
                yield pd.DataFrame({"business": found["business"], "observation": found["observation"], "deadline": found["deadline"].astype("datetime64[us]")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [np.empty(0, OPEN)]
        for part in rows:
            if "pack" in part:
                fresh += [x[x["ts"] >= timerValues.getCurrentWatermarkInMs() * 1000] for x in _unpacked(part, OPEN)]
                continue
            part = part[(part["business"] != NOBODY) & part["deadline"].notna()]
            fresh.append(_array(OPEN, part["business"], part["observation"], _micros(part["ts"]), _micros(part["deadline"])))
        if any(map(len, fresh)):
            yield from self._ripe(np.concatenate(fresh), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ripe(np.empty(0, OPEN), timerValues.getCurrentWatermarkInMs())


def _packed(rows: DataFrame, kind: np.dtype, delay: str, buckets: int) -> GroupedData:
    """Rows with the columns of a kind (the first: the key; ts in microseconds, not null), as packs of a bucket of keys.

    A pack bears the latest time in it, which moves the watermark as its rows
    would.  Spark drops whole packs behind it; of others, who unpacks them must
    leave out the rows behind it.  Rows of nobody, and those with a
    null in another column, only count for the time.
    """
    key, size = kind.names[0], PACKED

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packs() -> pa.RecordBatch:
            bucket, keep, found = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            bucket, keep, found = bucket[order], keep[order], found[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            data = [x[k].tobytes() for x, k in zip(np.split(found, first[1:]), np.split(keep, first[1:]))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.maximum.reduceat(found["ts"], first)), pa.array(data, pa.binary())], names=["bucket", "at", "pack"])

        for batch in batches:
            if not len(batch):
                continue
            held.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "keep")), _array(kind, *(batch.column(c).to_numpy(zero_copy_only=False) for c in kind.names))))
            n += len(batch)
            if n >= size:
                yield packs()
                held, n = [], 0
        if held:
            yield packs()

    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), ((F.col(key) != NOBODY) & F.forall(F.array(*[F.col(c).isNotNull() for c in kind.names]), lambda x: x)).alias("keep"), *[F.coalesce(c, F.lit(0)).alias(c) for c in kind.names])
    found = dealt.mapInArrow(pack, "bucket int, at long, pack binary")
    return found.select("bucket", F.timestamp_micros("at").alias("ts"), "pack").withWatermark("ts", delay).groupBy("bucket")


def advanced(events: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream of (target, state, n, moved_at, late): a row whenever more of a target's events have become final; n counts all of them.

    events: target, ts, event_id, asked (a state, or anything else for none).
    Events are folded in the order of (ts, event_id); one that comes after a
    later one has been folded, or behind the watermark, is left out, and counted
    in late or, where all of its pack is behind the watermark, with that as one
    row by the query's progress.  Rows without a
    target or time only move the watermark, if at all; a null event_id comes
    first of its time.
    """
    names = steps()[0]
    ask = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("asked")), F.lit(0)) - 1, F.lit(len(names))).cast("int")
    rows = events.filter("ts IS NOT NULL").select(F.coalesce("target", F.lit(NOBODY)).alias("target"), F.unix_micros("ts").alias("ts"), F.coalesce("event_id", F.lit(NOBODY)).alias("event_id"), ask.alias("ask"))
    return _packed(rows, WAITING, delay, buckets).transformWithStateInPandas(Advance(), ADVANCED, "Append", "EventTime")


def due(observations: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream of (business, observation, deadline), each when the watermark passes its deadline.

    observations: business, observation, ts, deadline (null: never due).
    """
    deadline = F.when(F.col("observation").isNotNull(), F.unix_micros("deadline")).alias("deadline")
    rows = observations.filter("ts IS NOT NULL").select(F.coalesce("business", F.lit(NOBODY)).alias("business"), F.coalesce("observation", F.lit(NOBODY)).alias("observation"), F.unix_micros("ts").alias("ts"), deadline)
    return _packed(rows, OPEN, delay, buckets).transformWithStateInPandas(Due(), DUE, "Append", "EventTime")


def with_rocks(spark: SparkSession) -> None:
    """Lets queries that start from now on keep their state in RocksDB, which timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
