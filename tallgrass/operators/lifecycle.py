"""The lifecycles of a target and of a message: allowed moves, ordered folds, gates before sending, the breaker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The moves that are allowed between the states of a target, and between those of a message.
TARGET_MOVES = {
    "enrolled": ["drafted", "opted_out", "done"],
    "drafted": ["approved", "opted_out", "done"],
    "approved": ["queued", "drafted", "opted_out", "done"],
    "queued": ["sent", "unknown", "opted_out"],
    "sent": ["bounced", "replied", "opted_out", "no_response", "unknown"],
    "unknown": ["sent", "bounced", "opted_out", "done"],
    "bounced": ["opted_out", "done"],
    "replied": ["follow_up", "done", "opted_out"],
    "no_response": ["follow_up", "done", "opted_out"],
    "follow_up": ["drafted", "done", "opted_out"],
    "opted_out": [],
    "done": [],
}
MESSAGE_MOVES = {
    "drafted": ["approved", "rejected"],
    "rejected": [],
    "approved": ["queued", "drafted"],
    "queued": ["sent", "unknown", "failed"],
    "sent": [],
    "unknown": [],
    "failed": [],
}
MOVES = {"target": TARGET_MOVES, "message": MESSAGE_MOVES}
#: The state that a target begins in.
FIRST = "enrolled"


def moving_to(state: str, kind: str = "target") -> list[str]:
    """The states from which one may move to a state."""
    return [s for s, to in MOVES[kind].items() if state in to]


def allowed(before: Column, after: Column, kind: str = "target") -> Column:
    """Whether a move is allowed; staying in a known state is, unknown states aren't."""
    legal = F.create_map(*[x for s, to in MOVES[kind].items() for x in (F.lit(s), F.array(*[F.lit(t) for t in (s, *to)]))])
    return F.coalesce(F.array_contains(F.element_at(legal, before), after), F.lit(False))


def verdict(before: Column, after: Column, kind: str = "target") -> Column:
    """What a move is: ok, noop, unknown state, missing (nothing is known of the row) or illegal."""
    known = list(MOVES[kind])
    return (
        F.when(after.isNull() | ~after.isin(known), "unknown state").when(before.isNull(), "missing").when(before == after, "noop")
        .when(allowed(before, after, kind), "ok").otherwise("illegal")
    )


def step(state: str, asked: str | None, kind: str = "target") -> str:
    """The state after an event; moves that aren't allowed are ignored."""
    return asked if asked in MOVES[kind][state] else state


def steps(kind: str = "target") -> tuple[list[str], np.ndarray]:
    """The states in order, and for each asked state (last: none) the map of states that it makes."""
    names = list(MOVES[kind])
    return names, np.array([[names.index(step(s, ask, kind)) for s in names] for ask in [*names, None]], np.uint8)


def composed(maps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps of each run of equal groups applied in order, as one map; and where each run begins.

    Neighbours are composed in rounds, so a run of n maps takes log n of them.
    """
    at = np.arange(len(group))
    while len(group):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        second = np.flatnonzero(place % 2 == 1)
        if not len(second):
            break
        maps = maps.copy()
        maps[second - 1] = np.take_along_axis(maps[second], maps[second - 1].astype(np.intp), axis=1)
        keep = place % 2 == 0
        maps, group, at = maps[keep], group[keep], at[keep]
    return maps, at


def ordered_maps(events: DataFrame, kind: str = "target") -> DataFrame:
    """(target, maps, n): what a target's events (target, ts, event_id, asked) make of every state, as maps to be applied in order.

    Events are dealt by ranges of target and time, so that a target of very many
    events stands in several tasks.  A task streams by and leaves one map for
    each of its targets and batches.  asked: a state, or null for none.
    """
    names, table = steps(kind)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            target, asked = (batch.column(c) for c in ("target", "asked"))
            code = pa.compute.fill_null(pa.compute.index_in(asked, pa.array(names)), len(names)).to_numpy(zero_copy_only=False)
            group = np.where(target.is_null().to_numpy(zero_copy_only=False), -1, target.dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False))
            one, at = composed(table[code], group)
            n = np.diff(np.append(at, len(batch)))
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays([target.take(where), batch.column("ts").take(where), batch.column("event_id").take(where), pa.array(one.tolist(), pa.list_(pa.int32())), pa.array(n)], names=["target", "ts", "event_id", "map", "n"])

    order = ["target", "ts", "event_id"]
    rows = events.select("target", F.unix_micros("ts").alias("ts"), "event_id", "asked")
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(maps, "target long, ts long, event_id long, map array<int>, n long")
    return parts.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "map"))).alias("maps"), F.sum("n").alias("n"))


def _names(kind: str) -> Column:
    return F.array(*[F.lit(s) for s in MOVES[kind]])


def applied(start: Column | None = None, kind: str = "target") -> Column:
    """The state after all of `maps`, from the state before (none: the first one)."""
    before = F.lit(0) if start is None else F.coalesce(F.array_position(_names(kind), start) - 1, F.lit(0)).cast("int")
    return F.get(_names(kind), F.aggregate("maps", before, lambda s, m: F.get(m["map"], s)))


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def moves_table(spark: SparkSession, kind: str = "target") -> DataFrame:
    """The allowed moves as rows: a fixed table."""
    return spark.createDataFrame([(a, b) for a, bs in MOVES[kind].items() for b in bs], "before string, after string")
