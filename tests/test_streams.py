"""Streams of many small files in disorder against the batch, and what their stores hold."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import lifecycle as L
from tallgrass.streaming import advance as A
from tallgrass.streaming import events as S

BASE = dt.datetime(2024, 1, 1)
EVENTS = "target long, ts timestamp, event_id long, asked string"


def fold(events):
    want = {}
    for t, _, _, asked in sorted((e for e in events if e[0] is not None), key=lambda e: (e[1], e[2])):
        s, n = want.get(t, (L.FIRST, 0))
        want[t] = L.step(s, asked), n + 1
    return want


def test_moves_are_those_of_the_tables():
    assert L.moving_to("bounced") == ["sent", "unknown"] and L.moving_to("replied") == ["sent"]
    assert set(L.TARGET_MOVES) - set(L.moving_to("opted_out")) == {"opted_out", "done"}
    assert L.step("enrolled", "sent") == "enrolled" and L.step("sent", "unknown") == "unknown" and L.step("bounced", "opted_out") == "opted_out"
    assert L.step("queued", "failed", "message") == "failed" and L.step("sent", "queued", "message") == "sent"
    assert all(b in L.MOVES[k] for k in L.MOVES for to in L.MOVES[k].values() for b in to)


def test_verdicts(spark):
    rows = [("drafted", "approved"), ("drafted", "sent"), ("sent", "sent"), (None, "sent"), ("sent", "lost"), ("sent", None), ("done", "opted_out")]
    df = spark.createDataFrame(rows, "a string, b string").select(L.verdict(F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in df.collect()] == ["ok", "illegal", "noop", "missing", "unknown state", "unknown state", "illegal"]
    assert L.moves_table(spark, "message").count() == sum(map(len, L.MESSAGE_MOVES.values()))


def test_composed_maps_equal_steps():
    r = np.random.default_rng(2)
    names, table = L.steps()
    code, group = r.integers(0, len(names) + 1, 500), np.sort(r.integers(0, 9, 500))
    maps, at = L.composed(table[code], group)
    for m, g in zip(maps, group[at]):
        for start in range(len(names)):
            s = start
            for c in code[group == g]:
                s = table[c][s]
            assert m[start] == s


def made(seed, n=400, targets=6):
    r = random.Random(seed)
    return [(r.choice([*range(targets), None] if i % 50 == 0 else range(targets)), BASE + dt.timedelta(minutes=i), i, r.choice([*L.TARGET_MOVES, None, "lost"])) for i in range(n)]


def test_ordered_maps(spark):
    events = made(3)
    df = spark.createDataFrame(events, EVENTS).repartition(5)
    got = {r.target: (r.s, r.n) for r in L.ordered_maps(df).select("target", L.applied().alias("s"), "n").collect() if r.target is not None}
    assert got == fold(events)
    later = L.ordered_maps(df).withColumn("kept", F.lit("done")).select(L.applied(F.col("kept")).alias("s")).distinct().collect()
    assert [r.s for r in later] == ["done"]
    assert L.ordered_maps(df.filter("target > 99")).count() == 0


def ran(rows, path):
    query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.parquet(f"{path}/out"), query.recentProgress


def files(spark, path, parts, schema):
    """One file for each part, in their order."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_of_disordered_files_equals_the_fold(spark, tmp_path):
    A.with_rocks(spark)
    events, r = made(1), random.Random(9)
    # Each event comes up to an hour and a half late, in files of forty.
    jumbled = sorted(events, key=lambda e: e[1] + dt.timedelta(minutes=r.randint(0, 90)))
    parts = [jumbled[i : i + 40] for i in range(0, len(jumbled), 40)]
    closing = [(None, BASE + dt.timedelta(days=50), None, None)]
    stream = files(spark, str(tmp_path / "in"), [*parts, closing], EVENTS)
    out, progress = ran(A.advanced(stream, "2 hours"), str(tmp_path))
    got = {x.target: (x.v.state, x.v.n) for x in out.groupBy("target").agg(F.max_by(F.struct("state", "n"), "n").alias("v")).collect()}
    assert got == fold(events)
    operators = [o for p in progress for o in p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for o in operators) == 0
    # The store holds what may still be overtaken, not the stream: two hours of events, their timers, and the states.
    assert max(o["numRowsTotal"] for o in operators) < 250 and operators[-1]["numRowsTotal"] <= 3 * 6


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    A.with_rocks(spark)
    at = lambda h: BASE + dt.timedelta(hours=h)
    parts = [[(1, at(0), 1, "drafted")], [(1, at(48), 2, "approved")], [(1, at(70), 3, "queued")], [(1, at(1), 4, "done"), (1, at(71), 5, None)], [(1, at(2), 6, "done")], [(None, at(500), None, None)]]
    out, progress = ran(A.advanced(files(spark, str(tmp_path / "in"), parts, EVENTS), "10 hours"), str(tmp_path))
    last = out.orderBy("n", "late").collect()[-1]
    assert (last.state, last.n) == ("queued", 4)
    assert last.late + sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 2


def test_deadlines_come_once(spark, tmp_path):
    A.with_rocks(spark)
    at = lambda h: BASE + dt.timedelta(hours=h)
    schema = "business long, observation long, ts timestamp, deadline timestamp"
    parts = [
        [(1, 1, at(0), at(5)), (1, 2, at(0), at(100)), (2, 3, at(0), None), (None, 4, at(0), at(1))], [(1, 2, at(6), at(20)), (1, 1, at(20), at(30))], [(2, 5, at(21), at(2000))],
        [(1, 6, at(40), at(41))], [(None, None, at(300), None)],
    ]
    out, progress = ran(A.due(files(spark, str(tmp_path / "in"), parts, schema), "1 hour"), str(tmp_path))
    got = sorted((r.business, r.observation, (r.deadline - BASE).total_seconds() / 3600) for r in out.collect())
    # Observation 1 comes due, is seen again, and comes due again; 2 is put forward.
    assert got == [(1, 1, 5.0), (1, 1, 30.0), (1, 2, 20.0), (1, 6, 41.0)]
    assert [o for p in progress for o in p["stateOperators"]][-1]["numRowsTotal"] <= 3


@pytest.mark.parametrize("slices", [1, 4])
def test_staged_files_have_no_late_rows(spark, tmp_path, slices):
    events = [(i % 5, BASE + dt.timedelta(hours=i * 7 % 240), i, "sent") for i in range(240)]
    df = spark.createDataFrame(events, EVENTS).repartition(3)
    delay, high = S.staged(df, str(tmp_path / "in"), slices)
    assert high == int((BASE + dt.timedelta(hours=239)).timestamp() * 1_000_000) and spark.read.parquet(str(tmp_path / "in")).count() == 241
    assert int(delay.split()[0]) <= 240 * 3600 // slices + 3601
    seen = S.deduplicated(S.read_events(spark, str(tmp_path / "in"), 2).select(F.col("asked").alias("event_type"), F.col("target").alias("user_id"), "ts"), delay)
    out, progress = ran(seen.select("dedupe_key"), str(tmp_path))
    assert out.filter("dedupe_key IS NOT NULL").count() >= 240
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 0
    assert S.staged(df.filter("target > 99"), str(tmp_path / "none"))[1] == 0
