"""What queries need must grow no faster than their tables."""

import json
import random
import tracemalloc
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.functions import rules as R
from tallgrass.operators import imports as I
from tallgrass.operators import lifecycle as L
from tallgrass.operators import resolve as R2
from tallgrass.operators import retrieve as RT
from tallgrass.plans import catalogue
from tallgrass.sources import spool as P
from tallgrass.streaming import advance as A
from tallgrass.streaming import events as S


def test_a_hidden_address_is_worked_out_once(spark):
    hidden = "07" + "".join(f"{ord(c) ^ 7:02x}" for c in "a.b@one.com")
    df = spark.createDataFrame([(hidden,), (hidden[:-2],), (hidden[:-2] + "zz",), ("07",), ("",), (None,)], "c string")
    got = df.select(R.decode_hidden_email(F.upper("c")).alias("email"))
    assert [r.email for r in got.collect()] == ["a.b@one.com", "a.b@one.co", None, None, None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


class Store:
    """A value's state, and the calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        pass

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def clear(self):
        self.value = None


def _batches(r, columns, rows):
    """Batches of random rows, each with the watermark before it."""
    for k in range(12):
        yield 100 * k, pd.DataFrame([rows(r) for _ in range(300)], columns=columns)


def test_deadlines_of_a_bucket_are_kept_as_arrays():
    r, store, due, got, want, open_ = random.Random(4), Store(), A.Due(), [], [], {}
    due.init(store)
    for mark, part in _batches(r, ["business", "observation", "ts", "deadline"], lambda r: (r.randrange(40), r.randrange(25), r.randrange(1300), r.choice([None, r.randrange(2500)]))):
        times = {c: pd.to_datetime(part[c], unit="ms") for c in ("ts", "deadline")}
        for found in due.handleInputRows((0,), iter([part.assign(**times)]), type("T", (), {"getCurrentWatermarkInMs": lambda self: mark})()):
            got += [(b, o, int(d.value) // 1_000_000) for b, o, d in found.astype({"deadline": "datetime64[ns]"}).itertuples(index=False)]
        for ts, d, o, b in sorted((ts, d, o, b) for b, o, ts, d in part.itertuples(index=False) if d == d):
            known = open_.get((b, o))
            if known and known[0] > ts:
                continue
            if known and known[1] <= ts:
                want.append((b, o, known[1]))
            open_[b, o] = ts, d
        for key in [k for k, v in open_.items() if v[1] < mark]:
            want.append((*key, open_.pop(key)[1]))
    assert sorted(got) == sorted(want) and len(want) > 500
    assert store.calls == 12  # 3,600 rows of 1,000 observations


def test_states_of_a_bucket_are_kept_as_arrays():
    r, store, advance, got, rows = random.Random(5), Store(), A.Advance(), {}, []
    advance.init(store)
    asks = [*L.TARGET_MOVES, None, "lost"]
    for k in range(13):
        mark = 100 * k if k < 12 else 10_000
        part = pd.DataFrame([(r.randrange(50), 100 * k + r.randrange(150), 1000 * k + i, r.choice(asks)) for i in range(200)], columns=["target", "ts", "event_id", "asked"])
        rows += part.itertuples(index=False) if k < 12 else []
        part["ts"] = pd.to_datetime(part["ts"], unit="ms")
        timers = type("T", (), {"getCurrentWatermarkInMs": lambda self: mark})()
        for found in advance.handleInputRows((0,), iter([part]), timers) if k < 12 else advance.handleExpiredTimer((0,), timers, None):
            got |= {t: (s, n, late) for t, s, n, _, late in found.itertuples(index=False)}
    want = {}
    for t, _, _, asked in sorted(rows, key=lambda e: (e[1], e[2])):
        state, n, _ = want.get(t, (L.FIRST, 0, 0))
        want[t] = L.step(state, asked), n + 1, 0
    assert got == want and store.calls <= 13


def test_a_shared_phone_makes_no_pairs(spark):
    cols = "id string, phone string, name string, postal string, seq long"
    many = [(f"m{i}", "1", f"Firm {i % 7}", f"AB{i % 3} 1", 1000 - i) for i in range(300)]
    a = spark.createDataFrame([*many, ("x", "2", "Other", "", 1), ("y", "2", "Thing", None, 2), ("z", None, "Firm", "AB1 1", 3)], cols)
    b = spark.createDataFrame([(f"r{i}", "1", "Firm ab", "ZZ 9", i) for i in range(40)] + [("s", "2", "None", "", 1), ("t", "2", "None", None, 1), ("u", "1", "None", "AB1", 1), ("v", None, "Firm", "AB1", 1)], cols)
    got = R2.phone_matches(a, b)
    assert {(r.drop_id, r.keep_id) for r in got.collect()} == {(f"r{i}", "m299") for i in range(40)} | {("s", "x"), ("u", "m298")}
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "mark" in joins[0]


def test_rows_without_a_match_are_spread(spark):
    rows = spark.range(4000).select(F.col("id").alias("row"), F.when(F.col("id") % 4 == 0, F.col("id") % 8).alias("k"), F.lit("a").alias("x"))
    index = spark.createDataFrame([(0, "zero"), (None, "none"), (5, "five")], "key long, v string")
    found = I.looked_up(rows, {"key": F.col("k")}, index)
    assert found.columns == ["row", "k", "x", "key", "v"]
    assert {(r.k, r.v): r["count"] for r in found.groupBy("k", "v").count().collect()} == {(None, None): 3000, (0, "zero"): 500, (4, None): 500}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        tasks = I.looked_up(rows, {"key": F.col("k")}, index).groupBy(F.spark_partition_id()).agg(F.count_if(F.col("k").isNull()).alias("n")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(r.n for r in tasks) < 1000  # nulls of one plain key would all meet in one task


def test_imports_join_each_row_once_to_what_stands(spark):
    rows = spark.createDataFrame([(i, "b", "x", "t" if i % 2 else None) for i in range(6)], "row long, business_id string, outcome string, contacted_at string")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("domain", "website", "phone", "email", "channel", "call_date", "notes", "recorded_by")})
    businesses = spark.createDataFrame([("b", None, None)], "id string, domain string, phone string")
    old = spark.createDataFrame([("b", "phone", "x", "u", None)], "business string, channel string, result string, contacted_at string, notes string")
    found = I.import_outcomes(rows, businesses, spark.createDataFrame([], "business string, value string"), old).routes
    assert {r.row: r.action for r in found.collect()} == {1: "imported", **dict.fromkeys((0, 2, 3, 4, 5), "duplicate")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_ranks_need_no_task_with_a_whole_status(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, r.choice(["F", "O", None]), r.choice(["1", "2", "3", None]), r.choice([None, float(r.randrange(40))])) for i in range(999)] + [(1000 + i, "P", "1", 1.0) for i in range(3)] + [(2000, "Q", "1", 1.0)]
    o = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").repartition(3)
    o.write.parquet(str(tmp_path / "orders.parquet"))
    got = catalogue.QUERIES["rank_functions"](spark, str(tmp_path))
    w, by = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority"), Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")
    want = o.select("o_orderkey", F.rank().over(w), F.dense_rank().over(w), F.ntile(4).over(by), F.round(F.percent_rank().over(w), 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window " in line]
    assert len(windows) == 1 and "part#" in windows[0].split("windowspecdefinition(")[1].split("ASC")[0]


def _as_whole(text):
    """A file's kinds, by the definition."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            data = [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError:
            data = None
        if not data:
            return None
    return [i.get("kind") for i in (data if isinstance(data, list) else [data]) if isinstance(i, dict)]


def test_event_files_are_never_held_whole(tmp_path, monkeypatch):
    one, two = '{"kind": "a"}', '{"kind": "b, ]\\u00e9"}'
    texts = [
        "", " \n", one, f"{one}\n{two}\n", f"[{one},{two}]", f" [ {one} ,\n {two} ] \n", "[]", "[ ]", "[]x", f"[{one}", f"[{one},]", f"[{one}]\n[{two}]", f"{one}\n{{broken", "7", "7\n8", f"[12, 1.5e3, null, {one}]", '{\n"kind":\n"p"}',
        f"{one}\r{two}", f"{one}\x0b{two}", f"{one}{two}", "[1 2]", "[,]", f"[{one} {two}]", "[" + ", ".join([one, "[1, {}]", two] * 50) + "]", "[\"" + "x" * 500 + f"\"{' ' * 200},{one}]", "[", "]", f"[{one}]]",
    ]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(P, "CHARACTERS", size)
        for i, text in enumerate(texts):
            (tmp_path / "f.json").write_bytes(text.encode())
            got = list(P.events_of(str(tmp_path), "f.json"))
            want = _as_whole(text)
            assert ([r[0] for r in got] == want) if want is not None else (len(got) == 1 and got[0][-1]), (i, text)
    (tmp_path / "bad.json").write_bytes(b"[\xff]")
    assert list(P.events_of(str(tmp_path), "bad.json"))[0][-1].startswith("UnicodeDecodeError")
    for start, between, end in (("", "\n", ""), ("[", ",", "]")):
        (tmp_path / "big.json").write_text(start + between.join([one] * 200_000) + end)
        tracemalloc.start()
        assert sum(1 for _ in P.events_of(str(tmp_path), "big.json")) == 200_000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12 << 20  # a fraction of what 200,000 dicts take


def test_equal_letters_are_written_once_by_all_tasks(spark, tmp_path, monkeypatch):
    class Counted(P.LetterWriter):
        def write(self, iterator):
            batches = list(iterator)
            made = super().write(iter(batches))
            (tmp_path / f"task-{uuid.uuid4().hex}").write_text(str(sum(map(len, batches))))
            return made

    class Seen(P.LetterFiles):
        def writer(self, schema, overwrite):
            return Counted(self.options["path"], "txt")

    monkeypatch.setattr(P, "LetterFiles", Seen)
    P.write_letters(spark.range(0, 3000, 1, 1).select(F.concat(F.lit("letter "), F.col("id") % 60).alias("content")), str(tmp_path / "letters"))
    tasks = [int(f.read_text()) for f in tmp_path.glob("task-*")]
    assert len(list((tmp_path / "letters").glob("*.txt"))) == 60
    assert sum(tasks) == 60 and max(tasks) < 20  # 3,000 rows in one task before


def test_rows_reach_a_store_as_packs_in_as_many_tasks_as_run(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 3).select(F.when(F.col("id") % 9 > 0, F.col("id") % 300).otherwise(A.NOBODY).alias("target"), (F.col("id") * 7).alias("ts"), F.col("id").alias("event_id"), F.lit(1).alias("ask"))
    packs = A._packed(rows, A.WAITING, "1 hour", 8).agg(F.collect_list("pack").alias("packs"), F.max("ts").alias("ts")).collect()
    assert sum(len(r.packs) for r in packs) <= 3 * 9 and max(r.ts.microsecond for r in packs) == 19_999 * 7
    found = [t for r in packs for p in r.packs for t in np.frombuffer(p, A.WAITING).tolist()]
    assert sorted(found) == sorted((i % 300, i * 7, i, 1) for i in range(20_000) if i % 9)
    events = spark.range(500).select((F.col("id") % 50).alias("target"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("event_id"), F.lit("drafted").alias("asked"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        delay, _ = S.staged(events, str(tmp_path / "events"), 2)
        A.with_rocks(spark)
        out = S.run_to_table(A.advanced(S.read_events(spark, str(tmp_path / "events"), 8), delay), str(tmp_path / "run"), "append")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        assert sorted(tuple(r) for r in out.groupBy("target").agg(F.max("n"), F.max_by("state", "n")).collect()) == [(t, 10, "drafted") for t in range(50)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    stores = [p for p in (tmp_path / "run/checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert len(stores) == 8  # 40 before


def test_rows_that_cannot_be_among_the_best_meet_no_vectors(spark):
    cols = "query long, doc long, score double"
    plain = spark.createDataFrame([(1, 10, 0.3), (1, 11, 0.2), (2, 10, 0.1)], cols)
    leaders = spark.createDataFrame([(1, 10, 0.9), (1, 12, 0.8), (1, 13, 0.1), (3, 10, 0.4)], cols)
    got = {r.query: (sorted(r.docs), r.most, round(r.least, 6)) for r in RT.reachable(plain, leaders, 2, 0.12).collect()}
    assert got == {1: ([10, 11], 0.2, 0.79999), 2: ([10], 0.12, float("-inf")), 3: ([], 0.12, float("-inf"))}
