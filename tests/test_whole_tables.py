"""Queries over tables that are folders of part files, or hold more than the given ones."""

import pytest
from pyspark.sql import functions as F

from tallgrass.plans import catalogue

SF = "/root/testdata/sf0.001"


def same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.select(*a.columns).collect())))


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The events, shuffled over many part files."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{SF}/events.parquet").repartition(30, F.rand(1)).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_event_dedupe", "stream_state_machine", "stream_windowed_counts"])
def test_streams_of_many_files(spark, many_files, name):
    got, one = catalogue.QUERIES[name](spark, many_files), catalogue.QUERIES[name](spark, SF)
    assert got.count() > 0
    if name == "stream_event_dedupe":  # a digest takes in the user, so the first of a key has the same columns in any order
        assert got.count() == got.select("dedupe_key").distinct().count()
    assert same(got, one)
    if name == "stream_state_machine":
        assert same(got, catalogue.QUERIES["lifecycle_fold"](spark, many_files))


def test_every_order_has_its_number(spark, tmp_path):
    keys = [(1, 7), (3_999_999, 8), (4_000_000, 9), ((1 << 24) - 1, 10), (1 << 24, 11), (6_000_000_000, 1_500_000_000)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.cid for r in catalogue.QUERIES["cid_hex_decode"](spark, str(tmp_path)).collect()}
    assert got == {k: str((k << 40) + c) for k, c in keys}


def test_every_address_has_its_context(spark, tmp_path):
    text = "x" * 200 + " Sales: a@one.com, " + "y" * 200 + " press: b@two.org now, A@One.com again, b@two.org"
    spark.createDataFrame([(1, text), (2, "none here"), (3, None), (4, "c@d.com")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.email): r.context for r in catalogue.QUERIES["email_context_window"](spark, str(tmp_path)).collect()}
    want = {(1, e): " ".join(text[text.find(e) - 90 : text.find(e) + len(e) + 90].split()) for e in ("a@one.com", "b@two.org")}
    assert got == want | {(4, "c@d.com"): "c@d.com"}


def test_lifecycle_of_a_user_of_many_events(spark, tmp_path):
    import random

    from tallgrass.operators import lifecycle as L
    from tallgrass.plans.lifecycle import ASKS

    r = random.Random(3)
    kinds = [*ASKS, "other"]
    rows = [(7 if r.random() < 0.6 else r.randrange(8, 60), i, r.randrange(10_000), r.choice(kinds)) for i in range(5_000)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, event_type string")
    df.select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "event_type", F.lit(1.0).alias("value")).repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for user, _, _, kind in sorted(rows, key=lambda x: (x[2], x[1])):
        state, n = want.get(user, (L.FIRST, 0))
        want[user] = L.step(state, ASKS.get(kind)), n + 1
    found = catalogue.QUERIES["lifecycle_fold"](spark, str(tmp_path))
    assert {x.user_id: (x.state, x.n) for x in found.collect()} == want
    assert "InPandas" not in found._jdf.queryExecution().toString()  # no user's events meet in one frame


def test_states_go_on_from_earlier_batches(spark):
    from tallgrass.operators import lifecycle as L
    from tallgrass.plans.lifecycle import asking

    e = asking(spark, SF)
    cut = e.agg(F.percentile_approx(F.unix_micros("ts"), 0.4)).first()[0]
    early, late = e.filter(F.unix_micros("ts") <= cut), e.filter(F.unix_micros("ts") > cut)
    kept = L.ordered_maps(early).select("target", L.applied().alias("kept"))
    again = L.ordered_maps(late).join(kept, "target", "full").select("target", F.when(F.col("maps").isNull(), F.col("kept")).otherwise(L.applied(F.col("kept"))).alias("state"))
    got = {r.target: r.state for r in again.collect()}
    assert got == {r.user_id: r.state for r in catalogue.QUERIES["lifecycle_fold"](spark, SF).collect()}
