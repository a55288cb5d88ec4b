"""Rates from feeds, row by row, and what is left."""

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import pace as P

FEED = "stage string, ts double, n long, done long, total long"


def plain(rows, now):
    """One row after another, as a watcher of the feed sees them."""
    seen = {}
    for stage, ts, _, done, total in sorted(rows, key=lambda r: (r[1], r[2])):
        h = seen.setdefault(stage, [])
        done, total = done or 0, total or 0
        if not h or h[-1][1:] != (done, total):
            h.append((ts, done, total))
    out = {}
    for stage, h in seen.items():
        rate = None
        for a in (h[-P.WINDOW :][0], h[0]):
            if rate is None and h[-1][0] > a[0] and h[-1][1] > a[1]:
                rate = (h[-1][1] - a[1]) / (h[-1][0] - a[0])
        eta = max(0.0, (h[-1][2] - h[-1][1]) / rate) if rate and h[-1][2] else None
        out[stage] = (max(0.0, now - h[0][0]), h[-1][1], h[-1][2], h[-1][2] - h[0][2], rate, eta)
    return out, sum(map(len, seen.values()))


@pytest.mark.parametrize("seed", range(3))
def test_estimates_are_those_of_the_feed(spark, seed):
    r = random.Random(seed)
    rows = []
    for stage in ("a", "b", "c", None):
        t, done, total = r.uniform(0, 5000), 0, r.choice([0, 300])
        for n in range(150):
            t += r.choice([0.0, 1.0, 400.0, 9000.0])
            done += r.choice([0, 0, 1, 2]) if stage != "c" else 0
            total += r.choice([0, 0, 0, 5]) if total else 0
            rows.append((stage, t, n, done if r.random() < 0.95 else max(0, done - 1), total or None))
    df = spark.createDataFrame(rows, FEED).repartition(4)
    want, n = plain(rows, 1e6)
    assert P.changes(df).count() == n and P.changes(df, 50.0).count() == n
    got = {x.stage: (x.elapsed, x.done, x.total, x.growth, x.rate, x.eta) for x in P.estimates(df, F.lit(1e6)).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert [a is None for a in got[k]] == [b is None for b in w] and all(a is None or abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got[k], w))


def test_paces_store_and_status(spark):
    measured = spark.createDataFrame([("enrich", 2.0), ("registry", None)], "stage string, per_item double")
    store = spark.createDataFrame([("enrich", 9.0, 1.0), ("registry", 3.0, 1.0), ("gbp", 0.0, 1.0)], "stage string, per_item double, measured_at double")
    pace = P.paces(measured, store)
    assert {r.stage: (r.pace, r.source.split()[0], r.source.split()[1]) for r in pace.collect()} == {
        "discover": (180.0, "documented", "default"), "enrich": (2.0, "measured", "on"), "registry": (3.0, "measured", "earlier"), "gbp": (0.02, "documented", "default"), "validate": (0.3, "documented", "default"),
    }
    assert {(r.stage, r.per_item, r.measured_at) for r in P.stored(store, measured, F.lit(5.0)).collect()} == {("enrich", 2.0, 5.0), ("registry", 3.0, 1.0), ("gbp", 0.0, 1.0)}
    work = spark.createDataFrame([("discover", 8, 10), ("enrich", 5, 5), ("registry", 0, 100), ("gbp", 0, 0)], "stage string, done long, total long")
    s = P.status(work, pace)
    assert {r.stage: (r.state, r.left, r.eta) for r in s.collect()} == {"discover": ("pending", 2, 360.0), "enrich": ("done", 0, 0.0), "registry": ("pending", 100, 300.0), "gbp": ("pending", 0, 0.0)}
    assert P.time_left(s).first().eta == 660.0 and P.time_left(s, overlapped=False).first().eta == 660.0
    assert P.status(work, pace, F.col("stage") == "enrich").filter("state = 'running'").count() == 1
