"""Subdivision against the queue it stands for, and sites of companies."""

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import domains as N
from tallgrass.operators import subdivide as B

BOX = (0.0, 0.0, 8.0, 4.0)


def queue(planned, places, grid, full, least_new, deepest, known=()):
    """One search after another, as a campaign makes them."""
    seen, out = set(known), []
    todo = [(t, 0, ix, iy) for t, ix, iy, _ in sorted(planned, key=lambda p: p[3])]
    cell = lambda v, lo, hi, n: max(0, min(n - 1, int((v - lo) / (hi - lo) * n // 1)))
    for text, depth, ix, iy in todo:
        n = 1 << depth
        found = {i for i, t, x, y in places if t == text and cell(x, 0, 8, grid[0] * n) == ix and cell(y, 0, 4, grid[1] * n) == iy}
        new = found - seen
        seen |= found
        split = len(found) >= full and len(new) >= least_new and depth < deepest
        out.append((text, depth, ix, iy, len(found), len(new), split))
        if split:
            todo += [(text, depth + 1, 2 * ix + q % 2, 2 * iy + q // 2) for q in range(4)]
    return out


@pytest.fixture(scope="module")
def campaign(spark):
    r = random.Random(2)
    places = [(i, t, min(7.9, abs(r.gauss(2, 1.5))), r.uniform(-0.5, 4.5)) for i in range(300) for t in r.sample(["cafe", "bar", "shop"], r.randint(1, 2))]
    planned = [(t, ix, iy, 4 * k + 2 * ix + iy) for k, t in enumerate(["shop", "cafe", "bar"]) for ix in range(2) for iy in range(2)]
    return planned, places, spark.createDataFrame(planned, "text string, ix long, iy long, place long"), spark.createDataFrame(places, "id long, text string, x double, y double")


@pytest.mark.parametrize("full, least_new, deepest", [(20, 5, 3), (20, 0, 2), (1, 1, 1), (10_000, 1, 3), (30, 25, 2)])
def test_rounds_find_what_the_queue_finds(campaign, full, least_new, deepest):
    planned, places, a, b = campaign
    got = B.subdivided(a, b, BOX, (2, 2), full, least_new, deepest).drop("place").collect()
    assert sorted(map(tuple, got)) == sorted(queue(planned, places, (2, 2), full, least_new, deepest))


def test_a_resumed_campaign_asks_nothing_twice(spark, campaign):
    planned, places, a, b = campaign
    made = spark.createDataFrame([("shop", 0, 0, 0), ("shop", 1, 1, 1)], "text string, depth int, ix long, iy long")
    got = B.subdivided(a, b, BOX, (2, 2), 20, 1, 3, made)
    assert got.join(made, B.KEY).count() == 0 and got.filter("depth = 0").count() == len(planned) - 1
    known = {i for i, t, x, y in places if t == "shop" and x < 4 and y < 2}
    want = queue([p for p in planned if p[:3] != ("shop", 0, 0)], places, (2, 2), 20, 1, 3, known)
    assert sorted(map(tuple, got.drop("place").collect())) == sorted(want)
    assert B.subdivided(a.limit(0), b, BOX, (2, 2)).count() == 0


def test_candidates(spark):
    names = ["The Old Kings Garage Ltd", "Smith & Co", "LIMITED", None, "One", "a b"]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select(N.candidates(N.content_words(F.col("n"))).alias("c")).collect()]
    assert got[0] == [s + e for s in ("oldkingsgarage", "old-kings-garage", "oldkings") for e in N.ENDINGS]
    assert got[1] == ["smith.co.uk", "smith.com", "smith.uk"] and got[2] == got[3] == [] and got[4] == ["one.co.uk", "one.com", "one.uk"]
    assert got[5] == [s + e for s in ("ab", "a-b") for e in N.ENDINGS]


def test_pages_bear_witness(spark):
    companies = spark.createDataFrame([
        (1, "Kings Garage Ltd", "AB1 2CD", "0001"), (2, "Queens Road", None, "0002"), (3, "Third", " ", "SC3"), (4, "Fourth", "ZZ9 9ZZ", None), (5, None, "AB1 2CD", "5"), (6, "Sixth", "", ""),
    ], "id long, name string, postal string, number string")
    pages = spark.createDataFrame([
        ("KingsGarage.com", 1, "<p>call</p>", "We are at ab 12cd, York"), ("kingsgarage.co.uk", 1, "parked", ""), ("queensroad.co.uk", 2, "", "Queens Road Motors"), ("queensroad.co.uk", 1, "", "welcome"),
        ("queens-road.com", 1, "QUEENS ROAD", None), ("third.uk", 1, "Company sc3", ""), ("fourth.com", 1, "", "nothing"), ("sixth.com", 1, "", "empty"),
    ], "domain string, place long, html string, text string")
    got = {r.id: (r.domain, r.matched_on, r.tried) for r in N.resolved(companies, pages).collect()}
    assert got == {
        1: ("kingsgarage.com", "AB1 2CD", 2), 2: ("queens-road.com", "queens road", 5), 3: ("third.uk", "SC3", 3), 4: (None, None, 3), 5: (None, None, 0), 6: (None, None, 3),
    }
