"""The similarity join and the register lookup against plain versions."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import similar as M

NAMES = [
    "A B S MOT Station", "ABS MOT STATION LTD", "Weiß & Söhne GmbH", "Weiss Sohne", "The Company Ltd", "", None, "garage", "Garage Services Limited", "garage garage", "x", "12345", "12354", "Straße 7",
    "kings road motors", "king's road motor co", "MOTORS KINGS ROAD", "aaaaaaaaaa", "aaaa", "abababab", "babababa",
]


def names(seed, n):
    r = random.Random(seed)
    words = ["garage", "motors", "road", "kings", "queens", "tyre", "auto", "service", "mot", "best", "city", "lane", "ford", "fort"]
    return [" ".join(r.choices(words, k=r.randint(1, 4))) + r.choice(["", " Ltd", "s", " 1"]) for _ in range(n)]


def key(name):
    folded = (name or "").lower().replace("ß", "ss")
    return " ".join(sorted({t for t in re.split(r"[^a-z0-9]+", folded) if t and t not in M.LEGAL_TOKENS}))


def likeness(a, b, ratio=True):
    x, y = set(a.split()), set(b.split())
    j = len(x & y) / len(x | y)
    r = difflib.SequenceMatcher(None, a.replace(" ", ""), b.replace(" ", "")).ratio() if ratio else 0
    return round(max(j, r), 3)


def test_keys(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = rows.select("n", M.name_key(F.col("n")).alias("k"), F.size(M.characters(M.name_key(F.col("n")))).alias("c")).collect()
    assert all(r.k == key(r.n) and r.c == len(key(r.n).replace(" ", "")) for r in got)


@pytest.mark.parametrize("threshold", [0.3, 0.45, 0.6, 0.85, 1.0])
@pytest.mark.parametrize("ratio", [True, False])
def test_every_pair_at_the_threshold(spark, threshold, ratio):
    left = sorted({(i % 2, key(n)) for i, n in enumerate(NAMES + names(1, 60))})
    right = sorted({(i % 2, key(n)) for i, n in enumerate(names(2, 60) + NAMES)})
    a, b = (spark.createDataFrame(rows, "block int, key string").repartition(3) for rows in (left, right))
    got = {(r.block, r.a, r.b, r.similarity) for r in M.similar_keys(a, b, threshold, ["block"], ratio).collect()}
    want = {(p, x, y, s) for p, x in left for q, y in right if p == q and x and y and (s := likeness(x, y, ratio)) >= threshold}
    assert {g[:3] for g in got} == {w[:3] for w in want}
    if ratio:
        assert got == want
    assert M.similar_keys(a.filter("block > 5"), b, threshold, ["block"], ratio).count() == 0


def test_common_words_make_no_pairs(spark):
    """A word that all names share stands in no prefix where nearly all words must agree."""
    rows = spark.createDataFrame([(f"firm a{i} b{i} c{i}",) for i in range(400)], "key string")
    assert M._by_words(rows, rows, [], 0.6).count() == 400
    assert M.similar_keys(rows, rows, 0.6, ratio=False).count() == 400


COMPANIES = [
    ("c1", "ABS MOT STATION LTD", "1 High St, York, YO1 7HH", "active"), ("c2", "A B S Mot Stations", "2 High St, York, YO1 7HH", "dissolved"), ("c3", "ABS MOT Station", "Leeds LS1", "active"),
    ("c4", "Unrelated Holdings", "3 High St, York", "active"), (None, "A B S MOT Station", "York", "active"), ("c6", "A B S MOT Station", "York", None), ("c7", None, "York", "active"), ("c8", "ABS MOT STATION", "New York City", "Active"),
]


def test_registry_lookup(spark):
    listings = [("l1", "A B S MOT Station", "York", None), ("l2", "A B S MOT Station", None, "ls1 "), ("l3", "Bakery", "York", None), ("l4", None, "York", None), ("l5", "ABS MOT Station", None, None), ("l6", "abs mot station", "new york", "")]
    a = spark.createDataFrame(listings, "id string, name string, city string, postal string")
    b = spark.createDataFrame(COMPANIES, "number string, name string, address string, status string")
    got = {r.id: (r.number, r.similarity) for r in M.registry_lookup(a, b).collect()}
    s = lambda x, y: likeness(key(x), key(y))
    assert got == {"l1": ("c1", s("A B S MOT Station", "ABS MOT STATION LTD")), "l2": ("c3", s("A B S MOT Station", "ABS MOT Station")), "l6": ("c8", 1.0)}
    loose = {r.id: r.number for r in M.registry_lookup(a, b, active_only=False).collect()}
    assert loose["l1"] == "c6"
    assert M.registry_lookup(a, b.filter("number = 'none'")).count() == 0
    people = spark.createDataFrame([("c1", "SMITH, John", "company-secretary", None), ("c1", "Gone, Al", "director", "2020"), ("c3", " ", "director", None)], "number string, name string, role string, left string")
    assert [tuple(r) for r in M.officers(M.registry_lookup(a, b), people).collect()] == [("l1", "c1", "John Smith", "Company Secretary")]


def test_substrings_held(spark):
    r = random.Random(4)
    texts = sorted({"".join(r.choices("ab ", k=r.randint(1, 9))) for _ in range(120)})
    parts, wholes = spark.createDataFrame([(t,) for t in texts], "part string"), spark.createDataFrame([(t,) for t in texts], "whole string")
    assert {tuple(x) for x in M.substrings_held(parts, wholes).collect()} == {(p, w) for p in texts for w in texts if p in w}
