"""Profiles as data: what is refused, what overrides do, every factor's steps, and dispatch by name."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import rubric as B


@pytest.mark.parametrize("campaign, said", [
    ({"colour": 1}, "unknown settings"), ({"soft": "hiring"}, "soft must be"), ({"min_reviews": True}, "min_reviews must be"), ({"hard": ["no_fax"]}, "no_fax"), ({"hard": ["competitor:"]}, "competitor"),
    ({"weights_override": {"size_match": -1}}, "weights"), ({"weights_override": {"size_match": "x"}}, "weights"),
])
def test_settings_are_checked(campaign, said):
    with pytest.raises(ValueError, match=said):
        B.settled(campaign)


def test_rubrics_are_checked():
    with pytest.raises(ValueError, match="unknown factors"):
        B.settled({}, B.DEFAULT | {"factors": {"luck": 5}})
    with pytest.raises(ValueError, match="tier A"):
        B.settled({}, B.DEFAULT | {"tiers": {"a_min": 10, "b_min": 60}})


def test_overrides_and_hashes():
    p = B.settled({"weights_override": {"size_match": 40, "luck": 3}, "soft": ["hiring"]})
    assert p["factors"]["size_match"] == 40 and "luck" not in p["factors"] and B.DEFAULT["factors"]["size_match"] == 10
    assert B.profile_hash(p) == B.profile_hash(dict(reversed(p.items()))) != B.profile_hash(B.settled({}))


ROWS = [
    (1, "Kings Garage", "MOT centre", None, "+1", "x.com", 4.5, 30, "Leeds", "GB", "p", True, True, {"careers": True, "stale_site": True}, "2019", None), (2, "Group of Firms", None, ["Tyre shop"], None, None, 3.0, 60, None, "us", None, None, None, None, None, "phone:+1"),
    (3, None, "Community centre", [], "+2", "", None, None, "York", "United Kingdom", "", False, False, {}, None, None), (4, "Acme Ltd", "bakery", None, "+3", "y.com", 0.0, 5, "", None, None, None, True, {"https": False}, None, None),
]
SCHEMA = "id int, name string, category string, categories array<string>, phone string, website string, rating double, reviews long, city string, country string, place_id string, registry boolean, crawled boolean, signals map<string,boolean>, copyright_year string, chain string"
CAMPAIGN = {
    "categories": ["mot centre"], "aliases": {"cars": {"exact": ["garage", "mot centre"], "adjacent": ["tyre shop"]}}, "min_reviews": 10, "max_reviews": 50, "areas": ["Leeds, England"], "country": "uk", "offer": "calls",
    "hard": ["competitor:acme", "no_phone"], "soft": ["stale_site", "hiring", "website_missing", "low_rating_high_volume", "few_reviews", "website_no_ssl"],
}


def test_scores(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.id: r for r in B.scored(df, CAMPAIGN).collect()}
    points = lambda i: {f.name: f.points for f in got[i].factors}
    assert points(1) == {"industry_match": 25.0, "need_signals": 25.0, "size_match": 10.0, "geography_match": 10.0, "business_model": 8.0, "data_confidence": 20.0}
    assert got[1].total == 98.0 and got[1].tier == "A" and got[1].negatives == [] and got[1].hooks == ["Copyright year on the site is 2019 (looks unmaintained) — refresh angle for: calls", "Actively hiring — growing and likely budgeted"]
    assert points(2) == {"industry_match": 15.0, "need_signals": 25.0, "size_match": 3.0, "geography_match": 5.0, "business_model": 3.0, "data_confidence": 6.0}
    assert [(n.name, n.points) for n in got[2].negatives] == [("franchise_or_chain", -25.0), ("out_of_area", -20.0), ("chain_member", -15.0)]
    assert got[2].total == 17.0 and got[2].tier == "DQ" and got[2].disqualified == "no_phone"
    assert points(3)["industry_match"] == 2.5 and points(3)["size_match"] == 4.0 and got[3].disqualified is None and got[3].negatives == []
    assert got[4].disqualified == "competitor:acme" and got[4].hooks == ["Site has no HTTPS — easy credibility pitch alongside: calls", "Almost no reviews — visibility/marketing angle"] and points(4)["geography_match"] == 5.0
    assert {r.profile for r in got.values()} == {B.profile_hash(B.settled(CAMPAIGN))} and "n_people" not in got[1].asDict()


def test_factors_of_older_rubrics(spark):
    df = spark.createDataFrame([(1, "Ann", 2, "valid", "+1"), (2, "", 2, "valid", None), (3, None, 0, None, "+1"), (4, None, None, "inferred", ""), (5, None, None, None, None)], "id int, dm_name string, n_people int, email_tier string, phone string")
    old = B.DEFAULT | {"factors": {"dm_identified": 10, "verified_direct_contact": 10}}
    assert [[f.points for f in r.factors] for r in B.scored(df, {}, old).orderBy("id").collect()] == [[10.0, 10.0], [3.0, 6.0], [0.0, 4.0], [0.0, 2.0], [0.0, 1.0]]


def test_dispatch(spark):
    B.register("flat", lambda rows, p: rows.withColumn("total", F.lit(float(p["tiers"]["a_min"]))))
    df = spark.createDataFrame([(1,)], "id int")
    assert B.scored(df, {"profile": "flat"}).first().total == 80.0 and B.scored(df, {"profile": "lost"}).first().tier == "C"
    del B.PROFILES["flat"]
