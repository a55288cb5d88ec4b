"""Picks without judgement, approval of exact words, doubts at the time of sending."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import deciders as D
from tallgrass.operators import sending as S


def test_people_of_profiles(spark):
    named = [("b", "credit", 1, "ann"), ("b", "signature", 2, "ANN"), ("b", "signature", 3, "Ann"), ("b", "credit", 4, "Bob"), ("b", "credit", 5, "BOB"), ("b", "credit", 6, "Bob"), ("b", "credit", 7, "Cy"), ("b", "credit", 8, ""), ("b", "signature", 9, None), ("c", "credit", 1, "Dee")]
    known = spark.createDataFrame([("b", "CY"), ("x", "Dee")], "business string, name string")
    df = spark.createDataFrame(named, "business string, kind string, position int, name string").repartition(3)
    got = {tuple(r) for r in D.profile_people(df, known).collect()}
    assert got == {("b", "ANN", "signed an owner reply on Google"), ("b", "Bob", "credited by customers in 2 reviews"), ("c", "Dee", "credited by customers in 1 review")}


def test_backlogs(spark):
    profiles = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "business string, facts string")
    people = spark.createDataFrame([("a", "site", 1, "Ann"), ("c", "gbp", 0, "Cy")], "business string, origin string, is_dm int, name string")
    assert [r.business for r in D.profile_backlog(profiles, people).collect()] == ["a"]
    businesses = spark.createDataFrame([("a", "a.com"), ("b", None)], "business string, domain string")
    contacts = spark.createDataFrame([("a", "email", "valid")], "business string, kind string, tier string")
    assert [tuple(r) for r in D.inference_backlog(businesses, people, contacts).collect()] == [("a", "a.com", "Ann")]
    more = contacts.union(spark.createDataFrame([("a", "email", "inferred")], "business string, kind string, tier string"))
    assert D.inference_backlog(businesses, people, more).count() == 0


def test_picks_of_the_register(spark):
    people = [("one", "Ann Lee", "registry", 0), ("one", "Nominees Ltd", "registry", 0), ("two", "A", "registry", 0), ("two", "B", "registry", 0), ("chosen", "A", "registry", 0), ("chosen", "Z", "agent", 1), ("gone", "A", "registry", 0), ("site", "A", "site", 0), ("none", None, "registry", None)]
    profiles = spark.createDataFrame([(b, "ACTIVE") for b in ("one", "two", "chosen", "site", "none")] + [("gone", "dissolved")], "business string, status string")
    got = [tuple(r) for r in D.register_picks(spark.createDataFrame(people, "business string, name string, labeled_by string, is_dm int"), profiles).collect() if r.name]
    assert got == [("one", "Ann Lee")]


def test_picks_by_title_and_number(spark):
    people = [("a", 1, "Shop Owner", 0), ("a", 2, "clerk", 0), ("b", 3, "owner", 0), ("b", 4, "co-owner", 0), ("c", 5, "owner", 0), ("c", 6, "owner", 0), ("d", 7, "owner", 0), ("d", 8, None, -1), ("e", 9, None, 0), ("f", 10, "owner", 0), ("f", 11, "owner", 0)]
    routes = spark.createDataFrame([("b", 4), ("b", 4), ("c", 5), ("c", 6), ("e", 9), ("x", 10)], "business string, person int")
    df = spark.createDataFrame(people, "business string, person int, title string, is_dm int")
    assert {tuple(r) for r in D.heuristic_picks(df, routes, ["Owner", ""]).collect()} == {("a", 1, 0.55, "heuristic_auto"), ("b", 4, 0.65, "heuristic_route")}
    assert D.heuristic_picks(df, routes, []).count() == 0


def test_readiness(spark):
    df = spark.createDataFrame([(True, True, "x"), (True, None, None), (None, True, "x"), (False, True, "")], "v boolean, n boolean, s string")
    assert [r.x for r in df.select(D.call_readiness(F.col("v"), F.col("n"), F.col("s")).alias("x")).collect()] == ["READY - named contact", "READY - ask switchboard", "UNVERIFIED PHONE - confirm number", "NO PHONE - research first"]


@pytest.fixture(scope="module")
def outgoing(spark):
    messages = [(1, 10, "drafted", "h1", None, None), (2, 10, "sent", "h2", "h2", "bo"), (3, 11, "drafted", "h3", "old", None), (4, 12, "drafted", "h4", None, None), (5, 13, "approved", "new", "old", "bo"), (6, 14, "drafted", None, None, None)]
    targets = [(10, "m", "A", "drafted"), (11, "m", "B", "enrolled"), (12, "other", "A", "drafted"), (13, "m", "A", "approved"), (14, "m", "A", "sent")]
    return spark.createDataFrame(messages, "id long, target long, state string, draft_hash string, approved_hash string, approved_by string"), spark.createDataFrame(targets, "id long, campaign string, tier string, state string")


@pytest.mark.parametrize("how, ids, moved", [({"tier": "A"}, {1, 6}, {10}), ({"ids": [3, 4]}, {3}, set()), ({"all_drafted": True}, {1, 3, 6}, {10})])
def test_approvals(outgoing, how, ids, moved):
    after, targets = S.approved(*outgoing, "m", "ann", **how)
    rows = {r.id: r for r in after.collect()}
    assert {i for i, r in rows.items() if r.approved_by == "ann"} == ids and all(rows[i].state == "approved" and rows[i].approved_hash == rows[i].draft_hash for i in ids)
    assert rows[2].state == "sent" and rows[5].approved_by == "bo" and len(rows) == 6
    before = {r.id: r.state for r in outgoing[1].collect()}
    assert {r.id for r in targets.collect() if r.state != before[r.id]} == moved
    held = {r.id: (r.state, r.holds) for r in S.still_approved(after).collect()}
    assert held[5] == ("drafted", False) and held[2] == ("sent", True) and all(held[i] == ("approved", True) for i in ids - {6})


@pytest.mark.parametrize("how", [{}, {"tier": "A", "all_drafted": True}, {"ids": [1], "tier": "A"}])
def test_approvals_need_one_choice_and_a_name(outgoing, how):
    with pytest.raises(ValueError, match="exactly one"):
        S.approved(*outgoing, "m", "ann", **how)
    with pytest.raises(ValueError, match="a name"):
        S.approved(*outgoing, "m", " ", all_drafted=True)


def test_doubts_at_the_time_of_sending(spark):
    eligible = spark.createDataFrame([(1, "a", True, []), (2, "b", True, []), (3, "c", True, []), (4, None, False, ["suppressed"]), (5, "e", False, ["site_dead"])], "business long, email string, eligible boolean, reasons array<string>")
    confirmed = spark.createDataFrame([(1, "a"), (1, "a"), (3, "c"), (2, "other")], "business long, email string")
    seen = spark.createDataFrame([(1, "a", "2025-02", ""), (3, "c", "", "2024-12"), (3, "c", None, None), (5, "e", "2024-01", None)], "business long, value string, recheck_at string, fresh_until string")
    got = {r.business: (r.eligible, r.reasons) for r in S.rechecked(eligible, confirmed, seen, F.lit("2025-01")).collect()}
    assert got == {1: (True, []), 2: (False, ["email_unconfirmed"]), 3: (False, ["email_stale"]), 4: (False, ["suppressed"]), 5: (False, ["site_dead", "email_unconfirmed", "email_stale"])}
    loose = {r.business: r.eligible for r in S.rechecked(eligible, confirmed, seen, F.lit("2025-01"), need_confirmation=False).collect()}
    assert loose[2] and not loose[3]


def test_policies(spark):
    df = spark.createDataFrame([("gb ",), ("de",), (None,)], "c string").select(S.policy(F.col("c")).alias("p")).collect()
    assert [(r.p.jurisdiction, r.p.allowed, len(r.p.sources)) for r in df] == [("GB", True, 4), ("DE", False, 0), ("UNKNOWN", False, 0)]
