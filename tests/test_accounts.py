"""Goldens of what pages show, of the gate, of merges and of what comes back from outreach."""

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import profiles as G
from tallgrass.functions import sites as S
from tallgrass.operators import company as N
from tallgrass.operators import drafts as D
from tallgrass.operators import letters as L
from tallgrass.operators import outreach as O
from tallgrass.operators import resolve as R
from tallgrass.operators import score as P
from tallgrass.sources.html import structured_people


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("html, want", [
    ('<a href="mailto:Info@Shop.com?subject=a">x</a>', [("info@shop.com", "role")]), ("<p>jo (at) shop (dot) com", [("jo@shop.com", "personal")]), ("strategy.in action", []),
    ("<b>i</b>nfo@shop.com", [("info@shop.com", "role")]), ("<p>ann@shop.com joann@shop.com", [("ann@shop.com", "personal"), ("joann@shop.com", "personal")]),
    ("<script>a@b.com", []), ("<style>x@y.org</style>test@shop.com a@example.com", []), ("", []), (None, None),
])
def test_emails(spark, html, want):
    got = one(spark, html, S.emails)
    assert (got and [tuple(x) for x in got]) == want or (got == [] and want == [])


@pytest.mark.parametrize("text, want", [
    ("Max Sherwin, Owner", [("Max Sherwin", "Owner", "other")]), ("Our team: Director Jane A. Roe and Manager Tom Fox", [("Jane A. Roe", "Director", "team"), ("Tom Fox", "Manager", "team")]),
    ("Owner Best Prices", []), ("Peter Pan 3 weeks ago. Response from the owner", []), ("", []), (None, None),
])
def test_people(spark, text, want):
    got = one(spark, text, lambda c: S.people(c, F.lit("https://a.com/x")))
    assert (got and [tuple(x) for x in got]) == (want or got)
    assert want is None or len(got) == len(want)


def test_page_marks(spark):
    assert one(spark, "you can book your slot", S.booking_text) is True and one(spark, "a book of six long words about the test", S.booking_text) is False
    assert one(spark, "find us on Google", S.review_noise) is False and one(spark, "thank you Google", S.review_noise) is True
    assert one(spark, "more than 20 people, 12 staff", S.headcount) == 20 and one(spark, "no one", S.headcount) is None
    assert one(spark, "IT manager and sales team; head of technology", S.departments) == ["it", "sales"]
    spots = one(spark, "a cat, a cat and cat", lambda c: S.windows(c, "cat"))
    assert [x.start for x in spots] == [2, 9, 17]


def test_gate_and_trim(spark):
    at = F.lit("2026-01-01T10:47:00Z")
    found = D.facts({"city": (F.lit("Leeds"), "maps", at), "hiring": (F.lit("has a live careers/jobs page"), "site", at), "rating": (F.lit(None), "maps", at)})
    e = F.lit("")
    p = D.packet(F.lit("Acme Garage"), F.lit("Leeds"), found, (e, e), (e, e), e, e)

    def reasons(subject, observation, used):
        return spark.range(1).select(D.gate(p, F.lit(subject), F.lit(observation), F.lit(used)).alias("r")).first().r

    assert reasons("A note", "Acme Garage's careers page shows hiring.", "hiring") == []
    assert reasons("", "You had 47 calls in Leeds.", "city") == ["NUMBER:47"]  # a fact's time is no evidence
    assert reasons("", "See Leeds Ltd 1STOP now.", "city") == ["PROPER_NOUN:Leeds Ltd", "PROPER_NOUN:Ltd"]
    assert reasons("", "", None) == ["USED_FACT:none"] and reasons("x" * 61, "in Leeds", "city") == ["LENGTH:subject"]
    assert spark.range(1).select(D.inferred_fact(p, F.lit("x"), F.lit("in leeds it has a live careers/jobs page")).alias("k")).first().k == "hiring"
    kept = spark.range(1).select(D.trimmed(p, 1).alias("a"), D.trimmed(p, 10_000).alias("b"), D.tokens(p).alias("n")).first()
    assert kept.a == [] and len(kept.b) == 2 and kept.n > 60


def test_cascade(spark):
    kind = "id string, key string, place_id string, phone string, name string, postal string"
    stored = spark.createDataFrame([("a", "k1", "p1", "1", "Joes Garage", "A1 1", 1), ("b", "k2", None, "1", "Joes", "B2 2", 2), ("c", "k3", None, "2", "Solo", None, 3)], kind + ", seq int")
    incoming = spark.createDataFrame([
        ("1", "k3", "p1", "1", "x", None), ("2", "n", "p1", None, "x", None), ("3", "n", "p9", "1", "Joes Shop", None), ("4", "n", None, "1", "Joes", None), ("5", "n", None, "1", "Else", "ZZ 1"),
        ("6", "n", None, "2", "Else", "ZZ 1"), ("7", "n", "p8", "2", "Else", None), ("8", None, None, None, None, None),
    ], kind)
    got = {r.id: (r.match_id, r.how) for r in R.match_cascade(incoming, stored).collect()}
    assert got == {
        "1": ("c", "key"), "2": ("a", "place"), "3": ("b", "phone"), "4": ("a", "phone"), "5": (None, "new"), "6": ("c", "phone"), "7": (None, "new"), "8": (None, "new"),
    }
    empty = stored.limit(0)
    assert {r.how for r in R.match_cascade(incoming, empty).collect()} == {"new"}


def test_outreach(spark):
    assert [one(spark, x, O.reply_kind) for x in ("Not interested", "INTERESTED!", "", None)] == ["not_interested", "interested", "other", "other"]
    assert [one(spark, x, lambda c: O.raw_kind(c, F.lit(None))) for x in ("bounce 512", "room 512", "unsubscribe", None)] == ["bounce_hard", "reply", "unsubscribe", "reply"]
    events = spark.createDataFrame([("reply", " A@x.com", "", "t1", "stop", 1), ("reply", "a@x.com", None, "t1", "other", 2), ("bounce_hard", "", "<h>", "t0", "", 3), ("reply", "z@x.com", "", "t", "", 4)], "kind string, email string, message_id string, occurred_at string, body string, seq int")
    messages = spark.createDataFrame([(1, 10, "<h>", "drafted", 1), (2, 11, "<g>", "sent", 1), (3, 11, None, "sent", 2)], "id int, target int, header string, state string, sent_at int")
    contacts = spark.createDataFrame([(11, "a@x.com"), (10, "b@x.com")], "target int, email string")
    found = O.ingested(events, messages, contacts)
    got = {(r.kind, r.email): (r.message, r.target, r.suppress, r.asked) for r in found.collect()}
    assert got == {("reply", "a@x.com"): (3, 11, "reply_optout", "opted_out"), ("bounce_hard", ""): (1, 10, None, "bounced"), ("reply", "z@x.com"): (None, None, None, "replied")}
    targets = spark.createDataFrame([(10, "approved"), (11, "sent"), (12, "sent")], "target int, state string")
    assert {tuple(r) for r in O.states_after(targets, found).collect()} == {(10, "approved"), (11, "opted_out"), (12, "sent")}


def test_fit_of_an_unknown_account(spark):
    none = F.lit(None)
    fit = P.account_fit(none.cast("array<string>"), ["cars"], none.cast("int"), F.lit(True), none.cast("long"), none.cast("array<struct<text:string,strength:string,date:string>>"), none.cast("array<string>"), [none, none, none], [none, none, none], none.cast("string"))
    r = spark.range(1).select(*[v.alias(k) for k, v in fit.items()]).first()
    assert (r.total, r.grade, r.confidence, r.industry) == (0.0, "D", 0, False)


@pytest.mark.parametrize("html, want", [
    ('<script type="application/ld+json">{"@type": "Event", "organizer": {"@type": "Person", "name": "A B"}, "performer": [{"@type": "Person", "name": "C D", "email": ["x", "c@d.org"]}, {"@type": "Organization", "name": "Org"}]}</script>',
     [("A B", "", "event", [], []), ("C D", "", "event", [], ["c@d.org"])]),
    ('<script type="application/ld+json">{"@type": "ProfilePage", "mainEntity": {"@type": ["Thing", "Person"], "name": "E F", "telephone": {"value": " 1  2 "}}}</script>', [("E F", "", "profile", ["1 2"], [])]),
    ('<div class="card team-member-x"><h3>G H</h3><p class="position">Boss</p><a href="tel:123?x">t</a></div><div class="vcard"><span itemprop="name">g h</span><b class="title">boss</b><a class="tel" title="12 4">x</a></div>', [("G H", "Boss", "structured", ["123", "12 4"], [])]),
    ("".join(f'<div class="employee"><h2>N {i}</h2></div>' for i in range(9)), [(f"N {i}", "", "structured", [], []) for i in range(8)]),
    ('<div class="vcard"><b class="fn">one two three four five six seven</b></div><script type="application/ld+json">[1, "x", null, {"@type": null}]</script>', []), ("<b>" * 5000, []), ("", []),
])
def test_structured_people(html, want):
    assert structured_people(html) == want


def test_profiles_of_nothing(spark):
    row = spark.range(1).select(
        G.card(F.lit(" "), F.lit(""), F.lit(None).cast("array<string>"), F.lit(None)).alias("none"), G.card(F.lit("A"), F.lit(None), F.lit(None).cast("array<string>"), F.lit("https://a.com")).alias("card"),
        G.appointments(F.lit(None).cast(G.ABOUT)).alias("a"), G.signed_names(F.lit(None).cast("array<struct<reviewer:string,text:string>>"), F.lit(None).cast("string")).alias("s"),
        G.map_category(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), [])[0].alias("c"), G.display_phone(F.lit("+447911123456")).alias("p"), G.display_phone(F.lit(None).cast("string")).alias("q"),
        G.any_mobile(F.lit(None).cast("array<string>")).alias("m"), G.locality(F.lit(None).cast("string"), F.lit(None).cast("string"))[0].alias("l"),
    ).first()
    assert row.none is None and row.card.name == "A" and row.card.website == "https://a.com" and row.card.phone is None and row.card.category is None
    assert (row.a, row.s, row.c, row.p, row.q, row.m, row.l) == ("none", None, None, "+44 7911 123456", "", False, "")


def test_company_of_unknowns(spark):
    none = lambda kind: F.lit(None).cast(kind)
    c = N.Company(none("array<string>"), none("date"), none("array<date>"), none("boolean"), none("boolean"), none("string"), none("string"), none("boolean"))
    row = N.scored(spark.range(1), c, ["1"], F.lit("2025-01-01").cast("date")).first()
    assert (row.total, row.tier) == (9.5, "C") and [f.why for f in row.factors] == ["no trade codes", "age unknown", "no officers on file", "site not crawled", "no domain", ""]
    points, why = N.contactability(none("boolean"), F.lit(True), none("boolean"), F.lit(False))
    assert tuple(spark.range(1).select(points, why).first()) == (30, "e-mail")


def test_letters(spark):
    with pytest.raises(ValueError, match="b, c"):
        L.letter("{{a}} {{b}} {{c}}", {"a": F.lit("x")})
    body = L.letter("\n {{a}}-{{b}}\n", {"a": F.lit("x {{b}}"), "b": F.lit(None).cast("string")})
    assert spark.range(1).select(body.alias("t")).first().t == "x {{b}}-\n"


def test_windows_and_people_of_long_pages(spark):
    """Places by running sums over thousands of matches, with characters of several bytes, and people across the pieces of a text."""
    import random
    import re
    import time

    r = random.Random(1)
    words = ["Owner é", "director", "xx", "zz ", "日本", "Manager"]
    long = " ".join(r.choice(words) for _ in range(6000))
    rows = spark.createDataFrame([(long,), ("",), ("Owner",), (None,)], "t string")
    got = [r.w if r.w is None else [tuple(x) for x in r.w] for r in rows.select(S.windows(F.col("t"), S.TITLES).alias("w")).collect()]
    assert got == [[(m.start(), m[0]) for m in re.finditer(S.TITLES, long)], [], [(0, "Owner")], None]
    name = lambda i: "Jo" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    page = "".join(f"Owner {name(i)} Doe ok é. " for i in range(20_000))
    big = spark.createDataFrame([(page,)], "t string")
    began = time.time()
    found = big.select(S.people(F.col("t"), F.lit("https://x.com/"), 20_000).alias("p")).first().p
    assert [p.name for p in found] == [f"{name(i)} Doe" for i in range(17_576)] and {p.title for p in found} == {"Owner"}
    assert time.time() - began < 60
