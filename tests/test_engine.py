"""Goldens and small cases of functions, operators, sources and stages."""

import json

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import cards as K
from tallgrass.functions import text as T
from tallgrass.operators import contacts as C
from tallgrass.operators import lifecycle as L
from tallgrass.operators import planning as P
from tallgrass.operators import resolve as R
from tallgrass.operators import retrieve as V
from tallgrass.operators import stages
from tallgrass.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw, want", [("Joe's Auto Repair, LLC", "joes auto repair"), ("  ACME   Ltd. ", "acme"), ("", ""), (None, None)])
def test_norm_name(spark, raw, want):
    assert one(spark, raw, T.norm_name) == want


@pytest.mark.parametrize("raw, want", [
    ("HTTP://Shop.Example.com/a/?utm_source=x&b=1#f", "http://shop.example.com/a?b=1"), ("example.com/", "https://example.com"),
    ("https://www.facebook.com/joe", None), ("", None), (None, None),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, raw, T.canonical_url) == want


@pytest.mark.parametrize("raw, want", [("shop.bar.co.uk", "bar.co.uk"), ("www.bar.com:8080", "bar.com"), ("a.b.c.de", "c.de"), ("localhost", "localhost")])
def test_apex_domain(spark, raw, want):
    assert one(spark, raw, T.apex_domain) == want


@pytest.mark.parametrize("raw, region, want", [("(713) 555-0100", "US", "+17135550100"), ("020 7946 0958", "GB", "+442079460958"), ("+49 30 123456", "US", "+4930123456"), ("123", "US", None), (None, "US", None)])
def test_e164(spark, raw, region, want):
    assert one(spark, raw, lambda c: T.e164(c, region)) == want


def test_names_and_cells(spark):
    assert one(spark, "SMITH, Jane", T.natural_name) == "Jane Smith"
    assert one(spark, "=1+1", T.safe_cell) == "'=1+1"
    assert one(spark, "<p>a<script>x</script>b<style>never closed", T.html_text) == "a b" or one(spark, "<p>a<script>x</script>b<style>never closed", T.html_text) == "ab"


@pytest.mark.parametrize("email, mx, want", [("info@a.com", True, "role"), ("j@a.com", True, "valid"), ("j@a.com", None, "unknown"), ("j@a.com", False, "invalid"), ("test@a.com", True, "invalid"), ("nonsense", True, "invalid")])
def test_email_tier(spark, email, mx, want):
    assert spark.createDataFrame([(email, mx)], "e string, m boolean").select(C.email_tier(F.col("e"), F.col("m")).alias("y")).first().y == want


@pytest.mark.parametrize("email, domain, want", [("a@x.com", "x.com", "own_domain"), ("a@m.x.com", "x.com", "own_domain"), ("a@y.com", "x.com", "foreign"), ("joes@gmail.com", "x.com", "freemail_linked"), ("a@gmail.com", "x.com", "freemail_unlinked")])
def test_affinity(spark, email, domain, want):
    df = spark.createDataFrame([(email, domain)], "e string, d string")
    assert df.select(C.email_affinity(F.col("e"), F.col("d"), F.lit("Joes Garage")).alias("y")).first().y == want


def test_richest_merge(spark):
    df = spark.createDataFrame([("k", 1, "", 4.0, "a"), ("k", 2, "x", None, "b"), ("k", 3, "y", 2.0, "a")], "key string, seq int, name string, rating double, cat string")
    r = R.richest_merge(df, "key", "seq", ["name"], ["rating"], ["cat"]).first()
    assert (r.name, r.rating, r.cat, r.n_rows) == ("x", 2.0, "a,b", 3)


def test_unique_hits(spark):
    target = spark.createDataFrame([("1", "a", "p"), ("2", "b", "p"), ("3", "b", "q")], "id string, domain string, phone string")
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "q"), (3, None, "q"), (4, None, "p"), (5, "z", "z")], "n int, domain string, phone string")
    got = {r.n: (r.match_id, r.reason) for r in R.unique_hits(rows, target, ["domain", "phone"]).collect()}
    assert got == {1: ("1", "domain"), 2: (None, "ambiguous:domain"), 3: ("3", "phone"), 4: (None, "ambiguous:phone"), 5: (None, "unmatched")}


def test_phone_matches_one_listing_each(spark):
    a = spark.createDataFrame([("m1", "1", "Joes Garage", "AB1 1CD", 2), ("m2", "1", "Joes Garage", "AB1 1CD", 1)], "id string, phone string, name string, postal string, seq int")
    b = spark.createDataFrame([("r1", "1", "JOES", "ZZ9 9ZZ", 0), ("r2", "1", "Other", "QQ1 1QQ", 0)], "id string, phone string, name string, postal string, seq int")
    assert [(r.drop_id, r.keep_id) for r in R.phone_matches(a, b).collect()] == [("r1", "m2")]


def test_tiles(spark):
    t = P.tiles(spark, (0.0, 0.0, 1.0, 1.0), 30.0, 100)
    assert t.count() == 16
    kids = P.children(t)
    assert kids.count() == 64 and kids.first().depth == 1
    assert P.grid_shape((0, 0, 1, 1), 30.0, 5)[2] > 30.0


def test_lifecycle():
    state = L.FIRST
    for asked in ("approved", "drafted", "approved", "queued", "bounced", "sent", "bounced", "replied"):
        state = L.step(state, asked)
    assert state == "bounced"


def test_bm25_prefers_the_holder(spark):
    docs = spark.createDataFrame([(1, "red boat sails"), (2, "blue car drives"), (3, "red car stands"), (4, None), (5, "a b")], "id int, text string")
    q = spark.createDataFrame([(9, "red boat")], "id int, text string")
    asked = V.terms(q, "id", "text")
    weighted = V.weights(V.postings(docs, "id", "text", asked))
    scores = V.bm25(weighted, asked)
    top = V.top_k(scores, 1).first()
    assert top.doc == 1 and top.score > 0 and scores.count() == 2
    found = V.holders(weighted, docs, q)
    assert [tuple(r) for r in found.collect()] == [(9, 1)]
    assert [tuple(r) for r in V.best_places(scores, found).collect()] == [(9, 1)]
    assert [tuple(r) for r in V.best_places(scores, found.withColumn("doc", F.lit(3))).collect()] == [(9, 2)]


def test_holders_need_whole_passages(spark):
    docs = spark.createDataFrame([(1, "xthe old red boats sailed"), (2, "the old red boat"), (3, "old red"), (4, "red old the boat")], "id int, text string")
    q = spark.createDataFrame([(7, "the old red boat"), (8, "he old re"), (9, "old red"), (10, "zzz")], "id int, text string")
    weighted = V.weights(V.postings(docs, "id", "text", V.terms(q, "id", "text")))
    assert {tuple(r) for r in V.holders(weighted, docs, q).collect()} == {(7, 1), (7, 2), (8, 1), (8, 2), (9, 1), (9, 2), (9, 3)}


def test_nearest_takes_sound_vectors_only(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.0]), (10, [])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = V.top_k(V.nearest(v, v.withColumn("bonus", F.lit(0.0)), 2), 2)
    assert sorted((r.query, r.doc, r.score) for r in got.collect()) == [
        (1, 1, 1.0), (1, 9, 1.0), (2, 2, 1.0), (2, 3, 0.707107), (3, 1, 0.707107), (3, 3, 1.0), (8, 8, 1.0), (9, 1, 1.0), (9, 9, 1.0),
    ]
    assert V.nearest(v.filter("id < 0"), v.withColumn("bonus", F.lit(0.0)), 2).count() == 0


@pytest.mark.parametrize("text, want", [
    ("intro\n# One \nbody\n\n## Two\n\n# Three\nx\r\ny", [("doc", 1, 1, "intro"), ("One", 2, 4, "body"), ("Three", 7, 9, "x\ny")]), ("", [("doc", 1, 1, "")]), ("# A", [("doc", 1, 1, "# A")]),
    ("### deep", [("doc", 1, 1, "### deep")]), (None, None),
])
def test_heading_chunks(spark, text, want):
    got = one(spark, text, lambda c: V.heading_chunks(c, F.lit("doc")))
    assert (got and [tuple(x) for x in got]) == want


def test_index_changes(spark):
    rows, index = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, d string"), spark.createDataFrame([(2, "x"), (3, None), (4, "y")], "k int, d string")
    assert {tuple(r) for r in V.index_changes(rows, index, "k", "d").collect()} == {(1, "new"), (2, "changed"), (3, "unchanged"), (4, "gone")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"title": "A", "tel": ""}\nnot json\n{"title": "B", "phone": "2"}\n')
    rows = files.read_listings(spark, str(tmp_path / "l.json"), "title string, tel string, phone string")
    good, bad = files.quarantined(rows, F.col("_bad").isNull())
    assert (len(good.collect()), len(bad.collect())) == (2, 1)
    assert {tuple(r) for r in files.mapped(good, {"name": ["title"], "phone": ["tel", "phone"], "site": ["web"]}).collect()} == {("A", None, None), ("B", "2", None)}
    (tmp_path / "r.csv").write_bytes("Site_Number,Trading_Name,Town,Postcode,Phone\n1,Joe\x92s, leeds ,LS1,0\n".encode("latin-1"))
    assert files.read_register(spark, str(tmp_path / "r.csv"), "Leeds").first().Trading_Name == "Joe’s"
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_register(spark, str(tmp_path / "x.csv"))
    (tmp_path / "lab.txt").write_text('{"biz": "b1", "pick": 2}\nb2\t0\nnoise\n')
    assert {tuple(r) for r in files.read_labels(spark, str(tmp_path / "lab.txt")).collect()} == {("b1", 2), ("b2", 0)}
    files.write_sheet(good.select("title", "tel"), str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {("A", "-"), ("B", "-")}
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string"), spark.createDataFrame([(2, 2, "c")], "k int, at int, v string")
    assert {tuple(r) for r in files.upserted(old, new, ["k"], "at").collect()} == {(1, 1, "a"), (2, 2, "c")}



def test_stages_resume(spark, tmp_path):
    plan = [("double", lambda s, d: d.withColumn("id", F.col("id") * 2)), ("keep", lambda s, d: d.filter("id > 2"))]
    rows, ran = stages.run_stages(spark, spark.range(4), plan, str(tmp_path))
    assert ran == ["double", "keep"] and rows.count() == 2
    assert stages.run_stages(spark, spark.range(4), plan, str(tmp_path))[1] == []


@pytest.mark.parametrize("line, want", [("4.5 (1,234)", (4.5, 1234)), ("5", (5.0, None)), ("Open now", (None, None)), (None, (None, None))])
def test_rating_line(spark, line, want):
    df = spark.createDataFrame([(line,)], "x string")
    a, b = K.rating_line(F.col("x"))
    assert tuple(df.select(a.alias("a"), b.alias("b")).first()) == want


@pytest.mark.parametrize("text, want", [("please book a table now", True), ("book one two three four table", False), ("table to book", True), ("booking a table", False), ("", False)])
def test_near_words(spark, text, want):
    assert one(spark, text, lambda c: K.near_words(c, "book", "table", 4)) is want


def test_cards(spark):
    assert one(spark, "dc576aff5f40dc49", K.hex_to_decimal) == "15877276656365263945"
    assert one(spark, "https://x.example/url?q=https%3A%2F%2Fa.b%2Fc&sa=1", K.unwrap_redirect) == "https://a.b/c"
    assert one(spark, "Open · Closes 5 · 020 7946 0958", K.last_segment_phone) == "020 7946 0958"
    assert one(spark, "Left VM", K.outcome) == "voicemail" and one(spark, "Gate Keeper!", K.outcome) == "gate_keeper"
    assert one(spark, 3725, K.duration, "int") == "1h 2m"
