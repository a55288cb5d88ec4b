"""Queries over whole listing cards, profiles, people on pages, companies and letters; what they read follows from the tables' keys."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import profiles as G
from ..operators import company as N
from ..operators import letters as L
from ..sources.html import structured_people as people_of
from .accounts import pages_with, pick, text
from .base import businesses, query, table, with_businesses


@query(with_businesses("""
SELECT id, name, CAST(seq AS VARCHAR) AS cid, CAST('51.' || (100 + reviews) AS DOUBLE) AS lat, -0.25::DOUBLE AS lng, rating, CASE WHEN rating IS NOT NULL THEN reviews END AS reviews, category, CASE WHEN phone IS NOT NULL THEN reviews || ' High St' END AS street,
  CASE WHEN reviews % 2 = 0 THEN 'Closed' ELSE 'Open 24 hours' END AS open_state, phone, 'https://' || domain || '/' AS website, CASE WHEN phone IS NOT NULL THEN reviews || ' High St, ' || city END AS address FROM businesses"""))
def card_rows(spark, sf_dir):
    """Listing cards read whole: lines, address and redirected site."""
    k, phone = F.col("reviews"), F.col("phone")
    about = F.concat(F.col("category"), F.lit(" ·  · "), F.coalesce(F.when(phone.isNotNull(), text(k, " High St")), F.lit("")))
    lines = F.array(F.coalesce(text(F.col("rating"), " (", F.format_number(k, 0), ")"), F.lit("No reviews")), F.concat_ws(" · ", F.when(k % 2 == 0, "Closed").otherwise("Open 24 hours"), F.when(k % 2 == 0, "Opens 8:30 AM Thu"), phone), about)
    href = text("https://maps.example/place/x/!1s0xab12:0x", F.lower(F.hex("seq")), "!3d51.", k + 100, "!4d-0.25")
    site = F.concat(F.lit("https://search.example/url?q="), F.url_encode(F.concat(F.lit("https://"), "domain", F.lit("/"))), F.lit("&sa=U"))
    b = businesses(spark, sf_dir).withColumn("c", G.card(F.concat(F.lit(" "), "name"), href, lines, site))
    town, _ = G.locality(F.concat(F.lit("shops in the Arcade in "), "city", F.lit(", United Kingdom")), F.lit(""))
    return b.select("id", "c.name", "c.cid", "c.lat", "c.lng", "c.rating", "c.reviews", "c.category", "c.street", "c.open_state", "c.phone", "c.website", G.full_address(F.col("c.street"), town).alias("address"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 2 THEN '' ELSE n_name END AS town, CASE n_nationkey % 3 WHEN 0 THEN 'UK' END AS country FROM nation""")
def search_localities(spark, sf_dir):
    """Town and country of a search, by its area or its text."""
    k = F.col("n_nationkey")
    town, country = G.locality(pick([None, F.concat(F.lit("cafes in the park in "), "n_name"), "cafes"], k), pick([F.concat("n_name", F.lit(", UK")), "", None], k))
    return table(spark, sf_dir, "nation").select(k, town.alias("town"), country.alias("country"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Old Town ' || c_custkey || ' Mill Rd' WHEN 1 THEN c_custkey || ' Mill Rd' END AS street, CASE WHEN c_custkey % 2 = 0 THEN 'Leeds' END AS city, 'LS' || c_custkey AS postal,
  CASE WHEN c_custkey % 3 = 2 THEN 'Shop' WHEN c_custkey % 3 = 1 THEN 'Auto repair shop' ELSE 'Cafe' END AS category, CASE WHEN c_custkey % 3 = 2 THEN 'Shop' WHEN c_custkey % 3 = 1 THEN 'Shop|Auto repair shop' ELSE 'Cafe|Bar' END AS categories FROM customer""")
def listing_places(spark, sf_dir):
    """Parts of structured addresses, and the category of a listing that goes with the wanted one."""
    k = F.col("c_custkey")
    whole = F.struct(F.when(k % 3 == 0, "Old Town").otherwise("").alias("borough"), F.when(k % 3 != 2, text(k, " Mill Rd")).alias("street"), F.when(k % 2 == 0, "Leeds").otherwise(" ").alias("city"), F.lit("").alias("state"), text("LS", k).alias("postal_code"), F.lit("GB").alias("country"))
    names = pick([F.array(F.lit("Cafe"), F.lit(" Bar ")), F.array(F.lit("Auto repair shop")), F.lit(None).cast("array<string>")], k)
    best, every = G.map_category(pick(["Cafe", "Shop", " Shop"], k), names, ["auto REPAIR"])
    at = G.split_address(whole)
    return table(spark, sf_dir, "customer").select(k, at["street"].alias("street"), at["city"].alias("city"), at["postal"].alias("postal"), best.alias("category"), F.array_join(every, "|").alias("categories"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' ELSE 'none' END AS appointments, CASE WHEN c_custkey % 3 = 0 THEN 'https://book.example/' || c_custkey ELSE '' END AS links,
  'Bob' || CASE WHEN c_custkey % 2 = 0 THEN ',Amy' ELSE '' END AS signed FROM customer""")
def profile_facts(spark, sf_dir):
    """Appointments, order links and the names that sign replies."""
    k = F.col("c_custkey")
    option = lambda name, on: F.struct(F.lit(name).alias("name"), F.lit(on).cast("boolean").alias("enabled"))
    group = lambda id_, name, *options: F.array(F.struct(F.lit(id_).cast("string").alias("id"), F.lit(name).alias("name"), F.array(*options).alias("options")))
    about = pick([
        group("", "Planning", option("Appointment required", None), option("Appointments recommended", True)), group("planning", "x", option("Appointment required", False), option("Appointments recommended", True)),
        group("crowd", "Planning", option("Appointment required", True)), F.lit(None).cast(G.ABOUT),
    ], k)
    orders = F.array(F.struct(F.when(k % 3 == 0, text("https://book.example/", k)).alias("link")), F.struct(F.lit("").alias("link")))
    reply = lambda who, said: F.struct(F.lit(who).alias("reviewer"), (said if not isinstance(said, str) else F.lit(said)).alias("text"))
    replies = F.array(
        reply("Sam Hill", "Thanks Sam, glad we could help. Regards, Bob"), reply("Ann", "Thanks Ann"), reply("Jo", "Kind regards, Team"), reply("Al", "Cheers, Ed " + "and so on " * 7),
        reply("Di", "Best wishes Firm"), reply("Bo", "Thanks MOT"), reply("Cy", F.when(k % 2 == 0, "Best wishes Amy")), reply(None, "Thank you, Bob"),
    )
    c = table(spark, sf_dir, "customer")
    return c.select(k, G.appointments(about).alias("appointments"), F.array_join(G.order_links(orders), ",").alias("links"), F.array_join(G.signed_names(replies, F.lit("The Firm")), ",").alias("signed"))


@query(with_businesses("""
SELECT id, coalesce('+1 ' || substr(phone, 3, 3) || '-' || substr(phone, 6, 3) || '-' || substr(phone, 9), '') AS shown, coalesce(phone IS NOT NULL AND substr(phone, 9) IS NOT NULL, FALSE) AS mobile FROM businesses"""))
def phones_shown(spark, sf_dir):
    """Numbers as a sheet shows them, and whether one may be a mobile."""
    return businesses(spark, sf_dir).select("id", G.display_phone(F.col("phone")).alias("shown"), G.any_mobile(F.array("phone", F.lit(None))).alias("mobile"))


PEOPLE = [
    '<script type="application/ld+json">{"@graph": [{"@type": "https://schema.org/Person", "name": "Ann  Lee", "jobTitle": "Owner", "email": "mailto:Ann@Shop.com?x=1", "telephone": ["020 7946 0001", "(020) 79460001"]}, {"@type": "Review", "author": {"@type": "Person", "name": "No One"}}]}</script>',
    '<div class="vcard"><span class="fn">Bo <b>Fox</b></span><i class="role">Manager</i><span class="tel"><b class="value">555 1</b></span><a href="mailto:bo@shop.com?subject=a">mail</a><p class="note">x</div><script type="application/ld+json">{broken</script>',
    '<script type="application/ld+json">[{"@type": "AutoBusiness", "founder": {"@id": "#c"}, "employee": [{"@type": "Thing", "name": "T"}]}, {"@id": "#c", "@type": "Person", "name": "Cy Roe", "hasOccupation": {"name": "Founder"}}]</script>',
    '<div class="staff-member"><p>nobody</p></div>',
]


@query("""
SELECT page_id, 0 AS place, CASE page_id % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo Fox' ELSE 'Cy Roe' END AS name, CASE page_id % 4 WHEN 0 THEN 'Owner' WHEN 1 THEN 'Manager' ELSE 'Founder' END AS title, 'structured' AS context,
  CASE page_id % 4 WHEN 0 THEN '020 7946 0001' WHEN 1 THEN '555 1' ELSE '' END AS phones, CASE page_id % 4 WHEN 0 THEN 'ann@shop.com' WHEN 1 THEN 'bo@shop.com' ELSE '' END AS emails FROM pages WHERE page_id % 4 <> 3""")
def structured_people(spark, sf_dir):
    """People that pages name in linked data and contact cards, read by a parser over Arrow batches, as markup nests."""
    schema = pa.schema([("page_id", pa.int64()), ("place", pa.int32()), ("name", pa.string()), ("title", pa.string()), ("context", pa.string()), ("phones", pa.string()), ("emails", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (i, place, name, title, context, ",".join(phones), ",".join(emails))
                for i, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True)
                for place, (name, title, context, phones, emails) in enumerate(people_of(html or ""))
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in found], schema=schema)

    return pages_with(spark, sf_dir, PEOPLE).select("page_id", "html").mapInArrow(run, "page_id long, place int, name string, title string, context string, phones string, emails string")


@query("""
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey * 97 % 6000 AS INTEGER) / 365.25 END AS years, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2025-12-31' - CAST(s_suppkey * 31 % 900 AS INTEGER) END AS officer FROM supplier),
f AS (SELECT *, least(100, CASE WHEN k % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN years IS NULL THEN 5 WHEN years < 1 THEN 10 WHEN years <= 3 THEN 15 WHEN years <= 10 THEN 20 ELSE 15 END + CASE WHEN officer >= DATE '2024-12-31' THEN 20 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 15 ELSE 0 END
  + CASE WHEN k % 7 <> 0 THEN 10 ELSE 0 END + 4.5 + CASE WHEN k % 5 <> 4 THEN 6 ELSE 0 END + CASE WHEN k % 3 <> 2 THEN 3 ELSE 0 END + CASE WHEN k % 7 <> 0 THEN 1.5 ELSE 0 END) AS total,
  CASE WHEN k % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN k % 7 <> 0 THEN 30 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 15 ELSE 0 END AS points FROM s),
t AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'DQ' WHEN total >= 75 THEN 'A' WHEN total >= 55 THEN 'B' ELSE 'C' END AS tier FROM f)
SELECT k AS s_suppkey, CAST(total AS DOUBLE) AS total, tier, CAST(points AS INTEGER) AS points, CASE WHEN tier = 'DQ' THEN 'DISQUALIFIED' WHEN tier IN ('A', 'B') AND points >= 55 THEN 'READY_FOR_OUTREACH' WHEN points = 0 THEN 'NEEDS_ENRICHMENT' ELSE 'MANUAL_REVIEW' END AS status FROM t""")
def company_scores(spark, sf_dir):
    """Companies by register and site, how they can be reached, and whether they are ready."""
    k, today = F.col("s_suppkey"), F.lit(dt.date(2025, 12, 31))
    trades = pick([F.array(F.lit("62012"), F.lit("10710")), F.array(F.lit("10710")), F.lit(None).cast("array<string>")], k)
    officers = pick([F.array(F.date_sub(today, (k * 31 % 900).cast("int"))), F.array().cast("array<date>"), F.lit(None).cast("array<date>"), F.lit(None).cast("array<date>")], k)
    domain = F.when(k % 7 != 0, text("c", k, ".example"))
    c = N.Company(trades, F.when(k % 5 != 0, F.date_sub(today, (k * 97 % 6000).cast("int"))), officers, k % 2 == 0, k % 3 != 2, domain, F.when(k % 11 == 0, "Dissolved").when(k % 11 != 1, " active"), k % 5 != 4)
    points, _ = N.contactability(k % 2 == 0, domain.isNotNull(), k % 3 == 0, k % 4 == 0)
    s = N.scored(table(spark, sf_dir, "supplier"), c, ["62012", "62020"], today)
    return s.select(k, "total", "tier", points.alias("points"), N.readiness(F.col("tier"), points).alias("status"))


BODY = "\n{{greeting}}\n\n{{observation}}\n\n{{offer_line}}\n\n{{signature}}\n{{postal_address}}\n{{privacy_line}}\n{{optout_line}}\n"


@query(with_businesses("""
SELECT id, 'To: x@' || domain || chr(10) || 'Subject: A note' || chr(10) || chr(10) || 'Hello ' || name || ',' || chr(10) || chr(10) || 'You have ' || reviews || ' reviews.' || chr(10) || chr(10) || 'Bookings' || CASE WHEN reviews % 2 = 0 THEN ' — less phone work' ELSE '' END || chr(10) || chr(10)
 || CASE reviews % 3 WHEN 0 THEN 'Kim' WHEN 1 THEN 'Desk' ELSE 'The Team' END || chr(10) || '1 High St' || chr(10) || CASE WHEN reviews % 2 = 0 THEN 'Privacy notice: https://p.example' ELSE 'We use only publicly available business information to send this one-time introduction (UK GDPR Art. 14).' END || chr(10)
 || CASE reviews % 3 WHEN 0 THEN 'Don''t want these emails? Unsubscribe: https://u.example' WHEN 1 THEN 'Don''t want these emails? Reply ''unsubscribe'' or email u@u.example.' ELSE 'Reply ''unsubscribe'' at any time and we will stop.' END || chr(10) AS draft FROM businesses WHERE domain IS NOT NULL"""))
def letter_files(spark, sf_dir):
    """Drafts as files, from a body with slots."""
    k = F.col("reviews")
    sender = L.sender_slots(pick(["Kim", " ", None], k), pick([None, "Desk", ""], k), F.lit("1 High St"), F.when(k % 2 == 0, "https://p.example"), pick(["https://u.example", None, ""], k), pick([None, "u@u.example", None], k))
    slots = sender | {"greeting": text("Hello ", F.col("name"), ","), "observation": text("You have ", k, " reviews."), "offer_line": L.offer_line(F.lit("Bookings "), F.when(k % 2 == 0, "less phone work"))}
    return businesses(spark, sf_dir).filter("domain IS NOT NULL").select("id", L.as_file(text("x@", F.col("domain")), F.lit("A note"), L.letter(BODY, slots)).alias("draft"))
