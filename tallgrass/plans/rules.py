"""Queries over small decisions, each by the functions of tallgrass.functions.rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from .base import businesses, query, table, with_businesses

KEY = b"message-id"


def _pad(byte: int) -> str:
    return "".join(f"\\x{k ^ byte:02X}" for k in KEY.ljust(64, b"\0"))


@query(f"""
SELECT conv_id, turn, substr(sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(concat_ws('|', conv_id, turn, text))))), 1, 24) AS token FROM conversations""")
def message_id_tokens(spark, sf_dir):
    """Keyed digests of messages."""
    token = F.substring(R.hmac_sha256(KEY, F.concat_ws("|", "conv_id", "turn", "text")), 1, 24)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", token.alias("token"))


@query(r"""
SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS header, '+1713555' || s_suppkey AS phone, 'shop' || s_suppkey || '.example.com' AS domain FROM supplier""")
def import_keys(spark, sf_dir):
    """Keys of imported cells: headings, numbers and sites."""
    url = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "https://WWW.").otherwise("www."), F.lit("Shop"), F.col("s_suppkey").cast("string"), F.lit(".Example.com:8080/a?b=c "))
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", R.header_key(F.col("s_name")).alias("header"), R.phone_key(F.concat(F.lit("+1 (713) 555-"), F.col("s_suppkey").cast("string"), F.lit(" x"))).alias("phone"), R.domain_key(url).alias("domain"))


@query("""
SELECT c_nationkey, CASE WHEN count(*) = 0 THEN '0%' ELSE CAST(round_even(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 0) AS BIGINT) || '%' END AS share FROM customer GROUP BY 1""")
def percent_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("n"), F.count(F.lit(1)).alias("total"))
    return c.select("c_nationkey", R.percent(F.col("n"), F.col("total")).alias("share"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'own domain, valid mailbox' WHEN 1 THEN 'own domain, role mailbox' ELSE 'own domain' END
  WHEN 1 THEN 'personal freemail, linked to owner name' WHEN 2 THEN 'personal freemail, UNLINKED — do not mail' WHEN 3 THEN 'foreign domain — not the business''s own' ELSE 'none' END AS confidence FROM customer""")
def email_confidence_text(spark, sf_dir):
    k = F.col("c_custkey")
    affinity = F.get(F.array(*map(F.lit, ("own_domain", "freemail_linked", "freemail_unlinked", "foreign"))), (k % 5).cast("int"))
    tier = F.get(F.array(F.lit("valid"), F.lit("role"), F.lit("")), (k % 3).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.email_confidence(affinity, tier).alias("confidence"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN FALSE WHEN o_orderkey % 7 = 1 THEN TRUE ELSE o_orderkey % 4 = 2 END AS dead FROM orders""")
def site_dead(spark, sf_dir):
    """Whether a crawled site is dead, by its error and status."""
    k = F.col("o_orderkey")
    error = F.when(k % 7 == 0, "robots-disallowed").when(k % 7 == 1, "timeout").when(k % 7 == 2, "")
    status = F.get(F.array(F.lit(200), F.lit(301), F.lit(404), F.lit(None).cast("int")), (k % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.site_is_dead(error, status).alias("dead"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN -1.0 ELSE CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS DOUBLE) END AS days FROM orders""")
def warmup_age_days(spark, sf_dir):
    """Days since a mailbox began to warm up; -1 where no start can be read."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    started = F.when(F.col("o_orderkey") % 9 == 0, day).otherwise(F.concat(day, F.lit("T00:00:00Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.age_days(started, F.lit("2000-01-01").cast("timestamp")).alias("days"))


@query("""
WITH p AS (SELECT c_custkey AS k, (c_custkey * 37 % 1000) / 1000.0 AS lat, (c_custkey * 91 % 1000) / 1000.0 AS lon, 'town' || (c_custkey % 3) AS town FROM customer),
j AS (SELECT a.k, abs(a.lat - b.lat) AS s, abs(a.lon - b.lon) AS e, a.town, b.town AS other FROM p a JOIN p b ON b.k = a.k + 3 - 2 * (a.k % 2))
SELECT k, s <= 0.2 AND e <= 0.2 AS overlap, CASE WHEN s <= 0.15 AND e <= 0.15 THEN FALSE WHEN town <> other THEN TRUE ELSE s > 0.3 OR e > 0.3 END AS distinct_place FROM j""")
def place_guard(spark, sf_dir):
    """Hits of one search: whether their boxes overlap and whether they are different places."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    p = c.select(k.alias("k"), ((k * 37 % 1000) / 1000.0).alias("lat"), ((k * 91 % 1000) / 1000.0).alias("lon"), F.concat(F.lit("town"), (k % 3).cast("string")).alias("town"))
    o = p.select(*[F.col(x).alias(f"{x}2") for x in p.columns])
    box = lambda lat, lon: (F.round(F.col(lat) - 0.1, 4), F.round(F.col(lat) + 0.1, 4), F.round(F.col(lon) - 0.1, 4), F.round(F.col(lon) + 0.1, 4))
    overlap = R.boxes_overlap(box("lat", "lon"), box("lat2", "lon2"))
    apart = R.distinct_places((F.col("lat"), F.col("lat2")), (F.col("lon"), F.col("lon2")), overlap, (F.col("town"), F.col("town2")))
    return p.join(o, F.col("k2") == F.col("k") + 3 - 2 * (F.col("k") % 2)).select("k", overlap.alias("overlap"), apart.alias("distinct_place"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name || ' north' ELSE 'Harbour ' || c_custkey || ', ' || n_name END AS area FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def qualified_areas(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))  # nations are a fixed table of 25 rows
    area = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("n_name"), F.lit(" north"))).otherwise(F.concat(F.lit("Harbour "), F.col("c_custkey").cast("string")))
    found = R.qualified_area(area, F.col("n_name"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.replace(found, F.lower("n_name"), F.col("n_name"))).otherwise(found).alias("area"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ana' WHEN 1 THEN 'sean' WHEN 2 THEN 'jose' END AS first, CASE c_custkey % 5 WHEN 0 THEN 'delacruz' || c_custkey WHEN 1 THEN 'murphy' || c_custkey WHEN 2 THEN 'vandermeer' || c_custkey END AS last FROM customer""")
def person_name_split(spark, sf_dir):
    """First and last names of people; companies and single words have none."""
    shapes = F.array(*map(F.lit, ("Ana de la Cruz", " Seán Vincent  Murphy", "José van der Meer", "Firm Holdings ", "Cher")))
    name = F.concat(F.get(shapes, (F.col("c_custkey") % 5).cast("int")), F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_custkey") % 5 == 3, F.concat(name, F.lit(" Ltd"))).otherwise(name)
    first, last = R.person_name(name)
    return table(spark, sf_dir, "customer").select("c_custkey", first.alias("first"), last.alias("last"))


@query("""
SELECT s_suppkey, s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS complete, chr(10) || '--' || chr(10) || s_name || CASE WHEN s_suppkey % 4 <> 0 THEN chr(10) || 'Box ' || s_suppkey ELSE '' END || chr(10) || 'We found ' || s_name || ' in public business listings; see https://p.example. Reply STOP to opt out.' || chr(10) ||
  CASE WHEN s_suppkey % 3 <> 0 THEN 'To opt out: mailto:u@p.example' || CASE WHEN s_suppkey % 2 = 0 THEN ' or https://p.example/u' ELSE '' END ELSE 'To opt out, reply STOP.' END AS footer FROM supplier""")
def sender_footer(spark, sf_dir):
    """Whether a sender may send, and the footer of what it sends."""
    k = F.col("s_suppkey")
    postal, mailto = F.when(k % 4 != 0, F.concat(F.lit("Box "), k.cast("string"))), F.when(k % 3 != 0, F.lit("u@p.example"))
    url, mail, privacy = F.when((k % 3 != 0) & (k % 2 == 0), F.lit("https://p.example/u")), F.lit("a@p.example"), F.lit("https://p.example")
    identity = (F.col("s_name"), mail, postal, privacy, mailto, url)
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.identity_complete(*identity).alias("complete"), R.message_footer(*identity, F.col("s_name")).alias("footer"))


@query("""
SELECT n_nationkey, substr(sha1('{"area":"' || n_name || '","country":"US","industries":["a","b"]}'), 1, 12) AS profile FROM nation""")
def profile_hash(spark, sf_dir):
    """Identity of a search profile: its fields in order of their names, without limits and notes."""
    fields = F.struct(F.col("n_name").alias("area"), F.lit("US").alias("country"), F.array(F.lit("a"), F.lit("b")).alias("industries"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(F.sha1(F.to_json(fields).cast("binary")), 1, 12).alias("profile"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN 'who' || c_custkey || '@shop.example.com' END AS email FROM customer""")
def hidden_email_decode(spark, sf_dir):
    """Addresses that pages hide as xored hex; every sixth one is broken."""
    k = F.col("c_custkey")
    email = F.concat(F.lit("who"), k.cast("string"), F.lit("@shop.example.com"))
    key = (k % 200 + 7).cast("int")
    xored = lambda e, i: F.lpad(F.hex(F.ascii(F.substring(e, i, F.lit(1))).bitwiseXOR(key)), 2, "0")
    body = T.let(email, lambda e: F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: xored(e, i)), ""))
    body = T.let(body, lambda b: F.when(k % 6 == 0, F.replace(b, F.right(b, F.lit(2)), F.lit("zz"))).otherwise(b))
    code = F.concat(F.lpad(F.hex(key), 2, "0"), body)
    return table(spark, sf_dir, "customer").select("c_custkey", R.decode_hidden_email(code).alias("email"))


@query(with_businesses("""
SELECT id, CASE seq % 4 WHEN 0 THEN 'switchboard' WHEN 1 THEN 'direct' WHEN 2 THEN 'mobile' ELSE CASE WHEN phone IS NULL THEN 'unknown' ELSE 'main_line' END END AS kind FROM businesses"""))
def phone_kinds(spark, sf_dir):
    """What kind of line a number is, by the words beside it and its range."""
    k = F.col("seq") % 4
    context = F.when(k == 0, "Main Reception").when(k == 1, "her ext. 12")
    phone = F.when(k == 2, F.lit("+447700900123")).otherwise(F.col("phone"))
    return businesses(spark, sf_dir).select("id", R.classify_phone(phone, context, F.col("phone")).alias("kind"))
