"""Compliance ladders, scores, evidence packets and the check of drafted text."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contacts as C
from ..operators import score as S
from .base import businesses, query, table, with_businesses

CONTACTS = """
, contacts AS (SELECT id, domain, name, kind, CASE kind WHEN 0 THEN 'info@' || coalesce(domain, 'other.example.com') WHEN 1 THEN 'test@gmail.com' WHEN 2 THEN 'firm' || reviews || '@gmail.com' ELSE 'j.doe@' || coalesce(domain, 'elsewhere.example.org') END AS email,
  CASE WHEN reviews % 11 = 0 THEN NULL ELSE reviews % 5 <> 0 END AS mx FROM businesses, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS kind) k),
tiers AS (SELECT id, domain, email, CASE WHEN split_part(email, '@', 1) IN ('example','test','user','name','email','your','yourname','noreply','no-reply') THEN 'invalid' WHEN mx IS NULL THEN 'unknown' WHEN NOT mx THEN 'invalid' WHEN split_part(email, '@', 1) IN ('info','contact','hello','office','admin','sales','support','enquiries','mail','team') THEN 'role' ELSE 'valid' END AS tier,
  CASE WHEN split_part(email, '@', 2) = domain THEN 'own_domain' WHEN split_part(email, '@', 2) <> 'gmail.com' THEN CASE WHEN domain IS NULL THEN 'own_domain' ELSE 'foreign' END WHEN contains(split_part(email, '@', 1), 'firm') THEN 'freemail_linked' ELSE 'freemail_unlinked' END AS affinity FROM contacts)"""


def contacts(spark, sf_dir):
    b = businesses(spark, sf_dir)
    kinds = F.array(
        F.concat(F.lit("info@"), F.coalesce("domain", F.lit("other.example.com"))), F.lit("test@gmail.com"),
        F.concat(F.lit("firm"), F.col("reviews").cast("string"), F.lit("@gmail.com")), F.concat(F.lit("j.doe@"), F.coalesce("domain", F.lit("elsewhere.example.org"))),
    )
    rows = b.select("id", "domain", "name", "reviews", F.explode(kinds).alias("email")).withColumn("mx", F.when(F.col("reviews") % 11 != 0, F.col("reviews") % 5 != 0))
    return rows.select("id", "domain", "email", C.email_tier(F.col("email"), F.col("mx")).alias("tier"), C.email_affinity(F.col("email"), F.col("domain"), F.col("name")).alias("affinity"))


@query(with_businesses(CONTACTS + " SELECT id, email, tier, affinity FROM tiers"))
def email_tier_ladder(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", "email", "tier", "affinity")


GROUP_SQL = """CASE WHEN tier IN ('valid','role') AND affinity = 'own_domain' THEN 0 WHEN tier IN ('valid','role') AND affinity = 'freemail_linked' THEN 1 WHEN tier = 'inferred' THEN 2 WHEN tier IN ('valid','role','risky','catch_all') THEN 3 WHEN tier = 'unknown' THEN 4 ELSE 5 END"""
ORDER_SQL = f"""{GROUP_SQL}, list_position(['own_domain','freemail_linked','','freemail_unlinked','foreign'], affinity), list_position(['valid','role','risky','catch_all','inferred','unknown','invalid'], tier), email"""


@query(with_businesses(CONTACTS + f" SELECT id, email, row_number() OVER (PARTITION BY id ORDER BY {ORDER_SQL}) AS place FROM tiers"))
def email_send_rank(spark, sf_dir):
    c = contacts(spark, sf_dir)
    w = Window.partitionBy("id").orderBy(C.send_group(F.col("tier"), F.col("affinity")), C.rank_in(C.AFFINITY_ORDER, F.col("affinity")), C.rank_in(C.TIER_ORDER, F.col("tier")), "email")
    return c.select("id", "email", F.row_number().over(w).cast("long").alias("place"))


@query(with_businesses(CONTACTS + f" SELECT id, email, tier FROM tiers WHERE tier IN ('valid','role') AND affinity IN ('own_domain','freemail_linked') QUALIFY row_number() OVER (PARTITION BY id ORDER BY {ORDER_SQL}) = 1"))
def best_contact_struct_max(spark, sf_dir):
    """The best address that may be written to, as the least tuple: an aggregate, no window."""
    c = contacts(spark, sf_dir).filter(F.col("tier").isin("valid", "role") & F.col("affinity").isin("own_domain", "freemail_linked"))
    key = F.struct(C.send_group(F.col("tier"), F.col("affinity")).alias("g"), C.rank_in(C.AFFINITY_ORDER, F.col("affinity")).alias("a"), C.rank_in(C.TIER_ORDER, F.col("tier")).alias("t"), F.col("email").alias("email"), F.col("tier").alias("tier"))
    return c.groupBy("id").agg(F.min(key).alias("m")).select("id", F.col("m.email").alias("email"), F.col("m.tier").alias("tier"))


ENTITY_SQL = "CASE WHEN seq % 4 = 0 THEN 'corporate_active' WHEN seq % 4 = 1 THEN 'corporate_inactive' WHEN source = 'register' THEN 'corporate_unknown' WHEN reviews > 100 THEN 'unmatched' ELSE 'unchecked' END"


def entities(spark, sf_dir):
    b = businesses(spark, sf_dir)
    status = F.when(F.col("seq") % 4 == 0, "active").when(F.col("seq") % 4 == 1, "dissolved")
    return b.withColumn("entity", C.entity_type(status, F.col("source") == "register", F.col("reviews") > 100))


@query(with_businesses(f" SELECT id, {ENTITY_SQL} AS entity FROM businesses"))
def entity_type(spark, sf_dir):
    return entities(spark, sf_dir).select("id", "entity")


BASIS_SQL = f"""CASE WHEN tier NOT IN ('valid','role') OR affinity IN ('freemail_unlinked','foreign') THEN 'none' WHEN region = 'us' THEN 'b2b' WHEN entity = 'corporate_active' THEN 'b2b' WHEN entity = 'corporate_inactive' THEN 'confirm' WHEN entity = 'corporate_unknown' THEN 'b2b' WHEN entity = 'unmatched' THEN CASE WHEN affinity IN ('own_domain','freemail_linked') THEN 'b2b' ELSE 'confirm' END ELSE 'confirm' END"""
BASES = CONTACTS + f", ent AS (SELECT id, phone, rating, {ENTITY_SQL} AS entity, CASE WHEN seq % 6 = 0 THEN 'us' ELSE 'gb' END AS region FROM businesses), basis AS (SELECT id, email, phone, rating, tier, affinity, entity, {BASIS_SQL} AS basis FROM tiers JOIN ent USING (id))"


def bases(spark, sf_dir):
    e = entities(spark, sf_dir).select("id", "phone", "rating", "entity", F.when(F.col("seq") % 6 == 0, "us").otherwise("gb").alias("region"))
    c = contacts(spark, sf_dir).join(e, "id")
    return c.withColumn("basis", C.lawful_basis(F.col("tier"), F.col("affinity"), F.col("entity"), F.col("region")))


@query(with_businesses(BASES + " SELECT id, email, basis FROM basis"))
def lawful_basis(spark, sf_dir):
    return bases(spark, sf_dir).select("id", "email", "basis")


@query(with_businesses(BASES + " SELECT id, email, concat_ws(',', CASE WHEN tier NOT IN ('valid','role') THEN 'tier:' || tier END, CASE WHEN affinity IN ('freemail_unlinked','foreign') THEN 'affinity:' || affinity END, CASE WHEN basis <> 'b2b' THEN 'basis:' || basis END, CASE WHEN rating IS NULL THEN 'no_rating' END) AS reasons, basis = 'b2b' AND rating IS NOT NULL AS eligible FROM basis"))
def eligibility_reasons(spark, sf_dir):
    b = bases(spark, sf_dir)
    reasons = F.array_compact(F.array(
        F.when(~F.col("tier").isin("valid", "role"), F.concat(F.lit("tier:"), "tier")), F.when(F.col("affinity").isin("freemail_unlinked", "foreign"), F.concat(F.lit("affinity:"), "affinity")),
        F.when(F.col("basis") != "b2b", F.concat(F.lit("basis:"), "basis")), F.when(F.col("rating").isNull(), F.lit("no_rating")),
    ))
    return b.select("id", "email", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


@query(with_businesses(BASES + ", n AS (SELECT id, any_value(phone) AS phone, bool_or(basis = 'b2b') AS ok, bool_or(basis = 'confirm') AS confirm, any_value(rating) AS rating FROM basis GROUP BY id) SELECT id, CASE WHEN rating < 0.5 THEN 'skip' WHEN phone IS NOT NULL AND rating >= 4 THEN 'call named' WHEN phone IS NOT NULL THEN 'call switchboard' WHEN ok THEN 'email' WHEN confirm THEN 'confirm' ELSE 'research' END AS action FROM n"))
def next_action(spark, sf_dir):
    n = bases(spark, sf_dir).groupBy("id").agg(F.max("phone").alias("phone"), F.max("rating").alias("rating"), F.bool_or(F.col("basis") == "b2b").alias("ok"), F.bool_or(F.col("basis") == "confirm").alias("confirm"))
    action = F.when(F.col("rating") < 0.5, "skip").when(F.col("phone").isNotNull() & (F.col("rating") >= 4), "call named").when(F.col("phone").isNotNull(), "call switchboard").when(F.col("ok"), "email").when(F.col("confirm"), "confirm").otherwise("research")
    return n.select("id", action.alias("action"))


@query(r"""
SELECT page_id, CASE WHEN length(html) < 500 THEN 'empty' WHEN starts_with(url, 'http://') AND regexp_matches(html, '(?i)track\(') THEN 'insecure' WHEN regexp_matches(html, '(?i)parked') THEN 'parked' WHEN length(html) > 20000 THEN 'large' ELSE 'live' END AS status FROM pages""")
def site_status(spark, sf_dir):
    h, n = F.col("html"), F.length("html")
    status = F.when(n < 500, "empty").when(F.col("url").startswith("http://") & h.rlike(r"(?i)track\("), "insecure").when(h.rlike("(?i)parked"), "parked").when(n > 20000, "large").otherwise("live")
    return table(spark, sf_dir, "pages").select("page_id", status.alias("status"))


HITS_SQL = "(CASE WHEN domain IS NULL THEN 1 ELSE 0 END + CASE WHEN rating <= 3.9 AND reviews >= 50 THEN 1 ELSE 0 END + CASE WHEN reviews < 10 THEN 1 ELSE 0 END)"
SCORE_SQL = f"""
, f AS (SELECT *, CASE WHEN category IN ('MACHINERY','AUTOMOBILE') THEN 1.0 WHEN category = 'BUILDING' THEN 0.6 ELSE 0.1 END AS f1, CASE WHEN {HITS_SQL} > 0 THEN least(1.0, 0.4 + 0.3 * {HITS_SQL}) ELSE 0.2 END AS f2,
  CASE WHEN reviews IS NULL THEN 0.4 WHEN reviews < 20 THEN 0.2 WHEN reviews > 150 THEN 0.3 ELSE 1.0 END AS f3, CASE WHEN city IS NULL THEN 0.5 WHEN city IN ('NATION_1','NATION_2','NATION_3') THEN 1.0 ELSE 0.3 END AS f4,
  CASE WHEN regexp_matches(lower(name), '\\b(franchise|group|inc|corporation)\\b') THEN 0.3 ELSE 0.8 END AS f5, least(1.0, 0.3 + CASE WHEN source = 'register' THEN 0.4 ELSE 0.0 END + CASE WHEN domain IS NOT NULL THEN 0.2 ELSE 0.0 END + CASE WHEN place_id IS NOT NULL THEN 0.1 ELSE 0.0 END) AS f6,
  CASE WHEN regexp_matches(lower(name), '\\b(franchise|group)\\b') THEN -25.0 ELSE 0.0 END + CASE WHEN rating IS NULL THEN -15.0 ELSE 0.0 END AS neg FROM businesses),
s AS (SELECT *, round_even(greatest(0.0, least(100.0, round_even(f1::DOUBLE * 25, 2) + round_even(f2::DOUBLE * 25, 2) + round_even(f3::DOUBLE * 10, 2) + round_even(f4::DOUBLE * 10, 2) + round_even(f5::DOUBLE * 10, 2) + round_even(f6::DOUBLE * 20, 2) + greatest(neg::DOUBLE, -40.0)))::DOUBLE, 1) AS total FROM f),
t AS (SELECT *, CASE WHEN phone IS NULL THEN 'DQ' WHEN total >= 80 THEN 'A' WHEN total >= 60 THEN 'B' ELSE 'C' END AS tier FROM s)""".replace("\\\\", "\\")


def need_hits():
    r = F.col("reviews")
    return F.array_compact(F.array(F.when(F.col("domain").isNull(), F.lit("website_missing")), F.when((F.col("rating") <= 3.9) & (r >= 50), F.lit("low_rating_high_volume")), F.when(r < 10, F.lit("few_reviews"))))


def scored(spark, sf_dir):
    b = businesses(spark, sf_dir).withColumn("hits", need_hits())
    low = F.lower("name")
    cat = F.col("category")
    confidence = F.least(F.lit(1.0), 0.3 + F.when(F.col("source") == "register", 0.4).otherwise(0.0) + F.when(F.col("domain").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("place_id").isNotNull(), 0.1).otherwise(0.0))
    factors = [
        S.Factor("industry_match", 25, F.when(cat.isin("MACHINERY", "AUTOMOBILE"), 1.0).when(cat == "BUILDING", 0.6).otherwise(0.1), cat),
        S.Factor("need_signals", 25, S.need_share(F.size("hits")), F.array_join("hits", " ")),
        S.Factor("size_match", 10, S.size_share(F.col("reviews"), 20, 150), F.col("reviews").cast("string")),
        S.Factor("geography_match", 10, F.when(F.col("city").isNull(), 0.5).when(F.col("city").isin("NATION_1", "NATION_2", "NATION_3"), 1.0).otherwise(0.3), F.col("city")),
        S.Factor("business_model", 10, F.when(low.rlike(r"\b(franchise|group|inc|corporation)\b"), 0.3).otherwise(0.8), F.col("name")),
        S.Factor("data_confidence", 20, confidence, F.col("source")),
    ]
    negatives = F.when(low.rlike(r"\b(franchise|group)\b"), -25.0).otherwise(0.0) + F.when(F.col("rating").isNull(), -15.0).otherwise(0.0)
    return S.apply_profile(b, factors, negatives, F.col("phone").isNull(), 80, 60)


@query(with_businesses(SCORE_SQL + " SELECT id, total, tier FROM t"))
def score_default_profile(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "total", "tier")


@query(with_businesses(SCORE_SQL + """, e AS (SELECT id, unnest(['industry_match','need_signals','size_match','geography_match','business_model','data_confidence']) AS factor, unnest([round_even(f1::DOUBLE * 25, 2), round_even(f2::DOUBLE * 25, 2), round_even(f3::DOUBLE * 10, 2), round_even(f4::DOUBLE * 10, 2), round_even(f5::DOUBLE * 10, 2), round_even(f6::DOUBLE * 20, 2)]) AS points FROM t)
SELECT id, string_agg(factor, ',' ORDER BY points DESC, factor) AS top3 FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY points DESC, factor) <= 3) x GROUP BY 1"""))
def score_explanations(spark, sf_dir):
    return scored(spark, sf_dir).select("id", S.top_reasons(F.col("factors")).alias("top3"))


@query(with_businesses(SCORE_SQL + """, c AS (SELECT id, tier, phone, CASE WHEN reviews % 3 = 0 THEN 30 ELSE 0 END + CASE WHEN domain IS NOT NULL THEN 30 WHEN reviews % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN source = 'register' THEN 5 ELSE 0 END AS p FROM t)
SELECT id, CAST(p AS BIGINT) AS contactability, CASE WHEN tier = 'DQ' THEN 'DQ' WHEN tier IN ('A','B') AND p >= 50 THEN 'READY' WHEN phone IS NOT NULL THEN 'CALL_ONLY' ELSE 'RESEARCH' END AS status FROM c"""))
def contactability_status(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = F.when(F.col("reviews") % 3 == 0, 30).otherwise(0) + F.when(F.col("domain").isNotNull(), 30).when(F.col("reviews") % 2 == 0, 20).otherwise(0) + F.when(F.col("phone").isNotNull(), 25).otherwise(0) + F.when(F.col("source") == "register", 5).otherwise(0)
    status = F.when(F.col("tier") == "DQ", "DQ").when(F.col("tier").isin("A", "B") & (p >= 50), "READY").when(F.col("phone").isNotNull(), "CALL_ONLY").otherwise("RESEARCH")
    return s.select("id", p.cast("long").alias("contactability"), status.alias("status"))


@query(with_businesses("""
, h AS (SELECT id, unnest(list_filter([CASE WHEN domain IS NULL THEN 'no site yet' END, CASE WHEN rating <= 3.9 AND reviews >= 50 THEN 'rated ' || rating || ' by ' || reviews END, CASE WHEN reviews < 10 THEN 'only ' || reviews || ' reviews' END], lambda x: x IS NOT NULL)) AS hook FROM businesses) SELECT id, hook FROM h"""))
def need_hooks(spark, sf_dir):
    b = businesses(spark, sf_dir)
    r = F.col("reviews")
    hooks = F.array_compact(F.array(
        F.when(F.col("domain").isNull(), F.lit("no site yet")), F.when((F.col("rating") <= 3.9) & (r >= 50), F.concat(F.lit("rated "), F.col("rating").cast("string"), F.lit(" by "), r.cast("string"))),
        F.when(r < 10, F.concat(F.lit("only "), r.cast("string"), F.lit(" reviews"))),
    ))
    return b.select("id", F.explode(hooks).alias("hook"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS departments, sum(o_totalprice::DECIMAL(18,2)) AS revenue, max(o_orderdate) AS last FROM orders GROUP BY 1),
s AS (SELECT c_custkey, n, CASE WHEN c_mktsegment IN ('MACHINERY','BUILDING') THEN 15 ELSE 0 END + CASE WHEN n BETWEEN 10 AND 20 THEN 15 WHEN n BETWEEN 5 AND 9 THEN 5 ELSE 0 END + CASE WHEN revenue BETWEEN 1000000 AND 4000000 THEN 10 ELSE 0 END + CASE WHEN departments >= 2 THEN 5 ELSE 0 END + CASE WHEN departments >= 5 THEN 5 ELSE 0 END
  + CASE WHEN last >= TIMESTAMP '2000-06-01' THEN 20 WHEN last >= TIMESTAMP '2000-01-01' THEN 10 ELSE 5 END + CASE WHEN c_acctbal > 0 THEN 15 ELSE 8 END AS total FROM customer JOIN o ON c_custkey = o_custkey)
SELECT c_custkey, CAST(total AS BIGINT) AS total, CASE WHEN n < 5 THEN 'DQ' WHEN total >= 80 THEN 'A' WHEN total >= 65 THEN 'B' WHEN total >= 50 THEN 'C' ELSE 'D' END AS tier FROM s""")
def score_account_fit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("departments"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"), F.max(F.col("o_orderdate").cast("timestamp")).alias("last"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey")
    n, d = F.col("n"), F.col("departments")
    since = lambda day: F.col("last") >= F.to_timestamp(F.lit(day))
    total = (
        F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), 15).otherwise(0) + F.when(n.between(10, 20), 15).when(n.between(5, 9), 5).otherwise(0) + F.when(F.col("revenue").between(1000000, 4000000), 10).otherwise(0)
        + F.when(d >= 2, 5).otherwise(0) + F.when(d >= 5, 5).otherwise(0) + F.when(since("2000-06-01"), 20).when(since("2000-01-01"), 10).otherwise(5) + F.when(F.col("c_acctbal") > 0, 15).otherwise(8)
    )
    c = c.withColumn("total", total.cast("long"))
    t = F.col("total")
    return c.select("c_custkey", "total", F.when(n < 5, "DQ").when(t >= 80, "A").when(t >= 65, "B").when(t >= 50, "C").otherwise("D").alias("tier"))


@query("""
WITH a AS (SELECT s_suppkey, s_acctbal, date_diff('day', min(l_shipdate)::DATE, DATE '2001-01-01') / 365.25 AS years, max(l_shipdate) AS last, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2),
s AS (SELECT s_suppkey, CASE WHEN n % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN years < 1 THEN 10 WHEN years <= 3 THEN 15 WHEN years <= 10 THEN 20 ELSE 15 END + CASE WHEN last::DATE >= DATE '2000-01-01' THEN 20 ELSE 0 END + CASE WHEN s_acctbal > 0 THEN 15 ELSE 0 END + CASE WHEN n > 550 THEN 10 ELSE 0 END AS total, s_acctbal FROM a)
SELECT s_suppkey, CAST(total AS BIGINT) AS total, CASE WHEN s_acctbal < -900 THEN 'DQ' WHEN total >= 75 THEN 'A' WHEN total >= 55 THEN 'B' ELSE 'C' END AS tier FROM s""")
def score_company_profile(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.datediff(F.lit("2001-01-01").cast("date"), F.to_date(F.min("l_shipdate"))) / 365.25).alias("years"), F.to_date(F.max("l_shipdate")).alias("last"), F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "supplier").join(a, "s_suppkey")
    y = F.col("years")
    total = F.when(F.col("n") % 2 == 0, 25).otherwise(0) + F.when(y < 1, 10).when(y <= 3, 15).when(y <= 10, 20).otherwise(15) + F.when(F.col("last") >= F.lit("2000-01-01").cast("date"), 20).otherwise(0) + F.when(F.col("s_acctbal") > 0, 15).otherwise(0) + F.when(F.col("n") > 550, 10).otherwise(0)
    s = s.withColumn("total", total.cast("long"))
    return s.select("s_suppkey", "total", F.when(F.col("s_acctbal") < -900, "DQ").when(F.col("total") >= 75, "A").when(F.col("total") >= 55, "B").otherwise("C").alias("tier"))


def facts():
    fact = lambda k, v, ok: F.when(ok, F.struct(F.lit(k).alias("k"), v.alias("v")))
    return F.array_compact(F.array(
        fact("category", F.col("category"), F.col("category").isNotNull()), fact("city", F.col("city"), F.col("city").isNotNull()), fact("rating", F.col("rating").cast("string"), F.col("rating") >= 4),
        fact("no_website", F.lit("yes"), F.col("domain").isNull()), fact("few_reviews", F.col("reviews").cast("string"), F.col("reviews") < 10),
    ))


@query(with_businesses("""
, p AS (SELECT id, [CASE WHEN category IS NOT NULL THEN 'category=' || category END, CASE WHEN city IS NOT NULL THEN 'city=' || city END, CASE WHEN rating >= 4 THEN 'rating=' || rating END, CASE WHEN domain IS NULL THEN 'no_website=yes' END, CASE WHEN reviews < 10 THEN 'few_reviews=' || reviews END] AS f FROM businesses)
SELECT id, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ';') AS packet, CAST(len(list_filter(f, lambda x: x IS NOT NULL)) AS BIGINT) AS n_facts FROM p"""))
def evidence_packets(spark, sf_dir):
    b = businesses(spark, sf_dir).withColumn("f", facts())
    return b.select("id", F.array_join(F.transform("f", lambda x: F.concat(x["k"], F.lit("="), x["v"])), ";").alias("packet"), F.size("f").cast("long").alias("n_facts"))


@query(with_businesses("""
SELECT id, CASE WHEN domain IS NULL OR reviews < 10 THEN 'A' WHEN rating >= 4 THEN 'B' ELSE 'C' END AS grade FROM businesses"""))
def packet_grade(spark, sf_dir):
    """A: a distinctive fact; B: a rating; C: neither."""
    keys = F.transform(facts(), lambda f: f["k"])
    grade = F.when(F.arrays_overlap(keys, F.array(F.lit("no_website"), F.lit("few_reviews"))), "A").when(F.array_contains(keys, "rating"), "B").otherwise("C")
    return businesses(spark, sf_dir).select("id", grade.alias("grade"))


@query(with_businesses("""
SELECT id, 'Hello, ' || name || ': ' || coalesce(CASE WHEN domain IS NULL THEN 'you have no site yet' END, CASE WHEN reviews < 10 THEN 'you have ' || reviews || ' reviews' END, CASE WHEN rating >= 4 THEN 'you are rated ' || rating END, 'we looked you up') || '.' AS body FROM businesses"""))
def template_draft(spark, sf_dir):
    first = F.coalesce(F.when(F.col("domain").isNull(), F.lit("you have no site yet")), F.when(F.col("reviews") < 10, F.concat(F.lit("you have "), F.col("reviews").cast("string"), F.lit(" reviews"))), F.when(F.col("rating") >= 4, F.concat(F.lit("you are rated "), F.col("rating").cast("string"))), F.lit("we looked you up"))
    return businesses(spark, sf_dir).select("id", F.concat(F.lit("Hello, "), "name", F.lit(": "), first, F.lit(".")).alias("body"))


@query(r"""
SELECT conv_id, turn, len(regexp_extract_all(text, '[0-9]+')) AS numbers, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') AS email, regexp_matches(text, 'https?://') AS url, length(text) > 400 AS too_long, regexp_matches(lower(text), '\b(guarantee|free|act now)\b') AS banned FROM conversations WHERE role = 'assistant'""")
def gate_number_email_url(spark, sf_dir):
    t = F.col("text")
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.regexp_count(t, F.lit("[0-9]+")).cast("long").alias("numbers"), t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+").alias("email"), t.rlike("https?://").alias("url"), (F.length(t) > 400).alias("too_long"), F.lower(t).rlike(r"\b(guarantee|free|act now)\b").alias("banned"))


@query()
def gate_full(spark, sf_dir):
    """Capitalised words inside a reply's sentences that stand nowhere in the turn before: unsupported names."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lower("text").alias("haystack"))
    inner = F.regexp_replace("text", r"(^|[.!?]\s+)\S+", " ")
    names = F.array_distinct(F.regexp_extract_all(inner, F.lit(r"\b\p{Lu}\p{Ll}+\b"), F.lit(0)))
    a = c.filter("role = 'assistant'").join(asked, ["conv_id", "turn"]).withColumn("names", names)
    missing = F.filter("names", lambda w: ~F.contains(F.col("haystack"), F.lower(w)))
    return a.select("conv_id", "turn", F.array_join(missing, ",").alias("unsupported"), (F.size(missing) == 0).alias("passed"))


@query("""
SELECT o_custkey, min(o_orderkey) AS pick FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) = 1""")
def heuristic_dm_label(spark, sf_dir):
    """Owners with exactly one candidate of the wanted title."""
    return table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("pick")).filter("n = 1").select("o_custkey", "pick")
