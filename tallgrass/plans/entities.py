"""Sources, filters, entity resolution and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import resolve as R
from .base import businesses, query, table, with_businesses


@query("""
SELECT 'customer' AS origin, CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_nationkey AS area, c_acctbal AS amount FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, s_nationkey, s_acctbal FROM supplier
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, -1, p_retailprice FROM part""")
def union_sources_field_map(spark, sf_dir):
    """Sources of different columns through their field maps into one schema."""
    maps = {
        "customer": {"key": "c_custkey", "name": "c_name", "area": "c_nationkey", "amount": "c_acctbal"},
        "supplier": {"key": "s_suppkey", "name": "s_name", "area": "s_nationkey", "amount": "s_acctbal"},
        "part": {"key": "p_partkey", "name": "p_name", "amount": "p_retailprice"},  # has no area
    }
    out = None
    for origin, fields in maps.items():
        rows = table(spark, sf_dir, origin).select(F.lit(origin).alias("origin"), *[F.col(c).alias(a) for a, c in fields.items()]).withColumn("key", F.col("key").cast("string"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.fillna({"area": -1})


@query(with_businesses("""
SELECT id, coalesce(domain, phone, place_id, 'none') AS route, CASE WHEN domain IS NOT NULL THEN 'domain' WHEN phone IS NOT NULL THEN 'phone' WHEN place_id IS NOT NULL THEN 'place' ELSE 'none' END AS route_kind FROM businesses"""))
def first_present_pick(spark, sf_dir):
    b = businesses(spark, sf_dir)
    kind = F.when(T.absent(F.col("domain")).isNotNull(), "domain").when(T.absent(F.col("phone")).isNotNull(), "phone").when(T.absent(F.col("place_id")).isNotNull(), "place").otherwise("none")
    return b.select("id", F.coalesce(T.first_present(F.col("domain"), F.col("phone"), F.col("place_id")), F.lit("none")).alias("route"), kind.alias("route_kind"))


@query("""
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, coalesce(CAST(props->>'$.missing' AS VARCHAR), 'absent') AS missing FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50""")
def json_props_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.filter(k >= 50).select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("absent")).alias("missing"))


@query("""
SELECT p_partkey, p_brand, p_size FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL') AND p_size BETWEEN 5 AND 40 AND p_brand <> 'Brand#13'""")
def company_filter_exclude_list(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter(~F.col("p_type").isin("ECONOMY", "SMALL") & F.col("p_size").between(5, 40) & (F.col("p_brand") != "Brand#13")).select("p_partkey", "p_brand", "p_size")


@query("""
SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, json_valid(props) AS parsed FROM events""")
def permissive_json_scan(spark, sf_dir):
    """Lines that don't parse stay, marked."""
    e = table(spark, sf_dir, "events").withColumn("j", F.from_json("props", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return e.select("event_id", F.col("j.k").alias("k"), F.col("j._bad").isNull().alias("parsed"))


@query(with_businesses("""
, suppressed AS (SELECT DISTINCT 'site' || (user_id % 300) || '.example.com' AS domain FROM events WHERE event_type = 'error' AND value > 90)
SELECT id, category, reviews, CAST(row_number() OVER (ORDER BY (category = 'REGISTER'), reviews DESC, id) AS BIGINT) AS place FROM businesses b
WHERE domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM suppressed s WHERE s.domain = b.domain)
QUALIFY place <= 200"""))
def enrich_queue_priority(spark, sf_dir):
    """The next 200 rows to visit: with a site, not suppressed, most reviewed first."""
    sup = table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 90").select(F.concat(F.lit("site"), (F.col("user_id") % 300).cast("string"), F.lit(".example.com")).alias("domain")).distinct()
    queue = businesses(spark, sf_dir).filter("domain IS NOT NULL").join(sup, "domain", "left_anti")
    top = queue.orderBy(F.col("category") == "REGISTER", F.desc("reviews"), "id").limit(200)  # a queue's length is the feature
    return top.select("id", "category", "reviews", F.row_number().over(Window.orderBy(F.col("category") == "REGISTER", F.desc("reviews"), "id")).cast("long").alias("place"))


@query("""
SELECT DISTINCT o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = '1-URGENT')""")
def dm_pending_semi_anti(spark, sf_dir):
    """Owners with a candidate row and without a labelled one."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    some = o.join(l.filter("l_returnflag = 'R'"), o.o_orderkey == l.l_orderkey, "left_semi")
    done = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return some.join(done, "o_custkey", "left_anti").select("o_custkey").distinct()


@query("""
SELECT event_id, user_id, event_type, CAST(strftime(due, '%Y-%m-%d') AS VARCHAR) AS due FROM (
  SELECT *, CASE WHEN event_type = 'click' THEN ts + INTERVAL 5 DAY WHEN event_type = 'purchase' THEN ts + INTERVAL 10 DAY END AS due FROM events) x
WHERE due IS NOT NULL AND due <= TIMESTAMP '2024-01-20 00:00:00'""")
def observations_due(spark, sf_dir):
    """Observations whose deadline has come by a given day."""
    ts = F.col("ts").cast("timestamp")
    due = F.when(F.col("event_type") == "click", ts + F.expr("INTERVAL 5 DAYS")).when(F.col("event_type") == "purchase", ts + F.expr("INTERVAL 10 DAYS"))
    rows = table(spark, sf_dir, "events").withColumn("due", due)
    return rows.filter("due <= timestamp'2024-01-20 00:00:00'").select("event_id", "user_id", "event_type", F.date_format("due", "yyyy-MM-dd").alias("due"))


@query(with_businesses("""
SELECT id, CASE WHEN phone IS NULL THEN 'no_phone' WHEN regexp_matches(lower(name), '\\b(group|franchise)\\b') THEN 'franchise_or_chain' WHEN domain IS NULL THEN 'no_website_hard' WHEN regexp_matches(name, '\\b13\\b') THEN 'competitor:13' END AS reason FROM businesses""".replace("\\\\", "\\")))
def hard_disqualify_first_match(spark, sf_dir):
    b = businesses(spark, sf_dir)
    reason = (
        F.when(F.col("phone").isNull(), "no_phone").when(F.lower("name").rlike(r"\b(group|franchise)\b"), "franchise_or_chain")
        .when(F.col("domain").isNull(), "no_website_hard").when(F.col("name").rlike(r"\b13\b"), "competitor:13")
    )
    return b.select("id", reason.alias("reason"))


@query(with_businesses("""
SELECT id, coalesce(domain, CASE WHEN source = 'register' THEN 'register row: no site listed' ELSE 'no site on the listing' END) AS site,
 coalesce(phone, 'no phone found') AS phone_text, coalesce(CAST(rating AS VARCHAR), CASE WHEN reviews > 0 THEN 'reviews without rating' ELSE 'no reviews' END) AS rating_text FROM businesses"""))
def blank_reason_fill(spark, sf_dir):
    """No blank cell: each says why it has no value."""
    b = businesses(spark, sf_dir)
    site = F.coalesce("domain", F.when(F.col("source") == "register", "register row: no site listed").otherwise("no site on the listing"))
    rating = F.coalesce(F.col("rating").cast("string"), F.when(F.col("reviews") > 0, "reviews without rating").otherwise("no reviews"))
    return b.select("id", site.alias("site"), F.coalesce("phone", F.lit("no phone found")).alias("phone_text"), rating.alias("rating_text"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(t, '^[=@+\-]') THEN '''' || t ELSE t END AS cell FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t FROM documents) d""")
def safe_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_cell(F.col("text")).alias("cell"))


@query(with_businesses("""
, k AS (SELECT id, coalesce('pid:' || place_id, 'na:' || substr(sha1(trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\b(llc|l\\.l\\.c\\.|inc\\.?|incorporated|ltd\\.?|limited|gmbh|s\\.?a\\.?|pllc|llp|co\\.|corp\\.?|corporation)\\b\\.?', '', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) || '|' || lower(postal) || '|' || lower(city)), 1, 12)) AS dedupe_key FROM businesses)
SELECT id, dedupe_key, 'biz_' || substr(sha1(dedupe_key), 1, 12) AS entity_id FROM k""".replace("\\\\", "\\")))
def dedupe_key_id(spark, sf_dir):
    b = businesses(spark, sf_dir)
    key = R.dedupe_key(F.col("place_id"), F.lit(None).cast("string"), F.col("name"), F.col("postal"), F.col("city"))
    return b.select("id", key.alias("dedupe_key"), R.entity_id(key).alias("entity_id"))


@query(with_businesses("""
SELECT name AS entity, arg_min(domain, seq) FILTER (domain IS NOT NULL) AS domain, arg_min(phone, seq) FILTER (phone IS NOT NULL) AS phone, arg_max(rating, seq) FILTER (rating IS NOT NULL) AS rating,
 string_agg(DISTINCT category, ',' ORDER BY category) AS category, count(*) AS n_rows, min(seq) AS first_seq FROM businesses GROUP BY name"""))
def upsert_richest_merge(spark, sf_dir):
    b = businesses(spark, sf_dir).withColumnRenamed("name", "entity")
    return R.richest_merge(b, "entity", "seq", ["domain", "phone"], ["rating"], ["category"])


@query(with_businesses("""
, t AS (SELECT id, phone, seq, source, 'firm' AS w, regexp_extract(name, '[0-9]+') AS num, split_part(postal, ' ', 1) AS district FROM businesses WHERE phone IS NOT NULL)
SELECT b.id AS drop_id, arg_min(a.id, a.seq) AS keep_id FROM t a JOIN t b ON a.phone = b.phone WHERE a.source = 'maps' AND b.source = 'register' GROUP BY b.id"""))
def phone_fallback_merge(spark, sf_dir):
    """Register rows that fold into a listing of the same phone; all names here share a token."""
    b = businesses(spark, sf_dir).filter("phone IS NOT NULL")
    return R.phone_matches(b.filter("source = 'maps'"), b.filter("source = 'register'"))


@query("""
SELECT l_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS categories, count(DISTINCT p_type) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def merge_categories_union(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = l.select("l_suppkey", "l_partkey").join(p.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    cats = F.array_sort(F.collect_set("p_type"))
    return j.groupBy("l_suppkey").agg(F.array_join(cats, ",").alias("categories"), F.size(cats).cast("long").alias("n"))


@query(with_businesses("""
, d AS (SELECT domain FROM businesses WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1), p AS (SELECT phone FROM businesses WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT id, coalesce('domain:' || d.domain, 'phone:' || p.phone) AS chain FROM businesses b LEFT JOIN d ON d.domain = b.domain LEFT JOIN p ON p.phone = b.phone WHERE d.domain IS NOT NULL OR p.phone IS NOT NULL"""))
def chain_map(spark, sf_dir):
    return R.chain_map(businesses(spark, sf_dir), "id", "domain", "phone")


@query("""
WITH m AS (SELECT c_custkey AS drop_id, c_custkey - 1 AS keep_id FROM customer WHERE c_custkey % 3 = 1)
SELECT coalesce(keep_id, o_custkey) AS o_custkey, o_orderpriority, min(o_orderkey) AS child_id FROM orders LEFT JOIN m ON o_custkey = drop_id GROUP BY 1, 2""")
def repoint_children(spark, sf_dir):
    m = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 1").select(F.col("c_custkey").alias("drop_id"), (F.col("c_custkey") - 1).alias("keep_id"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("child_id"))
    return R.repoint(o, m, "o_custkey", ["o_custkey", "o_orderpriority"])


@query("""
WITH old AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <= 2), new AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS first_order FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2)
SELECT n.* FROM new n LEFT JOIN old o USING (l_suppkey, l_partkey) WHERE o.l_suppkey IS NULL""")
def insert_ignore_people(spark, sf_dir):
    """New keys only; a key that is there already is left alone."""
    l = table(spark, sf_dir, "lineitem")
    new = l.filter("l_linenumber > 2").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("first_order"))
    return new.join(l.filter("l_linenumber <= 2").select("l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"], "left_anti")


@query("""
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS seen, min(event_id) AS kept FROM events GROUP BY 1, 2, 3""")
def observation_dedupe(spark, sf_dir):
    """One observation for each logical key, the first."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("seen"), F.min("event_id").alias("kept"))


@query("""
SELECT DISTINCT owner, kind, v FROM (SELECT c_custkey AS owner, 'segment' AS kind, c_mktsegment AS v FROM customer UNION ALL SELECT o_custkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_custkey, 'status', o_orderstatus FROM orders) x
WHERE NOT EXISTS (SELECT 1 FROM orders y WHERE y.o_custkey = x.owner AND y.o_orderpriority = x.v AND y.o_totalprice > 400000)""")
def backfill_union(spark, sf_dir):
    """Three tables as observations, without those that stand already."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.select(F.col("c_custkey").alias("owner"), F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("v"))
    rows = rows.unionByName(o.select(F.col("o_custkey").alias("owner"), F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("v")))
    rows = rows.unionByName(o.select(F.col("o_custkey").alias("owner"), F.lit("status").alias("kind"), F.col("o_orderstatus").alias("v")))
    old = o.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("v"))
    return rows.distinct().join(old, ["owner", "v"], "left_anti").select("owner", "kind", "v")


@query("""
WITH s AS (SELECT o_custkey AS user_id, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1)
SELECT c_custkey, c_mktsegment, orders, CAST(spent AS DOUBLE) AS spent, CAST(least(100, orders * 3 + CASE WHEN c_acctbal > 5000 THEN 25 ELSE 5 END + CASE WHEN spent > 2000000 THEN 30 ELSE 10 END) AS BIGINT) AS score FROM customer JOIN s ON c_custkey = user_id
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey AND event_type = 'error' AND value > 50)""")
def ranked_leads_anti(spark, sf_dir):
    """Scored leads without the suppressed."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    sup = table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 50").select(F.col("user_id").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").join(sup, "c_custkey", "left_anti")
    score = F.least(F.lit(100), F.col("orders") * 3 + F.when(F.col("c_acctbal") > 5000, 25).otherwise(5) + F.when(F.col("spent") > 2000000, 30).otherwise(10))
    return c.join(s, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment", "orders", F.col("spent").cast("double").alias("spent"), score.cast("long").alias("score"))


@query(with_businesses("""
, r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'site' || (user_id % 300) || '.example.com' END AS domain, CASE WHEN event_id % 2 = 0 THEN '+1713555' || lpad(CAST(user_id % 500 AS VARCHAR), 4, '0') END AS phone FROM events),
d AS (SELECT domain, count(*) AS n, min(id) AS id FROM businesses WHERE domain IS NOT NULL GROUP BY 1), p AS (SELECT phone, count(*) AS n, min(id) AS id FROM businesses WHERE phone IS NOT NULL GROUP BY 1)
SELECT event_id, CASE WHEN d.n = 1 THEN d.id WHEN d.n > 1 THEN NULL WHEN p.n = 1 THEN p.id END AS match_id,
 CASE WHEN d.n = 1 THEN 'domain' WHEN d.n > 1 THEN 'ambiguous:domain' WHEN p.n = 1 THEN 'phone' WHEN p.n > 1 THEN 'ambiguous:phone' ELSE 'unmatched' END AS reason
FROM r LEFT JOIN d ON d.domain = r.domain LEFT JOIN p ON p.phone = r.phone"""))
def unique_hit_cascade(spark, sf_dir):
    """List rows matched by domain, then phone, only where one business is hit."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("site"), (F.col("user_id") % 300).cast("string"), F.lit(".example.com"))).alias("domain"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("+1713555"), F.lpad((F.col("user_id") % 500).cast("string"), 4, "0"))).alias("phone"))
    return R.unique_hits(e, businesses(spark, sf_dir), ["domain", "phone"]).select("event_id", "match_id", "reason")


@query("""
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_message_per_target(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    best = F.max(F.struct("ts", "event_id", "value")).alias("m")
    return e.groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 40 AND l_discount >= 0.08)""")
def person_route_exists(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), table(spark, sf_dir, "lineitem").filter("l_quantity >= 40 AND l_discount >= 0.08")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@query("""
SELECT p_brand, count(*) AS n, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS value FROM events JOIN part ON p_partkey = CAST(props->>'$.k' AS BIGINT) GROUP BY 1""")
def json_key_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("p_partkey"), "value")
    return e.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


@query("""
WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
a AS (SELECT * FROM t WHERE word = 'the'), b AS (SELECT * FROM t WHERE word = 'that')
SELECT a.doc_id, a.pos AS pos, min(abs(a.pos - b.pos)) AS gap FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 5 GROUP BY 1, 2""")
def nearest_span_pairing(spark, sf_dir):
    """For each span of one kind the nearest of the other within five words: an equi-join on buckets of places, not on whole documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "word")).filter(F.col("word").isin("the", "that"))
    d = d.withColumn("pos", (F.col("pos") + 1).cast("long")).withColumn("cell", F.floor(F.col("pos") / 6))
    a = d.filter("word = 'the'").select("doc_id", "pos", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    b = d.filter("word = 'that'").select("doc_id", F.col("pos").alias("other"), "cell")
    return a.join(b, ["doc_id", "cell"]).filter("abs(pos - other) <= 5").groupBy("doc_id", "pos").agg(F.min(F.abs(F.col("pos") - F.col("other"))).alias("gap"))
