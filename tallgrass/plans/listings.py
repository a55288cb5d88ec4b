"""Listing cards, guesses of addresses, plans by list and the lesser operators around contacts and messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cards as K
from .base import businesses, query, table, with_businesses


@query(with_businesses("""
SELECT id, rating, CASE WHEN rating IS NOT NULL THEN reviews ELSE -1 END AS reviews FROM businesses"""))
def card_rating_parse(spark, sf_dir):
    """Rating and reviews read back from a card's line."""
    b = businesses(spark, sf_dir).withColumn("line", F.concat(F.col("rating").cast("string"), F.lit(" ("), F.format_number("reviews", 0), F.lit(")")))
    rating, reviews = K.rating_line(F.col("line"))
    return b.select("id", rating.alias("rating"), F.coalesce(reviews, F.lit(-1)).alias("reviews"))


@query("""
SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 1099511627776::HUGEINT + o_custkey::HUGEINT AS VARCHAR) AS cid FROM orders""")
def cid_hex_decode(spark, sf_dir):
    """Numbers of any order read back from hex."""
    o = table(spark, sf_dir, "orders")
    digits = F.concat(F.hex("o_orderkey"), F.lpad(F.hex("o_custkey"), 10, "0"))
    return o.select("o_orderkey", K.hex_to_decimal(digits).alias("cid"))


@query("""
SELECT page_id, url AS target FROM pages""")
def redirect_unwrap(spark, sf_dir):
    wrapped = F.concat(F.lit("https://search.example/url?q="), F.url_encode("url"), F.lit("&sa=U"))
    return table(spark, sf_dir, "pages").select("page_id", K.unwrap_redirect(wrapped).alias("target"))


@query(with_businesses("""
SELECT id, CASE WHEN phone IS NOT NULL THEN phone END AS phone FROM businesses"""))
def card_phone_segment(spark, sf_dir):
    line = F.concat_ws(" · ", F.lit("Open"), F.lit("Closes 5"), F.col("phone"))
    return businesses(spark, sf_dir).select("id", K.last_segment_phone(line).alias("phone"))


@query("""
SELECT s_suppkey, 'Mon ' || (8 + s_suppkey % 3) || '-17 | Wed ' || (9 + s_suppkey % 2) || '-12, 13-18' || CASE WHEN s_suppkey % 2 = 0 THEN ' | Sun 10-14' ELSE '' END AS hours FROM supplier""")
def format_hours(spark, sf_dir):
    k = F.col("s_suppkey")
    hours = F.create_map(
        F.lit("Wednesday"), F.array(F.concat((9 + k % 2).cast("string"), F.lit("-12")), F.lit("13-18")), F.lit("Sunday"), F.when(k % 2 == 0, F.array(F.lit("10-14"))).otherwise(F.array().cast("array<string>")),
        F.lit("Monday"), F.array(F.concat((8 + k % 3).cast("string"), F.lit("-17"))),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.format_hours(hours).alias("hours"))


@query("""
SELECT doc_id, translate(lower(text), 'àáâäãåçèéêëìíîïñòóôöõùúûüý', 'aaaaaaceeeeiiiinooooouuuuy') AS folded FROM documents""")
def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.ascii_fold(F.col("text")).alias("folded"))


INFER = """
WITH a AS (SELECT c_nationkey AS domain, c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'jane.doe' WHEN 1 THEN 'j.doe' WHEN 2 THEN 'jane_doe' WHEN 3 THEN 'info' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'al.roe' ELSE 'b.roe' END END AS loc FROM customer),
s AS (SELECT domain, CASE WHEN regexp_matches(loc, '^[a-z]{2,}\\.[a-z]{2,}$') THEN 'first.last' WHEN regexp_matches(loc, '^[a-z]\\.[a-z]{2,}$') THEN 'f.last' WHEN regexp_matches(loc, '^[a-z]{2,}_[a-z]{2,}$') THEN 'first_last' END AS shape, c_custkey FROM a),
g AS (SELECT domain, shape, count(*) AS n, min(c_custkey) AS f FROM s WHERE shape IS NOT NULL GROUP BY 1, 2)
SELECT domain, shape, n, round(least(0.75, 0.45 + 0.15 * (n - 1))::DOUBLE, 2) AS confidence, CASE shape WHEN 'first.last' THEN 'zoe.oneal' WHEN 'f.last' THEN 'z.oneal' ELSE 'zoe_oneal' END AS guess FROM g QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, f) = 1""".replace("\\\\", "\\")


@query(INFER)
def infer_email(spark, sf_dir):
    """The commonest shape of a site's addresses and what it gives for a person; the one seen first wins a tie."""
    k = F.col("c_custkey") % 5
    local = F.when(k == 0, "jane.doe").when(k == 1, "j.doe").when(k == 2, "jane_doe").when(k == 3, "info").when(F.col("c_nationkey") % 2 == 0, "al.roe").otherwise("b.roe")
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("domain"), K.shape_of(local).alias("shape"), "c_custkey").filter("shape IS NOT NULL")
    g = s.groupBy("domain", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("f"))
    best = g.groupBy("domain").agg(F.max_by(F.struct("shape", "n"), F.struct("n", -F.col("f"))).alias("b")).select("domain", "b.*")
    confidence = F.round(F.least(F.lit(0.75), 0.45 + 0.15 * (F.col("n") - 1)), 2)
    return best.select("domain", "shape", "n", confidence.alias("confidence"), K.build_local(F.col("shape"), F.lit("Zoé"), F.lit("Oneal")).alias("guess"))


@query("""
WITH s AS (SELECT p_partkey, unnest([replace(p_name, ' ', ''), replace(p_name, ' ', '-')]) AS slug FROM part) SELECT p_partkey, slug || '.' || tld AS candidate FROM s, (SELECT unnest(['com', 'co.uk', 'net']) AS tld) t""")
def domain_candidates(spark, sf_dir):
    slugs = F.array(F.regexp_replace("p_name", " ", ""), F.regexp_replace("p_name", " ", "-"))
    tlds = F.array(F.lit("com"), F.lit("co.uk"), F.lit("net"))
    found = F.flatten(F.transform(slugs, lambda s: F.transform(tlds, lambda t: F.concat(s, F.lit("."), t))))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("candidate"))


@query("""
WITH c AS (SELECT DISTINCT p_brand, p_size FROM part), n AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1) // 5 AS chunk FROM c) SELECT p_brand, chunk, string_agg(p_size, ',' ORDER BY p_size) AS codes FROM n GROUP BY 1, 2""")
def plan_code_chunks(spark, sf_dir):
    """Each area's codes in chunks of five, one query each."""
    codes = F.array_sort(F.collect_set("p_size"))
    c = table(spark, sf_dir, "part").groupBy("p_brand").agg(codes.alias("codes"))
    c = c.select("p_brand", "codes", F.explode(F.sequence(F.lit(0), F.floor((F.size("codes") - 1) / 5))).alias("chunk"))
    return c.select("p_brand", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.slice("codes", (F.col("chunk") * 5 + 1).cast("int"), F.lit(5)), ",").alias("codes"))


@query("""
SELECT n_nationkey, cat, row_number() OVER (ORDER BY turn, n_nationkey, cat) AS place FROM (SELECT n_nationkey, cat, row_number() OVER (PARTITION BY n_nationkey ORDER BY cat) AS turn FROM nation, (SELECT DISTINCT p_type AS cat FROM part) p) x""")
def plan_builder(spark, sf_dir):
    """Every area with every category, rotated so that each area's next query comes in turn."""
    cats = table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_type")).alias("cats"))
    n = table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(cats), F.lit(True))  # one row of a few categories
    q = n.select("n_nationkey", F.posexplode("cats").alias("turn", "cat"))
    return q.select("n_nationkey", "cat", F.row_number().over(Window.orderBy("turn", "n_nationkey", "cat")).cast("long").alias("place"))


@query("""
WITH p AS (SELECT p_partkey, (p_retailprice - 900.0) / 1200.0 AS x, (p_size - 1.0) / 50.0 AS y FROM part), d AS (SELECT p_partkey, CAST(d AS INTEGER) AS depth, CAST(least((1 << d) - 1, floor(x * (1 << d))) AS BIGINT) AS ix, CAST(least((1 << d) - 1, floor(y * (1 << d))) AS BIGINT) AS iy FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS d) s),
c AS (SELECT depth, ix, iy, count(*) AS n FROM d GROUP BY 1, 2, 3), l AS (SELECT d.p_partkey, min(d.depth) AS depth FROM d JOIN c USING (depth, ix, iy) WHERE n <= 40 OR depth = 4 GROUP BY 1)
SELECT l.depth, d.ix, d.iy, count(*) AS n FROM l JOIN d ON d.p_partkey = l.p_partkey AND d.depth = l.depth GROUP BY 1, 2, 3""")
def quadtree_leaves(spark, sf_dir):
    """Boxes split while they hold over forty points, to depth four; every level follows by arithmetic."""
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_retailprice") - 900.0) / 1200.0).alias("x"), ((F.col("p_size") - 1.0) / 50.0).alias("y"))
    d = p.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("w", F.expr("shiftleft(1, depth)"))
    cell = lambda c: F.least(F.col("w") - 1, F.floor(F.col(c) * F.col("w"))).cast("long")
    d = d.select("p_partkey", "depth", cell("x").alias("ix"), cell("y").alias("iy"))
    c = d.groupBy("depth", "ix", "iy").agg(F.count(F.lit(1)).alias("n")).filter("n <= 40 OR depth = 4")
    leaf = d.join(c, ["depth", "ix", "iy"]).groupBy("p_partkey").agg(F.min(F.struct("depth", "ix", "iy")).alias("l"))
    return leaf.groupBy("l.depth", "l.ix", "l.iy").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, coalesce(date_diff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)), -1) AS days FROM events WHERE event_type = 'click'""")
def message_step_number(spark, sf_dir):
    """Which message of a target it is, and days since the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return e.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("step"), F.coalesce(F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(w))), F.lit(-1)).cast("long").alias("days"))


@query("""
SELECT user_id, event_type, arg_max(value, event_id) AS label, arg_max(CAST(props->>'$.k' AS BIGINT), event_id) FILTER (CAST(props->>'$.k' AS BIGINT) > 20) AS kept FROM events GROUP BY 1, 2""")
def contact_upsert_conflict(spark, sf_dir):
    """On a conflict the new label wins; the other column only if the new value counts."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("label"), F.max_by("k", F.when(F.col("k") > 20, F.col("event_id"))).alias("kept"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def status_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).fillna(0)


@query("""
SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS s FROM events) e""")
def duration_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.duration(F.floor(F.col("value") * 97)).alias("duration"))


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'callback' WHEN '2-HIGH' THEN 'voicemail' WHEN '3-MEDIUM' THEN 'not_interested' ELSE trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') END AS outcome FROM orders""")
def canonical_outcome(spark, sf_dir):
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", " Call Back").when(p == "2-HIGH", "left vm").when(p == "3-MEDIUM", "NI").otherwise(p)
    return table(spark, sf_dir, "orders").select("o_orderkey", K.outcome(raw).alias("outcome"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
h AS (SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.word = 'with' AND b.word = 'from' AND abs(a.pos - b.pos) <= 4) SELECT doc_id, h.doc_id IS NOT NULL AS near FROM documents LEFT JOIN h USING (doc_id)""")
def booking_word_distance(spark, sf_dir):
    """Whether two trigger words stand within four words of each other."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(K.near_words(F.col("text"), "with", "from", 4), F.lit(False)).alias("near"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_qualifying_hit(spark, sf_dir):
    """The first hit of each lookup that passes the gates, in the order of the answer."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P' AND o_totalprice > 100000")
    return o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_totalprice").alias("o_totalprice"))


@query(with_businesses("""
, k AS (SELECT phone, min(seq) AS first FROM businesses WHERE phone IS NOT NULL GROUP BY 1), known AS (SELECT DISTINCT phone FROM businesses WHERE source = 'register' AND phone IS NOT NULL)
SELECT b.id, known.phone IS NOT NULL AS known FROM businesses b JOIN k ON b.phone = k.phone AND b.seq = k.first LEFT JOIN known ON known.phone = b.phone"""))
def batch_dedupe_known_flag(spark, sf_dir):
    """The first row of each number in a batch, and whether the register has it already."""
    b = businesses(spark, sf_dir).filter("phone IS NOT NULL")
    first = b.groupBy("phone").agg(F.min_by("id", "seq").alias("id"), F.bool_or(F.col("source") == "register").alias("known"))
    return first.select("id", "known")


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bsincerely\b') OR len(regexp_extract_all(text, '(?i)\b(?:was|were|they|from)\b')) >= 2 THEN 'noise' ELSE 'clean' END AS review FROM documents""")
def review_noise(spark, sf_dir):
    """One strong marker, or two weak ones."""
    strong, weak = F.col("text").rlike(r"(?i)\bsincerely\b"), F.regexp_count("text", F.lit(r"(?i)\b(?:was|were|they|from)\b")) >= 2
    return table(spark, sf_dir, "documents").select("doc_id", F.when(strong | weak, "noise").otherwise("clean").alias("review"))


@query("""
SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS confirmed, arg_max(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS evidence FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') > 0""")
def confirmation_evidence(spark, sf_dir):
    """The strongest confirmed observation of each owner, and the newest that isn't of the weakest kind."""
    done, strong = F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "5-LOW"
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(done, F.col("o_totalprice"))).alias("confirmed"), F.max(F.when(done & strong, F.col("o_orderkey"))).alias("evidence"))
    return o.filter("evidence IS NOT NULL")


@query(with_businesses("""
, d AS (SELECT name, min(seq) AS keep FROM businesses WHERE source = 'maps' GROUP BY 1 HAVING count(*) >= 2) SELECT b.id AS drop_id, k.id AS keep_id FROM businesses b JOIN d ON b.name = d.name AND b.seq <> d.keep JOIN businesses k ON k.seq = d.keep WHERE b.source = 'maps'"""))
def repair_merge_groups(spark, sf_dir):
    """Groups of one name: which rows go, and into which."""
    b = businesses(spark, sf_dir).filter("source = 'maps'")
    g = b.groupBy("name").agg(F.min_by("id", "seq").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return b.join(g, "name").filter("id <> keep_id").select(F.col("id").alias("drop_id"), "keep_id")


