"""Scalars and what is taken out of text and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contacts as C
from .base import businesses, query, table, with_businesses

LEGAL_SQL = r"\b(llc|l\.l\.c\.|inc\.?|incorporated|ltd\.?|limited|gmbh|s\.?a\.?|pllc|llp|co\.|corp\.?|corporation)\b\.?"
EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
TRACKING_SQL = "['utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','ref']"
HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
SECOND_SQL = str(tuple(T.SECOND_LEVEL))
STRIP_SQL = "regexp_replace(" * 4 + "html" + "".join(rf", '(?is)<{t}\b.*?(</{t}\s*>|$)', '', 'g')" for t in ("script", "style", "noscript", "template"))


@query(with_businesses(rf"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{LEGAL_SQL}', '', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS name_norm FROM businesses"""))
def norm_name(spark, sf_dir):
    return businesses(spark, sf_dir).select("id", T.norm_name(F.col("name")).alias("name_norm"))


@query(rf"""
WITH u AS (SELECT page_id, url, {HOST_SQL} AS host, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({TRACKING_SQL}, lower(split_part(p, '=', 1)))) AS q FROM pages)
SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || host || regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS website FROM u""")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("website"))


@query(rf"""
WITH h AS (SELECT page_id, string_split(regexp_replace(regexp_replace({HOST_SQL}, ':\d+$', ''), '^www\.', ''), '.') AS l FROM pages),
t AS (SELECT page_id, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three FROM h) SELECT page_id, CASE WHEN two IN {SECOND_SQL} THEN three ELSE two END AS domain FROM t""")
def apex_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.apex_domain(T.host(F.col("url"))).alias("domain"))


@query(rf"""
WITH k AS (SELECT regexp_replace({HOST_SQL}, '^www\.', '') || regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS page FROM pages)
SELECT page, count(*) AS n FROM k GROUP BY 1""")
def url_dedup_key(spark, sf_dir):
    key = F.substring_index(T.url_key(F.col("url")), "?", 1)
    return table(spark, sf_dir, "pages").groupBy(key.alias("page")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+?[0-9(][0-9()\-. ]{7,}[0-9]')) AS raw FROM documents), d AS (SELECT *, regexp_replace(raw, '\D', '', 'g') AS d FROM p)
SELECT doc_id, raw, CASE WHEN starts_with(raw, '+') THEN CASE WHEN starts_with(d, '1') THEN CASE WHEN regexp_matches(d, '^1?[2-9]\d{2}[2-9]\d{6}$') THEN '+' || d END WHEN regexp_matches(d, '^\d{8,15}$') THEN '+' || d END
 WHEN regexp_matches(d, '^1?[2-9]\d{2}[2-9]\d{6}$') THEN '+1' || CASE WHEN length(d) = 11 THEN substr(d, 2) ELSE d END END AS e164 FROM d""")
def e164_subset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.PHONE), F.lit(0))).alias("raw"))
    return d.select("doc_id", "raw", T.e164(F.col("raw")).alias("e164"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'never verified' WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 'yes' ELSE '' END AS stale FROM events""")
def stale_flag(spark, sf_dir):
    old = F.col("ts").cast("timestamp") < F.expr("timestamp'2024-01-10 00:00:00'")
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "never verified").when(old, "yes").otherwise("").alias("stale"))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'GB' WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' ELSE 'none' END AS region FROM documents""")
def map_lookup_region(spark, sf_dir):
    regions = {"en": "england", "de": "germany", "fr": "france", "es": "spain"}
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.lookup(T.REGIONS, T.lookup(regions, F.col("lang"))), F.lit("none")).alias("region"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS title FROM part""")
def title_case_acronyms(spark, sf_dir):
    """Short words as acronyms, others capitalised."""
    word = lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.initcap(w))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), word), " ").alias("title"))


@query("""
WITH n AS (SELECT p_partkey, upper(split_part(p_name, ' ', 2)) || ', ' || split_part(p_name, ' ', 1) AS raw FROM part)
SELECT p_partkey, upper(trim(split_part(raw, ',', 2))[1]) || lower(trim(split_part(raw, ',', 2))[2:]) || ' ' || upper(split_part(raw, ',', 1)[1]) || lower(split_part(raw, ',', 1)[2:]) AS natural FROM n""")
def natural_name(spark, sf_dir):
    raw = F.concat(F.upper(F.element_at(F.split("p_name", " "), 2)), F.lit(", "), F.substring_index("p_name", " ", 1))
    return table(spark, sf_dir, "part").select("p_partkey", T.natural_name(raw).alias("natural"))


@query(rf"""
SELECT page_id, sha256({STRIP_SQL}) AS bare_sha256, length({STRIP_SQL}) AS n FROM pages""")
def strip_noise_html(spark, sf_dir):
    bare = T.strip_noise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(bare, 256).alias("bare_sha256"), F.length(bare).cast("long").alias("n"))


@query(rf"""
SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{EMAIL_SQL}'))) AS email FROM documents""")
def extract_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@query(rf"""
WITH e AS (SELECT doc_id, text, regexp_extract(text, '{EMAIL_SQL}') AS email FROM documents)
SELECT doc_id, email, trim(regexp_replace(substr(text, greatest(1, instr(text, email) - 90), least(90, instr(text, email) - 1) + length(email) + 90), '\s+', ' ', 'g')) AS context FROM e WHERE email <> ''""")
def email_context_window(spark, sf_dir):
    """What stands around each of a document's addresses, at its first place; the SQL takes the first address only."""
    found = F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))
    lowered = F.transform(found, F.lower)
    distinct = F.filter(found, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(distinct).alias("email"))
    at = F.instr("text", F.col("email"))
    start = F.greatest(F.lit(1), at - 90)
    window = F.substring(F.col("text"), start, F.least(F.lit(90), at - 1) + F.length("email") + 90)
    return d.select("doc_id", "email", T.clean_name(window).alias("context"))


@query(rf"""
WITH e AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{EMAIL_SQL}'))) AS email FROM documents), f AS (SELECT *, split_part(email, '@', 1) AS loc, split_part(email, '@', -1) AS host, 'mail' || (doc_id % 10) || '.example.com' AS domain FROM e)
SELECT doc_id, email, CASE WHEN host = domain OR ends_with(host, '.' || domain) OR ends_with(domain, '.' || host) THEN 'own_domain' WHEN host NOT IN ('gmail.com','yahoo.com','hotmail.com','outlook.com','icloud.com','aol.com','live.com','protonmail.com') THEN 'foreign' WHEN contains(loc, 'firm') THEN 'freemail_linked' ELSE 'freemail_unlinked' END AS affinity FROM f""")
def email_affinity(spark, sf_dir):
    e = extract_emails(spark, sf_dir).withColumn("domain", F.concat(F.lit("mail"), (F.col("doc_id") % 10).cast("string"), F.lit(".example.com")))
    return e.select("doc_id", "email", C.email_affinity(F.col("email"), F.col("domain"), F.lit("Firm")).alias("affinity"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+?[0-9(][0-9()\-. ]{7,}[0-9]')) AS raw FROM documents), d AS (SELECT doc_id, raw, regexp_replace(raw, '\D', '', 'g') AS d FROM p),
e AS (SELECT doc_id, CASE WHEN starts_with(raw, '+') THEN CASE WHEN starts_with(d, '1') THEN CASE WHEN regexp_matches(d, '^1?[2-9]\d{2}[2-9]\d{6}$') THEN '+' || d END WHEN regexp_matches(d, '^\d{8,15}$') THEN '+' || d END WHEN regexp_matches(d, '^1?[2-9]\d{2}[2-9]\d{6}$') THEN '+1' || right(d, 10) END AS e FROM d)
SELECT doc_id, count(DISTINCT e) AS phones FROM e WHERE e IS NOT NULL GROUP BY 1""")
def extract_phones(spark, sf_dir):
    return e164_subset(spark, sf_dir).filter("e164 IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("e164").alias("phones"))


@query(r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*?href="([^"]*)"[^>]*>', 1) AS l FROM pages) SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(l) AS href FROM a) x GROUP BY 1, 2""")
def anchor_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(T.HREF), F.lit(1))).alias("href"))
    return p.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*?href="([^"]*)"[^>]*>', 1) AS l FROM pages), b AS (SELECT page_id, unnest(l) AS href, unnest(range(1, len(l) + 1)) AS pos FROM a),
c AS (SELECT page_id, href, min(pos) AS pos, CASE WHEN regexp_matches(lower(href), '(about|team|contact|the|and)') THEN 0 ELSE 1 END AS pri FROM b GROUP BY 1, 2)
SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pri, pos) AS place FROM c QUALIFY place <= 4""")
def link_priority_cap(spark, sf_dir):
    """The four links to follow of each page: wanted ones first, then as they stand; the cap is the feature."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(T.HREF), F.lit(1))).alias("pos", "href"))
    c = p.groupBy("page_id", "href").agg(F.min("pos").alias("pos")).withColumn("pri", F.when(F.lower("href").rlike("(about|team|contact|the|and)"), 0).otherwise(1))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pri", "pos")).cast("long")).filter("place <= 4").select("page_id", "href", "place")


@query(rf"""
SELECT page_id, length(trim(regexp_replace(regexp_replace({STRIP_SQL}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_text, len(regexp_extract_all(html, '(?i)<script')) AS scripts,
 length(trim(regexp_replace(regexp_replace({STRIP_SQL}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) < 400 AND (len(regexp_extract_all(html, '(?i)<script')) >= 4 OR regexp_matches(html, '(?i)<div id="(root|app)"')) AS js_shell FROM pages""")
def js_shell_detect(spark, sf_dir):
    n, scripts = F.length(T.html_text(F.col("html"))).cast("long"), F.regexp_count("html", F.lit("(?i)<script")).cast("long")
    shell = (n < 400) & ((scripts >= 4) | F.col("html").rlike('(?i)<div id="(root|app)"'))
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n_text"), scripts.alias("scripts"), shell.alias("js_shell"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)(hubspot|salesforce)') THEN 'crm' WHEN regexp_matches(html, '(?i)(sap|netsuite)') THEN 'erp' WHEN regexp_matches(html, '(?i)track\(') THEN 'tracker' ELSE 'none' END AS tech, regexp_matches(html, '(?i)<form') AS has_form FROM pages""")
def tech_fingerprints(spark, sf_dir):
    h = F.col("html")
    tech = F.when(h.rlike("(?i)(hubspot|salesforce)"), "crm").when(h.rlike("(?i)(sap|netsuite)"), "erp").when(h.rlike(r"(?i)track\("), "tracker").otherwise("none")
    return table(spark, sf_dir, "pages").select("page_id", tech.alias("tech"), h.rlike("(?i)<form").alias("has_form"))


@query(r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b(sales|marketing|finance|operations|it|and|with|from)\b', 1))), ',') AS departments FROM documents""")
def departments(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\b(sales|marketing|finance|operations|it|and|with|from)\b"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("departments"))


@query("""
SELECT s_suppkey, count(*) AS headcount, CASE WHEN count(*) < 20 THEN '<20' WHEN count(*) < 50 THEN '20-49' WHEN count(*) <= 500 THEN '50-500' ELSE '>500' END AS band FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity > 25 GROUP BY 1""")
def employee_band(spark, sf_dir):
    n = F.count(F.lit(1))
    band = F.when(n < 20, "<20").when(n < 50, "20-49").when(n <= 500, "50-500").otherwise(">500")
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(n.alias("headcount"), band.alias("band"))


@query("""
SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS age, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') <= 90 THEN 'VERY_STRONG' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') <= 180 THEN 'STRONG' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') <= 365 THEN 'MEDIUM' ELSE 'WEAK' END AS freshness FROM orders""")
def trigger_freshness(spark, sf_dir):
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate")).cast("long")
    band = F.when(age <= 90, "VERY_STRONG").when(age <= 180, "STRONG").when(age <= 365, "MEDIUM").otherwise("WEAK")
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"), band.alias("freshness"))


@query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(not interested|no thanks|remove)') THEN 'not_interested' WHEN regexp_matches(lower(text), '(wrong person|not me)') THEN 'wrong_person' WHEN regexp_matches(lower(text), '(out of office|ooo|vacation)') THEN 'ooo' WHEN regexp_matches(lower(text), '(interested|sure|yes|the th)') THEN 'interested' ELSE 'other' END AS label, regexp_matches(lower(text), '(unsubscribe|opt out|stop)') AS opt_out FROM conversations WHERE role = 'user'""")
def reply_classification(spark, sf_dir):
    t = F.lower("text")
    label = F.when(t.rlike("(not interested|no thanks|remove)"), "not_interested").when(t.rlike("(wrong person|not me)"), "wrong_person").when(t.rlike("(out of office|ooo|vacation)"), "ooo").when(t.rlike("(interested|sure|yes|the th)"), "interested").otherwise("other")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", label.alias("label"), t.rlike("(unsubscribe|opt out|stop)").alias("opt_out"))


@query(r"""
WITH f AS (SELECT doc_id, regexp_extract_all(text, '\b([A-Z][a-z]+ [A-Z][a-z]+)\b[^.\n]{0,60}?\b(?:owner|director|manager|founder|of|the)\b', 1) AS xs FROM documents), u AS (SELECT doc_id, unnest(xs) AS person, unnest(range(len(xs))) AS i FROM f),
d AS (SELECT doc_id, person, min(i) AS i FROM u GROUP BY 1, 2) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS place, person FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 8""")
def extract_people(spark, sf_dir):
    """Capitalised pairs of words near a title word, at most eight of a document, without repeats."""
    d = table(spark, sf_dir, "documents")
    near = r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b[^.\n]{0,60}?\b(?:owner|director|manager|founder|of|the)\b"
    found = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(near), F.lit(1))), 1, 8)
    return d.select("doc_id", F.posexplode(found).alias("place", "person"))


@query()
def card_headings(spark, sf_dir):
    """Headings and emphasised text of page cards, by the standard library's parser over Arrow batches."""
    import pyarrow as pa

    from ..sources.html import card_texts

    def run(batches):
        for batch in batches:
            rows = [(i, k, t) for i, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for k, t in enumerate(card_texts(h or ""))]
            ids, places, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=["page_id", "place", "text"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, place int, text string")
