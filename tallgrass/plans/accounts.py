"""Queries over crawled sites, packets and drafts, outreach events, merges and account scores.

Pages get a passage that follows from their key behind their own markup, so
that SQL can state what must be found in them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sites as S
from ..functions import text as T
from ..operators import contacts as C
from ..operators import drafts as D
from ..operators import outreach as O
from ..operators import resolve as R
from ..operators import score as P
from .base import query, table

GAP = "<p>" + "." * 130 + "</p>"


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(values: list, k: Column) -> Column:
    """The value whose place is k modulo their number."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k % len(values)).cast("int"))


def each(rows, key: str, found: Column, *fields: str):
    """A row for each element. An outer explode keeps Spark from working the array out once more to drop empty ones first."""
    found = rows.select(key, F.explode_outer(found).alias("x")).filter("x IS NOT NULL")
    return found.select(key, *[F.col(f"x.{f}") for f in fields])


def pages_with(spark, sf_dir, passages: list):
    """Pages, each with one of the passages behind its markup, by its key."""
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select(k, "url", F.concat("html", F.lit(GAP), pick(passages, k)).alias("html"))


HIDDEN = "2a" + "".join(f"{ord(c) ^ 0x2A:02x}" for c in "amy@store.com")
PLAIN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


@query(rf"""
WITH own AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '{PLAIN}'))) AS email FROM pages)
SELECT page_id, 'sales@shop' || page_id || '.com' AS email, 'role' AS label FROM pages WHERE page_id % 6 = 0
UNION SELECT page_id, 'joe' || page_id || '@shop' || page_id || '.com', 'personal' FROM pages WHERE page_id % 6 = 1
UNION SELECT page_id, 'info@shop' || page_id || '.com', 'role' FROM pages WHERE page_id % 6 = 2
UNION SELECT page_id, unnest(['ann@shop.com', 'joann@shop.com']), 'personal' FROM pages WHERE page_id % 6 = 4
UNION SELECT page_id, 'amy@store.com', 'personal' FROM pages WHERE page_id % 6 = 5
UNION SELECT page_id, email, CASE WHEN split_part(email, '@', 1) IN {tuple(T.ROLES)} THEN 'role' ELSE 'personal' END FROM own WHERE split_part(email, '@', 1) NOT IN {tuple(T.PLACEHOLDERS)} AND NOT contains(email, 'example.')""")
def page_emails(spark, sf_dir):
    """Addresses of pages: linked, spoken, hidden and plain ones; not those of scripts, pictures and placeholders."""
    k = F.col("page_id")
    pages = pages_with(spark, sf_dir, [
        text('<a class="c" href="mailto:Sales@shop', k, '.com?subject=x">write</a>'), text("<p>joe", k, " [at] shop", k, " [dot] com</p>"), text("<p><b>i</b>nfo@shop", k, ".com</p>"),
        text('<script>var m="x@shop', k, '.com";</script><p>test@shop.com</p>'), "<p>ann@shop.com, joann@shop.com, logo@2x.png</p>", f'<span data-cfemail="{HIDDEN}">hidden</span>',
    ])
    return each(pages, "page_id", S.emails(F.col("html")), "email", "label")


@query("""
SELECT page_id, 'facebook' AS network, 'https://www.facebook.com/p' || page_id AS url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'x', 'https://x.com/p' FROM pages WHERE page_id % 2 = 0""")
def page_socials(spark, sf_dir):
    found = text('<a href="https://www.facebook.com/p', F.col("page_id"), """?ref=1">f</a><a rel=me href='https://m.facebook.com/other'>f</a><a href="https://x.com/p">x</a>""")
    return each(pages_with(spark, sf_dir, [found, '<a href="/facebook.com">f</a>']), "page_id", S.socials(F.col("html")), "network", "url")


@query("""
SELECT page_id, TRUE AS link_list, CASE WHEN page_id % 2 = 0 THEN 'https://shop' || page_id || '.com/home?x=1' END AS site FROM pages""")
def link_list_target(spark, sf_dir):
    """Where a list of links leads: to the first host that is neither such a list nor a social network."""
    social = '<a href="#top">t</a><a href="mailto:a@b.com">m</a><a href="https://linktr.ee/z">l</a><a href="https://m.me/z">m</a><a href="/about">a</a>'
    p = pages_with(spark, sf_dir, [text(social, '<a href="https://shop', F.col("page_id"), '.com/home?x=1">s</a>'), social])
    base = F.lit("https://linktr.ee/u")
    return p.select("page_id", S.is_link_list(base).alias("link_list"), S.first_real_link(base, F.col("html")).alias("site"))


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 2019 WHEN 1 THEN 2025 END AS copyright_year, CASE page_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS stale_site, page_id % 3 = 0 AS careers,
  CASE page_id % 5 WHEN 0 THEN 'platform:calendly' WHEN 1 THEN 'regex' WHEN 2 THEN 'regex' WHEN 3 THEN 'platform:kwik-fit' END AS booking_source FROM pages""")
def site_signals(spark, sf_dir):
    p = pages_with(spark, sf_dir, [
        '<p>&copy; Firm 2019</p><iframe src="https://calendly.com/x"></iframe>', "<p>Copyright 2024 Firm, © 2025. Book your slot today.</p>", "<p>Schedule an appointment</p>",
        '<a href="https://www.KwikFit.example/now">x</a>', "<p>We book holidays at the sea</p>",
    ])
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_extract("url", "^[^?]*", 0), F.lit("/jobs/1"))).otherwise(F.col("url"))
    return p.select("page_id", *[c.alias(k) for k, c in S.signals(F.col("html"), url, 2026, 3).items()])


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS office, CASE page_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'INFERRED' ELSE 'UNKNOWN' END AS office_state,
  CASE page_id % 3 WHEN 0 THEN 'hubspot' WHEN 1 THEN 'dynamics' END AS crm, CASE page_id % 3 WHEN 0 THEN 'odoo' WHEN 1 THEN 'dynamics365' END AS erp,
  CASE page_id % 3 WHEN 0 THEN 'tms,customer_portal' WHEN 1 THEN 'wms' ELSE '' END AS other, CASE page_id % 3 WHEN 0 THEN 'operations,it' WHEN 1 THEN 'hr' ELSE '' END AS departments,
  CASE page_id % 3 WHEN 0 THEN 45 WHEN 1 THEN 1200 END AS employees, CASE page_id % 3 WHEN 0 THEN '20-49' WHEN 1 THEN '>500' ELSE 'unknown' END AS size FROM pages""")
def site_profile(spark, sf_dir):
    """Systems, departments and headcount that pages show."""
    p = pages_with(spark, sf_dir, [
        '<script src="//js.hs-scripts.com/1.js"></script><p>Our operations, a team of 45 people. Head of Technology. Odoo, transport management system, client portal.</p>',
        '<img src="https://crm4.dynamics.com/p"><p>HR manager. Business Central and a WMS for 1200+ staff.</p>', "<p>Nothing here.</p>",
    ])
    h, k = F.col("html"), F.col("page_id")
    p, t = p.withColumn("text", S.visible_text(h)), F.col("text")
    office, state = S.office_suite(F.array(pick(["a.mail.protection.outlook.com", "aspmx.l.google.com", "mx.shop.com"], k)))
    return p.select(
        k, office.alias("office"), state.alias("office_state"), S.crm(h).alias("crm"), S.erp(h, t).alias("erp"), F.array_join(S.other_systems(t), ",").alias("other"),
        F.array_join(S.departments(t), ",").alias("departments"), S.headcount(t).alias("employees"), S.headcount_range(S.headcount(t)).alias("size"),
    )


@query("""
SELECT page_id, 'strong' AS strength, '2025-01-01' AS date, 'MEDIUM' AS fresh FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'medium', NULL, 'UNKNOWN' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'strong', '2023-01-01', 'LOW' FROM pages WHERE page_id % 3 = 1""")
def site_triggers(spark, sf_dir):
    """Signs of change that pages tell of, by the trade, with how fresh they are."""
    p = pages_with(spark, sf_dir, [f"<p>A new office in 2024, moved 2025.</p>{GAP}<p>We are hiring.</p>", "<p>Fleet expansion since 2023</p>", "<p>Fleet expansion since 2023, a new era.</p>"])
    found = S.triggers(S.visible_text(F.col("html")), pick(["", "Logistics", "saas"], F.col("page_id")))
    return each(p, "page_id", found, "strength", "date").withColumn("fresh", S.freshness(F.col("date"), F.lit("2025-12-31")))


@query("""
SELECT page_id, 'Jane Doe' AS name, 'Owner' AS title, 'other' AS context FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'Mary Ann Smith', 'Managing Director', 'team' FROM pages WHERE page_id % 5 = 1""")
def titled_people(spark, sf_dir):
    """People beside their titles; no reviewers, form labels or headings."""
    p = pages_with(spark, sf_dir, [
        "<p>Owner Jane Doe runs it. Founder: jane doe; owner Jane Doe.</p>", "<h2>Meet the team</h2><p>Mary Ann Smith, Managing Director</p>", "<p>Response from the owner. Peter Parker ★★★★★</p>",
        "<p>Director: Contact Us Today</p>", "<p>Peter Parker was here.</p>",
    ])
    found = S.people(S.visible_text(F.col("html")), F.lit("https://shop.com/"))
    return each(p, "page_id", found, "name", "title", "context")


def packets(spark, sf_dir):
    """target, packet: what is known of customers."""
    k = F.col("c_custkey")
    at = F.lit("2026-01-01T00:00:00Z")
    found = D.facts({
        "category": (F.col("c_mktsegment"), "maps", at), "city": (pick(["Leeds", "York"], k), "maps", at), "rating": (F.when(k % 5 != 0, text("4.5 stars (", k, " reviews)")), "maps", at),
        "booking": (F.when(k % 2 == 0, "has online booking (Google Business)"), "gbp", at), "no_website": (F.when(k % 7 == 0, "no business website found"), "maps", at),
        "hiring": (F.when(k % 3 == 0, "has a live careers/jobs page"), "site", at), "dm_name": (F.when(k % 4 == 0, "Ann Lee"), "registry", at),
    })
    lit = F.lit
    p = D.packet(text("Alder Works ", k), pick(["Leeds", "York"], k), found, (lit("answering"), lit("no missed calls")), (lit("Ann"), lit("main")), lit("first_touch"), lit("Hello,"))
    return table(spark, sf_dir, "customer").select(k.alias("target"), p.alias("packet"))


FACTS_SQL = """
WITH f AS (SELECT c_custkey AS target, unnest([
  {'r': 1, 'k': 'category', 'v': c_mktsegment, 's': 'maps', 'ok': TRUE}, {'r': 3, 'k': 'city', 'v': CASE WHEN c_custkey % 2 = 0 THEN 'Leeds' ELSE 'York' END, 's': 'maps', 'ok': TRUE},
  {'r': 2, 'k': 'rating', 'v': '4.5 stars (' || c_custkey || ' reviews)', 's': 'maps', 'ok': c_custkey % 5 <> 0}, {'r': 14, 'k': 'booking', 'v': 'has online booking (Google Business)', 's': 'gbp', 'ok': c_custkey % 2 = 0},
  {'r': 5, 'k': 'no_website', 'v': 'no business website found', 's': 'maps', 'ok': c_custkey % 7 = 0}, {'r': 8, 'k': 'hiring', 'v': 'has a live careers/jobs page', 's': 'site', 'ok': c_custkey % 3 = 0},
  {'r': 15, 'k': 'dm_name', 'v': 'Ann Lee', 's': 'registry', 'ok': c_custkey % 4 = 0}]) AS x FROM customer),
n AS (SELECT target, x.r AS r, x.k AS k, length('{"k": "' || x.k || '", "v": "' || x.v || '", "src": "' || x.s || '", "at": "2026-01-01T00:00:00Z"}') AS n FROM f WHERE x.ok),
frame AS (SELECT c_custkey AS target, length('{"co": "Alder Works ' || c_custkey || '", "city": "' || CASE WHEN c_custkey % 2 = 0 THEN 'Leeds' ELSE 'York' END || '", "facts": [], "offer": {"what": "answering", "value_prop": "no missed calls"}, "sender": {"from_name": "Ann", "label": "main"}, "purpose": "first_touch", "greeting": "Hello,", "constraints": {"max_observation_words": 45, "max_subject_chars": 60, "template_numbers": [], "literals": []}}') AS frame FROM customer),
t AS (SELECT target, r, k, CAST(ceil((frame + sum(n) OVER w + 2 * (count(*) OVER w - 1)) / 4.0) AS BIGINT) AS tokens FROM n JOIN frame USING (target) WINDOW w AS (PARTITION BY target ORDER BY r DESC))"""


@query(FACTS_SQL + " SELECT target, max(tokens) AS tokens FROM t GROUP BY 1")
def packet_tokens(spark, sf_dir):
    return packets(spark, sf_dir).select("target", D.tokens(F.col("packet")).alias("tokens"))


@query(FACTS_SQL + """, k AS (SELECT target, list_sort(list(k) FILTER (tokens <= 150)) AS kept FROM t GROUP BY 1)
SELECT target, array_to_string(coalesce(kept, []), ',') AS kept, CASE WHEN NOT list_has_any(coalesce(kept, []), ['booking','hiring']) THEN 'C' WHEN list_contains(kept, 'dm_name') THEN 'A' ELSE 'B' END AS grade FROM k""")
def packet_trim(spark, sf_dir):
    """What is left of packets of at most 150 tokens, and their grade."""
    p = packets(spark, sf_dir).withColumn("kept", D.trimmed(F.col("packet"), 150))
    return p.select("target", F.array_join(F.array_sort(F.transform("kept", lambda f: f["k"])), ",").alias("kept"), D.grade(F.col("kept")).alias("grade"))


@query("""
SELECT c_custkey AS target, CASE c_custkey % 8 WHEN 0 THEN 'applied' WHEN 2 THEN 'applied' WHEN 3 THEN 'insufficient_evidence' WHEN 4 THEN 'skipped' ELSE 'rejected' END AS outcome,
  CASE c_custkey % 8 WHEN 0 THEN 'booking' WHEN 1 THEN 'category' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'city' END AS used_fact,
  CASE c_custkey % 8 WHEN 1 THEN 'NUMBER:999999999,USED_FACT:unreferenced,NEGATION:claimed' WHEN 5 THEN 'EMAIL:bob@else.com,URL:https://else.com/x,PROPER_NOUN:Bob,USED_FACT:unreferenced'
    WHEN 6 THEN 'BANNED:3,BANNED:4' WHEN 7 THEN 'LENGTH:observation' ELSE '' END AS reasons FROM customer""")
def drafts_judged(spark, sf_dir):
    """Drafts through the gate: what becomes of each, what it cites, and why it fails."""
    k = F.col("c_custkey")
    observation = pick([
        text("I saw that Alder Works shows booking for ", k, "."), "You can book online with 999999999 others.", "You trade in Leeds today.", "", "Anything.",
        "Mail bob@else.com or see https://else.com/x now, Bob.", "Most garages trust us; we guarantee it in Leeds.", "word " * 46 + "York",
    ], k)
    cited = pick(["booking", "category", None, None, None, "city", "city", "city"], k)
    drafts = table(spark, sf_dir, "customer").select(k.alias("target"), (k % 8 == 3).alias("abstain"), F.lit("Note for Alder Works").alias("subject"), observation.alias("observation"), cited.alias("used_fact"))
    found = D.judged(drafts, packets(spark, sf_dir).filter("target % 8 <> 4"))
    return found.select("target", "outcome", "used_fact", F.when(F.col("outcome") == "rejected", F.array_join("reasons", ",")).otherwise("").alias("reasons"))


@query("""
SELECT o_custkey AS target, arg_max('note ' || o_orderkey, o_orderkey) FILTER (o_orderstatus = 'O') AS subject FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0 AND count(*) FILTER (o_orderstatus = 'P') = 0""")
def draft_retries(spark, sf_dir):
    """Targets whose drafts were all rejected, with the newest."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "rejected").when(F.col("o_orderstatus") == "P", "drafted").otherwise("sent")
    return D.retry_set(o.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("id"), state.alias("state"), text("note ", F.col("o_orderkey")).alias("subject")))


def any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


REPLY_SQL = "CASE " + " ".join(f"WHEN {any_sql('lower(body)', w)} THEN '{k}'" for k, w in O.REPLIES.items()) + " ELSE 'other' END"
RAW_SQL = "CASE " + " ".join(f"WHEN {any_sql('lower(body)', w)} THEN '{k}'" for k, w in O.RAW.items())
RAW_SQL += rf" WHEN regexp_matches(lower(body), '\b5\d\d\b') AND regexp_matches(lower(body), 'bounce|delivery|undeliver') THEN 'bounce_hard' WHEN {any_sql('lower(body)', O.OPT_OUT)} THEN 'unsubscribe' ELSE 'reply' END"
ENDS = ["No thanks.", "Sounds good, tell me more", "Please reach out to Ann", "I am out of office", "Please STOP", "Mailbox full", "error 571 in delivery", "this is spam", ""]


@query(f"""
WITH b AS (SELECT conv_id, turn, text || ' ' || {ENDS!r}[CAST((conv_id + turn) % 9 + 1 AS INT)] AS body FROM conversations)
SELECT conv_id, turn, {REPLY_SQL} AS reply, {any_sql('lower(body)', O.OPT_OUT)} AS optout, {RAW_SQL} AS raw FROM b""")
def reply_kinds(spark, sf_dir):
    """What kind of reply a message is, or of mail where nothing says that it is one."""
    body = F.concat("text", F.lit(" "), pick(ENDS, F.col("conv_id") + F.col("turn")))
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", O.reply_kind(body).alias("reply"), O.opts_out(body).alias("optout"), O.raw_kind(F.lit(""), body).alias("raw"))


BODIES = ["Yes please", "please stop", "not interested", ""]


def outreach_events(spark, sf_dir):
    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id").cast("string")
    kind = F.when(F.col("event_type") == "error", "bounce_hard").when(F.col("event_type") == "view", "bounce_soft").when(F.col("event_type") == "signup", F.when(k % 9 == 0, "unsubscribe").otherwise("reply")).otherwise("reply")
    events = e.select(
        kind.alias("kind"), text(" U", u, "@x.com").alias("email"), F.when(k % 3 == 0, text("<m", u, ">")).otherwise("").alias("message_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("occurred_at"),
        pick(BODIES, F.floor(k / 4)).alias("body"), k.alias("seq"),
    )
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    messages = c.select(n.alias("id"), n.alias("target"), text("<m", n, ">").alias("header"), pick(["sent", "drafted"], n).alias("state"), (n % 100).alias("sent_at"))
    contacts = c.select(n.alias("target"), text("u", n % 70, "@x.com").alias("email"))
    return events, messages, contacts


INGEST_SQL = f"""
WITH e0 AS (SELECT CASE event_type WHEN 'error' THEN 'bounce_hard' WHEN 'view' THEN 'bounce_soft' WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'unsubscribe' ELSE 'reply' END ELSE 'reply' END AS kind,
  'u' || user_id || '@x.com' AS email, CASE WHEN event_id % 3 = 0 THEN '<m' || user_id || '>' END AS mid, strftime(ts, '%Y-%m-%d %H:%M') AS occurred_at, {BODIES!r}[CAST((event_id // 4) % 4 + 1 AS INT)] AS body, event_id FROM events),
e AS (SELECT substr(sha1(kind || '|' || email || '|' || coalesce(mid, 'None') || '|' || occurred_at), 1, 20) AS dedupe_key, kind, email, mid, occurred_at, arg_min(body, event_id) AS body FROM e0 GROUP BY ALL),
m AS (SELECT c_custkey AS target, '<m' || c_custkey || '>' AS header, c_custkey % 2 = 0 AS sent, c_custkey % 100 AS sent_at, 'u' || (c_custkey % 70) || '@x.com' AS email FROM customer),
last AS (SELECT email, target FROM m WHERE sent QUALIFY row_number() OVER (PARTITION BY email ORDER BY sent_at DESC, target DESC) = 1),
r AS (SELECT dedupe_key, kind, e.email, occurred_at, CASE WHEN kind = 'reply' THEN {REPLY_SQL} ELSE '' END AS classification, kind = 'reply' AND {any_sql('lower(body)', O.OPT_OUT)} AS optout, coalesce(m.target, last.target) AS target
  FROM e LEFT JOIN m ON m.header = e.mid LEFT JOIN last ON last.email = e.email),
a AS (SELECT *, CASE WHEN kind IN ('bounce_hard','unsubscribe') THEN kind WHEN optout THEN 'reply_optout' END AS suppress, CASE WHEN kind = 'bounce_hard' THEN 'bounced' WHEN kind = 'bounce_soft' THEN NULL WHEN kind = 'unsubscribe' OR optout THEN 'opted_out' ELSE 'replied' END AS asked FROM r)"""


@query(INGEST_SQL + " SELECT dedupe_key, kind, email, occurred_at, classification, optout, target AS message, target, suppress, asked FROM a")
def outreach_ingest(spark, sf_dir):
    """Events, once each, with the message they belong to, what they suppress and the state they ask for."""
    return O.ingested(*outreach_events(spark, sf_dir))


@query(INGEST_SQL + """, s AS (SELECT target, list(asked ORDER BY occurred_at, dedupe_key) AS asks FROM a WHERE target IS NOT NULL AND asked IS NOT NULL GROUP BY 1)
SELECT c_custkey AS target, list_reduce(list_prepend(CASE WHEN c_custkey % 2 = 0 THEN 'sent' ELSE 'drafted' END, coalesce(asks, [])), lambda x, y: CASE WHEN y = 'opted_out' AND x <> 'opted_out' THEN y WHEN y IN ('bounced','replied') AND x = 'sent' THEN y ELSE x END) AS state
FROM customer LEFT JOIN s ON target = c_custkey""")
def outreach_states(spark, sf_dir):
    """States of targets after all that came back."""
    events, messages, contacts = outreach_events(spark, sf_dir)
    return O.states_after(messages.select("target", "state"), O.ingested(events, messages, contacts))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS business FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'domain' AS kind, 'site' || business || '.com' AS value, business FROM o WHERE business % 4 <> 3 UNION SELECT 'email', unnest(['a' || business || '@x.com', 'b' || business || '@x.com']), business FROM o""")
def opt_out_fan_out(spark, sf_dir):
    """What an opt-out suppresses: the site and each address of a business."""
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    outcomes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("business"), F.when(k % 3 == 0, "opt_out").otherwise("called").alias("result"))
    c = table(spark, sf_dir, "customer")
    known = c.select(n.alias("business"), F.when(n % 4 != 3, text("site", n, ".com")).alias("domain"))
    contacts = c.select(n.alias("business"), F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), v.alias("value")) for a, v in (("email", text("a", n, "@x.com")), ("email", text("b", n, "@x.com")), ("phone", text("+1", n)))])).alias("x"))
    return O.opt_out_fan_out(outcomes, known, contacts.select("business", "x.kind", "x.value"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'invalid' WHEN c_custkey % 40 IN (5, 8) THEN 'risky' WHEN c_custkey % 40 >= 30 THEN 'unknown' WHEN c_custkey % 40 % 3 = 0 THEN 'invalid' WHEN c_custkey % 4 = 0 THEN 'role' ELSE 'valid' END AS tier FROM customer""")
def email_checks(spark, sf_dir):
    """Tiers of addresses by exchanges and disposable domains, each domain looked up once."""
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k, F.concat(pick(["info", "ann", "test", "joe"], k), text("@d", k % 40, ".com")).alias("email"))
    d = e.select(F.substring_index("email", "@", -1).alias("domain")).distinct().withColumn("n", F.regexp_extract("domain", r"\d+", 0).cast("int"))
    return O.checked_emails(e, d.filter("n < 30").select("domain", (F.col("n") % 3 != 0).alias("mx")), d.filter("n IN (5, 8)"), C.email_tier).select("c_custkey", "tier")


TREES = ["Alder", "Birch", "Cedar", "Dogwood", "Elder"]


def cascade_rows(spark, sf_dir):
    """Stored rows (of customers) and incoming ones (of suppliers)."""
    n, m = F.col("c_custkey"), F.col("s_suppkey")
    stored = table(spark, sf_dir, "customer").select(
        text("c", n).alias("id"), text("pid:", n).alias("key"), F.when(n % 3 != 0, text("pid", n)).alias("place_id"), F.when(n % 11 != 0, text("+1", n % 200)).alias("phone"),
        F.concat(pick(TREES, n), F.lit(" Ltd")).alias("name"), text("A", n % 7, " 1AA").alias("postal"), n.alias("seq"), (n * 13 % 97).alias("reviews"),
    )
    incoming = table(spark, sf_dir, "supplier").select(
        text("s", m).alias("id"), F.when(m % 5 == 0, text("pid:", m)).otherwise(text("new:", m)).alias("key"), F.when(m % 5 == 1, text("pid", m)).when(m % 5 == 2, text("other", m)).alias("place_id"),
        text("+1", m * 7 % 260).alias("phone"), pick(TREES, m).alias("name"), text("A", m % 6, " 9ZZ").alias("postal"),
    )
    return stored, incoming


CASCADE_SQL = f"""
WITH s AS (SELECT 'c' || c_custkey AS id, 'pid:' || c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN 'pid' || c_custkey END AS place_id, CASE WHEN c_custkey % 11 <> 0 THEN '+1' || (c_custkey % 200) END AS phone, {TREES!r}[CAST(c_custkey % 5 + 1 AS INT)] AS name, 'A' || (c_custkey % 7) AS postal, c_custkey AS seq, c_custkey * 13 % 97 AS reviews FROM customer),
i AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'pid:' ELSE 'new:' END || s_suppkey AS key, CASE s_suppkey % 5 WHEN 1 THEN 'pid' || s_suppkey WHEN 2 THEN 'other' || s_suppkey END AS place_id, '+1' || (s_suppkey * 7 % 260) AS phone, {TREES!r}[CAST(s_suppkey % 5 + 1 AS INT)] AS name, 'A' || (s_suppkey % 6) AS postal FROM supplier)"""


@query(CASCADE_SQL + """, ph AS (SELECT i.id, arg_min(s.id, s.seq) AS m FROM i JOIN s ON i.phone = s.phone AND (i.place_id IS NULL OR s.place_id IS NULL) AND (i.name = s.name OR i.postal = s.postal) GROUP BY 1),
lone AS (SELECT phone, min(id) AS m FROM s GROUP BY 1 HAVING count(*) = 1)
SELECT i.id, coalesce(a.id, b.id, ph.m, CASE WHEN i.place_id IS NULL THEN lone.m END) AS match_id, CASE WHEN a.id IS NOT NULL THEN 'key' WHEN b.id IS NOT NULL THEN 'place' WHEN ph.m IS NOT NULL OR (i.place_id IS NULL AND lone.m IS NOT NULL) THEN 'phone' ELSE 'new' END AS how
FROM i LEFT JOIN s a ON a.key = i.key LEFT JOIN s b ON b.place_id = i.place_id LEFT JOIN ph ON ph.id = i.id LEFT JOIN lone ON lone.phone = i.phone""")
def upsert_cascade(spark, sf_dir):
    """Which stored row each incoming one merges into, and by what."""
    stored, incoming = cascade_rows(spark, sf_dir)
    return R.match_cascade(incoming, stored)


@query(CASCADE_SQL + """, a AS (SELECT * FROM s WHERE place_id IS NOT NULL AND phone IS NOT NULL QUALIFY row_number() OVER (PARTITION BY phone ORDER BY reviews DESC, id DESC) = 1)
SELECT s.id AS drop_id, a.id AS keep_id FROM s JOIN a USING (phone) WHERE s.place_id IS NULL AND (s.name = a.name OR s.postal = a.postal)""")
def repair_by_phone(spark, sf_dir):
    """Register rows that fold into the listing with their phone."""
    return R.repair_by_phone(cascade_rows(spark, sf_dir)[0])


@query("""
SELECT c_custkey, 'a' AS kept_a, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'a' END AS last_a, CASE WHEN c_custkey % 2 = 0 THEN 'b' END AS kept_b FROM customer""")
def facts_merged(spark, sf_dir):
    """Facts of a business with later ones: filled where they lack, or overwritten."""
    even = F.col("c_custkey") % 2 == 0
    old, new = F.create_map(F.lit("a"), F.lit("a")), F.when(even, F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("b")))
    kept, last = R.facts_merged(old, new, False), R.facts_merged(old, new, True)
    return table(spark, sf_dir, "customer").select("c_custkey", kept["a"].alias("kept_a"), last["a"].alias("last_a"), kept["b"].alias("kept_b"))


@query("""
SELECT c_custkey, [1.0, 0.6, 0.1, 0.1, 0.6, 0.1, 1.0][CAST(c_custkey % 7 + 1 AS INT)]::DOUBLE AS share FROM customer""")
def industry_shares(spark, sf_dir):
    """How well trades fit wanted ones: by name, by their vertical, by a shared word."""
    trades = pick([F.array(F.lit(x)) for x in ("Garage", "Tyre shop", "Community centre", "Bakery", "Truck Repair")] + [F.lit(None).cast("array<string>"), F.array(F.lit("Bakery"), F.lit("Auto Repair Shop"))], F.col("c_custkey"))
    share = P.industry_share(trades, ["Auto repair shop"], {"cars": (["auto repair shop", "garage"], ["tyre shop", "car wash"]), "food": (["bakery"], ["cafe"])})
    return table(spark, sf_dir, "customer").select("c_custkey", share.alias("share"))


@query("""
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 4 = 3 THEN 'website_missing' END, CASE WHEN c_custkey % 4 <> 3 AND c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'website_no_ssl' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 1 THEN 'stale_site' END,
  CASE WHEN c_custkey % 10 < 4 AND c_custkey % 100 >= 50 THEN 'low_rating_high_volume' END, CASE WHEN c_custkey % 100 < 10 THEN 'few_reviews' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 = 0 THEN 'weak_social_presence' END,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 2 THEN 'phone_only_booking' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 3 THEN 'hiring' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 4 THEN 'no_video_presence' END) AS needs FROM customer""")
def need_signals(spark, sf_dir):
    """Signs of need; what no crawl has seen is none."""
    k = F.col("c_custkey")
    some = lambda r, v: F.when(k % 5 == r, v)
    signals = {"https": some(0, False), "stale_site": some(1, True), "booking_hint": some(2, False), "careers": some(3, True), "no_video_presence": some(4, True), "stale_social": some(4, True)}
    soft = ["website_missing", "website_no_ssl", "stale_site", "low_rating_high_volume", "few_reviews", "weak_social_presence", "phone_only_booking", "hiring", "no_video_presence"]
    needs = P.need_signals(soft, F.when(k % 4 != 3, "https://x.com"), F.when(k % 10 < 4, 3.5).when(k % 10 < 6, 4.5), k % 100, k % 3 == 0, F.when(k % 7 == 0, 0).when(k % 7 == 1, 2), signals)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(needs, ",").alias("needs"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_mktsegment IN ('BUILDING','AUTOMOBILE') AS fits, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 700 END AS employees, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 100000 % 200000000 END AS revenue FROM customer),
p AS (SELECT *, CASE WHEN fits THEN 15 ELSE 0 END + CASE WHEN employees BETWEEN 50 AND 500 THEN 15 WHEN employees BETWEEN 20 AND 49 THEN 5 ELSE 0 END + CASE WHEN revenue BETWEEN 10000000 AND 150000000 THEN 10 ELSE 0 END
  + CASE k % 4 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 0 END + CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 0 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END
  + CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 20 ELSE 10 END WHEN k % 4 = 1 THEN 5 ELSE 0 END AS total,
  1 + (employees IS NOT NULL)::INT + (revenue IS NOT NULL)::INT + 2 * (k % 4 < 2)::INT + (k % 3 < 2)::INT + (k % 2 = 0 OR k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0)::INT AS known FROM c),
g AS (SELECT *, CASE WHEN employees < 20 AND k % 2 = 0 THEN 'DQ' WHEN total >= 80 THEN 'A' WHEN total >= 65 THEN 'B' WHEN total >= 50 THEN 'C' ELSE 'D' END AS grade FROM p)
SELECT k AS c_custkey, total::DOUBLE AS total, grade, CAST(round_even(100.0 * known / 7, 0) AS BIGINT) AS confidence,
  CASE WHEN grade = 'DQ' THEN 'DISQUALIFIED' WHEN employees < 50 OR employees > 500 OR NOT fits OR grade = 'C' THEN 'MANUAL_REVIEW' WHEN grade IN ('A','B') AND k % 101 >= 60 THEN 'READY_FOR_OUTREACH' ELSE 'NEW' END AS status FROM g""")
def account_profiles(spark, sf_dir):
    """Fit, confidence and status of accounts; an unknown input lowers the confidence only."""
    k = F.col("c_custkey")
    employees, revenue = F.when(k % 5 != 0, k % 700), F.when(k % 3 == 0, k * 100_000 % 200_000_000)
    one = lambda strength: F.array(F.struct(F.lit("t").alias("text"), F.lit(strength).alias("strength"), F.when(k % 8 == 0, "2025-11-01").otherwise("2024-01-01").alias("date")))
    triggers = F.when(k % 4 == 0, one("strong")).when(k % 4 == 1, one("medium"))
    depts = F.when(k % 3 == 0, F.array(F.lit("operations"), F.lit("hr"))).when(k % 3 == 1, F.array(F.lit("hr")))
    fresh = S.freshness(F.get(triggers, F.lit(0))["date"], F.lit("2025-12-31"))
    fit = P.account_fit(F.array("c_mktsegment"), ["building", "auto"], employees, k % 2 == 0, revenue, triggers, depts, [k % 2 == 0, k % 7 == 0, k % 11 == 0], [k % 13 == 0, F.lit(None), F.lit(False)], fresh)
    c = table(spark, sf_dir, "customer").select(k, *[v.alias(n) for n, v in fit.items()], employees.alias("employees"))
    return c.select(k, "total", "grade", "confidence", P.account_status(F.col("grade"), k % 101, F.col("industry"), F.col("employees")).alias("status"))
