"""People who decide, and decisions on the way out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deciders as D
from ..operators import sending as S
from .base import query, table

_K = "CAST(props->>'$.k' AS BIGINT)"
NAMED_SQL = f"n AS (SELECT user_id AS business, CASE event_type WHEN 'signup' THEN 'signature' ELSE 'credit' END AS kind, event_id AS position, CASE event_id % 3 WHEN 0 THEN 'NAME ' || {_K} WHEN 1 THEN 'Name ' || {_K} ELSE 'name ' || {_K} END AS name FROM events WHERE event_type IN ('signup', 'click'))"


def named(spark, sf_dir):
    """Names on profiles: a user's sign-ups are signatures, their clicks credits, in three spellings."""
    k, e = F.get_json_object("props", "$.k"), F.col("event_id")
    name = F.concat(F.when(e % 3 == 0, "NAME ").when(e % 3 == 1, "Name ").otherwise("name "), k)
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "click"))
    return rows.select(F.col("user_id").alias("business"), F.when(F.col("event_type") == "signup", "signature").otherwise("credit").alias("kind"), e.alias("position"), name.alias("name"))


@query(f"""
WITH {NAMED_SQL}, s AS (SELECT business, lower(name) AS low, arg_min(name, position) AS name FROM n WHERE kind = 'signature' GROUP BY 1, 2),
c0 AS (SELECT business, lower(name) AS low, name, count(*) AS k, min(position) AS p FROM n WHERE kind = 'credit' GROUP BY 1, 2, 3), c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY business, low ORDER BY p) = 1),
o AS (SELECT user_id AS business, 'name ' || {_K} AS low FROM events WHERE event_type = 'error'),
u AS (SELECT business, low, name, 'signed an owner reply on Google' AS snippet FROM s UNION ALL SELECT business, low, name, 'credited by customers in ' || k || CASE WHEN k = 1 THEN ' review' ELSE ' reviews' END FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.business = c.business AND s.low = c.low))
SELECT business, name, snippet FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.business = u.business AND o.low = u.low)""")
def profile_people(spark, sf_dir):
    """People whom profiles name, and how."""
    known = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("business"), F.concat(F.lit("Name "), F.get_json_object("props", "$.k")).alias("name"))
    return D.profile_people(named(spark, sf_dir), known)


TITLES = ["OWNER", "Managing director"]


def candidates(spark, sf_dir):
    """Orders as people of their customers."""
    k = F.col("o_orderkey")
    title = F.when(k % 11 == 0, "Owner").when(k % 13 == 0, "the Managing Director").when(k % 5 == 0, "clerk")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("business"), k.alias("person"), title.alias("title"), F.when(k % 97 == 0, 1).when(k % 101 == 0, -1).otherwise(0).alias("is_dm"),
        F.when(k % 4 == 0, "registry").otherwise("site").alias("labeled_by"), F.concat(F.lit("Person "), k, F.when(k % 8 == 0, " Ltd").otherwise("")).alias("name"),
    )


CANDIDATES_SQL = """p AS (SELECT o_custkey AS business, o_orderkey AS person, CASE WHEN o_orderkey % 11 = 0 THEN 'owner' WHEN o_orderkey % 13 = 0 THEN 'the managing director' WHEN o_orderkey % 5 = 0 THEN 'clerk' END AS title, CASE WHEN o_orderkey % 97 = 0 THEN 1 WHEN o_orderkey % 101 = 0 THEN -1 ELSE 0 END AS is_dm,
  o_orderkey % 4 = 0 AS registry, 'Person ' || o_orderkey || CASE WHEN o_orderkey % 8 = 0 THEN ' Ltd' ELSE '' END AS name FROM orders)"""


@query(f"""
WITH {CANDIDATES_SQL}, f AS (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = person AND l_quantity > 40) AS routed FROM p WHERE (contains(title, 'owner') OR contains(title, 'managing director')) AND business NOT IN (SELECT business FROM p WHERE is_dm <> 0)),
g AS (SELECT business, count(*) AS n, min(person) AS one, count(*) FILTER (routed) AS k, min(person) FILTER (routed) AS reached FROM f GROUP BY 1)
SELECT business, CASE WHEN n = 1 THEN one ELSE reached END AS person, CAST(CASE WHEN n = 1 THEN 0.55 ELSE 0.65 END AS DOUBLE) AS confidence, CASE WHEN n = 1 THEN 'heuristic_auto' ELSE 'heuristic_route' END AS by FROM g WHERE n = 1 OR k = 1""")
def heuristic_labels(spark, sf_dir):
    """Deciders by title alone, or by a number of their own where several have one."""
    routes = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("person")).distinct().join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("person"), F.col("o_custkey").alias("business")), "person")
    return D.heuristic_picks(candidates(spark, sf_dir), routes, TITLES)


@query(f"""
WITH {CANDIDATES_SQL}, g AS (SELECT business, count(*) FILTER (registry AND NOT regexp_matches(name, '(?i)\\bltd\\b')) AS n, min(name) FILTER (registry AND NOT regexp_matches(name, '(?i)\\bltd\\b')) AS name, bool_or(is_dm = 1) AS chosen FROM p GROUP BY 1)
SELECT business, g.name FROM g JOIN customer ON c_custkey = business WHERE n = 1 AND NOT chosen AND c_mktsegment <> 'BUILDING'""".replace("\\\\", "\\"))
def register_picks(spark, sf_dir):
    """The only individual of an active company whom the register names."""
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("business"), F.when(F.col("c_mktsegment") == "BUILDING", "dissolved").otherwise("Active").alias("status"))
    return D.register_picks(candidates(spark, sf_dir), profiles)


@query(f"""
WITH {CANDIDATES_SQL} SELECT business, 'd' || business AS domain, name FROM p WHERE is_dm = 1 AND business % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = business AND event_type = 'purchase' AND value > 95)""")
def inference_backlog(spark, sf_dir):
    """Deciders at businesses with a domain whose address was not inferred yet."""
    c = F.col("c_custkey")
    businesses = table(spark, sf_dir, "customer").select(c.alias("business"), F.when(c % 3 != 0, F.concat(F.lit("d"), c)).alias("domain"))
    contacts = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("business"), F.lit("email").alias("kind"), F.when(F.col("value") > 95, "inferred").otherwise("valid").alias("tier"))
    return D.inference_backlog(businesses, candidates(spark, sf_dir), contacts)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'READY - named contact' WHEN c_custkey % 3 <> 0 THEN 'READY - ask switchboard' WHEN c_custkey % 5 <> 0 THEN 'UNVERIFIED PHONE - confirm number' ELSE 'NO PHONE - research first' END AS readiness FROM customer""")
def call_readiness(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, D.call_readiness(k % 3 != 0, k % 2 == 0, F.when(k % 5 != 0, "x")).alias("readiness"))


MESSAGES_SQL = """t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE 'main' END AS campaign, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'A' ELSE 'B' END AS tier, CASE WHEN c_custkey % 3 = 0 THEN 'enrolled' ELSE 'drafted' END AS state FROM customer),
m AS (SELECT o_orderkey AS id, o_custkey AS target, CASE o_orderstatus WHEN 'F' THEN 'drafted' WHEN 'O' THEN 'approved' ELSE 'sent' END AS state, 'h' || o_orderkey AS draft_hash, CASE WHEN o_orderstatus <> 'F' THEN 'h' || (o_orderkey - o_orderkey % 2) END AS approved_hash FROM orders),
a AS (SELECT m.*, m.state = 'drafted' AND t.campaign = 'main' AND t.tier = 'A' AS now FROM m LEFT JOIN t ON t.id = m.target)"""


def outgoing(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    targets = table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 4 == 0, "x").otherwise("main").alias("campaign"), F.when(F.col("c_mktsegment") == "MACHINERY", "A").otherwise("B").alias("tier"), F.when(c % 3 == 0, "enrolled").otherwise("drafted").alias("state"))
    s = F.col("o_orderstatus")
    messages = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("target"), F.when(s == "F", "drafted").when(s == "O", "approved").otherwise("sent").alias("state"), F.concat(F.lit("h"), k).alias("draft_hash"),
        F.when(s != "F", F.concat(F.lit("h"), k - k % 2)).alias("approved_hash"), F.lit(None).cast("string").alias("approved_by"),
    )
    return messages, targets


@query(f"""
WITH {MESSAGES_SQL} SELECT id, CASE WHEN now THEN 'approved' WHEN state = 'approved' AND draft_hash IS DISTINCT FROM approved_hash THEN 'drafted' ELSE state END AS state, coalesce(CASE WHEN now THEN draft_hash ELSE approved_hash END = draft_hash, FALSE) AS holds, CASE WHEN now THEN 'ann' END AS approved_by FROM a""")
def approvals(spark, sf_dir):
    """Messages after an approval of tier A, those whose words changed since theirs going back."""
    after, _ = S.approved(*outgoing(spark, sf_dir), "main", "ann", tier="A")
    return S.still_approved(after).select("id", "state", "holds", "approved_by")


@query(f"""
WITH {MESSAGES_SQL} SELECT t.id, CASE WHEN t.state = 'drafted' AND t.id IN (SELECT target FROM a WHERE now) THEN 'approved' ELSE t.state END AS state FROM t""")
def approved_targets(spark, sf_dir):
    """Targets that move along with what is approved."""
    return S.approved(*outgoing(spark, sf_dir), "main", "ann", tier="A")[1].select("id", "state")


@query("""
WITH o AS (SELECT o_custkey AS business, 'm' || (o_orderkey % 3) AS email, bool_or(CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m') <= '1996-06' WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m') <= '1996-06' ELSE FALSE END) AS stale FROM orders GROUP BY 1, 2),
e AS (SELECT c_custkey AS business, CASE WHEN c_custkey % 6 <> 5 THEN 'm' || (c_custkey % 3) END AS email, c_custkey % 5 <> 0 AS eligible, CASE WHEN c_custkey % 5 = 0 THEN ['suppressed'] ELSE [] END AS reasons FROM customer),
r AS (SELECT e.business, e.email, eligible, list_concat(reasons, list_filter([CASE WHEN e.email IS NOT NULL AND e.business % 7 = 0 THEN 'email_unconfirmed' END, CASE WHEN coalesce(stale, FALSE) THEN 'email_stale' END], lambda x: x IS NOT NULL)) AS all_reasons FROM e LEFT JOIN o ON o.business = e.business AND o.email = e.email)
SELECT business, email, len(all_reasons) = 0 AS eligible, array_to_string(all_reasons, ',') AS reasons FROM r""")
def eligibility_rechecked(spark, sf_dir):
    """Eligibility at the time of sending, with fresh doubts."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    eligible = table(spark, sf_dir, "customer").select(c.alias("business"), F.when(c % 6 != 5, F.concat(F.lit("m"), c % 3)).alias("email"), (c % 5 != 0).alias("eligible"), F.when(c % 5 == 0, F.array(F.lit("suppressed"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    confirmed = table(spark, sf_dir, "customer").filter(c % 7 != 0).select(c.alias("business"), F.concat(F.lit("m"), c % 3).alias("email"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("business"), F.concat(F.lit("m"), k % 3).alias("value"), F.when(k % 4 == 1, month).otherwise("").alias("recheck_at"), F.when(k % 4 == 2, month).alias("fresh_until"))
    return S.rechecked(eligible, confirmed, seen, F.lit("1996-06")).withColumn("reasons", F.array_join("reasons", ","))


@query("""
WITH c AS (SELECT n_nationkey, list_extract(['us', ' GB ', 'EU', 'DE', NULL, ''], CAST(n_nationkey % 6 + 1 AS INT)) AS country FROM nation), u AS (SELECT *, upper(trim(coalesce(country, ''))) AS code FROM c)
SELECT n_nationkey, CASE WHEN code = '' THEN 'UNKNOWN' ELSE code END AS jurisdiction, code IN ('US', 'GB', 'EU') AS allowed, CASE WHEN code = 'US' THEN 'operator_review_required' WHEN code IN ('GB', 'EU') THEN 'legitimate_interest_review_required' ELSE 'manual_review_required' END AS review, CASE WHEN code IN ('US', 'GB', 'EU') THEN 4 ELSE 0 END AS sources FROM u""")
def country_policies(spark, sf_dir):
    """What a country allows; one that isn't known allows nothing."""
    k = F.col("n_nationkey")
    country = F.element_at(F.array(*[F.lit(x) for x in ("us", " GB ", "EU", "DE", None, "")]), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(k, S.policy(country).alias("p")).select(k, "p.jurisdiction", "p.allowed", "p.review", F.size("p.sources").alias("sources"))
