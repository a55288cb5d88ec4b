"""Imports of lists into several tables, published as one version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports as I
from ..sources import versions as V
from ..sources.scratch import shared_path
from .base import businesses, query, table, with_businesses

RESULTS = ["Meeting booked", "DNC", " no answer ", "Left / message", "", "interested / qualified"]
CANON = ["meeting_booked", "do_not_contact", "no_answer", "left___message", "unknown", "interested"]
assert len(RESULTS) == len(CANON)


def _pick(names, i):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))


def calls(spark, sf_dir):
    """Orders as rows of a calling list: how a row names its business depends on its key."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    site = F.concat(F.lit("site"), c % 300, F.lit(".example.com"))
    return o.select(
        k.alias("row"), F.when(k % 4 == 0, F.concat(F.lit("c"), c)).when(k % 4 == 1, "nobody").alias("business_id"), F.when(k % 4 == 1, F.concat(F.lit("HTTPS://www."), site, F.lit("/x?y"))).alias("domain"),
        F.when(k % 8 == 2, site).alias("website"), F.when(k % 4 == 3, F.concat(F.lit("+1 (713) 555-"), F.lpad((c % 500).cast("string"), 4, "0"))).alias("phone"),
        F.when(k % 8 == 6, F.concat(F.lit(" Mail"), c, F.lit("@x.com"))).alias("email"), F.when(k % 3 == 0, "email").alias("channel"), _pick(RESULTS, c).alias("outcome"), F.lit(None).cast("string").alias("call_date"),
        F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("contacted_at"), F.when(k % 7 == 0, "again").alias("notes"), F.lit("ann").alias("recorded_by"),
        F.concat(F.lit("Pat "), F.chr(65 + k % 20)).alias("decision_maker"), F.when(k % 2 == 0, "Owner").alias("dm_title"), F.when(k % 3 != 1, F.concat(F.lit("(713) 555-"), F.lpad((k % 40).cast("string"), 4, "0"))).alias("dm_phone"),
        F.when(k % 2 == 0, "A").alias("sheet"),
    )


def known_contacts(spark, sf_dir):
    """Two addresses for three customers in four; every tenth shares one with the next."""
    c = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").filter(c % 4 != 3).select(F.concat(F.lit("c"), c).alias("business"), F.concat(F.lit("mail"), c, F.lit("@X.com")).alias("value"))
    shared = table(spark, sf_dir, "customer").filter(c % 10 == 1).select(F.concat(F.lit("c"), c).alias("business"), F.concat(F.lit("mail"), c - 1, F.lit("@x.com")).alias("value"))
    return own.unionByName(shared)


MATCH_SQL = """,
r AS (SELECT o_orderkey AS row, CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'nobody' END AS bid, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 8 = 2 THEN 'site' || (o_custkey % 300) || '.example.com' END AS site,
  CASE WHEN o_orderkey % 4 = 3 THEN '+1713555' || lpad(CAST(o_custkey % 500 AS VARCHAR), 4, '0') {dm} END AS phone, CASE WHEN o_orderkey % 8 = 6 THEN 'mail' || o_custkey || '@x.com' END AS email, o_custkey AS c, o_orderdate FROM orders),
ct AS (SELECT 'c' || c_custkey AS business, 'mail' || c_custkey || '@x.com' AS v FROM customer WHERE c_custkey % 4 <> 3 UNION ALL SELECT 'c' || c_custkey, 'mail' || (c_custkey - 1) || '@x.com' FROM customer WHERE c_custkey % 10 = 1),
kd AS (SELECT domain AS v, count(*) AS n, min(id) AS id FROM businesses WHERE domain IS NOT NULL GROUP BY 1), kp AS (SELECT phone AS v, count(*) AS n, min(id) AS id FROM businesses WHERE phone IS NOT NULL GROUP BY 1),
kc AS (SELECT v, count(DISTINCT business) AS n, min(business) AS id FROM ct GROUP BY 1),
m AS (SELECT r.*, CASE WHEN b.id IS NOT NULL THEN b.id WHEN kd.n = 1 THEN kd.id WHEN kd.n > 1 THEN NULL WHEN kp.n = 1 THEN kp.id WHEN kp.n > 1 THEN NULL WHEN kc.n = 1 THEN kc.id END AS business,
  CASE WHEN b.id IS NOT NULL THEN 'business_id' WHEN kd.n = 1 THEN 'domain' WHEN kd.n > 1 THEN 'ambiguous_domain' WHEN kp.n = 1 THEN 'phone' WHEN kp.n > 1 THEN 'ambiguous_phone' WHEN kc.n = 1 THEN 'contact' WHEN kc.n > 1 THEN 'ambiguous_contact' ELSE 'unmatched' END AS reason
  FROM r LEFT JOIN businesses b ON b.id = r.bid LEFT JOIN kd ON kd.v = site LEFT JOIN kp ON kp.v = r.phone LEFT JOIN kc ON kc.v = r.email)"""

ACTION_SQL = "CASE WHEN starts_with(reason, 'ambiguous') THEN 'ambiguous' WHEN reason = 'unmatched' THEN 'unmatched' {rest} END"
OUTCOME_SQL = with_businesses(MATCH_SQL.format(dm="") + f""",
x AS (SELECT row, business, reason, CASE WHEN row % 3 = 0 THEN 'email' ELSE 'phone' END AS channel, list_extract({CANON!r}, CAST(c % {len(CANON)} + 1 AS INT)) AS result, CASE WHEN row % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS day, CASE WHEN row % 7 = 0 THEN 'again' ELSE '' END AS notes FROM m),
old AS (SELECT 'c' || c_custkey AS business, 'phone' AS channel, list_extract({CANON!r}, CAST(c_custkey % {len(CANON)} + 1 AS INT)) AS result, '1995-06' AS day, '' AS notes FROM customer WHERE c_custkey % 3 = 0),
a AS (SELECT x.*, {ACTION_SQL.format(rest='''WHEN day IS NULL THEN CASE WHEN row > min(row) OVER (PARTITION BY business, channel, result, notes) OR EXISTS (SELECT 1 FROM old WHERE old.business = x.business AND old.channel = x.channel AND old.result = x.result AND old.notes = x.notes) THEN 'duplicate' ELSE 'imported' END
  WHEN row > min(row) OVER (PARTITION BY business, channel, result, notes, day) OR EXISTS (SELECT 1 FROM old WHERE old.business = x.business AND old.channel = x.channel AND old.result = x.result AND old.notes = x.notes AND old.day = x.day) THEN 'duplicate' ELSE 'imported' ''')} AS action FROM x)""")


def _outcomes(spark, sf_dir):
    c = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").filter(c % 3 == 0).select(F.concat(F.lit("c"), c).alias("business"), F.lit("phone").alias("channel"), _pick(CANON, c).alias("result"), F.lit("1995-06").alias("contacted_at"), F.lit(None).cast("string").alias("notes"), F.lit("old").alias("recorded_by"))
    return old, I.import_outcomes(calls(spark, sf_dir), businesses(spark, sf_dir), known_contacts(spark, sf_dir), old)


@query(OUTCOME_SQL + " SELECT row, business, reason, action FROM a")
def outcome_import(spark, sf_dir):
    """What becomes of each row of a calling list, and why."""
    return _outcomes(spark, sf_dir)[1].routes


@query(OUTCOME_SQL + " SELECT business, channel, result, contacted_at, count(*) AS n FROM (SELECT business, channel, result, day AS contacted_at FROM a WHERE action = 'imported' UNION ALL SELECT business, channel, result, day FROM old) u GROUP BY ALL")
def outcomes_published(spark, sf_dir):
    """The outcomes after the import, as readers of the published version see them."""
    old, new = _outcomes(spark, sf_dir)
    folder = shared_path(spark, "published")
    V.publish(spark, folder, {"outcomes": old.select(*new.targets["outcomes"].columns)})
    V.publish(spark, folder, new.targets, {"routes": new.routes}, expected=1)
    return V.current(spark, folder, "outcomes").groupBy("business", "channel", "result", "contacted_at").agg(F.count(F.lit(1)).alias("n"))


DM_SQL = with_businesses(MATCH_SQL.format(dm="WHEN o_orderkey % 3 <> 1 THEN '713555' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 4, '0')") + f""",
v AS (SELECT row, business, reason, 'Pat ' || chr(CAST(65 + row % 20 AS INT)) || chr(10) || CASE WHEN row % 2 = 0 THEN 'Owner' ELSE '' END AS person, 'human_calling:' || CASE WHEN row % 2 = 0 THEN 'A' ELSE 'unknown' END AS source,
  unnest(CASE WHEN row % 3 <> 1 AND row % 8 = 6 THEN ['phone', 'email'] WHEN row % 3 <> 1 THEN ['phone'] WHEN row % 8 = 6 THEN ['email'] ELSE [NULL] END) AS field, email FROM m),
f AS (SELECT row, business, reason, person, source, field, CASE field WHEN 'phone' THEN '+1713555' || lpad(CAST(row % 40 AS VARCHAR), 4, '0') WHEN 'email' THEN email END AS value FROM v),
a AS (SELECT *, {ACTION_SQL.format(rest="WHEN field IS NULL THEN 'person' WHEN row > min(row) OVER (PARTITION BY business, field, value, source, person) THEN 'duplicate' ELSE 'imported'")} AS action FROM f)""")


@query(DM_SQL + " SELECT row, business, reason, field, value, action FROM a")
def dm_import(spark, sf_dir):
    """What becomes of the numbers and addresses of confirmed decision makers."""
    none = spark.createDataFrame([], "business string, field string, value string, source string, person string")
    return I.import_people(calls(spark, sf_dir), businesses(spark, sf_dir), known_contacts(spark, sf_dir), none).routes
