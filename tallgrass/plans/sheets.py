"""What leaves the engine: sheets, summaries and reports, and the backlogs that feed the stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import resolve as R
from .base import businesses, query, table, with_businesses
from .decisions import SCORE_SQL, scored


@query(with_businesses(SCORE_SQL + """
SELECT 'tier' AS part, tier AS label, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'route', CASE WHEN phone IS NOT NULL AND domain IS NOT NULL THEN 'both' WHEN phone IS NOT NULL THEN 'phone' WHEN domain IS NOT NULL THEN 'site' ELSE 'none' END, count(*) FROM t GROUP BY 2"""))
def summary_sheet(spark, sf_dir):
    """Histograms of a run in one pass: each row counts once in every part."""
    route = F.when(F.col("phone").isNotNull() & F.col("domain").isNotNull(), "both").when(F.col("phone").isNotNull(), "phone").when(F.col("domain").isNotNull(), "site").otherwise("none")
    part = lambda p, c: F.struct(F.lit(p).alias("part"), c.alias("label"))
    rows = scored(spark, sf_dir).select(F.explode(F.array(part("tier", F.col("tier")), part("category", F.col("category")), part("route", route))).alias("x"))
    return rows.groupBy("x.part", "x.label").agg(F.count(F.lit(1)).alias("n"))


@query(with_businesses(SCORE_SQL + """
SELECT category, '{"a":' || count(*) FILTER (tier = 'A') || ',"b":' || count(*) FILTER (tier = 'B') || ',"rows":' || count(*) || '}' AS report FROM t GROUP BY 1"""))
def report_json(spark, sf_dir):
    t = F.col("tier")
    r = scored(spark, sf_dir).groupBy("category").agg(F.count_if(t == "A").alias("a"), F.count_if(t == "B").alias("b"), F.count(F.lit(1)).alias("rows"))
    return r.select("category", F.to_json(F.struct("a", "b", "rows")).alias("report"))


@query(with_businesses(SCORE_SQL + """
SELECT id, total, tier, concat_ws(' | ', name, city, coalesce(phone, 'no phone'), coalesce(domain, 'no site')) AS line FROM t WHERE tier IN ('A', 'B')"""))
def lead_sheet_rows(spark, sf_dir):
    """The rows of the final sheet; they are sorted by (-total, tier, id) where they are written."""
    s = scored(spark, sf_dir).filter(F.col("tier").isin("A", "B"))
    return s.select("id", "total", "tier", F.concat_ws(" | ", "name", "city", F.coalesce("phone", F.lit("no phone")), F.coalesce("domain", F.lit("no site"))).alias("line"))


@query("""
WITH m AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1) SELECT m.user_id, e.event_id, e.value, c_name, coalesce(n_name, 'unknown') AS area FROM m JOIN events e ON e.event_id = m.event_id JOIN customer ON c_custkey = m.user_id LEFT JOIN nation ON n_nationkey = c_nationkey""")
def drafts_sheet(spark, sf_dir):
    """The newest draft of each target with its owner and area."""
    best = table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.max(F.struct("event_id", "value")).alias("m"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = best.join(c, F.col("user_id") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # nations: a fixed table
    return rows.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"), "c_name", F.coalesce("n_name", F.lit("unknown")).alias("area"))


@query("""
SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def registry_backlog(spark, sf_dir):
    """Rows to look up: without a registry person, with an owner that counts."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    good = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(done, "o_orderkey", "left_anti").join(good, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""
WITH old AS (SELECT DISTINCT lower(trim(c_mktsegment)) AS value FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT lower(trim(event_type)) AS value, min(event_id) AS first FROM events GROUP BY 1 UNION ALL SELECT lower(trim(c_mktsegment)), min(c_custkey) FROM customer GROUP BY 1) SELECT value, first FROM new WHERE value NOT IN (SELECT value FROM old)""")
def suppress_insert_ignore(spark, sf_dir):
    """New suppressed values, in lower case and trimmed; those there already are left alone."""
    norm = lambda c: F.lower(F.trim(F.col(c))).alias("value")
    c = table(spark, sf_dir, "customer")
    new = table(spark, sf_dir, "events").groupBy(norm("event_type")).agg(F.min("event_id").alias("first")).unionByName(c.groupBy(norm("c_mktsegment")).agg(F.min("c_custkey").alias("first")))
    return new.join(c.filter("c_custkey % 2 = 0").select(norm("c_mktsegment")), "value", "left_anti")


@query("""
SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderpriority, ';' ORDER BY o_orderpriority, o_orderkey) AS candidates, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def label_batch_lines(spark, sf_dir):
    """A line of candidates for each owner, in the order in which they are numbered."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    found = F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey")))
    line = F.array_join(F.transform(found, lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderpriority"])), ";")
    return o.groupBy("o_custkey").agg(line.alias("candidates"), F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, o_orderkey AS picked FROM c WHERE place = o_custkey % 3""")
def label_pick_by_index(spark, sf_dir):
    """A label names a candidate by its number in the line."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    c = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumn("place", F.row_number().over(w) - 1)
    return c.filter("place = o_custkey % 3").select("o_custkey", F.col("o_orderkey").alias("picked"))


@query("""
SELECT o_custkey, o_orderpriority, count(*) AS same, CASE WHEN count(*) = 1 THEN min(o_orderkey) ELSE -1 END AS reuse FROM orders GROUP BY 1, 2""")
def identity_continuity(spark, sf_dir):
    """A person's row is used again only where exactly one has the name."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(n.alias("same"), F.when(n == 1, F.min("o_orderkey")).otherwise(-1).alias("reuse"))


@query(with_businesses("""
, f AS (SELECT id, name, phone, domain, category, reviews FROM businesses), p AS (SELECT id, CASE WHEN domain IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN reviews >= 100 THEN 1 ELSE 0 END AS n FROM f)
SELECT id, CAST(n AS BIGINT) AS channels, n >= 2 AS name_allowed FROM p"""))
def corroborations(spark, sf_dir):
    """How many independent channels speak for a name; two let it be used."""
    n = sum((c.cast("long") for c in (F.col("domain").isNotNull(), F.col("phone").isNotNull(), F.col("reviews") >= 100)), F.lit(0).cast("long"))
    return businesses(spark, sf_dir).select("id", n.alias("channels"), (n >= 2).alias("name_allowed"))


@query("""
SELECT l_suppkey, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 1 AND sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) >= 1""")
def having_each_kind(spark, sf_dir):
    kinds = lambda k: F.bool_or(F.col("l_returnflag") == k)
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"), kinds("R").alias("r"), kinds("N").alias("n"))
    return g.filter("r AND n").select("l_suppkey", "first_order", "last_order")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_run(spark, sf_dir):
    return R.newest_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")
