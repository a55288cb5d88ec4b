"""Progress, paces and what is left of a campaign."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pace as P
from .base import query, table

STAGES = {"signup": "discover", "view": "enrich", "click": "registry", "purchase": "validate", "error": "export"}
FEED_SQL = f"""
f AS (SELECT CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STAGES.items())} END AS stage, epoch_us(ts) / 1e6 AS ts, event_id AS n, CASE WHEN event_type = 'click' THEN 5 ELSE event_id // 7 END AS done, CASE WHEN event_type <> 'view' THEN 20000 + event_id // 1000 * 10 END AS total FROM events),
c AS (SELECT stage, ts, n, done, coalesce(total, 0) AS total FROM f WINDOW w AS (PARTITION BY stage ORDER BY ts, n) QUALIFY lag(done) OVER w IS DISTINCT FROM done OR lag(coalesce(total, 0)) OVER w IS DISTINCT FROM coalesce(total, 0) OR row_number() OVER w = 1),
a AS (SELECT stage, arg_min({{'ts': ts, 'done': done, 'total': total}}, {{'ts': ts, 'n': n}}) AS a, arg_max({{'ts': ts, 'done': done, 'total': total}}, {{'ts': ts, 'n': n}}) AS z FROM c GROUP BY 1),
l AS (SELECT stage, arg_min({{'ts': ts, 'done': done}}, {{'ts': ts, 'n': n}}) AS w FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ts DESC, n DESC) <= 12) k GROUP BY 1),
e AS (SELECT stage, a, z, coalesce(CASE WHEN z.ts > w.ts AND z.done > w.done THEN (z.done - w.done) / (z.ts - w.ts) END, CASE WHEN z.ts > a.ts AND z.done > a.done THEN (z.done - a.done) / (z.ts - a.ts) END) AS rate FROM a JOIN l USING (stage))"""


def _estimates(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    stage = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in STAGES.items()])
    done = F.when(F.col("event_type") == "click", 5).otherwise(F.floor(n / 7))
    total = F.when(F.col("event_type") != "view", 20000 + F.floor(n / 1000) * 10)
    feed = e.select(stage.alias("stage"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), n.alias("n"), done.alias("done"), total.alias("total"))
    return P.estimates(feed, F.lit(1_800_000_000.0))


@query(f"""
WITH {FEED_SQL.strip()}
SELECT stage, z.done AS done, z.total AS total, z.total - a.total AS growth, round(rate * 3600, 6) AS per_hour, CASE WHEN z.total > 0 AND rate IS NOT NULL THEN round(greatest(0.0, (z.total - z.done) / rate) / 3600, 4) END AS hours, round(1800000000.0 - a.ts, 3) AS elapsed FROM e""")
def progress_estimates(spark, sf_dir):
    """Rates and ends of stages from the feed of their progress."""
    rows = _estimates(spark, sf_dir)
    return rows.select("stage", "done", "total", "growth", F.round(F.col("rate") * 3600, 6).alias("per_hour"), F.round(F.col("eta") / 3600, 4).alias("hours"), F.round("elapsed", 3).alias("elapsed"))


@query(f"""
WITH {FEED_SQL.strip()}, d AS (SELECT unnest({list(P.DEFAULT)!r}) AS stage, CAST(unnest({list(P.DEFAULT.values())!r}) AS DOUBLE) AS fallback), s AS (SELECT 'registry' AS stage, 2.25 AS per_item UNION ALL SELECT 'discover', 9.0),
p AS (SELECT d.stage, coalesce(1 / e.rate, s.per_item, fallback) AS pace, CASE WHEN e.rate IS NOT NULL THEN 'measured on this run' WHEN s.per_item IS NOT NULL THEN 'measured earlier in this workspace' ELSE 'documented default' END AS source FROM d LEFT JOIN e USING (stage) LEFT JOIN s USING (stage)),
w AS (SELECT 'discover' AS stage, count(*) FILTER (o_orderstatus <> 'P') AS done, count(*) AS total FROM orders UNION ALL SELECT 'enrich', count(*) FILTER (c_custkey % 4 <> 0), count(*) FROM customer UNION ALL SELECT 'registry', count(*), count(*) FROM supplier UNION ALL SELECT 'gbp', 0, count(*) FROM part UNION ALL SELECT 'validate', 0, 0 FROM region WHERE r_regionkey = 0)
SELECT stage, CASE WHEN total - done <= 0 AND done > 0 THEN 'done' ELSE 'pending' END AS state, done, total, source, round(greatest(0, total - done) * pace, 4) AS eta FROM w JOIN p USING (stage)""")
def campaign_status(spark, sf_dir):
    """Each stage with what is done, what is left and how long it takes."""
    store = spark.createDataFrame([("registry", 2.25), ("discover", 9.0)], "stage string, per_item double")
    pace = P.paces(_estimates(spark, sf_dir), store)
    one = F.count(F.lit(1))
    work = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") != "P").alias("done"), one.alias("total")).withColumn("stage", F.lit("discover"))
    parts = [
        table(spark, sf_dir, "customer").agg(F.count_if(F.col("c_custkey") % 4 != 0).alias("done"), one.alias("total")).withColumn("stage", F.lit("enrich")),
        table(spark, sf_dir, "supplier").agg(one.alias("done"), one.alias("total")).withColumn("stage", F.lit("registry")), table(spark, sf_dir, "part").agg(F.lit(0).cast("long").alias("done"), one.alias("total")).withColumn("stage", F.lit("gbp")),
        spark.range(1).select(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("total"), F.lit("validate").alias("stage")),
    ]
    for part in parts:
        work = work.unionByName(part)
    return P.status(work, pace).select("stage", "state", "done", "total", "source", F.round("eta", 4).alias("eta"))
