"""Planning, aggregates, top-k, set operations and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import resolve as R
from ..sources.scratch import kept
from .base import businesses, query, table, with_businesses

money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))

BOX = (900.0, 1.0, 2100.0, 51.0)


@query("""
SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS turn,
 row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS in_brand FROM part""")
def plan_fair_rotation(spark, sf_dir):
    """Turns in which each area and category gets its k-th query before any gets the next."""
    p = table(spark, sf_dir, "part")
    turn = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    own = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return p.select("p_partkey", "p_brand", "p_type", turn.cast("long").alias("turn"), own.cast("long").alias("in_brand"))


@query("""
SELECT ix, iy, count(*) AS n, min(p_partkey) AS first_part FROM (SELECT p_partkey, CAST(greatest(0, least(11, floor((p_retailprice - 900.0) / 100.0))) AS BIGINT) AS ix, CAST(greatest(0, least(9, floor((p_size - 1.0) / 5.0))) AS BIGINT) AS iy FROM part) t GROUP BY 1, 2""")
def tile_grid_assign(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ix, iy = P.assign(F.col("p_retailprice"), F.col("p_size"), BOX, 12, 10)
    return p.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


QUARTERS = """
WITH t AS (SELECT CAST(greatest(0, least(11, floor((p_retailprice - 900.0) / 100.0))) AS BIGINT) AS ix, CAST(greatest(0, least(9, floor((p_size - 1.0) / 5.0))) AS BIGINT) AS iy, count(*) AS n FROM part GROUP BY 1, 2),
full_tiles AS (SELECT ix, iy, n, 900.0 + ix * 100.0 AS x0, 1.0 + iy * 5.0 AS y0 FROM t WHERE n >= 10)"""


@query(QUARTERS + """
SELECT ix, iy, q AS quarter, (x0 + (q % 2) * 50.0)::DOUBLE AS min_x, (y0 + (q // 2) * 2.5)::DOUBLE AS min_y FROM full_tiles, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS q) s""")
def quadtree_children(spark, sf_dir):
    """Quarters of tiles that are full."""
    t = tile_grid_assign(spark, sf_dir).filter("n >= 10").select("ix", "iy", F.lit(0).alias("depth"), (900.0 + F.col("ix") * 100.0).alias("min_x"), (1.0 + F.col("iy") * 5.0).alias("min_y"), (1000.0 + F.col("ix") * 100.0).alias("max_x"), (6.0 + F.col("iy") * 5.0).alias("max_y"))
    return P.children(t).select("ix", "iy", "quarter", "min_x", "min_y")


@query("""
WITH parents AS (SELECT n_nationkey, 900 + n_nationkey * 40 AS lo, 900 + n_nationkey * 40 + 70 AS hi FROM nation)
SELECT n_nationkey, count(*) AS n, min(p_partkey) AS first_part FROM part JOIN parents ON p_retailprice BETWEEN lo AND hi GROUP BY 1""")
def tile_prune_range_join(spark, sf_dir):
    """Points in overlapping ranges: both sides meet on buckets of the range, then the bounds decide."""
    step = 70
    n = table(spark, sf_dir, "nation").select("n_nationkey", (900 + F.col("n_nationkey") * 40).alias("lo"), (970 + F.col("n_nationkey") * 40).alias("hi"))
    n = n.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / step).alias("cell"))
    return p.join(n, "cell").filter("p_retailprice BETWEEN lo AND hi").groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


@query("""
SELECT p_brand, count(*) AS queries, count(*) FILTER (p_size > 25) AS tiled, count(*) * 120 AS ceiling, (2.0 * count(*) FILTER (p_size <= 25) + 4.0 * count(*) FILTER (p_size > 25))::DOUBLE AS minutes, count(DISTINCT p_type) AS areas FROM part GROUP BY 1""")
def plan_cost_estimate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tiled = F.count_if(F.col("p_size") > 25)
    n = F.count(F.lit(1))
    return p.groupBy("p_brand").agg(n.alias("queries"), tiled.alias("tiled"), (n * 120).alias("ceiling"), (2.0 * (n - tiled) + 4.0 * tiled).alias("minutes"), F.countDistinct("p_type").alias("areas"))


@query("""
WITH h AS (SELECT l_suppkey AS tile, l_partkey AS found, min(l_orderkey) AS first_query FROM lineitem GROUP BY 1, 2), q AS (SELECT l_suppkey AS tile, l_orderkey AS query, count(*) AS results FROM lineitem GROUP BY 1, 2)
SELECT tile, query, results, (SELECT count(*) FROM h WHERE h.tile = q.tile AND h.first_query = q.query) AS new_count FROM q WHERE results >= 2""")
def saturation_novelty_gate(spark, sf_dir):
    """Queries that gave many results, with how many of them were new to the tile."""
    l = table(spark, sf_dir, "lineitem")
    h = l.groupBy(F.col("l_suppkey").alias("tile"), "l_partkey").agg(F.min("l_orderkey").alias("query")).groupBy("tile", "query").agg(F.count(F.lit(1)).alias("new_count"))
    q = l.groupBy(F.col("l_suppkey").alias("tile"), F.col("l_orderkey").alias("query")).agg(F.count(F.lit(1)).alias("results")).filter("results >= 2")
    return q.join(h, ["tile", "query"], "left").fillna({"new_count": 0}).select("tile", "query", "results", "new_count")


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS strong, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS strong_users, count(DISTINCT CAST(props->>'$.k' AS BIGINT)) AS keys, max(event_id) AS last FROM events GROUP BY 1""")
def coverage_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    strong = F.col("value") > 50
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(strong).alias("strong"), F.countDistinct(F.when(strong, F.col("user_id"))).alias("strong_users"), F.countDistinct(F.get_json_object("props", "$.k").cast("long")).alias("keys"), F.max("event_id").alias("last"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END)::BIGINT AS verified, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS cost,
 round(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 4) AS rate, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / nullif(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 0), 2) AS cost_per_verified FROM lineitem GROUP BY 1, 2""")
def source_hit_rate(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    ok, n, cost = F.count_if(F.col("l_discount") >= 0.05), F.count(F.lit(1)), money("l_extendedprice").cast("double")
    return l.groupBy("l_returnflag", "l_linestatus").agg(n.alias("n"), ok.alias("verified"), cost.alias("cost"), F.round(ok / n, 4).alias("rate"), F.round(F.try_divide(cost, ok), 2).alias("cost_per_verified"))


@query("""
SELECT c_mktsegment, o_orderstatus, o_orderpriority, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""")
def outcome_attribution(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c.select("c_custkey", "c_mktsegment"), o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT coalesce(o_orderstatus, 'all') AS o_orderstatus, coalesce(o_orderpriority, 'all') AS o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def attribution_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    return r.fillna("all", ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(l_linestatus, 'all') AS l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def attribution_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).fillna("all", ["l_returnflag", "l_linestatus"])


@query("""
SELECT event_type, sum(value::DECIMAL(18,2))::DOUBLE AS cost, count(DISTINCT CASE WHEN value > 30 THEN user_id || ':' || event_type END) AS verified, round(sum(value::DECIMAL(18,2))::DOUBLE / count(DISTINCT CASE WHEN value > 30 THEN user_id || ':' || event_type END), 2) AS cost_per FROM events GROUP BY 1""")
def cost_per_verified(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    who = F.countDistinct(F.when(F.col("value") > 30, F.concat_ws(":", "user_id", "event_type")))
    cost = money("value").cast("double")
    return e.groupBy("event_type").agg(cost.alias("cost"), who.alias("verified"), F.round(cost / who, 2).alias("cost_per"))


@query(with_businesses("""
SELECT category, count(*) FILTER (reviews >= 150) AS a, count(*) FILTER (reviews >= 100 AND reviews < 150) AS b, count(*) FILTER (reviews < 100) AS c, count(*) AS n FROM businesses GROUP BY 1"""))
def tier_digest(spark, sf_dir):
    r = F.col("reviews")
    return businesses(spark, sf_dir).groupBy("category").agg(F.count_if(r >= 150).alias("a"), F.count_if((r >= 100) & (r < 150)).alias("b"), F.count_if(r < 100).alias("c"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT split_part(p_name, ' ', 1) AS hook, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, hook LIMIT 8""")
def top_hooks(spark, sf_dir):
    """The eight commonest first hooks; the number is the feature."""
    return table(spark, sf_dir, "part").groupBy(F.substring_index("p_name", " ", 1).alias("hook")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hook").limit(8)


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+) (?:is|was|who|did)\b', 1)) AS name FROM documents)
SELECT name, count(DISTINCT doc_id) AS n FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def credited_names_min3(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    names = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+) (?:is|was|who|did)\b"), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.countDistinct("doc_id").alias("n")).filter("n >= 3")


@query("""
SELECT user_id, event_type AS pattern, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def pattern_mode(spark, sf_dir):
    """The commonest pattern of each user; the one seen first wins a tie."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", -F.col("f"))).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("pattern"), F.col("b.n").alias("n"))


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1""")
def percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)").alias("median"))


@query("""
SELECT user_id, event_id, created FROM (SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS created FROM events) x WHERE created <= 5""")
def lead_cap_running(spark, sf_dir):
    """Rows up to the fifth creation of each run; the cap is the feature."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").withColumn("created", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w)).filter("created <= 5").select("user_id", "event_id", "created")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 3""")
def top_k_per_group(spark, sf_dir):
    """The three dearest lines of each supplier: a rank limit that Spark applies before the shuffle too."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
WITH t AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS p, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F'))) AS f FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_intersect(p, coalesce(f, []))), ',') AS both, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(coalesce(f, []), x))), ',') AS rest, len(p) AS n FROM t""")
def set_ops_tokens(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("f"))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return o.select("o_custkey", join(F.array_intersect("p", "f")).alias("both"), join(F.array_except("p", "f")).alias("rest"), F.size("p").cast("long").alias("n"))


@query("""
(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH') EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 80 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9500""")
def union_intersect_except(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderpriority = '2-HIGH'").select("o_custkey"))
    a = a.subtract(table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 80").select("user_id"))
    return a.union(table(spark, sf_dir, "customer").filter("c_acctbal > 9500").select("c_custkey")).distinct()


@query(with_businesses("""
SELECT id, domain, k, row_number() OVER (PARTITION BY domain ORDER BY reviews DESC, id) AS turn FROM (SELECT id, domain, reviews, row_number() OVER (PARTITION BY domain ORDER BY seq) AS k FROM businesses WHERE domain IS NOT NULL) b"""))
def domain_round_robin(spark, sf_dir):
    """The k-th row of each site comes before any (k+1)-th: rows ordered by turn share no site within a turn."""
    b = businesses(spark, sf_dir).filter("domain IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("domain").orderBy("seq"))
    turn = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("reviews"), "id"))
    return b.select("id", "domain", k.cast("long").alias("k"), turn.cast("long").alias("turn"))


@query("""
WITH p AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER w AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, done, round((done - first_value(done) OVER f) / nullif(s - first_value(s) OVER f, 0) * 3600, 4) AS per_hour FROM p WINDOW f AS (PARTITION BY user_id ORDER BY done ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def moving_rate_eta(spark, sf_dir):
    """Progress per hour over the last twelve changes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    p = table(spark, sf_dir, "events").select("user_id", "event_id", micros.alias("s"), F.row_number().over(w).cast("long").alias("done"))
    f = Window.partitionBy("user_id").orderBy("done").rowsBetween(-11, 0)
    rate = F.try_divide(F.col("done") - F.first("done").over(f), F.col("s") - F.first("s").over(f)) * 3600
    return p.select("user_id", "event_id", "done", F.round(rate, 4).alias("per_hour"))


@query("""
SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)""")
def change_detection(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w))
    return e.filter(~F.col("event_type").eqNullSafe(F.col("before"))).select("user_id", "event_id", "event_type")


@query(with_businesses("""
, d AS (SELECT domain FROM businesses WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1), p AS (SELECT phone FROM businesses WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT b.*, coalesce('domain:' || d.domain, 'phone:' || p.phone) AS chain FROM businesses b LEFT JOIN d ON d.domain = b.domain LEFT JOIN p ON p.phone = b.phone)
SELECT id, chain, CASE WHEN phone IS NULL THEN 'not eligible' WHEN chain IS NULL THEN 'enrolled' WHEN row_number() OVER (PARTITION BY chain, phone IS NULL ORDER BY reviews DESC, id) = 1 THEN 'enrolled' ELSE 'chain_duplicate' END AS outcome FROM c"""))
def chain_reservation(spark, sf_dir):
    """The first eligible member of each chain takes its place."""
    b = businesses(spark, sf_dir)
    c = b.join(R.chain_map(b, "id", "domain", "phone"), "id", "left")
    first = F.row_number().over(Window.partitionBy("chain", F.col("phone").isNull()).orderBy(F.desc("reviews"), "id")) == 1
    outcome = F.when(F.col("phone").isNull(), "not eligible").when(F.col("chain").isNull() | first, "enrolled").otherwise("chain_duplicate")
    return c.select("id", "chain", outcome.alias("outcome"))


@query("""
SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quarter, round(percent_rank() OVER w, 6) AS share FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)""")
def rank_functions(spark, sf_dir):
    """Ranks from counts of distinct values, and places from those of ranges, so that no task holds a whole status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    status, n = Window.partitionBy("o_orderstatus"), F.count(F.lit(1))
    before = lambda order: F.coalesce(F.sum("n").over(status.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Ranges of status, price and key, written, as they must stay what they are counted by.
    o = kept(o.repartitionByRange("o_orderstatus", "o_totalprice", "o_orderkey").withColumn("part", F.spark_partition_id()), "ranges")
    parts = o.groupBy("o_orderstatus", "part").agg(n.alias("n")).select(F.col("o_orderstatus").alias("s"), F.col("part").alias("p"), before("part").alias("offset"), F.sum("n").over(status).alias("total"))
    ranks = o.groupBy("o_orderstatus", "o_orderpriority").agg(n.alias("n")).select(
        F.col("o_orderstatus").alias("rs"), F.col("o_orderpriority").alias("rp"), (before("o_orderpriority") + 1).alias("rank"), F.row_number().over(status.orderBy("o_orderpriority")).cast("long").alias("dense")
    )
    place = F.row_number().over(Window.partitionBy("o_orderstatus", "part").orderBy("o_totalprice", "o_orderkey"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    o = o.withColumn("place", place).join(kept(parts, "parts"), same("o_orderstatus", "s") & same("part", "p")).join(kept(ranks, "ranks"), same("o_orderstatus", "rs") & same("o_orderpriority", "rp"))
    # Of n rows in four parts the first n % 4 have one more.
    at, size, more = F.col("offset") + F.col("place") - 1, F.floor(F.col("total") / 4), F.col("total") % 4
    quarter = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / size)) + 1
    share = F.when(F.col("total") > 1, (F.col("rank") - 1) / (F.col("total") - 1)).otherwise(0.0)
    return o.select("o_orderkey", "rank", "dense", quarter.cast("long").alias("quarter"), F.round(share, 6).alias("share"))
