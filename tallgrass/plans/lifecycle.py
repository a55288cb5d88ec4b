"""Lifecycle, gates, funnels and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources.scratch import shared_path
from ..streaming import advance as A
from ..streaming import events as S
from .base import query, table

#: What an event asks for, by its kind, and rarer moves by its value.
ASKS = {"signup": "drafted", "view": "approved", "click": "queued", "purchase": "sent", "error": "bounced"}
RARE = [(99.7, "opted_out"), (99.4, "done"), (92, "follow_up"), (86, "no_response"), (78, "replied"), (75, "unknown"), (72, None)]
ASKED_SQL = "CASE " + " ".join(f"WHEN value > {v} THEN {repr(s) if s else 'NULL'}" for v, s in RARE) + " ELSE CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASKS.items()) + " END END"
MOVES_SQL = ", ".join(f"'{a}>{b}'" for a, to in L.TARGET_MOVES.items() for b in to)


def asked():
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ASKS.items()])
    out = kind
    for v, s in reversed(RARE):
        out = F.when(F.col("value") > v, F.lit(s)).otherwise(out)
    return out


def asking(spark, sf_dir):
    """Events with the state that they ask for."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.col("ts").cast("timestamp").alias("ts"), "event_id", asked().alias("asked"))


@query(f"""
WITH s AS (SELECT user_id, event_id, {ASKED_SQL} AS after, lag({ASKED_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, before, after, CASE WHEN after IS NULL THEN 'unknown state' WHEN before IS NULL THEN 'missing' WHEN before = after THEN 'noop' WHEN before || '>' || after IN ({MOVES_SQL}) THEN 'ok' ELSE 'illegal' END AS verdict FROM s""")
def state_transitions_valid(spark, sf_dir):
    """What each asked move is, seen from what was asked before it."""
    w = Window.partitionBy("target").orderBy("ts", "event_id")
    e = asking(spark, sf_dir).withColumns({"before": F.lag("asked").over(w), "after": F.col("asked")})
    return e.select(F.col("target").alias("user_id"), "event_id", "before", "after", L.verdict(F.col("before"), F.col("after")).alias("verdict"))


MESSAGE_SQL = ", ".join(f"'{a}>{b}'" for a, to in L.MESSAGE_MOVES.items() for b in to)


@query(f"""
WITH m AS (SELECT *, list_extract({list(L.MESSAGE_MOVES)!r}, CAST(o_orderkey % 7 + 1 AS INT)) AS before, list_extract({[*L.MESSAGE_MOVES, "lost"]!r}, CAST(o_custkey % 8 + 1 AS INT)) AS after FROM orders)
SELECT before, after, CASE WHEN after = 'lost' THEN 'unknown state' WHEN before = after THEN 'noop' WHEN before || '>' || after IN ({MESSAGE_SQL}) THEN 'ok' ELSE 'illegal' END AS verdict, count(*) AS n FROM m GROUP BY ALL""")
def message_moves(spark, sf_dir):
    """Moves of messages by what they are."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(pick(list(L.MESSAGE_MOVES), F.col("o_orderkey")).alias("before"), pick([*L.MESSAGE_MOVES, "lost"], F.col("o_custkey")).alias("after"))
    return o.withColumn("verdict", L.verdict(F.col("before"), F.col("after"), "message")).groupBy("before", "after", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT user_id, count(*) AS n, max(value) AS best, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought FROM events GROUP BY 1),
r AS (SELECT user_id, CASE WHEN best < 60 THEN 'tier' WHEN bought > 15 THEN 'already_enrolled' WHEN errors > 18 THEN 'suppressed' WHEN n % 7 = 0 THEN 'no_sendable_email' WHEN n % 5 = 0 THEN 'entity_gate' ELSE 'enrol' END AS reason FROM u)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def enrolment_exclusions(spark, sf_dir):
    """Why targets aren't enrolled, by the first rule that holds."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    reason = F.when(F.col("best") < 60, "tier").when(F.col("bought") > 15, "already_enrolled").when(F.col("errors") > 18, "suppressed").when(F.col("n") % 7 == 0, "no_sendable_email").when(F.col("n") % 5 == 0, "entity_gate").otherwise("enrol")
    return u.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id % 10, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click')
SELECT event_id, CASE WHEN value < 2 THEN 'hash' WHEN user_id % 13 = 0 THEN 'suppressed' WHEN k > 5 THEN 'daily_cap' ELSE 'send' END AS gate FROM s""")
def send_gates_daily_cap(spark, sf_dir):
    """The first gate that holds a message back; a mailbox sends five a day."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    k = F.row_number().over(Window.partitionBy(F.col("user_id") % 10, F.to_date("ts")).orderBy("ts", "event_id"))
    e = e.withColumn("k", k)
    return e.select("event_id", F.when(F.col("value") < 2, "hash").when(F.col("user_id") % 13 == 0, "suppressed").when(F.col("k") > 5, "daily_cap").otherwise("send").alias("gate"))


@query("""
WITH l AS (SELECT user_id % 5 AS identity, event_type FROM events WHERE event_type IN ('click', 'error') QUALIFY row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC) <= 100)
SELECT identity, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS bounces, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 0.03 * count(*) AS paused FROM l GROUP BY 1""")
def circuit_breaker_last100(spark, sf_dir):
    """Identities whose last hundred messages bounced too often."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error")).withColumn("identity", F.col("user_id") % 5)
    e = L.last_n(e, ["identity"], [F.desc("ts"), F.desc("event_id")], 100)
    bounces, n = F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))
    return e.groupBy("identity").agg(n.alias("n"), bounces.alias("bounces"), (bounces >= 0.03 * n).alias("paused"))


@query("""
WITH s AS (SELECT event_id, epoch_us(ts) AS s FROM events), w AS (SELECT event_id, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS k, s FROM s)
SELECT (s // 60000000 - k) * 60 AS start, count(*) AS n, count(*) <= 2 AS within FROM w GROUP BY 1""")
def rate_limit_sliding_window(spark, sf_dir):
    """Requests in each five minutes, sliding by one, against a limit."""
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes", "1 minute")
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "events").groupBy(w).agg(n.alias("n"), (n <= 2).alias("within")).select(F.unix_timestamp("window.start").alias("start"), "n", "within")


@query("""
WITH f AS (SELECT user_id, bool_or(event_type = 'signup') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase' AND value > 60) AS d FROM events GROUP BY 1)
SELECT 'enrolled' AS stage, count(*) FILTER (a) AS n FROM f UNION ALL SELECT 'drafted', count(*) FILTER (a AND b) FROM f UNION ALL SELECT 'sent', count(*) FILTER (a AND b AND c) FROM f UNION ALL SELECT 'replied', count(*) FILTER (a AND b AND c AND d) FROM f""")
def funnel_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    has = lambda k: F.bool_or(F.col("event_type") == k)
    f = e.groupBy("user_id").agg(has("signup").alias("a"), has("view").alias("b"), has("click").alias("c"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("d"))
    one = f.agg(F.count_if("a").alias("enrolled"), F.count_if(F.col("a") & F.col("b")).alias("drafted"), F.count_if(F.expr("a AND b AND c")).alias("sent"), F.count_if(F.expr("a AND b AND c AND d")).alias("replied"))
    return one.unpivot([], ["enrolled", "drafted", "sent", "replied"], "stage", "n")


@query("""
SELECT user_id, session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) AS gap FROM events) x) y GROUP BY 1, 2""")
def sessions(spark, sf_dir):
    """Runs of a user's events without a gap of over six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("gap", F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > 6 * 3600 * 1000000, F.lit(True)))
    e = e.withColumn("session", F.sum(F.col("gap").cast("int")).over(w))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("start"))


FOLD_SQL = f"""
WITH l AS (SELECT user_id, count(*) AS n, list({ASKED_SQL} ORDER BY ts, event_id) AS asked FROM events GROUP BY 1)
SELECT user_id, list_reduce(list_prepend('{L.FIRST}', asked), lambda s, a: CASE WHEN list_contains([{MOVES_SQL}], s || '>' || a) THEN a ELSE s END) AS state, n FROM l"""


@query(FOLD_SQL)
def lifecycle_fold(spark, sf_dir):
    """Every target's last state by the ordered fold, in batch."""
    return L.ordered_maps(asking(spark, sf_dir)).select(F.col("target").alias("user_id"), L.applied().alias("state"), "n")


@query(FOLD_SQL)
def stream_state_machine(spark, sf_dir):
    """The same from a stream in disorder, with timers and a store of what isn't final."""
    path = shared_path(spark, "events")
    delay, _ = S.staged(asking(spark, sf_dir), path, slices=5)
    A.with_rocks(spark)
    rows = S.run_to_table(A.advanced(S.read_events(spark, path, S.slice_files(spark)), delay), shared_path(spark, "states"), "append")
    return rows.groupBy(F.col("target").alias("user_id")).agg(F.max_by("state", "n").alias("state"), F.max("n").alias("n"))


@query("""
WITH o AS (SELECT o_custkey AS business, o_orderkey AS observation, o_orderdate AS ts, o_orderdate + to_days(CAST(o_orderkey % 400 AS INT)) AS deadline FROM orders)
SELECT business, observation, deadline FROM o WHERE observation % 5 <> 0 AND deadline < (SELECT max(ts) FROM o) + INTERVAL 1 DAY""")
def stream_observations_due(spark, sf_dir):
    """Observations as their deadlines come, until the end of what is known."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("business"), F.col("o_orderkey").alias("observation"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    o = o.withColumn("deadline", F.when(F.col("observation") % 5 != 0, F.timestamp_micros(F.unix_micros("ts") + F.col("observation") % 400 * 86_400_000_000)))
    path = shared_path(spark, "observations")
    delay, _ = S.staged(o, path, slices=4)
    A.with_rocks(spark)
    rows = S.run_to_table(A.due(S.read_events(spark, path, S.slice_files(spark)), delay), shared_path(spark, "due"), "append")
    return rows.withColumn("deadline", F.col("deadline").cast("timestamp_ntz"))


@query("""
SELECT substr(sha1(event_type || '|' || user_id || '|' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')), 1, 20) AS dedupe_key, user_id, event_type FROM events GROUP BY ALL""")
def stream_event_dedupe(spark, sf_dir):
    """A stream of events, the first of each key."""
    path = shared_path(spark, "events")
    delay, _ = S.staged(table(spark, sf_dir, "events"), path)
    found = S.deduplicated(S.read_events(spark, path, S.slice_files(spark)).filter("event_id IS NOT NULL"), delay).select("dedupe_key", "user_id", "event_type")
    return S.run_to_table(found, shared_path(spark, "dedupe"), "append")


@query("""
WITH s AS (SELECT event_type, epoch_us(ts) // 1800000000 AS h FROM events), w AS (SELECT event_type, h - CAST(unnest([0, 1]) AS BIGINT) AS h FROM s)
SELECT h * 1800 AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_windowed_counts(spark, sf_dir):
    """Events of each hour, sliding by half an hour, from a stream in update mode."""
    path = shared_path(spark, "events")
    delay, _ = S.staged(table(spark, sf_dir, "events"), path)
    found = S.windowed(S.read_events(spark, path, S.slice_files(spark)), delay=delay).filter("event_type IS NOT NULL")
    rows = S.run_to_table(found, shared_path(spark, "windows"), "update", ["start", "event_type"])
    return rows.select(F.unix_timestamp("start").alias("start"), "event_type", "n")
