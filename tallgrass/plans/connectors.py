"""Sources and sinks beside tables: planned queries, letters as files, event files as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import lists as N
from ..sources import search as Q
from ..sources import spool as P
from ..sources.scratch import shared_path
from ..streaming import events as S
from .base import ORACLES, query, table
from .profiles import letter_files

_TEXT_SQL = "CASE c_custkey % 5 WHEN 0 THEN 'sic:' || c_custkey || ',,' || c_nationkey || '  loc: ' || n_name || ' ' WHEN 1 THEN ' sic:62012 loc:' || c_mktsegment WHEN 2 THEN 'sic: loc:x' WHEN 3 THEN 'plumber in ' || n_name ELSE 'sic:,, loc:' || n_name END"


@query(rf"""
WITH t AS (SELECT c_custkey, trim({_TEXT_SQL}) AS x FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, array_to_string(list_filter(string_split(regexp_extract(x, '^sic:([\d,]+)\s+loc:(.+)$', 1), ','), lambda c: c <> ''), '+') AS codes, trim(regexp_extract(x, '^sic:([\d,]+)\s+loc:(.+)$', 2)) AS place FROM t WHERE regexp_matches(x, '^sic:([\d,]+)\s+loc:(.+)$')""")
def planned_queries(spark, sf_dir):
    """Codes and place of planned queries; texts of another shape go."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(n, "c_nationkey").select("c_custkey", F.expr(_TEXT_SQL).alias("x"))
    return rows.select("c_custkey", Q.parsed_query(F.col("x")).alias("q")).filter("q IS NOT NULL").select("c_custkey", F.array_join("q.codes", "+").alias("codes"), "q.place")


@query(f"SELECT substr(sha1(draft), 1, 20) || '.txt' AS name, draft FROM ({ORACLES['letter_files']}) l GROUP BY draft")
def letter_sink(spark, sf_dir):
    """Drafts as files of a folder, read again."""
    folder = shared_path(spark, "letters")
    P.write_letters(letter_files(spark, sf_dir).select(F.col("draft").alias("content")), folder)
    found = spark.read.format("binaryFile").load(folder)
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.decode("content", "utf-8").alias("draft"))


@query("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS addresses FROM events GROUP BY 1")
def stream_event_spool(spark, sf_dir):
    """Events that come as files of JSON, as a stream by the names of the files."""
    folder = shared_path(spark, "spool")
    e = table(spark, sf_dir, "events")
    e.select(F.col("event_type").alias("kind"), F.concat("user_id", F.lit("@x.com")).alias("email"), F.col("ts").cast("string").alias("occurred_at"), F.lit("").alias("body"), F.lit(1).alias("other")).write.json(folder)
    rows = S.run_to_table(P.read_spool(spark, folder, stream=True), shared_path(spark, "spooled"), "append")
    return rows.filter("problem IS NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("email").alias("addresses"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Firm "' || c_custkey || '", Ltd; x' ELSE c_name END AS company, CASE WHEN c_custkey % 4 <> 3 THEN '+1 555 ' || c_custkey END AS phone, CASE WHEN c_custkey // 100 % 2 = 0 THEN c_mktsegment END AS segment FROM customer""")
def lists_sniffed(spark, sf_dir):
    """Lists of a hundred customers, with commas, tabs or semicolons, headers of several names and lines before them, read by what each file shows."""
    k = F.col("c_custkey")
    batch = F.floor(k / 100)
    sep = F.when(batch % 3 == 0, ",").when(batch % 3 == 1, "\t").otherwise(";")
    company = F.when(k % 5 == 0, F.concat(F.lit('"Firm ""'), k, F.lit('"", Ltd; x"'))).otherwise(F.col("c_name"))
    phone, even = F.when(k % 4 != 3, F.concat(F.lit("+1 555 "), k)).otherwise(" "), batch % 2 == 0
    parted = lambda *cs: F.concat(*[x for c in cs for x in (sep, c)][1:])
    line = F.when(even, parted(company, k.cast("string"), phone, F.col("c_mktsegment"))).otherwise(parted(k.cast("string"), phone, company))
    head = F.when(even, parted(*map(F.lit, ("Company", "Customer Key", "Primary Phone", "Segment")))).otherwise(parted(*map(F.lit, ("customer key", "PHONE", " company "))))
    rows = table(spark, sf_dir, "customer").select(batch.alias("batch"), k.alias("k"), line.alias("line"), F.when(even, head).otherwise(F.concat(F.lit("Our customers\n\n"), head)).alias("head"))
    files = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("ls"), F.first("head").alias("head"))  # a hundred lines
    folder = shared_path(spark, "lists")
    P.write_letters(files.select(F.concat(F.lit("list"), "batch").alias("name"), F.concat("head", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("content")), folder, "csv")
    f = lambda name: F.col("fields")[name].alias(name)
    return N.read_lists(spark, folder).select(F.col("fields")["customer_key"].cast("long").alias("c_custkey"), f("company"), f("phone"), f("segment"))
