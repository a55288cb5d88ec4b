"""Registry of queries, and the roles that the given tables play.

Customers stand for map listings, suppliers for register rows; names, sites,
phones and the like follow from their keys, so that both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, source, name, category, domain, phone, place_id, city, rating, reviews, postal."""
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), (F.col("c_custkey") + 1_000_000).alias("seq"), F.lit("maps").alias("source"), F.col("c_custkey").alias("k"),
        F.col("c_mktsegment").alias("category"), F.concat(F.lit("pid"), "c_custkey").alias("place_id"), F.col("c_nationkey").alias("nk"), F.col("c_acctbal").alias("bal"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("seq"), F.lit("register").alias("source"), F.col("s_suppkey").alias("k"),
        F.lit("REGISTER").alias("category"), F.lit(None).cast("string").alias("place_id"), F.col("s_nationkey").alias("nk"), F.col("s_acctbal").alias("bal"),
    )
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("city"))
    k = F.col("k")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (" Ltd", " LLC", " Group", "", " Inc.")]), (k % 5 + 1).cast("int"))
    return c.unionByName(s).join(F.broadcast(n), "nk", "left").select(  # nations are a fixed table of 25 rows
        "id", "seq", "source", F.concat(F.lit("Firm "), (k % 400).cast("string"), suffix).alias("name"), "category",
        F.when(k % 4 != 3, F.concat(F.lit("site"), (k % 300).cast("string"), F.lit(".example.com"))).alias("domain"),
        F.when(k % 7 != 6, F.concat(F.lit("+1713555"), F.lpad((k % 500).cast("string"), 4, "0"))).alias("phone"),
        "place_id", "city", F.when(k % 6 != 5, F.round(F.abs(F.col("bal")) % 50 / 10, 1)).alias("rating"), (k * 7 % 200).alias("reviews"),
        F.concat(F.lit("AB"), (k % 9 + 1).cast("string"), F.lit(" "), (k % 8).cast("string"), F.lit("CD")).alias("postal"),
    )


BUSINESSES = """
businesses AS (
  SELECT id, seq, source, 'Firm ' || (k % 400) || [' Ltd', ' LLC', ' Group', '', ' Inc.'][CAST(k % 5 + 1 AS INT)] AS name, category,
    CASE WHEN k % 4 <> 3 THEN 'site' || (k % 300) || '.example.com' END AS domain,
    CASE WHEN k % 7 <> 6 THEN '+1713555' || lpad(CAST(k % 500 AS VARCHAR), 4, '0') END AS phone,
    place_id, n_name AS city, CASE WHEN k % 6 <> 5 THEN round(abs(bal) % 50 / 10, 1) END AS rating, k * 7 % 200 AS reviews,
    'AB' || (k % 9 + 1) || ' ' || (k % 8) || 'CD' AS postal
  FROM (SELECT 'c' || c_custkey AS id, c_custkey + 1000000 AS seq, 'maps' AS source, c_custkey AS k, c_mktsegment AS category, 'pid' || c_custkey AS place_id, c_nationkey AS nk, c_acctbal AS bal FROM customer
        UNION ALL SELECT 's' || s_suppkey, s_suppkey, 'register', s_suppkey, 'REGISTER', NULL, s_nationkey, s_acctbal FROM supplier) b
  LEFT JOIN nation ON n_nationkey = nk)"""


def with_businesses(sql: str) -> str:
    return f"WITH {BUSINESSES.strip()}{sql}"
