"""Names that resemble each other, and the lookup of listings in a register of companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar as M
from .base import businesses, query, table, with_businesses

LEGAL_SQL = ", ".join(f"'{t}'" for t in M.LEGAL_TOKENS)


def key_sql(name: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split_regex(replace(lower({name}), 'ß', 'ss'), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({LEGAL_SQL})))), ' ')"


#: The longest block that x and y have in common (the first in x, then in y), and how much is in common over all blocks beside it, for rows of pairs (a, b).
BLOCK_SQL = """list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(y) + 1),
  lambda j: {'k': len(list_filter(range(1, least(len(x) - i, len(y) - j) + 2), lambda k: substr(x, i, k) = substr(y, j, k))), 'i': -i, 'j': -j}))))"""
RATIO_SQL = f"""
seg(a, b, x, y, m) AS (SELECT a, b, x, y, {BLOCK_SQL} AS m FROM (SELECT a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM pairs) p
  UNION ALL SELECT a, b, x, y, {BLOCK_SQL} FROM (SELECT a, b, unnest([substr(x, 1, CAST(-m.i - 1 AS BIGINT)), substr(x, CAST(m.k - m.i AS BIGINT))]) AS x, unnest([substr(y, 1, CAST(-m.j - 1 AS BIGINT)), substr(y, CAST(m.k - m.j AS BIGINT))]) AS y FROM seg WHERE m.k > 0) s
  WHERE x <> '' AND y <> ''),
ratio AS (SELECT a, b, 2.0 * sum(coalesce(m.k, 0)) / (len(replace(any_value(a), ' ', '')) + len(replace(any_value(b), ' ', ''))) AS r FROM seg GROUP BY a, b),
alike AS (SELECT a, b, round_even(greatest(r, CAST(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) AS DOUBLE) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))), 3) AS similarity FROM ratio)"""


def _part_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", M.name_key(F.col("p_name")).alias("key"))
    return p.groupBy("p_brand", "key").agg(F.count(F.lit(1)).alias("n"))


def _in_brands(spark, sf_dir, threshold: float, ratio: bool):
    """Pairs of different names of one brand, each with the parts that bear it."""
    names = _part_names(spark, sf_dir)
    keys = names.select("p_brand", "key")
    found = M.similar_keys(keys, keys, threshold, ["p_brand"], ratio).filter("a < b")
    n = lambda name: names.select("p_brand", F.col("key").alias(name), F.col("n").alias(f"parts_{name}"))
    return found.join(n("a"), ["p_brand", "a"]).join(n("b"), ["p_brand", "b"]).select("p_brand", "a", "b", "parts_a", "parts_b", "similarity")


@query(f"""
WITH n AS (SELECT p_brand, {key_sql('p_name')} AS key, count(*) AS n FROM part GROUP BY 1, 2)
SELECT x.p_brand, x.key AS a, y.key AS b, x.n AS parts_a, y.n AS parts_b, round_even(CAST(len(list_intersect(string_split(x.key, ' '), string_split(y.key, ' '))) AS DOUBLE) / len(list_distinct(list_concat(string_split(x.key, ' '), string_split(y.key, ' ')))), 3) AS similarity
FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.key < y.key WHERE x.key <> '' AND y.key <> '' AND similarity >= 0.3""")
def token_jaccard(spark, sf_dir):
    """Names of one brand that share three tenths of their words or more."""
    return _in_brands(spark, sf_dir, 0.3, ratio=False)


@query(f"""
WITH RECURSIVE n AS (SELECT p_brand, {key_sql('p_name')} AS key, count(*) AS n FROM part GROUP BY 1, 2),
twin AS (SELECT x.p_brand, x.key AS a, y.key AS b, x.n AS parts_a, y.n AS parts_b FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.key < y.key WHERE x.key <> ''),
pairs AS (SELECT DISTINCT a, b FROM twin), {RATIO_SQL}
SELECT p_brand, a, b, parts_a, parts_b, similarity FROM twin JOIN alike USING (a, b) WHERE similarity >= 0.6""")
def name_similarity(spark, sf_dir):
    """Names of one brand that are as similar as 0.6, by words or by matching blocks of characters."""
    return _in_brands(spark, sf_dir, 0.6, ratio=True)


def _companies(spark, sf_dir):
    """Register rows with an address and a status."""
    b = businesses(spark, sf_dir).filter("source = 'register'")
    status = F.when(F.col("reviews") % 5 == 0, "Dissolved").when(F.col("reviews") % 7 == 0, "").otherwise("Active")
    return b.select(F.col("id").alias("number"), "name", F.concat_ws(", ", F.lit("Unit 4"), F.initcap("city"), "postal").alias("address"), status.alias("status"))


LOOKUP_SQL = f"""
l AS (SELECT id, {key_sql('name')} AS key, lower(city) AS city, lower(postal) AS postal FROM businesses WHERE source = 'maps'),
c AS (SELECT id AS number, name AS legal_name, {key_sql('name')} AS key, lower('Unit 4, ' || city || ', ' || postal) AS hay FROM businesses WHERE source = 'register' AND reviews % 5 <> 0 AND reviews % 7 <> 0),
near AS (SELECT l.id, number, legal_name, l.key AS a, c.key AS b FROM l JOIN c ON (contains(hay, city) OR contains(hay, postal)) AND l.key <> '' AND c.key <> ''),
pairs AS (SELECT DISTINCT a, b FROM near), {RATIO_SQL},
hit AS (SELECT id, number, legal_name, similarity FROM near JOIN alike USING (a, b) WHERE similarity >= 0.45)"""


@query("WITH RECURSIVE" + with_businesses(f""", {LOOKUP_SQL}
SELECT id, number, legal_name, similarity FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, number) = 1""").strip()[4:])
def registry_lookup(spark, sf_dir):
    """The active company of the register that each listing is, by place and name."""
    listings = businesses(spark, sf_dir).filter("source = 'maps'").select("id", "name", "city", "postal")
    return M.registry_lookup(listings, _companies(spark, sf_dir)).drop("candidates")


@query("WITH RECURSIVE" + with_businesses(f""", {LOOKUP_SQL},
one AS (SELECT id, number FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, number) = 1),
p AS (SELECT 's' || o_custkey % (SELECT count(*) FROM supplier) AS number, o_orderpriority AS priority, CASE WHEN count(*) % 3 = 0 THEN 1 END AS gone, min(o_custkey) AS who FROM orders GROUP BY 1, 2)
SELECT id, number, 'Ada Number' || who AS person, 'Director Of ' || substr(priority, 3, 1) || lower(substr(regexp_extract(priority, '[A-Z]+'), 2)) AS role FROM one JOIN p USING (number) WHERE gone IS NULL""").strip()[4:])
def registry_officers(spark, sf_dir):
    """Those in office at the companies found, with their names in natural order."""
    one = registry_lookup(spark, sf_dir).select("id", "number")
    n = table(spark, sf_dir, "supplier").count()
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("s"), F.col("o_custkey") % n).alias("number"), "o_orderpriority").agg(F.when(F.count(F.lit(1)) % 3 == 0, 1).alias("left"), F.min("o_custkey").alias("who"))
    people = o.select("number", F.concat(F.lit("NUMBER"), "who", F.lit(", Ada")).alias("name"), F.concat(F.lit("director-of_"), F.lower(F.regexp_extract("o_orderpriority", "[A-Z]+", 0))).alias("role"), "left")
    return M.officers(one, people)
