"""Campaigns of searches, and sites of companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sites as S
from ..functions import text as T
from ..operators import domains as N
from ..operators import subdivide as B
from .base import query, table

BOX, GRID, FULL, DEEPEST = (900.0, 1.0, 2100.0, 51.0), (3, 2), 30, 3
_CELL = "CAST(greatest(0, least({n} - 1, floor((v - {lo}) / ({hi} - {lo}) * {n}))) AS BIGINT)"


def _rounds_sql() -> str:
    """The rounds written out one after another."""
    x0, y0, x1, y1 = BOX
    at = lambda d: f"SELECT id, text, {_CELL.format(n=GRID[0] << d, lo=x0, hi=x1).replace('v', 'x', 1)} AS ix, {_CELL.format(n=GRID[1] << d, lo=y0, hi=y1).replace('v', 'y', 1)} AS iy FROM places"
    sql = f"""WITH places AS (SELECT p_partkey AS id, p_brand AS text, CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part UNION ALL SELECT p_partkey, p_type, p_retailprice, p_size FROM part),
t AS (SELECT DISTINCT text FROM places), f0 AS (SELECT text, 0 AS depth, CAST(i % {GRID[0]} AS BIGINT) AS ix, CAST(i // {GRID[0]} AS BIGINT) AS iy, (dense_rank() OVER (ORDER BY text) - 1) * {GRID[0] * GRID[1]} + i AS place FROM t, range({GRID[0] * GRID[1]}) r(i))"""
    for d in range(DEEPEST + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM n{k}" for k in range(d)) or "SELECT NULL AS id WHERE FALSE"
        sql += f""",
h{d} AS (SELECT id, place FROM f{d} JOIN ({at(d)}) a USING (text, ix, iy)), n{d} AS (SELECT id, min(place) AS place FROM h{d} WHERE id NOT IN ({seen}) GROUP BY id),
r{d} AS (SELECT f{d}.*, coalesce(h.n, 0) AS results, coalesce(n.n, 0) AS new, coalesce(h.n, 0) >= {FULL} AND coalesce(n.n, 0) >= 5 AND {d} < {DEEPEST} AS split FROM f{d} LEFT JOIN (SELECT place, count(*) AS n FROM h{d} GROUP BY 1) h USING (place) LEFT JOIN (SELECT place, count(*) AS n FROM n{d} GROUP BY 1) n USING (place)),
f{d + 1} AS (SELECT text, depth + 1 AS depth, 2 * ix + q % 2 AS ix, 2 * iy + q // 2 AS iy, 4 * place + q AS place FROM r{d}, range(4) s(q) WHERE split)"""
    return sql + " " + " UNION ALL ".join(f"SELECT text, depth, ix, iy, results, new, split FROM r{d}" for d in range(DEEPEST + 1))


@query(_rounds_sql())
def campaign_subdivision(spark, sf_dir):
    """Searches by brand and by type over a grid of prices and sizes, split where they are full of parts nobody found before."""
    p = table(spark, sf_dir, "part")
    place = lambda text: p.select(F.col("p_partkey").alias("id"), F.col(text).alias("text"), F.col("p_retailprice").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    places = place("p_brand").unionByName(place("p_type"))
    tiles = GRID[0] * GRID[1]
    # A few dozen texts: their ranks are places in one sorted array.
    texts = places.agg(F.array_sort(F.collect_set("text")).alias("ts")).select(F.posexplode("ts").alias("rank", "text"))
    planned = texts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("text", (F.col("i") % GRID[0]).alias("ix"), F.floor(F.col("i") / GRID[0]).alias("iy"), (F.col("rank") * tiles + F.col("i")).alias("place"))
    return B.subdivided(planned, places, BOX, GRID, FULL, 5, DEEPEST).drop("place")


ENDINGS = (".example.org", ".example.net", ".example.com")
_LEGAL_SQL = ", ".join(f"'{w}'" for w in N.LEGAL)
HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^(www|m|blog|shop)\.', '')"
COMPANIES_SQL = f"""
p AS (SELECT page_id, html, {HOST_SQL} AS domain FROM pages),
one AS (SELECT split_part(domain, '.', 1) AS label, min(page_id) AS k FROM p GROUP BY 1),
c AS (SELECT k AS id, CASE k % 3 WHEN 0 THEN 'The ' || label || ' Company Ltd' WHEN 1 THEN label || ' LIMITED' ELSE label || ' & Sons' END AS name, CASE WHEN k % 2 = 0 THEN regexp_extract(html, '<h1>([^<]{{4,8}})', 1) END AS postal, CASE WHEN k % 5 = 0 THEN 'DOCTYPE' ELSE '00' || k END AS number FROM one JOIN p ON page_id = k)"""


def _companies(spark, sf_dir):
    """A company for each first label of a host, with marks that its earliest page may show."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_replace(T.host(F.col("url")), r"^(www|m|blog|shop)\.", "").alias("domain"))
    one = p.groupBy(F.substring_index("domain", ".", 1).alias("label")).agg(F.min("page_id").alias("page_id"))
    k, label = F.col("page_id"), F.col("label")
    name = F.when(k % 3 == 0, F.concat(F.lit("The "), label, F.lit(" Company Ltd"))).when(k % 3 == 1, F.concat(label, F.lit(" LIMITED"))).otherwise(F.concat(label, F.lit(" & Sons")))
    postal = F.when(k % 2 == 0, F.regexp_extract("html", "<h1>([^<]{4,8})", 1))
    companies = one.join(p.select("page_id", "html"), "page_id").select(k.alias("id"), name.alias("name"), postal.alias("postal"), F.when(k % 5 == 0, "DOCTYPE").otherwise(F.concat(F.lit("00"), k)).alias("number"))
    return companies, p


@query(f"""
WITH {COMPANIES_SQL.strip()},
w AS (SELECT *, list_filter(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN ({_LEGAL_SQL})) AS ws FROM c),
s AS (SELECT *, list_distinct([array_to_string(ws, ''), array_to_string(ws, '-'), array_to_string(ws[1:2], '')]) AS u FROM w),
o AS (SELECT id, postal, number, ws, CASE WHEN len(ws) = 0 THEN [] ELSE list_filter([array_to_string(ws, ''), CASE WHEN len(ws) > 1 THEN array_to_string(ws, '-') END, CASE WHEN len(ws) > 2 THEN array_to_string(ws[1:2], '') END], lambda x: x IS NOT NULL) END AS slugs FROM s),
e AS (SELECT id, postal, number, ws, 3 * len(slugs) AS n, unnest(range(0, 3 * len(slugs))) AS i, slugs FROM o), d AS (SELECT id, postal, number, ws, n, i, slugs[i // 3 + 1] || list_extract({list(ENDINGS)!r}, i % 3 + 1) AS domain FROM e),
root AS (SELECT domain, arg_min(html, page_id) AS html FROM p GROUP BY 1),
m AS (SELECT d.*, CASE WHEN coalesce(trim(postal), '') <> '' AND contains(replace(lower(' ' || html), ' ', ''), replace(lower(trim(postal)), ' ', '')) THEN trim(postal) WHEN contains(lower(html), array_to_string(ws, ' ')) THEN array_to_string(ws, ' ') WHEN contains(lower(html), lower(number)) THEN number END AS matched_on FROM d JOIN root USING (domain)),
b AS (SELECT id, min(i) AS i FROM m WHERE matched_on IS NOT NULL GROUP BY 1)
SELECT o.id, m.domain, m.matched_on, CAST(coalesce(b.i + 1, 3 * len(slugs)) AS INT) AS tried FROM o LEFT JOIN b USING (id) LEFT JOIN m ON m.id = b.id AND m.i = b.i""")
def domains_resolved(spark, sf_dir):
    """The sites of companies, guessed from their names and borne out by the pages themselves."""
    companies, p = _companies(spark, sf_dir)
    return N.resolved(companies, p.select("domain", "html", F.lit("").alias("text"), F.col("page_id").alias("place")), ENDINGS)


@query("""
SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0""")
def unresolved_companies(spark, sf_dir):
    """Companies of the register without a domain that nobody tried to find."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.lit("register").alias("source"), F.when(k % 3 != 0, "x.com").alias("domain"), F.when(k % 5 == 0, True).alias("tried"), F.col("s_name").alias("name"))
    return N.unresolved(rows).select("s_suppkey")
