"""Phone numbers by numbering plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phones as P
from .base import query, table

REGIONS = list(P.PLANS)


def _found_sql(region: str, x: str) -> str:
    plan = P.PLANS[region]
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match({x}, '{p}') THEN '{region}|+{plan.code}' || {x} || '|{k}' END" for k, p in plan.kinds.items()) + ")"


def _without_sql(prefix: str, x: str) -> str:
    return f"CASE WHEN starts_with({x}, '{prefix}') THEN substr({x}, {len(prefix) + 1}) END" if prefix else x


def _home_sql(region: str, d: str) -> str:
    plan = P.PLANS[region]
    tries = ([_without_sql(plan.trunk, d)] if plan.trunk else []) + [d, _without_sql(plan.code, d)] + ([_without_sql(plan.code + plan.trunk, d)] if plan.trunk else [])
    return "coalesce(" + ", ".join(_found_sql(r, f"({t})") for t in tries for r in (("CA", "US") if region in ("US", "CA") else (region,))) + ")"


def _abroad_sql(d: str) -> str:
    found = []
    for region in sorted(P.PLANS, key=lambda r: (r != "CA", r)):
        plan = P.PLANS[region]
        rest = f"substr({d}, {len(plan.code) + 1})"
        tries = [rest] + ([_without_sql(plan.trunk, rest)] if plan.trunk else []) + ([_without_sql("1", rest)] if region == "MX" else [])
        found += [f"CASE WHEN starts_with({d}, '{plan.code}') THEN {_found_sql(region, f'({t})')} END" for t in tries]
    planned = "|".join(sorted({p.code for p in P.PLANS.values()}))
    other = f"CASE WHEN regexp_matches({d}, '^({P.CODES})') AND NOT regexp_full_match(regexp_extract({d}, '^({P.CODES})', 1), '{planned}') AND length({d}) BETWEEN 8 AND 15 THEN '|+' || {d} || '|unknown' END"
    return f"coalesce({', '.join(found)}, {other})"


def parsed_sql(region: str, d: str) -> str:
    """'region|e164|kind' of digits with their plus, if they have one; region: a column."""
    home = "CASE " + " ".join(f"WHEN {region} = '{r}' THEN {_home_sql(r, d)}" for r in REGIONS) + " END"
    idd = f"CASE WHEN {region} IN ('US', 'CA') THEN {_without_sql('011', d)} WHEN {region} = 'AU' THEN {_without_sql('0011', d)} ELSE {_without_sql('00', d)} END"
    return f"coalesce(CASE WHEN NOT starts_with({d}, '+') THEN {home} END, {_abroad_sql(f'(CASE WHEN starts_with({d}, chr(43)) THEN substr({d}, 2) ELSE {idd} END)')})"


#: Numbers as they are written: digits that follow from an order's price and key, in five ways.
DIGITS = "lpad(CAST((o_orderkey * 7919 + CAST(round(o_totalprice * 100) AS BIGINT)) * 1000003 % 100000000000 AS VARCHAR), 11, '7')"
WRITTEN_SQL = f"""
r AS (SELECT o_orderkey AS k, o_custkey, list_extract({REGIONS!r}, CAST(o_orderkey % {len(REGIONS)} + 1 AS INT)) AS region, substr({DIGITS}, 1, CAST(8 + o_custkey % 4 AS INT)) AS n FROM orders),
w AS (SELECT k, region, CASE k % 5 WHEN 0 THEN n WHEN 1 THEN '0' || n WHEN 2 THEN '+' || list_extract({[P.PLANS[r].code for r in REGIONS]!r}, CAST(k % {len(REGIONS)} + 1 AS INT)) || n
  WHEN 3 THEN '00' || list_extract({[P.PLANS[r].code for r in REGIONS]!r}, CAST(o_custkey % {len(REGIONS)} + 1 AS INT)) || n ELSE '+' || n END AS d FROM r)"""


def written(spark, sf_dir):
    """k, region, raw: the digits with marks between them, an extension and the like."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    digits = F.lpad(((k * 7919 + F.round(F.col("o_totalprice") * 100).cast("long")) * 1000003 % 100000000000).cast("string"), 11, "7")
    n = F.substr(digits, F.lit(1), (8 + c % 4).cast("int"))
    codes = [P.PLANS[r].code for r in REGIONS]
    marked = F.concat(F.substring(n, 1, 3), F.lit(" "), F.substring(n, 4, 3), F.lit("-"), F.substring(n, 7, 20))
    raw = (
        F.when(k % 5 == 0, F.concat(marked, F.lit(" ext. 12"))).when(k % 5 == 1, F.concat(F.lit("(0"), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 20)))
        .when(k % 5 == 2, F.concat(F.lit("+"), pick(codes, k), F.lit(" (0)"), marked)).when(k % 5 == 3, F.concat(F.lit("tel:00"), pick(codes, c), marked)).otherwise(F.concat(F.lit("+"), marked))
    )
    return table(spark, sf_dir, "orders").select(k.alias("k"), pick(REGIONS, k).alias("region"), raw.alias("raw"))


@query(f"""
WITH {WRITTEN_SQL}, p AS (SELECT k, {parsed_sql('region', 'd')} AS x FROM w)
SELECT k, nullif(split_part(x, '|', 1), '') AS region, split_part(x, '|', 2) AS e164, split_part(x, '|', 3) AS kind FROM p WHERE x IS NOT NULL""")
def phone_plan(spark, sf_dir):
    """Numbers that can be dialled, as written in seventeen countries: where, how and of what kind."""
    rows = written(spark, sf_dir).select("k", P.parsed(F.col("raw"), F.col("region")).alias("x")).filter("x IS NOT NULL")
    return rows.select("k", "x.region", "x.e164", "x.kind")


@query(f"""
WITH {WRITTEN_SQL}, s AS (SELECT k, CASE WHEN starts_with(d, '+') THEN d ELSE '+' || d END AS stored FROM w), p AS (SELECT k, stored, {parsed_sql("''", 'stored')} AS x FROM s)
SELECT k, coalesce(split_part(x, '|', 2) = stored, FALSE) AS valid, CASE WHEN x IS NULL THEN 'unknown' ELSE split_part(x, '|', 3) END AS kind FROM p""")
def phone_validated(spark, sf_dir):
    """Whether stored numbers can be dialled, and their kinds."""
    stored = P.digits(F.col("raw"))
    rows = written(spark, sf_dir).select("k", F.when(stored.startswith("+"), stored).otherwise(F.concat(F.lit("+"), stored)).alias("stored"))
    return rows.select("k", P.is_valid(F.col("stored")).alias("valid"), P.kind(F.col("stored")).alias("kind"))


LANGS = {"en": "GB", "de": "DE", "fr": "FR", "es": "ES"}
_DIGITS_SQL = "(CASE WHEN regexp_matches(x, '^[(]*[+]') THEN '+' ELSE '' END) || regexp_replace(x, '[^0-9]', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, CASE lang {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in LANGS.items())} END AS region, unnest(regexp_extract_all(text, '{P.IN_TEXT}')) AS run FROM documents WHERE lang IN {tuple(LANGS)}),
t AS (SELECT doc_id, region, run, regexp_replace(run, '^([(]?[+][0-9 ().-]*?)[(]0[)]', '\\1') AS x FROM d),
w AS (SELECT doc_id, region, run, {parsed_sql('region', '(' + _DIGITS_SQL + ')')} AS p FROM t),
s AS (SELECT doc_id, region, unnest(string_split_regex(run, '{P.PARTED}')) AS x FROM w WHERE p IS NULL),
b AS (SELECT doc_id, {parsed_sql('region', '(' + _DIGITS_SQL + ')')} AS p FROM s)
SELECT DISTINCT doc_id, split_part(p, '|', 2) AS phone FROM (SELECT doc_id, p FROM w UNION ALL SELECT doc_id, p FROM b) u WHERE p IS NOT NULL""")
def document_phones(spark, sf_dir):
    """Numbers that documents show, read by the plan of their language's country."""
    d = table(spark, sf_dir, "documents")
    found = F.coalesce(*[F.when(F.col("lang") == lang, P.in_text(F.lit(""), F.col("text"), region)) for lang, region in LANGS.items()])
    return d.select("doc_id", F.explode(found).alias("phone"))
