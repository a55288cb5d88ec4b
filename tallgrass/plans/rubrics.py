"""Scores by profiles that are data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as R
from ..operators import rubric as B
from .base import businesses, query, with_businesses

CAMPAIGN = {
    "categories": ["Machinery", "auto parts"], "aliases": {"cars": {"exact": ["automobile", "auto parts"], "adjacent": ["building"]}, "homes": {"exact": ["household"], "adjacent": []}}, "min_reviews": 20, "max_reviews": 150,
    "areas": ["Nation_1, Somewhere", "NATION_7"], "country": "United Kingdom", "hard": ["no_phone", "competitor:Firm 13", "existing_client:firm 21"], "soft": ["website_missing", "few_reviews", "low_rating_high_volume", "hiring"],
    "offer": "answering", "weights_override": {"size_match": 15, "nothing": 3},
}

PROFILE_SQL = with_businesses("""
, d AS (SELECT domain FROM businesses WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1), ph AS (SELECT phone FROM businesses WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
b AS (SELECT b.*, d.domain IS NOT NULL OR ph.phone IS NOT NULL AS chained, list_extract(['GB', 'uk', 'France', NULL], CAST(reviews % 4 + 1 AS INT)) AS country FROM businesses b LEFT JOIN d ON d.domain = b.domain LEFT JOIN ph ON ph.phone = b.phone),
n AS (SELECT *, list_filter([CASE WHEN domain IS NULL THEN 'website_missing' END, CASE WHEN rating <> 0 AND rating <= 3.9 AND reviews >= 50 THEN 'low_rating_high_volume' END, CASE WHEN reviews < 10 THEN 'few_reviews' END, CASE WHEN reviews % 3 = 0 AND reviews % 2 = 0 THEN 'hiring' END], lambda x: x IS NOT NULL) AS hits FROM b),
f AS (SELECT *, CASE WHEN lower(category) IN ('machinery', 'auto parts', 'automobile') THEN 1.0 WHEN lower(category) = 'building' THEN 0.6 ELSE 0.1 END AS f1, CASE WHEN len(hits) > 0 THEN least(1.0, 0.4 + 0.3 * len(hits)) ELSE 0.2 END AS f2,
  CASE WHEN reviews < 20 THEN 0.2 WHEN reviews > 150 THEN 0.3 ELSE 1.0 END AS f3, CASE WHEN contains(lower(city || ' ' || postal), 'nation_1') OR contains(lower(city || ' ' || postal), 'nation_7') THEN 1.0 ELSE 0.3 END AS f4,
  CASE WHEN regexp_matches(name, '(?i)\\b(franchise|group|inc|corporation)\\b') THEN 0.3 ELSE 0.8 END AS f5, least(1.0, 0.3 + CASE WHEN source = 'register' THEN 0.4 ELSE 0 END + CASE WHEN reviews % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN place_id IS NOT NULL THEN 0.1 ELSE 0 END) AS f6,
  list_filter([CASE WHEN regexp_matches(name, '(?i)\\b(franchise|group)\\b') THEN 'franchise_or_chain' END, CASE WHEN country = 'France' THEN 'out_of_area' END, CASE WHEN chained THEN 'chain_member' END], lambda x: x IS NOT NULL) AS negs FROM n),
s AS (SELECT *, CASE WHEN phone IS NULL THEN 'no_phone' WHEN regexp_matches(name, '(?i)\\bfirm 13\\b') THEN 'competitor:Firm 13' WHEN regexp_matches(name, '(?i)\\bfirm 21\\b') THEN 'existing_client:firm 21' END AS disqualified,
  greatest(-40, CASE WHEN list_contains(negs, 'franchise_or_chain') THEN -25 ELSE 0 END + CASE WHEN list_contains(negs, 'out_of_area') THEN -20 ELSE 0 END + CASE WHEN list_contains(negs, 'chain_member') THEN -15 ELSE 0 END) AS against FROM f),
t AS (SELECT *, round_even(greatest(0.0, least(100.0, round_even(f1::DOUBLE * 25, 2) + round_even(f2::DOUBLE * 25, 2) + round_even(f3::DOUBLE * 15, 2) + round_even(f4::DOUBLE * 10, 2) + round_even(f5::DOUBLE * 10, 2) + round_even(f6::DOUBLE * 20, 2) + against))::DOUBLE, 1) AS total FROM s)
SELECT id, total, CASE WHEN disqualified IS NOT NULL THEN 'DQ' WHEN total >= 80 THEN 'A' WHEN total >= 60 THEN 'B' ELSE 'C' END AS tier, disqualified, array_to_string(negs, ',') AS negatives, len(hits)::INTEGER AS hooks,
  CASE WHEN domain IS NULL THEN 'No website at all — likely needs: answering' WHEN list_contains(hits, 'low_rating_high_volume') THEN 'Busy but rating is hurting (<=3.9 with 50+ reviews) — reputation/ops angle' WHEN reviews < 10 THEN 'Almost no reviews — visibility/marketing angle' WHEN len(hits) > 0 THEN 'Actively hiring — growing and likely budgeted' END AS first_hook FROM t""".replace("\\\\", "\\"))


@query(PROFILE_SQL)
def rubric_scores(spark, sf_dir):
    """Businesses under a rubric and a campaign's settings laid over it."""
    b = businesses(spark, sf_dir)
    chained = R.chain_map(b, "id", "domain", "phone")
    n = F.col("reviews")
    country = F.element_at(F.array(*[F.lit(x) for x in ("GB", "uk", "France", None)]), (n % 4 + 1).cast("int"))
    rows = b.join(chained, "id", "left").withColumns({"website": F.col("domain"), "registry": F.col("source") == "register", "crawled": n % 3 == 0, "signals": F.create_map(F.lit("careers"), n % 2 == 0), "country": country})
    s = B.scored(rows, CAMPAIGN)
    return s.select("id", "total", "tier", "disqualified", F.array_join(F.transform("negatives", lambda x: x["name"]), ",").alias("negatives"), F.size("hooks").alias("hooks"), F.get("hooks", F.lit(0)).alias("first_hook"))
