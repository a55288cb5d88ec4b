"""Weighted, explained scores. A profile is a list of factors; each gives a share of its weight and says why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Factor:
    name: str
    weight: float
    share: Column
    why: Column


def apply_profile(rows: DataFrame, factors: list[Factor], negatives: Column, disqualified: Column, a: float, b: float, floor: float = -40.0) -> DataFrame:
    """Adds total (0 to 100, one decimal), tier (DQ, A, B, C) and factors, an array of (name, points, why)."""
    points = [F.bround(f.share * f.weight, 2) for f in factors]
    raw = sum(points[1:], points[0]) + F.greatest(negatives, F.lit(floor))
    total = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)
    explained = F.array(*[F.struct(F.lit(f.name).alias("name"), p.alias("points"), f.why.alias("why")) for f, p in zip(factors, points)])
    out = rows.withColumns({"total": total, "factors": explained})
    return out.withColumn("tier", F.when(disqualified, "DQ").when(F.col("total") >= a, "A").when(F.col("total") >= b, "B").otherwise("C"))


def size_share(n: Column, low: int, high: int) -> Column:
    return F.when(n.isNull(), 0.4).when(n < low, 0.2).when(n > high, 0.3).otherwise(1.0)


def need_share(hits: Column) -> Column:
    return F.when(hits > 0, F.least(F.lit(1.0), 0.4 + 0.3 * hits)).otherwise(0.2)


def top_reasons(factors: Column, n: int = 3) -> Column:
    """The n factors of most points, as text."""
    ranked = F.sort_array(F.transform(factors, lambda f: F.struct((-f["points"]).alias("p"), f["name"].alias("name"))))
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda f: f["name"]), ",")


#: Words too common to show that two trades are alike.
COMMON_TRADE_WORDS = ["shop", "service", "services", "centre", "center", "station"]


def industry_share(categories: Column, wanted: list[str], verticals: dict[str, tuple[list[str], list[str]]]) -> Column:
    """1.0 for a wanted trade or one of its vertical, 0.6 for one beside that vertical or that shares a word, else 0.1.

    categories: array of names; verticals: exact and adjacent trades by name.
    """
    names = lambda xs: F.array(*[F.lit(x.lower()) for x in xs]) if xs else F.array().cast("array<string>")
    have = F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower)
    low = {w.lower() for w in wanted}
    mine = [v for v in verticals.values() if low & {x.lower() for group in v for x in group}]
    exact, beside = [x for v in mine for x in v[0]], [x for v in mine for x in v[1]]
    words = lambda c: F.filter(F.split(c, "[^a-z]+"), lambda t: (F.length(t) >= 4) & ~t.isin(COMMON_TRADE_WORDS))
    shared = F.arrays_overlap(F.flatten(F.transform(have, words)), F.flatten(F.transform(names(wanted), words)))
    return F.when(F.arrays_overlap(have, names([*wanted, *exact])), 1.0).when(F.arrays_overlap(have, names(beside)) | shared, 0.6).otherwise(0.1)


def need_signals(soft: list[str], website: Column, rating: Column, reviews: Column, crawled: Column, n_socials: Column, signals: dict[str, Column]) -> Column:
    """The wanted signs of need that a business shows, in fixed order.

    What a crawl shows counts only where crawled holds (a page was fetched) and
    the signal isn't null: an unknown is never a sign. signals: https,
    stale_site, booking_hint, careers, stale_social, no_social_presence,
    no_video_presence. n_socials: null where profiles weren't looked for.
    """
    seen = lambda k: F.coalesce(crawled & signals[k], F.lit(False)) if k in signals else F.lit(False)
    unseen = lambda k: F.coalesce(crawled & ~signals[k], F.lit(False)) if k in signals else F.lit(False)
    no_site = F.coalesce(website, F.lit("")) == ""
    n = F.coalesce(reviews, F.lit(0))
    rules = {
        "website_missing": no_site, "website_no_ssl": ~no_site & unseen("https"), "stale_site": seen("stale_site"),
        "low_rating_high_volume": (F.coalesce(rating, F.lit(5.0)) <= 3.9) & (n >= 50), "few_reviews": n < 10, "weak_social_presence": F.coalesce(crawled & (n_socials == 0), F.lit(False)),
        "phone_only_booking": unseen("booking_hint"), "hiring": seen("careers"), "stale_social": seen("stale_social"), "no_social_presence": seen("no_social_presence"),
        "no_video_presence": seen("no_video_presence"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items() if k in soft]))


def account_fit(
    categories: Column, targets: list[str], employees: Column, confirmed: Column, revenue: Column, triggers: Column, departments: Column, systems: list[Column], checked: list[Column], freshness: Column
) -> dict[str, Column]:
    """total (0 to 100), grade, confidence (per cent of the seven inputs known) and industry (whether it fits).

    Unknown inputs earn nothing and lower the confidence, they never
    disqualify; fewer than 20 employees do, if confirmed. triggers: array of
    (text, strength, date), the first deciding how fresh; systems: three
    columns, true where one is in use; checked: whether its absence is known.
    """
    have = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower), lambda c: c != "")
    fits = F.exists(have, lambda c: F.exists(F.array(*[F.lit(t.lower()) for t in targets]), lambda t: F.contains(c, t) | F.contains(t, c)))
    depts, found = F.coalesce(departments, F.array().cast("array<string>")), F.coalesce(F.size(triggers), F.lit(0)) > 0
    strong = found & F.exists(triggers, lambda t: t["strength"] == "strong")
    lead = F.get(triggers, F.lit(0))["strength"] == "strong"
    used = [F.coalesce(s, F.lit(False)) for s in systems]
    timely = F.when(lead & freshness.isin("VERY_STRONG", "STRONG", "UNKNOWN"), 20.0).when(lead | (freshness == "MEDIUM"), 10.0).otherwise(5.0)
    parts = [
        (F.when(fits, 15.0).otherwise(0.0), F.size(have) > 0),
        (F.when(employees.between(50, 500), 15.0).when(employees.between(20, 49), 5.0).otherwise(0.0), employees.isNotNull()),
        (F.when(revenue.between(10_000_000, 150_000_000), 10.0).otherwise(0.0), revenue.isNotNull()),
        (F.when(strong, 15.0).when(found, 8.0).otherwise(0.0), found),
        (F.when(F.size(depts) >= 2, 5.0).otherwise(0.0) + F.when(F.arrays_overlap(depts, F.array(F.lit("operations"), F.lit("it"))), 5.0).otherwise(0.0), F.size(depts) > 0),
        (sum((F.when(u, 5.0).otherwise(0.0) for u in used), F.lit(0.0)), F.greatest(*[u | F.coalesce(c, F.lit(False)) for u, c in zip(used, checked)])),
        (F.when(found, timely).otherwise(0.0), found),
    ]
    total = sum((p for p, _ in parts), F.lit(0.0))
    known = sum((k.cast("int") for _, k in parts), F.lit(0))
    dq = F.coalesce((employees < 20) & confirmed, F.lit(False))
    grade = F.when(dq, "DQ").when(total >= 80, "A").when(total >= 65, "B").when(total >= 50, "C").otherwise("D")
    return {"total": F.bround(total, 1), "grade": grade, "confidence": F.bround(100.0 * known / len(parts), 0).cast("long"), "industry": fits}


def account_status(grade: Column, contactability: Column, fits: Column, employees: Column) -> Column:
    """DISQUALIFIED, MANUAL_REVIEW (too small by estimate, off target, outside 50 to 500 employees, or C), READY_FOR_OUTREACH or NEW."""
    review = F.coalesce((employees < 50) | (employees > 500), F.lit(False)) | ~fits | (grade == "C")
    return F.when(grade == "DQ", "DISQUALIFIED").when(review, "MANUAL_REVIEW").when(grade.isin("A", "B") & (contactability >= 60), "READY_FOR_OUTREACH").otherwise("NEW")
