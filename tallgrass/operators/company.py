"""A score of companies by what a register and their site say: trade, age, new officers, hiring, site, and how sure all that is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import score as P


@dataclass(frozen=True)
class Company:
    """Columns a company is scored by; nulls are unknowns. officers: array of dates of appointment."""

    trades: Column
    incorporated: Column
    officers: Column
    careers: Column
    crawled: Column
    domain: Column
    status: Column
    registered: Column


def factors(c: Company, wanted: list[str], today: Column) -> list[P.Factor]:
    """The six factors with their weights; every share says why."""
    years = F.datediff(today, c.incorporated) / 365.25
    band = F.when(years < 1, "under one year").when(years <= 3, "one to three years").when(years <= 10, "three to ten years").otherwise("over ten years")
    trades = F.coalesce(c.trades, F.array().cast("array<string>"))
    shared = F.array_sort(F.array_intersect(trades, F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))
    newest = F.array_max(F.filter(F.coalesce(c.officers, F.array().cast("array<date>")), lambda d: d >= F.add_months(today, -12)))
    crawled, careers = F.coalesce(c.crawled, F.lit(False)), F.coalesce(c.careers, F.lit(False))
    known = {"registered": (F.coalesce(c.registered, F.lit(False)), 0.4), "site crawled": (crawled, 0.2), "domain resolved": (c.domain.isNotNull(), 0.1)}
    sure = 0.3 + sum(F.when(ok, x).otherwise(0.0) for ok, x in known.values())
    return [
        P.Factor("industry_fit", 25.0, F.when(F.size(shared) > 0, 1.0).otherwise(0.0), F.when(F.size(trades) == 0, "no trade codes").when(F.size(shared) == 0, "no wanted trade").otherwise(F.concat(F.lit("wanted trades: "), F.array_join(shared, ", ")))),
        P.Factor("incorporation_age", 20.0, F.when(years.isNull(), 0.25).when(years < 1, 0.5).when(years <= 3, 0.75).when(years <= 10, 1.0).otherwise(0.75), F.when(years.isNull(), "age unknown").otherwise(band)),
        P.Factor("new_director", 20.0, F.when(newest.isNotNull(), 1.0).otherwise(0.0), F.when(newest.isNotNull(), F.concat(F.lit("appointed "), newest.cast("string"))).when(F.coalesce(F.size(c.officers), F.lit(0)) > 0, "nobody appointed within a year").otherwise("no officers on file")),
        P.Factor("hiring", 15.0, F.when(careers, 1.0).otherwise(0.0), F.when(careers, "careers page").when(crawled, "no careers page").otherwise("site not crawled")),
        P.Factor("domain_resolved", 10.0, F.when(c.domain.isNotNull(), 1.0).otherwise(0.0), F.coalesce(c.domain, F.lit("no domain"))),
        P.Factor("data_confidence", 15.0, F.least(F.lit(1.0), sure), F.concat_ws(", ", *[F.when(ok, name) for name, (ok, _) in known.items()])),
    ]


def scored(rows: DataFrame, c: Company, wanted: list[str], today: Column) -> DataFrame:
    """Adds total, factors and tier; a company whose status is known and not active is disqualified."""
    status = F.lower(F.trim(F.coalesce(c.status, F.lit(""))))
    return P.apply_profile(rows, factors(c, wanted, today), F.lit(0.0), ~status.isin("", "active"), 75.0, 55.0)


def contactability(decider: Column, email: Column, phone: Column, officer: Column) -> tuple[Column, Column]:
    """Points of a hundred for the ways to reach a company, and what they are."""
    ways = {"decision maker": (decider, 30), "e-mail": (email, 30), "phone": (phone, 25), "registered officer": (officer, 15)}
    there = {name: (F.coalesce(ok, F.lit(False)), n) for name, (ok, n) in ways.items()}
    points = sum(F.when(ok, n).otherwise(0) for ok, n in there.values())
    why = F.concat_ws("; ", *[F.when(ok, name) for name, (ok, _) in there.items()])
    return points, F.when(why == "", "no way to reach them yet").otherwise(why)


def readiness(tier: Column, points: Column) -> Column:
    return F.when(tier == "DQ", "DISQUALIFIED").when(tier.isin("A", "B") & (points >= 55), "READY_FOR_OUTREACH").when(points == 0, "NEEDS_ENRICHMENT").otherwise("MANUAL_REVIEW")
