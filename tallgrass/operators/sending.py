"""What is decided on the way out: approval of exact words, eligibility at the time of sending, and a country's policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import moving_to

#: Policies by country; any other is for a person to judge.
POLICIES = {"US": "operator_review_required", "GB": "legitimate_interest_review_required", "EU": "legitimate_interest_review_required"}
SOURCES = ["public_site", "public_registry", "trade_license", "gbp"]


def policy(country: Column) -> Column:
    """(jurisdiction, allowed, personal_review, inferred_allowed, review, sources) for a country; an unknown one allows nothing."""
    code = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    known = code.isin(list(POLICIES))
    review = F.coalesce(*[F.when(code == c, r) for c, r in POLICIES.items()], F.lit("manual_review_required"))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(code == "", "UNKNOWN").otherwise(code).alias("jurisdiction"), known.alias("allowed"), F.lit(True).alias("personal_review"), F.lit(False).alias("inferred_allowed"), review.alias("review"),
        F.when(known, F.array(*[F.lit(s) for s in SOURCES])).otherwise(none).alias("sources"),
    )


def approved(messages: DataFrame, targets: DataFrame, campaign: str, approver: str, tier: str | None = None, ids: list[int] | None = None, all_drafted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Messages (id, target, state, draft_hash, approved_hash, approved_by) and targets (id, campaign, tier, state) after an approval.

    Exactly one of tier, ids and all_drafted says which drafted messages of the
    campaign are meant.  What is approved is the draft as it reads now; a target
    moves along where it may.
    """
    if not approver.strip():
        raise ValueError("an approval needs a name")
    if sum((bool(tier), bool(ids), all_drafted)) != 1:
        raise ValueError("exactly one of tier, ids and all_drafted")
    own = targets.filter(F.col("campaign") == campaign)
    own = own.filter(F.col("tier") == tier) if tier else own
    meant = messages.filter(F.col("state").isin(moving_to("approved", "message")))
    meant = meant.filter(F.col("id").isin(ids)) if ids else meant
    meant = meant.join(own.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target")
    picked = meant.select("id", F.lit(True).alias("_now"))
    now = F.coalesce("_now", F.lit(False))
    new = lambda value, c: F.when(now, value).otherwise(F.col(c)).alias(c)
    after = messages.join(picked, "id", "left").select("id", "target", new(F.lit("approved"), "state"), "draft_hash", new(F.col("draft_hash"), "approved_hash"), new(F.lit(approver), "approved_by"))
    touched = meant.select(F.col("target").alias("id")).distinct().withColumn("_now", F.lit(True))
    moved = now & F.col("state").isin([s for s in moving_to("approved") if s == "drafted"])
    return after, targets.join(touched, "id", "left").select("id", "campaign", "tier", F.when(moved, "approved").otherwise(F.col("state")).alias("state"))


def still_approved(messages: DataFrame) -> DataFrame:
    """Adds holds: whether a message's words are those that were approved; approved ones that changed go back to drafted."""
    holds = F.coalesce(F.col("draft_hash") == F.col("approved_hash"), F.lit(False))
    return messages.withColumns({"holds": holds, "state": F.when((F.col("state") == "approved") & ~holds, "drafted").otherwise(F.col("state"))})


def rechecked(eligible: DataFrame, confirmed: DataFrame, observations: DataFrame, now: Column, need_confirmation: bool = True) -> DataFrame:
    """Eligibility at the time of sending: business, email, eligible, reasons, from what was worked out (the same columns).

    An address that nothing confirms (confirmed: business, email), and one of
    which an observation is due again (observations: business, value,
    recheck_at, fresh_until as texts, blank for never), makes a business not
    eligible, with the reason.  Observations shrink to one row per business and
    address before they are joined.
    """
    due = lambda c: F.coalesce((F.col(c) != "") & (F.col(c) <= now), F.lit(False))
    stale = observations.groupBy("business", F.col("value").alias("email")).agg(F.max(due("recheck_at") | due("fresh_until")).alias("_stale"))
    known = confirmed.select("business", "email").distinct().withColumn("_known", F.lit(True))
    rows = eligible.join(stale, ["business", "email"], "left").join(known, ["business", "email"], "left")
    there = F.col("email").isNotNull()
    doubts = F.array_compact(F.array(
        F.when(there & F.lit(need_confirmation) & F.col("_known").isNull(), F.lit("email_unconfirmed")), F.when(there & F.coalesce("_stale", F.lit(False)), F.lit("email_stale")),
    ))
    return rows.select("business", "email", (F.col("eligible") & (F.size(doubts) == 0)).alias("eligible"), F.concat("reasons", doubts).alias("reasons"))
