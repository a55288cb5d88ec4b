"""Ladders and rankings over contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: The order in which tiers are shown.
TIER_ORDER = ["valid", "role", "risky", "catch_all", "inferred", "unknown", "invalid"]
AFFINITY_ORDER = ["own_domain", "freemail_linked", "", "freemail_unlinked", "foreign"]


def rank_in(order: list[str], c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), c)


def email_tier(email: Column, mx: Column) -> Column:
    """Syntax, placeholder, mail exchange (null: unknown), role, valid: the first that decides."""
    local = F.substring_index(email, "@", 1)
    syntax = email.rlike(f"^{T.EMAIL}$")
    return (
        F.when(email.isNull() | ~syntax, "invalid").when(local.isin(T.PLACEHOLDERS), "invalid").when(mx.isNull(), "unknown")
        .when(~mx, "invalid").when(local.isin(T.ROLES), "role").otherwise("valid")
    )


def email_affinity(email: Column, domain: Column, name: Column) -> Column:
    """own_domain, foreign, freemail_linked (a token of the name in the local part) or freemail_unlinked."""
    host, local = F.substring_index(email, "@", -1), F.substring_index(email, "@", 1)
    own = (host == domain) | F.endswith(host, F.concat(F.lit("."), domain)) | F.endswith(domain, F.concat(F.lit("."), host))
    linked = F.exists(T.name_tokens(name), lambda t: F.contains(local, t))
    return F.when(own, "own_domain").when(~host.isin(T.FREEMAIL), F.when(domain.isNull(), "own_domain").otherwise("foreign")).when(linked, "freemail_linked").otherwise("freemail_unlinked")


def send_group(tier: Column, affinity: Column) -> Column:
    """0 own valid or role, 1 linked, 2 inferred, 3 other valid, role, risky or catch-all, 4 unknown, 5 invalid."""
    good = tier.isin("valid", "role")
    return (
        F.when(good & (affinity == "own_domain"), 0).when(good & (affinity == "freemail_linked"), 1).when(tier == "inferred", 2)
        .when(good | tier.isin("risky", "catch_all"), 3).when(tier == "unknown", 4).otherwise(5)
    )


def entity_type(status: Column, registry_person: Column, checked: Column) -> Column:
    return (
        F.when(status.isNotNull(), F.when(status.isin("active", "open"), "corporate_active").otherwise("corporate_inactive"))
        .when(registry_person, "corporate_unknown").when(checked, "unmatched").otherwise("unchecked")
    )


def lawful_basis(tier: Column, affinity: Column, entity: Column, region: Column) -> Column:
    """none, b2b, confirm or consent, by the first rule that holds; freemail only when linked."""
    return (
        F.when(~tier.isin("valid", "role") | affinity.isin("freemail_unlinked", "foreign"), "none").when(region == "us", "b2b")
        .when(entity == "corporate_active", "b2b").when(entity == "corporate_inactive", "confirm").when(entity == "corporate_unknown", "b2b")
        .when(entity == "unmatched", F.when(affinity.isin("own_domain", "freemail_linked"), "b2b").otherwise("confirm")).otherwise("confirm")
    )
