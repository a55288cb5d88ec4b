"""Scoring profiles as data: a rubric with its overrides is checked, hashed and compiled to column expressions."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import score as S

#: The rubric that a campaign's own settings are laid over.
DEFAULT = {
    "version": 2,
    "tiers": {"a_min": 80, "b_min": 60},
    "negatives_cap": -40,
    "factors": {"industry_match": 25, "need_signals": 25, "size_match": 10, "geography_match": 10, "business_model": 10, "data_confidence": 20},
    "negatives": {"franchise_or_chain": -25, "out_of_area": -20, "chain_member": -15},
    "hooks": {
        "website_missing": "No website at all — likely needs: {offer}",
        "website_no_ssl": "Site has no HTTPS — easy credibility pitch alongside: {offer}",
        "stale_site": "Copyright year on the site is {year} (looks unmaintained) — refresh angle for: {offer}",
        "low_rating_high_volume": "Busy but rating is hurting (<=3.9 with 50+ reviews) — reputation/ops angle",
        "few_reviews": "Almost no reviews — visibility/marketing angle",
        "weak_social_presence": "No social profile is linked from their website — presence-building angle",
        "phone_only_booking": "No online booking found on their website — phone-only operation; automation pitch for: {offer}",
        "hiring": "Actively hiring — growing and likely budgeted",
        "stale_social": "Social profiles look abandoned (no recent posts) — presence/content angle for: {offer}",
        "no_social_presence": "No social profiles linked from their site at all — visibility angle",
        "no_video_presence": "No video/YouTube channel — video marketing angle for: {offer}",
    },
}
#: Names of countries that are one; words of names that tell of chains.
COUNTRIES = {"uk": "gb", "united kingdom": "gb", "united states": "us", "usa": "us"}
CHAIN_WORDS, MODEL_WORDS = ["franchise", "group"], ["franchise", "group", "inc", "corporation"]
#: What a campaign may set, with its kind.
SETTINGS = {
    "categories": list, "aliases": dict, "min_reviews": int, "max_reviews": int, "areas": list, "country": str, "mode": str, "hard": list, "soft": list, "offer": str, "weights_override": dict, "profile": str,
}
HARD = ("no_phone", "franchise_or_chain", "no_website_hard")
#: Columns that a profile may read; those that a table lacks count as null.
COLUMNS = {
    "name": "string", "category": "string", "categories": "array<string>", "phone": "string", "website": "string", "rating": "double", "reviews": "long", "city": "string", "region": "string", "postal": "string",
    "address": "string", "country": "string", "place_id": "string", "registry": "boolean", "crawled": "boolean", "n_socials": "int", "signals": "map<string,boolean>", "copyright_year": "string", "chain": "string",
    "dm_name": "string", "dm_title": "string", "n_people": "int", "email_tier": "string",
}


def words_in(name: Column, words: list[str]) -> Column:
    """Whether one of some words stands in a name as a whole word."""
    return F.coalesce(name.rlike(r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b"), F.lit(False)) if words else F.lit(False)


def settled(campaign: dict, rubric: dict = DEFAULT) -> dict:
    """A rubric under a campaign's settings, checked: what is missing gets its default, what isn't known is an error.

    Weights are overridden for factors that the rubric has; others are left out,
    so that a campaign may hold weights for several rubrics.
    """
    if unknown := set(campaign) - set(SETTINGS):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for k, v in campaign.items():
        if not isinstance(v, SETTINGS[k]) or isinstance(v, bool):
            raise ValueError(f"{k} must be of kind {SETTINGS[k].__name__}")
    if unknown := set(rubric["factors"]) - set(FACTORS):
        raise ValueError(f"unknown factors: {', '.join(sorted(unknown))}")
    for q in campaign.get("hard", []):
        if q not in HARD and not re.match(r"(competitor|existing_client):.+", q):
            raise ValueError(f"unknown reason to disqualify: {q}")
    if not rubric["tiers"]["a_min"] > rubric["tiers"]["b_min"] >= 0:
        raise ValueError("tier A must begin above tier B")
    weights = {n: campaign.get("weights_override", {}).get(n, w) for n, w in rubric["factors"].items()}
    if any(isinstance(w, bool) or not isinstance(w, (int, float)) or w < 0 for w in weights.values()):
        raise ValueError("weights are numbers from 0 on")
    plain = {"categories": [], "aliases": {}, "min_reviews": 0, "max_reviews": 0, "areas": [], "country": "", "mode": "local_business", "hard": [], "soft": [], "offer": "", "profile": "default"}
    return {**rubric, "factors": weights, **plain, **{k: v for k, v in campaign.items() if k != "weights_override"}}


def profile_hash(profile: dict) -> str:
    """Equal for equal profiles, whatever the order in which their parts are written."""
    return hashlib.sha256(json.dumps(profile, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def _categories() -> Column:
    return F.array_compact(F.concat(F.array(T.absent(F.col("category"))), F.coalesce("categories", F.array().cast("array<string>"))))


def _needs(p: dict) -> Column:
    signals = {k: F.try_element_at("signals", F.lit(k)) for k in ("https", "stale_site", "booking_hint", "careers", "stale_social", "no_social_presence", "no_video_presence")}
    return S.need_signals(p["soft"], F.col("website"), F.when(F.col("rating") != 0, F.col("rating")), F.col("reviews"), F.coalesce("crawled", F.lit(False)), F.col("n_socials"), signals)


def _size(p: dict) -> Column:
    n, least, most = F.col("reviews"), p["min_reviews"], p["max_reviews"]
    share = F.when(n.isNull(), 0.4)
    share = share.when(n < least, 0.2) if least else share
    share = share.when(n > most, 0.3) if most else share
    return share.otherwise(1.0)


def _geography(p: dict) -> Column:
    areas = [a.split(",")[0].strip().lower() for a in p["areas"] if a.strip()]
    if not areas:
        return F.lit(1.0)
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("city", "region", "postal", "address")]))
    inside = [F.contains(hay, F.lit(a)) for a in areas if a]
    out = F.when(F.trim(hay) == "", 0.5)
    for i in inside:
        out = out.when(i, 1.0)
    return out.otherwise(0.3)


def _confidence(p: dict) -> Column:
    plus = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.3) + plus(F.col("registry"), 0.4) + plus(F.col("crawled"), 0.2) + plus(T.absent(F.col("place_id")).isNotNull(), 0.1))


def _contact(p: dict) -> Column:
    phone, tier = T.absent(F.col("phone")).isNotNull(), F.col("email_tier")
    return F.when((tier == "valid") & phone, 1.0).when(tier.isin("valid", "role"), 0.6).when(phone, 0.4).when(tier == "inferred", 0.2).otherwise(0.1)


#: The share of its weight that each factor gives.
FACTORS: dict[str, Callable[[dict], Column]] = {
    "industry_match": lambda p: S.industry_share(_categories(), p["categories"], {k: (v.get("exact") or [], v.get("adjacent") or []) for k, v in p["aliases"].items()}),
    "need_signals": lambda p: S.need_share(F.size(_needs(p))),
    "size_match": _size,
    "geography_match": _geography,
    "business_model": lambda p: F.when(words_in(F.col("name"), MODEL_WORDS), 0.3).otherwise(0.8),
    "dm_identified": lambda p: F.when(T.absent(F.col("dm_name")).isNotNull(), 1.0).when(F.col("n_people") > 0, 0.3).otherwise(0.0),
    "verified_direct_contact": _contact,
    "data_confidence": _confidence,
}


def _disqualified(p: dict) -> Column:
    """The first reason that holds, in the campaign's order; null without one."""
    rules = {"no_phone": T.absent(F.col("phone")).isNull(), "franchise_or_chain": words_in(F.col("name"), CHAIN_WORDS), "no_website_hard": T.absent(F.col("website")).isNull()}
    held = [F.when(rules[q] if q in rules else words_in(F.col("name"), [q.split(":", 1)[1]]), q) for q in p["hard"]]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def _negatives(p: dict) -> Column:
    """(name, points) of what counts against a business."""
    low = F.lower(F.trim(F.coalesce("country", F.lit(""))))
    got, want = F.coalesce(T.lookup(COUNTRIES, low), low), COUNTRIES.get(p["country"].strip().lower(), p["country"].strip().lower())
    rules = {
        "franchise_or_chain": words_in(F.col("name"), CHAIN_WORDS) if p["mode"] == "local_business" else F.lit(False),
        "out_of_area": (got != "") & (got != want) if want else F.lit(False), "chain_member": F.col("chain").isNotNull(),
    }
    each = [F.when(c, F.struct(F.lit(n).alias("name"), F.lit(float(p["negatives"].get(n, DEFAULT["negatives"][n]))).alias("points"))) for n, c in rules.items()]
    return F.array_compact(F.array(*each))


def _hooks(p: dict) -> Column:
    def line(sign: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in p["hooks"].items():
            filled = F.replace(F.lit(words.replace("{offer}", p["offer"])), F.lit("{year}"), F.coalesce("copyright_year", F.lit("unknown")))
            out = F.when(sign == name, filled).otherwise(out)
        return out

    return F.array_compact(F.transform(_needs(p), line))


def default_profile(rows: DataFrame, p: dict) -> DataFrame:
    """Adds total, tier, factors (name, points, why), negatives, disqualified and hooks."""
    shares = {n: FACTORS[n](p) for n in p["factors"]}
    factors = [S.Factor(n, float(w), shares[n], F.concat(F.lit(f"{n}: "), F.bround(shares[n] * 100, 0).cast("int"), F.lit(" %"))) for n, w in p["factors"].items()]
    with_rules = rows.withColumns({"negatives": _negatives(p), "disqualified": _disqualified(p), "hooks": _hooks(p)})
    against = F.aggregate("negatives", F.lit(0.0), lambda s, x: s + x["points"])
    return S.apply_profile(with_rules, factors, against, F.col("disqualified").isNotNull(), p["tiers"]["a_min"], p["tiers"]["b_min"], float(p["negatives_cap"]))


#: Profiles by the name that a campaign gives; unknown names get the default one.
PROFILES: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"default": default_profile}


def register(name: str, profile: Callable[[DataFrame, dict], DataFrame]) -> None:
    PROFILES[name] = profile


def scored(rows: DataFrame, campaign: dict, rubric: dict = DEFAULT) -> DataFrame:
    """Rows under the profile that a campaign names, with the profile's hash; columns of COLUMNS that rows lack count as null and don't stay."""
    p = settled(campaign, rubric)
    lacking = [c for c in COLUMNS if c not in rows.columns]
    whole = rows.withColumns({c: F.lit(None).cast(COLUMNS[c]) for c in lacking}) if lacking else rows
    return PROFILES.get(p["profile"], default_profile)(whole, p).drop(*lacking).withColumn("profile", F.lit(profile_hash(p)))
