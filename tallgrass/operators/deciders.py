"""Who decides at a business: people that its profile and the register name, picks that need no judgement, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words of officers that are companies.
CORPORATE = r"(?i)\b(ltd|llp|limited|plc|inc|gmbh|company|corporation)\b"


def profile_people(named: DataFrame, known: DataFrame) -> DataFrame:
    """(business, name, snippet) to add, of names on a business's profile.

    named: business, kind (signature of a reply, or credit in a review),
    position, name; known: business, name of people whom the profile gave
    before.  Names are one whatever their case: a signature comes before
    credits, and of several spellings the first stays.  Credits are counted by
    spelling.  Two groupings that shrink before the shuffle, however often a
    name is credited.
    """
    there = named.filter(T.absent(F.col("name")).isNotNull()).withColumn("low", F.lower("name"))
    signed = there.filter("kind = 'signature'").groupBy("business", "low").agg(F.min_by("name", "position").alias("name")).withColumn("snippet", F.lit("signed an owner reply on Google"))
    spelt = there.filter("kind = 'credit'").groupBy("business", "low", "name").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"))
    credited = spelt.groupBy("business", "low").agg(F.min_by(F.struct("name", "n"), "position").alias("c"))
    said = F.concat(F.lit("credited by customers in "), F.col("c.n"), F.when(F.col("c.n") == 1, " review").otherwise(" reviews"))
    credited = credited.select("business", "low", F.col("c.name").alias("name"), said.alias("snippet")).join(signed.select("business", "low"), ["business", "low"], "left_anti")
    old = known.select("business", F.lower("name").alias("low")).distinct()
    return signed.unionByName(credited).join(old, ["business", "low"], "left_anti").select("business", "name", "snippet")


def profile_backlog(profiles: DataFrame, people: DataFrame) -> DataFrame:
    """Profiles (business, facts) with facts of which no person was taken yet (people: business, origin)."""
    return profiles.filter("facts IS NOT NULL").join(people.filter("origin = 'gbp'").select("business").distinct(), "business", "left_anti")


def inference_backlog(businesses: DataFrame, people: DataFrame, contacts: DataFrame) -> DataFrame:
    """(business, domain, name) of each decision maker of a business with a domain for which no address was inferred yet."""
    inferred = contacts.filter("kind = 'email' AND tier = 'inferred'").select("business").distinct()
    return businesses.filter("domain IS NOT NULL").join(people.filter("is_dm = 1").select("business", "name"), "business").join(inferred, "business", "left_anti").select("business", "domain", "name")


def register_picks(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(business, name) of the only individual whom the register names, where the company is active and nobody was chosen.

    people: business, name, labeled_by, is_dm; profiles: business, status.
    """
    person = ~F.coalesce(F.col("name").rlike(CORPORATE), F.lit(False)) & (F.col("labeled_by") == "registry")
    each = people.groupBy("business").agg(F.count_if(person).alias("n"), F.min(F.when(person, F.col("name"))).alias("name"), F.coalesce(F.max(F.col("is_dm") == 1), F.lit(False)).alias("chosen"))
    active = profiles.filter(F.lower("status") == "active").select("business").distinct()
    return each.filter("n = 1 AND NOT chosen").join(active, "business", "left_semi").select("business", "name")


def heuristic_picks(people: DataFrame, routes: DataFrame, titles: list[str]) -> DataFrame:
    """(business, person, confidence, by): the only candidate with a wanted title, or of several the only one with a direct or mobile number.

    people: business, person, title, is_dm (0: open, 1: chosen, -1: rejected);
    only businesses with open people alone count.  routes: business, person of
    numbers that are neither rejected nor stale and whose kind is direct or
    mobile.  Everything else stays as it is.
    """
    low = F.lower(F.coalesce("title", F.lit("")))
    wanted = F.lit(False)
    for t in filter(None, titles):
        wanted = wanted | F.contains(low, F.lit(t.lower()))
    open_ = people.groupBy("business").agg(F.max(F.col("is_dm") != 0).alias("done")).filter("NOT done").select("business")
    fit = people.filter(wanted).join(open_, "business", "left_semi").join(routes.select("business", "person").distinct().withColumn("routed", F.lit(True)), ["business", "person"], "left")
    each = fit.groupBy("business").agg(F.count(F.lit(1)).alias("n"), F.min("person").alias("one"), F.count_if("routed").alias("k"), F.min(F.when(F.col("routed"), F.col("person"))).alias("reached"))
    single = F.col("n") == 1
    return each.filter(single | (F.col("k") == 1)).select(
        "business", F.when(single, F.col("one")).otherwise(F.col("reached")).alias("person"), F.when(single, 0.55).otherwise(0.65).alias("confidence"), F.when(single, "heuristic_auto").otherwise("heuristic_route").alias("by")
    )


def call_readiness(validated: Column, named: Column, shown: Column) -> Column:
    """How ready a row is to be called: by a number that can be dialled, a person, and what number is shown."""
    ok = F.coalesce(validated, F.lit(False))
    return (
        F.when(ok & F.coalesce(named, F.lit(False)), "READY - named contact").when(ok, "READY - ask switchboard")
        .when(T.absent(shown).isNotNull(), "UNVERIFIED PHONE - confirm number").otherwise("NO PHONE - research first")
    )
