"""Evidence packets, and the gate that drafted text must pass: nothing in a draft that its packet doesn't hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Facts that set a business apart, the order in which facts go when a packet is too long, claims and denials.
DISTINCTIVE = ["legal_name", "incorporated_year", "company_status", "booking", "site_stale", "hiring", "phone_confirmed", "gbp_appointments", "review_name"]
DROP_ORDER = [
    "category", "rating", "city", "no_social_link", "no_website", "review_name", "gbp_appointments", "hiring", "phone_confirmed", "site_stale", "company_status", "incorporated_year",
    "legal_name", "booking",
]
BANNED = [
    r"(?i)\b(dozens|hundreds|many)\s+of\s+(garages|businesses|clients|companies)\b", r"(?i)\bwe(?:'ve| have)?\s+(cut|reduced|increased|saved)\b", r"(?i)\bcompetitors?\b",
    r"(?i)\bmost\s+(garages|businesses)\b", r"(?i)\bguarantee(?:d|s)?\b",
]
DENIES_BOOKING = r"(?i)\b(no online book\w*|don'?t take bookings?|do not take bookings?|doesn'?t take bookings? online|can'?t book online|cannot book online)\b"
CLAIMS_BOOKING = r"(?i)\b(book\w* (?:online|a slot online|an appointment online)|take bookings? online|you can book online)\b"
NUMBER = r"(?<![A-Za-z])\d+(?:\.\d+)?%?(?![A-Za-z])"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
URL = r"(?i)(?:https?://\S+|www\.[^\s,;]+)"
WORD = r"[A-Za-z][A-Za-z0-9'\-]*"

FACTS = "array<struct<k:string,v:string,src:string,at:string>>"


def facts(found: dict[str, tuple[Column, str, Column]]) -> Column:
    """An array of (k, v, src, at) of the facts whose value isn't null, in the given order."""
    one = lambda k, v, src, at: F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"), F.lit(src).alias("src"), at.cast("string").alias("at")))
    return F.array_compact(F.array(*[one(k, *x) for k, x in found.items()])).cast(FACTS)


def packet(company: Column, city: Column, found: Column, offer: tuple[Column, Column], sender: tuple[Column, Column], purpose: Column, greeting: Column, subject_chars: int = 60, observation_words: int = 45) -> Column:
    """A packet as a struct; its facts are an array as facts() gives it."""
    none = F.array().cast("array<string>")
    return F.struct(
        company.alias("co"), city.alias("city"), found.alias("facts"), F.struct(offer[0].alias("what"), offer[1].alias("value_prop")).alias("offer"),
        F.struct(sender[0].alias("from_name"), sender[1].alias("label")).alias("sender"), purpose.alias("purpose"), greeting.alias("greeting"),
        F.struct(F.lit(observation_words).alias("max_observation_words"), F.lit(subject_chars).alias("max_subject_chars"), none.alias("template_numbers"), none.alias("literals")).alias("constraints"),
    )


def _fact_chars(f: Column) -> Column:
    return F.length(F.to_json(f)) + 7  # a space behind each of four colons and three commas


def _frame_chars(p: Column) -> Column:
    """Characters of a packet without facts: a space behind each colon and comma of its 16 keys in four objects."""
    return F.length(F.to_json(p.withField("facts", F.array().cast(FACTS)))) + 28


def tokens(p: Column) -> Column:
    """A packet's tokens, taken as a quarter of the characters of its spaced JSON."""
    return _tokens(_frame_chars(p), p["facts"])


def _tokens(frame: Column, found: Column) -> Column:
    within = F.aggregate(found, F.lit(0), lambda n, f: n + _fact_chars(f))
    return F.ceil((frame + within + 2 * F.greatest(F.size(found) - 1, F.lit(0))) / 4).cast("long")


def trimmed(p: Column, most: int) -> Column:
    """A packet's facts without the least worth, as far as it must shrink; then from the end. Nothing but facts goes."""
    def kept(frame: Column) -> Column:
        by_worth = F.aggregate(F.array(*map(F.lit, DROP_ORDER)), p["facts"], lambda facts, k: F.when(_tokens(frame, facts) > most, F.filter(facts, lambda f: f["k"] != k)).otherwise(facts))
        each = F.sequence(F.lit(1), F.size(p["facts"]) + 1)
        return F.aggregate(each, by_worth, lambda facts, _: F.when((_tokens(frame, facts) > most) & (F.size(facts) > 0), F.slice(facts, F.lit(1), F.size(facts) - 1)).otherwise(facts))

    return T.let(_frame_chars(p), kept)


def grade(found: Column) -> Column:
    """A: a distinctive fact and a name to greet; B: the fact alone; C: neither."""
    keys = F.transform(found, lambda f: f["k"])
    apart = F.arrays_overlap(keys, F.array(*map(F.lit, DISTINCTIVE)))
    return F.when(apart & F.array_contains(keys, "dm_name"), "A").when(apart, "B").otherwise("C")


def haystack(p: Column) -> Column:
    """A packet as searchable text, without the times of its facts."""
    bare = F.transform(p["facts"], lambda f: f.dropFields("at"))
    return F.to_json(p.withField("facts", bare))


def _has_word(hay: Column, word: Column) -> Column:
    return F.regexp_like(hay, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))


def _interior(text: Column) -> Column:
    """Of each sentence what stands behind its first word, which is capitalised anyway."""
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s.rlike(rf"^\s*{WORD}"))
    return F.transform(sentences, lambda s: F.regexp_replace(s, rf"^\s*{WORD}", ""))


def _names(text: Column) -> Column:
    """Capitalised words and runs of them inside sentences. A word stuck to a digit is a part of some code, no name."""
    runs = lambda s: F.regexp_extract_all(s, F.lit(rf"\b[A-Z][A-Za-z0-9'\-]*(?:\s+[A-Z][A-Za-z0-9'\-]*)+\b"), F.lit(0))
    words = lambda s: F.filter(F.regexp_extract_all(s, F.lit(f"[0-9]?{WORD}"), F.lit(0)), lambda w: w.rlike("^[A-Z]"))
    return F.flatten(F.transform(_interior(text), lambda s: F.concat(runs(s), words(s))))


def inferred_fact(p: Column, subject: Column, observation: Column) -> Column:
    """The fact that a draft quotes by its value: distinctive ones first, category and city last; null where none is quoted."""
    text = F.lower(F.concat_ws("\n", subject, observation))
    quoted = F.filter(p["facts"], lambda f: (f["v"] != "") & F.contains(text, F.lower(f["v"])) & ~((f["k"] == "legal_name") & (F.lower(f["v"]) == F.lower(p["co"]))))
    ranked = F.transform(quoted, lambda f, i: F.struct(F.when(f["k"].isin(DISTINCTIVE), 2).when(f["k"].isin("category", "city"), 0).otherwise(1).alias("rank"), (-i).alias("at"), f["k"].alias("k")))
    return F.array_max(ranked)["k"]


def gate(p: Column, subject: Column, observation: Column, used_fact: Column) -> Column:
    """Why a draft fails, as an array of KIND:detail; empty where it passes. Null texts count as empty."""
    subject, observation = F.coalesce(subject, F.lit("")), F.coalesce(observation, F.lit(""))
    return T.let(haystack(p), lambda hay: _reasons(p, hay, subject, observation, used_fact))


def _reasons(p: Column, hay: Column, subject: Column, observation: Column, used_fact: Column) -> Column:
    text = F.concat(subject, F.lit("\n"), observation)
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tag = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(f"{kind}:"), x))
    when = lambda kind, c: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    bare = lambda n: F.regexp_replace(n, "%$", "")
    numbers = F.filter(found(NUMBER), lambda n: ~F.array_contains(p["constraints"]["template_numbers"], bare(n)) & ~_has_word(hay, n) & ~_has_word(hay, bare(n)))
    owner = lambda n: F.regexp_replace(n, "['’]s$", "")
    names = F.filter(F.concat(_names(subject), _names(observation)), lambda n: ~F.array_contains(p["constraints"]["literals"], n) & ~_has_word(hay, n) & ~_has_word(hay, owner(n)))
    low, cited = F.lower(text), F.get(F.filter(p["facts"], lambda f: f["k"] == used_fact), F.lit(0))
    key_words = F.filter(F.split(F.lower(used_fact), r"[_\s]+"), lambda t: F.length(t) > 3)
    referred = ((cited["v"] != "") & F.contains(low, F.lower(cited["v"]))) | F.exists(key_words, lambda t: F.contains(low, t)) | F.contains(low, F.lower(used_fact))
    none = F.coalesce(used_fact, F.lit("")) == ""
    booking = F.exists(p["facts"], lambda f: (f["k"] == "booking") & (f["v"] != ""))
    n_words = F.size(F.filter(F.split(observation, r"\s+"), lambda w: w != ""))
    return F.concat(
        tag("NUMBER", numbers), tag("EMAIL", F.filter(found(EMAIL), lambda m: ~F.contains(hay, m))), tag("URL", F.filter(found(URL), lambda m: ~F.contains(hay, m))), tag("PROPER_NOUN", names),
        when("USED_FACT:none", none), when("USED_FACT:unknown", ~none & cited.isNull()), when("USED_FACT:unreferenced", ~none & cited.isNotNull() & ~referred),
        when("LENGTH:subject", F.length(subject) > p["constraints"]["max_subject_chars"]), when("LENGTH:observation", n_words > p["constraints"]["max_observation_words"]),
        *[when(f"BANNED:{i}", text.rlike(b)) for i, b in enumerate(BANNED)],
        when("NEGATION:denied", booking & text.rlike(DENIES_BOOKING)), when("NEGATION:claimed", ~booking & text.rlike(CLAIMS_BOOKING)),
    )


def judged(drafts: DataFrame, packets: DataFrame, key: str = "target") -> DataFrame:
    """Drafts (key, abstain, subject, observation, used_fact) against packets (key, packet).

    Adds used_fact as cited or inferred, reasons, and outcome: skipped (no
    packet), insufficient_evidence (the writer abstained), applied or rejected.
    """
    cited = F.when(F.coalesce(F.col("used_fact"), F.lit("")) == "", inferred_fact(F.col("packet"), F.col("subject"), F.col("observation"))).otherwise(F.col("used_fact"))
    d = drafts.join(packets, key, "left").withColumn("used_fact", cited)
    d = d.withColumn("reasons", gate(F.col("packet"), F.col("subject"), F.col("observation"), F.col("used_fact")))
    outcome = F.when(F.col("packet").isNull(), "skipped").when(F.col("abstain"), "insufficient_evidence").when(F.size("reasons") == 0, "applied").otherwise("rejected")
    return d.withColumn("outcome", outcome).drop("packet")


def retry_set(messages: DataFrame, key: str = "target") -> DataFrame:
    """(key, subject): targets with rejected messages and no drafted one, with the newest rejection. Messages: key, id, state, subject."""
    newest = F.max_by("subject", F.when(F.col("state") == "rejected", F.col("id")))
    g = messages.groupBy(key).agg(F.bool_or(F.col("state") == "drafted").alias("_done"), F.bool_or(F.col("state") == "rejected").alias("_bad"), newest.alias("subject"))
    return g.filter("_bad AND NOT _done").select(key, "subject")
