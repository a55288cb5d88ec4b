"""What comes back from outreach: replies and bounces, matched to messages, suppressed and folded into target states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import moving_to

#: Words of replies, of opt-outs and of raw mail; what suppresses an address.
REPLIES = {
    "not_interested": ["not interested", "no thanks", "not for us", "please remove", "no thank you"],
    "wrong_person": ["wrong person", "not the right person", "reach out to", "forward this to", "try contacting"],
    "ooo": ["out of office", "on annual leave", "on vacation", "auto-reply", "automatic reply", "ooo"],
    "interested": ["interested", "sounds good", "tell me more", "yes please", "let's talk", "book a call"],
}
OPT_OUT = ["unsubscribe", "stop", "remove me", "opt out", "opt-out", "take me off"]
RAW = {
    "bounce_hard": ["undeliverable", "delivery status notification", "550", "no such user", "does not exist", "permanent failure"],
    "bounce_soft": ["mailbox full", "quota exceeded", "temporarily", "try again later", "451", "452"],
    "complaint": ["abuse report", "spam complaint", "this is spam", "arf report", "feedback loop"],
}
SUPPRESSES = ["bounce_hard", "complaint", "unsubscribe"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def opts_out(body: Column) -> Column:
    return _any(F.lower(F.coalesce(body, F.lit(""))), OPT_OUT)


def reply_kind(body: Column) -> Column:
    """The first kind of which a word stands in a reply, else other."""
    text = F.lower(F.coalesce(body, F.lit("")))
    return F.coalesce(*[F.when(_any(text, words), k) for k, words in REPLIES.items()], F.lit("other"))


def raw_kind(subject: Column, body: Column) -> Column:
    """The kind of mail that comes without one."""
    text = F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))
    known = [F.when(_any(text, words), k) for k, words in RAW.items()]
    code = F.when(text.rlike(r"\b5\d\d\b") & text.rlike("bounce|delivery|undeliver"), "bounce_hard")
    return F.coalesce(*known, code, F.when(_any(text, OPT_OUT), "unsubscribe"), F.lit("reply"))


def ingested(events: DataFrame, messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """New events with what they mean: one row per distinct event.

    events: kind, email, message_id, occurred_at (text), body, seq. messages:
    id, target, header, state, sent_at; headers are unique. contacts: target,
    email. An event belongs to the message its header names, else to the last
    one sent to its address. Adds dedupe_key, classification, optout, message,
    target, suppress (source, or null) and asked (the state it asks for).
    Repeats of an event collapse before the joins; an address has one row
    before it is joined, however many messages it got.
    """
    email = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    header = F.when(F.trim("message_id") != "", F.trim("message_id"))
    e = events.withColumns({"email": email, "message_id": header})
    key = F.substring(F.sha1(F.concat(F.coalesce("kind", F.lit("")), F.lit("|"), "email", F.lit("|"), F.coalesce("message_id", F.lit("None")), F.lit("|"), "occurred_at")), 1, 20)
    e = e.withColumn("dedupe_key", key).groupBy("dedupe_key", "kind", "email", "message_id", "occurred_at").agg(F.min_by("body", "seq").alias("body"))
    reply = F.col("kind") == "reply"
    optout = reply & opts_out(F.col("body"))
    e = e.withColumns({"classification": F.when(reply, reply_kind(F.col("body"))).otherwise(""), "optout": F.coalesce(optout, F.lit(False))}).drop("body")
    by_header = messages.filter("header IS NOT NULL").select(F.col("header").alias("message_id"), F.col("id").alias("_m1"), F.col("target").alias("_t1"))
    sent = messages.filter("state = 'sent'").groupBy("target").agg(F.max_by(F.struct("id", "target"), F.struct("sent_at", "id")).alias("m"), F.max(F.struct("sent_at", "id")).alias("at"))
    by_mail = sent.join(contacts.select("target", F.lower("email").alias("email")), "target").groupBy("email").agg(F.max_by("m", "at").alias("_m2"))
    e = e.join(by_header, "message_id", "left").join(by_mail, "email", "left")
    suppress = F.when(F.col("email") == "", None).when(F.col("kind").isin(SUPPRESSES), F.col("kind")).when(F.col("optout"), "reply_optout")
    asked = (
        F.when(F.col("kind") == "bounce_hard", "bounced").when(F.col("kind") == "bounce_soft", None).when(F.col("kind").isin("complaint", "unsubscribe") | F.col("optout"), "opted_out")
        .otherwise("replied")
    )
    return e.select(
        "dedupe_key", "kind", "email", "occurred_at", "classification", "optout", F.coalesce("_m1", "_m2.id").alias("message"), F.coalesce("_t1", "_m2.target").alias("target"),
        suppress.alias("suppress"), asked.alias("asked"),
    )


def states_after(targets: DataFrame, events: DataFrame) -> DataFrame:
    """(target, state) after all events, as if each came in turn; moves that aren't allowed are ignored.

    Events only ask for bounced, replied and opted_out, and of these each
    leaves only opted_out open, so the first event of each kind decides: three
    minima per target, however many events it has.
    """
    first = lambda s: F.min(F.when(F.col("asked") == s, F.struct("occurred_at", "dedupe_key")))
    asked = events.filter("target IS NOT NULL").groupBy("target").agg(first("bounced").alias("b"), first("replied").alias("r"), first("opted_out").alias("o"))
    s = F.col("state")
    bounces, replies = s.isin(moving_to("bounced")) & F.col("b").isNotNull(), s.isin(moving_to("replied")) & F.col("r").isNotNull()
    state = (
        F.when(F.col("o").isNotNull() & s.isin(moving_to("opted_out")), "opted_out").when(bounces & replies, F.when(F.col("b") < F.col("r"), "bounced").otherwise("replied"))
        .when(bounces, "bounced").when(replies, "replied").otherwise(s)
    )
    return targets.join(asked, "target", "left").select("target", state.alias("state"))


def opt_out_fan_out(outcomes: DataFrame, businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """(kind, value, business) to suppress for outcomes (business, result) of opt_out: the site and each address of the business."""
    out = outcomes.filter("result = 'opt_out'").select("business").distinct()
    site = out.join(businesses.select("business", "domain"), "business").filter("domain <> ''").select(F.lit("domain").alias("kind"), F.col("domain").alias("value"), "business")
    mail = out.join(contacts.filter("kind = 'email'").select("business", "value"), "business").select(F.lit("email").alias("kind"), "value", "business")
    return site.unionByName(mail).distinct()


def checked_emails(emails: DataFrame, exchanges: DataFrame, disposable: DataFrame, tier) -> DataFrame:
    """Adds tier to rows of (email): risky for disposable domains, else by tier(email, mx).

    exchanges: domain, mx, one row per domain that was looked up; disposable:
    domain. Spark chooses how the two meet the addresses; nothing is forced
    into memory.
    """
    e = emails.withColumn("_d", F.lower(F.substring_index("email", "@", -1)))
    e = e.join(exchanges.select(F.col("domain").alias("_d"), "mx"), "_d", "left").join(disposable.select(F.col("domain").alias("_d"), F.lit(True).alias("_risky")).distinct(), "_d", "left")
    plain = tier(F.col("email"), F.col("mx"))
    placeholder = tier(F.col("email"), F.lit(True)) == "invalid"
    return e.withColumn("tier", F.when(F.col("_risky") & ~placeholder, "risky").otherwise(plain)).drop("_d", "mx", "_risky")
