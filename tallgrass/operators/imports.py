"""Imports of outcomes and of confirmed decision makers from lists: matched by a cascade, routed with a reason, merged into several targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phones as P
from ..functions import text as T
from ..sources.scratch import kept

#: What callers write for an outcome, where it isn't its name with lines for blanks and slashes.
OUTCOMES = {
    "meeting booked": "meeting_booked", "interested / qualified": "interested", "interested": "interested", "callback": "callback", "send information": "send_information", "voicemail": "voicemail",
    "no answer": "no_answer", "wrong / disconnected": "wrong_number", "not interested": "not_interested", "do not contact": "do_not_contact", "dnc": "do_not_contact",
}


def outcome_of(value: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    plain = F.translate(raw, "/ ", "__")
    return F.coalesce(T.lookup(OUTCOMES, raw), T.absent(plain), F.lit("unknown"))


def phone_mark(value: Column) -> Column:
    """A number's digits and plus; null without any."""
    return T.absent(F.regexp_replace(F.coalesce(value, F.lit("")), "[^+0-9]", ""))


def site_mark(value: Column) -> Column:
    """The host of an address or bare domain, in lower case and without www.; null for blanks."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    whole = F.when(F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit("https://"), v))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(whole, r"^[^:]*://(?:[^/?#@]*@)?([^/?#]*)", 1), r":\d*$", ""), r"^www\.", "")
    return T.absent(F.when(v != "", host))


def mail_mark(value: Column) -> Column:
    return T.absent(F.lower(F.trim(F.coalesce(value, F.lit("")))))


def looked_up(rows: DataFrame, on: dict[str, Column], index: DataFrame) -> DataFrame:
    """Adds the columns of the index's row of the same keys (on: a key of the index and what it must equal), nulls where there is none.

    The index is written, so that Spark splits keys that many rows have.  Rows
    with a null among their keys match nothing; a hash of theirs is one more
    key, so that they don't meet in one task.
    """
    bare = F.lit(False)
    for c in on.values():
        bare = bare | c.isNull()
    own = {f"_of_{k}": c for k, c in on.items()} | {"_own": F.when(bare, F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))}
    same = F.col("_own") == F.col("_none")
    for k in on:
        same = same & (F.col(f"_of_{k}") == F.col(k))
    held = kept(index.withColumn("_none", F.lit(0).cast("long")), "index")
    return rows.withColumns(own).join(held, same, "left").drop(*own, "_none")


def matched(rows: DataFrame, businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds business and reason to rows (row, business_id, site, phone, email: marks as above): the first key that knows exactly one business.

    A key that knows several ends the search as ambiguous_<key>; a business_id
    that nobody has is passed over.  businesses: id, domain, phone; contacts:
    business, value.  Each key's index has one row per value, whatever the
    number of businesses that share it.  The result is a written table.
    """
    index = lambda df, key, id_, name: (
        df.filter(key.isNotNull()).groupBy(key.alias(f"_{name}")).agg(F.countDistinct(id_).alias(f"_n_{name}"), F.min(id_).alias(f"_id_{name}"))
    )
    known = {
        "business_id": ("business_id", index(businesses, F.col("id"), "id", "business_id")),
        "domain": ("site", index(businesses, T.absent(F.replace(F.lower("domain"), F.lit("www."), F.lit(""))), "id", "domain")),
        "phone": ("phone", index(businesses, T.absent(F.col("phone")), "id", "phone")),
        "contact": ("email", index(contacts, T.absent(F.lower("value")), "business", "contact")),
    }
    out = rows
    for name, (column, found) in known.items():
        out = looked_up(out, {f"_{name}": F.col(column)}, found)
    business, reason = F.lit(None).cast("string"), F.lit("unmatched")
    for name in reversed(known):
        n = F.col(f"_n_{name}")
        business = F.when(n == 1, F.col(f"_id_{name}")).when(n > 1, F.lit(None).cast("string")).otherwise(business)
        reason = F.when(n == 1, name).when(n > 1, f"ambiguous_{name}").otherwise(reason)
    return kept(out.select(*rows.columns, business.alias("business"), reason.alias("reason")), "matched")


def _unmatched(reason: Column) -> Column:
    return F.when(reason.startswith("ambiguous"), "ambiguous").when(reason == "unmatched", "unmatched")


@dataclass
class Imported:
    """routes: row, business, reason, action; targets: new rows by table."""

    routes: DataFrame
    targets: dict[str, DataFrame]


def import_outcomes(rows: DataFrame, businesses: DataFrame, contacts: DataFrame, outcomes: DataFrame) -> Imported:
    """Outcomes of a list, in the order of row, into outcomes (business, channel, result, contacted_at, notes).

    rows: row, business_id, domain, website, phone, email, channel, outcome,
    call_date, contacted_at, notes, recorded_by.  A row is a duplicate if one
    before it, or one that is there, has its business, channel, result and notes
    and its time; without a time, any such.  As rows before count, of each time
    the first row decides, and of rows without one the first of all: two minima
    for each group, however many rows it has.
    """
    site = F.coalesce(site_mark(F.col("domain")), site_mark(F.col("website")))
    marked = rows.withColumns({"site": F.when(T.absent(F.col("domain")).isNotNull(), site_mark(F.col("domain"))).otherwise(site), "phone": phone_mark(F.col("phone")), "email": mail_mark(F.col("email")), "business_id": T.absent(F.trim("business_id"))})
    m = matched(marked, businesses, contacts).withColumns({
        "channel": F.coalesce(T.absent(F.col("channel")), F.lit("phone")), "result": outcome_of(F.col("outcome")), "at": T.first_present(F.col("call_date"), F.col("contacted_at")),
        "notes": F.coalesce("notes", F.lit("")),
    })
    group, no, late = ["business", "channel", "result", "notes"], F.lit(False), F.lit(None).cast("long")
    there = outcomes.select("business", "channel", "result", F.coalesce("notes", F.lit("")).alias("notes"), F.col("contacted_at").alias("at"), late.alias("row"), F.lit(True).alias("_old"))
    both = m.filter("business IS NOT NULL").select(*group, "at", "row", no.alias("_old")).unionByName(there)
    # What counts for rows without a time, and what for those of each time.
    whose = F.explode(F.array_compact(F.array(F.lit(""), F.when(F.col("at").isNotNull(), F.concat(F.lit("at "), "at")))))
    seen = both.withColumn("time", whose).groupBy(*[F.col(c).alias(f"_{c}") for c in (*group, "time")]).agg(F.min("row").alias("_first"), F.max("_old").alias("_old"))
    time = F.coalesce(F.concat(F.lit("at "), "at"), F.lit(""))
    told = looked_up(m, {f"_{c}": F.col(c) for c in group} | {"_time": time}, seen)
    again = F.coalesce("_old", no) | (F.col("row") > F.col("_first"))
    action = F.coalesce(_unmatched(F.col("reason")), F.when(again, "duplicate").otherwise("imported"))
    told = told.withColumn("action", action)
    new = told.filter("action = 'imported'").select("business", "channel", "result", F.col("at").alias("contacted_at"), "notes", "recorded_by")
    return Imported(told.select("row", "business", "reason", "action"), {"outcomes": new})


def import_people(rows: DataFrame, businesses: DataFrame, contacts: DataFrame, observations: DataFrame, region: str = "US") -> Imported:
    """Confirmed decision makers of a list into people, contacts and observations.

    rows: row, business_id, domain, website, phone, email, decision_maker,
    dm_title, dm_phone, sheet.  The match by phone takes the decision maker's
    number where there is no other.  Each number and address is an observation
    of its business, source and person; those that are there already, or stand
    before in the list, are duplicates.  Observations: business, field, value,
    source, person.  Routes have a row for each of a row's values, or one
    without a value where there is none.
    """
    dm_phone, name, title = F.trim(F.coalesce("dm_phone", F.lit(""))), F.trim(F.coalesce("decision_maker", F.lit(""))), F.trim(F.coalesce("dm_title", F.lit("")))
    site = F.coalesce(F.when(T.absent(F.col("domain")).isNotNull(), site_mark(F.col("domain"))), site_mark(F.col("website")))
    primary = P.e164(F.col("phone"), region)
    value = F.coalesce(P.e164(dm_phone, region), phone_mark(dm_phone))
    marked = rows.withColumns({
        "_value": F.when(dm_phone != "", value), "_type": F.when(primary == value, "main_line").otherwise("direct"), "name": name, "title": title, "mail": mail_mark(F.col("email")),
        "source": F.concat(F.lit("human_calling:"), F.coalesce(T.absent(F.col("sheet")), F.lit("unknown"))), "source_url": F.coalesce("website", F.lit("")),
    })
    marked = marked.withColumns({"site": site, "phone": phone_mark(F.coalesce(T.absent(F.col("phone")), F.col("dm_phone"))), "email": F.col("mail"), "business_id": T.absent(F.trim("business_id"))})
    m = matched(marked, businesses, contacts)
    field = lambda f, v, kind, state: F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"), kind.alias("phone_type"), F.lit(state).alias("state")))
    both = F.array_compact(F.array(field("phone", F.col("_value"), F.col("_type"), "verified"), field("email", F.col("mail"), F.lit("unknown"), "observed")))
    person = F.when(F.col("name") != "", F.concat_ws("\n", "name", "title"))
    each = m.withColumn("person", person).withColumn("x", F.explode_outer(both)).select("row", "business", "reason", "name", "title", "person", "source", "source_url", "x.*")
    key = ["business", "field", "value", "source", "_person"]
    each = each.withColumn("_person", F.coalesce("person", F.lit("")))
    new, late = each.filter("business IS NOT NULL AND field IS NOT NULL").select(*key, "row", F.lit(False).alias("_old")), F.lit(None).cast("long")
    old = observations.withColumn("_person", F.coalesce("person", F.lit(""))).select(*key, late.alias("row"), F.lit(True).alias("_old"))
    seen = new.unionByName(old).groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.min("row").alias("_first"), F.max("_old").alias("_old"))
    told = looked_up(each, {f"_{c}": F.col(c) for c in key}, seen)
    action = F.coalesce(_unmatched(F.col("reason")), F.when(F.col("field").isNull(), F.when(F.col("name") != "", "person").otherwise("empty")).when(F.col("_old") | (F.col("row") > F.col("_first")), "duplicate").otherwise("imported"))
    told = told.withColumn("action", action)
    new = told.filter("action = 'imported'")
    people = told.filter("business IS NOT NULL AND name <> ''").select("business", "name", "title").distinct().withColumns({"labeled_by": F.lit("byol"), "origin": F.lit("human_calling")})
    # Of several values of one business, kind and value the last row's stays.
    found = new.groupBy("business", F.col("field").alias("kind"), "value").agg(F.max_by("phone_type", "row").alias("phone_type")).withColumns({"label": F.lit("human_called_dm"), "tier": F.lit("unknown")})
    evidence = F.concat(F.lit("Operator workbook "), F.substring_index("source", ":", -1), F.lit(": "), F.col("name"), F.lit(" — "), F.col("title"))
    seen = new.select("business", "field", "value", "source", "person", "source_url", F.regexp_replace(evidence, "^[ —]+|[ —]+$", "").alias("evidence"), F.lit(1.0).alias("confidence"), "state")
    return Imported(told.select("row", "business", "reason", "field", "value", "action"), {"people": people, "contacts": found, "observations": seen})
