"""Column functions for small decisions: keyed digests, names, import keys, site and sender states, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cards import ascii_fold
from .text import let

#: Particles that belong to a surname, and words that show a name to be a company's.
PARTICLES = ["de", "del", "della", "der", "van", "von", "da", "di", "du", "la", "le", "el", "bin", "ibn", "al", "st", "mac", "mc", "o"]
COMPANY_WORDS = ["ltd", "limited", "llc", "llp", "plc", "inc", "gmbh", "corp", "corporation", "co", "company", "group", "holdings", "services", "solutions", "trading"]


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest in lower-case hex; keys of over 64 bytes aren't taken."""
    if len(key) > 64:
        raise ValueError("the key is longer than a block")
    pad = lambda byte: F.lit(bytes(k ^ byte for k in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def header_key(c: Column) -> Column:
    """A column's heading without all that isn't a letter or digit."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def phone_key(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^+0-9]", "")


def domain_key(c: Column) -> Column:
    """The host of an address or bare domain, in lower case, without port and www."""
    text = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    return F.regexp_replace(F.regexp_extract(full, r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


def percent(n: Column, total: Column) -> Column:
    """A share as a whole percentage, halves to the even one; 0% of nothing."""
    return F.when(total != 0, F.concat(F.bround(100.0 * n / total, 0).cast("long").cast("string"), F.lit("%"))).otherwise("0%")


def email_confidence(affinity: Column, tier: Column) -> Column:
    own = F.when(F.coalesce(tier, F.lit("")) != "", F.concat(F.lit("own domain, "), tier, F.lit(" mailbox"))).otherwise("own domain")
    return (
        F.when(affinity == "own_domain", own)
        .when(affinity == "freemail_linked", "personal freemail, linked to owner name")
        .when(affinity == "freemail_unlinked", "personal freemail, UNLINKED — do not mail")
        .when(affinity == "foreign", "foreign domain — not the business's own")
        .otherwise("none")
    )


def site_is_dead(error: Column, status: Column) -> Column:
    """An error other than a refusal to robots, or a status from 400 on."""
    failed = F.coalesce(error, F.lit("")) != ""
    return F.when(error == "robots-disallowed", False).otherwise(failed | F.coalesce(status >= 400, F.lit(False)))


def age_days(started: Column, now: Column) -> Column:
    """Days since a start given as YYYY-MM-DDTHH:MM:SSZ; -1 without one."""
    at = F.when(started.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(F.regexp_replace(started, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss ")))
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0, F.lit(-1.0))


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (south, north, west, east) share a point; false where a side is missing."""
    return F.coalesce((a[0] <= b[1]) & (b[0] <= a[1]) & (a[2] <= b[3]) & (b[2] <= a[3]), F.lit(False))


def distinct_places(lat: tuple[Column, Column], lon: tuple[Column, Column], overlap: Column, label: tuple[Column, Column]) -> Column:
    """Whether two hits are different places: near ones whose boxes overlap aren't; else labels decide, then distance."""
    south, east = F.abs(lat[0] - lat[1]), F.abs(lon[0] - lon[1])
    near = F.coalesce((south <= 0.15) & (east <= 0.15), F.lit(False))
    return F.when(near & overlap, False).when(~label[0].eqNullSafe(label[1]), True).otherwise(F.coalesce((south > 0.3) | (east > 0.3), F.lit(True)))


def qualified_area(area: Column, country: Column) -> Column:
    """An area with its country's name behind it, unless it holds that already."""
    return F.when(F.contains(F.lower(area), F.lower(country)), area).otherwise(F.concat(area, F.lit(", "), country))


def person_name(name: Column) -> tuple[Column, Column]:
    """First and last name of a person, particles joined to the last; nulls for single words and companies."""
    words = F.filter(F.transform(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda t: F.regexp_replace(ascii_fold(t), "[^a-z0-9]", "")), lambda t: t != "")
    person = (F.size(words) >= 2) & ~F.exists(words, lambda t: t.isin(COMPANY_WORDS))
    rest = F.reverse(F.slice(words, 2, 1000))
    # From the back: the last word, and particles as long as they stand directly before it.
    last = F.aggregate(
        rest, F.struct(F.lit("").alias("s"), F.lit(True).alias("go")),
        lambda acc, t: F.struct(F.when(acc["go"] & ((acc["s"] == "") | t.isin(PARTICLES)), F.concat(t, acc["s"])).otherwise(acc["s"]).alias("s"), (acc["go"] & ((acc["s"] == "") | t.isin(PARTICLES))).alias("go")),
        lambda acc: acc["s"],
    )
    return F.when(person, F.get(words, F.lit(0))), F.when(person, last)


def identity_complete(name: Column, email: Column, postal: Column, privacy: Column, mailto: Column, url: Column) -> Column:
    """Whether a sender has all that a compliant message needs."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return there(name) & there(email) & there(postal) & there(privacy) & (there(mailto) | there(url))


def message_footer(name: Column, email: Column, postal: Column, privacy: Column, mailto: Column, url: Column, business: Column) -> Column:
    """The lines behind a message: sender, address, where the business was found, and how to opt out."""
    there = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    ways = F.concat_ws(" or ", F.concat(F.lit("mailto:"), there(mailto)), there(url))
    found = F.concat(F.lit("We found "), business, F.lit(" in public business listings; see "), F.coalesce(privacy, F.lit("")), F.lit(". Reply STOP to opt out."))
    return F.concat_ws("\n", F.lit(""), F.lit("--"), F.coalesce(there(name), email), there(postal), found, F.when(ways != "", F.concat(F.lit("To opt out: "), ways)).otherwise("To opt out, reply STOP."))


def decode_hidden_email(code: Column) -> Column:
    """An address hidden as hex, each byte xored with the first one; null where none comes out. ASCII only."""
    # let: the code may be a long expression, and each of its bytes is looked at.
    byte = lambda c, i: F.conv(F.substring(c, 2 * i + F.lit(1), F.lit(2)), 16, 10).cast("int")
    places = lambda c: F.sequence(F.lit(1), F.greatest(F.length(c) / 2 - 1, F.lit(1)).cast("int"))
    plain = lambda c: let(byte(c, F.lit(0)), lambda key: F.array_join(F.transform(places(c), lambda i: F.char(byte(c, i).bitwiseXOR(key))), ""))
    address = lambda p: F.when(p.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), p)
    return let(code, lambda c: F.when(c.rlike("^([0-9A-Fa-f]{2}){2,}$"), let(plain(c), address)))


def classify_phone(phone: Column, context: Column, main: Column) -> Column:
    """switchboard or direct by the words beside a number, mobile by its range (Great Britain), main_line if it is the business's own."""
    beside = F.lower(F.coalesce(context, F.lit("")))
    return (
        F.when(beside.rlike("switchboard|reception|operator"), "switchboard")
        .when(beside.rlike(r"direct|extension|ext\."), "direct")
        .when(phone.rlike(r"^\+447[1-57-9]\d{8}$"), "mobile")
        .when(phone == main, "main_line")
        .otherwise("unknown")
    )
