"""Column functions for what a listing's profile holds: whole cards, appointments, order links, names in replies, places and trades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cards as K
from .text import let

#: The patterns of a card's lines and address, of a sign-off, and words that are no name behind one.
OPEN = r"(?i)^(open|closed|opens)\b"
RATING = r"^(\d(?:\.\d)?)\s*\(?([\d,]+)?\)?$"
CID = r"!1s0x[0-9a-f]+:0x([0-9a-f]+)"
PLACE = r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"
SIGN_OFF = r"(?:[Tt]hanks|[Tt]hank you|[Rr]egards|[Cc]heers|(?:[Bb]est |[Ww]arm )?[Ww]ishes)[,]?\s+([A-Z][a-zA-Z']+)"
NO_NAMES = [
    "team", "thanks", "thank", "regards", "regard", "kind", "best", "warm", "the", "staff", "service", "you",
    "customer", "customers", "car", "cars", "ms", "mr", "mrs", "dr", "mot", "again", "everyone", "all",
    "guys", "sir", "madam",
]

ABOUT = "array<struct<id:string,name:string,options:array<struct<name:string,enabled:boolean>>>>"


def _segments(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, "·"), lambda x: F.trim(x)), lambda x: x != "")


def card(name: Column, href: Column, lines: Column, website: Column) -> Column:
    """A listing card as a struct; null for one without a name. lines: array of text lines in their order."""
    none = F.array().cast("array<string>")

    def read(xs: Column) -> Column:
        rated = F.get(F.filter(xs, lambda l: l.rlike(RATING)), F.lit(0))
        about = _segments(F.get(F.filter(xs, lambda l: l.contains("·") & ~l.rlike(OPEN) & (F.size(_segments(l)) > 0)), F.lit(0)))
        state = _segments(F.get(F.filter(xs, lambda l: l.rlike(OPEN)), F.lit(0)))
        last = F.try_element_at(state, F.lit(-1))
        rating, reviews = K.rating_line(rated)
        spot = lambda group: F.regexp_extract(href, PLACE, group).try_cast("double")
        code = F.regexp_extract(href, CID, 1)
        return F.struct(
            F.trim(name).alias("name"), F.when(code != "", K.hex_to_decimal(code)).alias("cid"), spot(1).alias("lat"), spot(2).alias("lng"), rating.alias("rating"), reviews.alias("reviews"),
            F.get(about, F.lit(0)).alias("category"), F.when(F.size(about) > 1, F.try_element_at(about, F.lit(-1))).alias("street"), F.get(state, F.lit(0)).alias("open_state"),
            F.when((F.size(state) > 1) & (F.length(F.regexp_replace(last, r"\D", "")) >= 6), last).alias("phone"), K.unwrap_redirect(website).alias("website"),
        )

    return F.when(F.trim(F.coalesce(name, F.lit(""))) != "", let(F.coalesce(lines, none), read))


def locality(text: Column, area: Column) -> tuple[Column, Column]:
    """Town and country that a search was for: from its area, else from what stands behind the last " in " of its text."""
    said = F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(" in ")), F.try_element_at(F.split(text, " in "), F.lit(-1))).otherwise("")
    whole = F.trim(F.coalesce(F.when(F.trim(area) != "", area), said))
    parts = F.filter(F.transform(F.split(whole, ","), lambda x: F.trim(x)), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-1)))


def full_address(street: Column, town: Column) -> Column:
    return F.when(F.coalesce(street, F.lit("")) != "", F.concat_ws(", ", street, F.when(town != "", town)))


def split_address(whole: Column) -> Column:
    """Parts of a structured address (borough, street, city, state, postal_code, country), empty ones as null."""
    part = lambda k: F.when(F.trim(whole[k]) != "", whole[k])
    street = F.concat_ws(" ", part("borough"), part("street"))
    return F.struct(F.when(street != "", street).alias("street"), part("city").alias("city"), part("state").alias("region"), part("postal_code").alias("postal"), part("country").alias("country"))


def map_category(raw: Column, names: Column, wanted: list[str]) -> tuple[Column, Column]:
    """The category that goes with a wanted one (either holds the other), else the first, and all of them."""
    low = F.array(*[F.lit(w.lower()) for w in wanted]).cast("array<string>")
    clean = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    first = F.trim(raw)
    every = F.when(F.coalesce(first, F.lit("")).isin("") | F.array_contains(clean, first), clean).otherwise(F.concat(F.array(first), clean))
    fits = F.filter(every, lambda c: F.exists(low, lambda w: F.contains(F.lower(c), w) | F.contains(w, F.lower(c))))
    return F.coalesce(F.get(fits, F.lit(0)), F.get(every, F.lit(0))), every


def appointments(about: Column) -> Column:
    """required, recommended or none by a profile's attributes (ABOUT); the first option of a group that says so decides."""
    groups = F.filter(F.coalesce(about, F.array().cast(ABOUT)), lambda g: F.lower(F.coalesce(F.when(g["id"] != "", g["id"]), g["name"], F.lit(""))).rlike("planning|appointment"))
    options = F.flatten(F.transform(groups, lambda g: F.coalesce(g["options"], F.array().cast("array<struct<name:string,enabled:boolean>>"))))
    label = lambda o: F.lower(F.coalesce(o["name"], F.lit("")))
    said = F.filter(options, lambda o: F.coalesce(o["enabled"], F.lit(True)) & label(o).rlike("required|recommended"))
    return F.when(F.size(said) == 0, "none").when(label(F.get(said, F.lit(0))).contains("required"), "required").otherwise("recommended")


def order_links(orders: Column) -> Column:
    """The links of a profile's ways to order: array of structs with a link."""
    return F.filter(F.transform(orders, lambda o: o["link"]), lambda x: F.coalesce(x, F.lit("")) != "")


def signed_names(replies: Column, business: Column) -> Column:
    """First names that sign an owner's replies (array of (reviewer, text)), each once, in order.

    Only the last sign-off counts, within the last 60 characters; the reviewer's
    own first name, words of the business's name, words in capitals and the
    like are none.
    """
    own = F.transform(F.regexp_extract_all(F.coalesce(business, F.lit("")), F.lit(r"([A-Za-z']+)"), F.lit(1)), F.lower)

    def signed(r: Column) -> Column:
        text = F.coalesce(r["text"], F.lit(""))
        names = F.regexp_extract_all(text, F.lit(SIGN_OFF), F.lit(1))
        name = F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))
        found = F.concat(F.try_element_at(F.regexp_extract_all(text, F.lit(SIGN_OFF), F.lit(0)), F.lit(-1)), F.try_element_at(F.split(text, SIGN_OFF), F.lit(-1)))
        reviewer = F.lower(F.get(F.split(F.trim(F.coalesce(r["reviewer"], F.lit(""))), " "), F.lit(0)))
        bad = F.lower(name).isin(NO_NAMES) | F.array_contains(own, F.lower(name)) | ((F.length(name) > 1) & (name == F.upper(name))) | (F.lower(name) == reviewer)
        return F.when((name != "") & (F.length(found) <= 60) & ~bad, name)

    return F.array_distinct(F.array_compact(F.transform(replies, signed)))


def display_phone(e164: Column) -> Column:
    """A number that no spreadsheet takes for a quantity: spaced for North America and mobiles of Great Britain, else as it is."""
    return F.when(
        e164.rlike(r"^\+1\d{10}$"), F.regexp_replace(e164, r"^\+1(\d{3})(\d{3})(\d{4})$", "+1 $1-$2-$3")
    ).otherwise(F.regexp_replace(F.coalesce(e164, F.lit("")), r"^\+44(7\d{3})(\d{6})$", "+44 $1 $2"))


def any_mobile(phones: Column) -> Column:
    """Whether a number may be a mobile one: any of North America, where they look alike, or of Great Britain's mobile range."""
    return F.exists(F.coalesce(phones, F.array().cast("array<string>")), lambda p: F.coalesce(p.rlike(r"^\+1[2-9]\d{2}[2-9]\d{6}$|^\+447[1-57-9]\d{8}$"), F.lit(False)))
