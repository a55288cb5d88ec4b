"""Column functions for listing cards, people's names, addresses to guess and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
#: What outcomes are called in imported lists.
OUTCOMES = {"vm": "voicemail", "left vm": "voicemail", "na": "no_answer", "no answer": "no_answer", "ni": "not_interested", "not interested": "not_interested", "cb": "callback", "call back": "callback"}
ACCENTS = ("àáâäãåçèéêëìíîïñòóôöõùúûüý", "aaaaaaceeeeiiiinooooouuuuy")


def rating_line(line: Column) -> tuple[Column, Column]:
    """Rating and number of reviews of a line such as "4.5 (1,234)"; null where it isn't one."""
    pattern = r"^(\d(?:\.\d)?)\s*\(?([\d,]+)?\)?$"
    ok = line.rlike(pattern)
    rating = F.when(ok, F.regexp_extract(line, pattern, 1).try_cast("double"))
    reviews = F.when(ok, F.regexp_replace(F.regexp_extract(line, pattern, 2), ",", "").try_cast("long"))
    return rating, reviews


def hex_to_decimal(c: Column) -> Column:
    """An unsigned number in hex, of up to 26 digits, as decimal text."""
    high = F.conv(F.substring(c, F.lit(1), F.length(c) - 10), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.right(c, F.lit(10)), 16, 10).cast("decimal(13,0)")
    wide = (high * F.lit(1 << 40).cast("decimal(13,0)") + low).cast("string")
    return F.when(F.length(c) <= 16, F.conv(c, 16, 10)).otherwise(wide)


def unwrap_redirect(url: Column) -> Column:
    """The target of a redirect's q parameter, else the address itself."""
    q = F.regexp_extract(url, r"[?&]q=([^&#]*)", 1)
    return F.when(q != "", F.url_decode(q)).otherwise(url)


def last_segment_phone(line: Column) -> Column:
    """The last part between dots if it has six digits or more."""
    last = F.trim(F.element_at(F.split(line, "·"), -1))
    return F.when(F.length(F.regexp_replace(last, r"\D", "")) >= 6, last)


def format_hours(hours: Column) -> Column:
    """A map from days to lists of times as one line in the order of the week."""
    day = lambda d: F.when(F.size(F.element_at(hours, F.lit(d))) > 0, F.concat(F.lit(f"{d[:3]} "), F.array_join(F.element_at(hours, F.lit(d)), ", ")))
    return F.concat_ws(" | ", *[day(d) for d in DAYS])


def ascii_fold(c: Column) -> Column:
    return F.translate(F.lower(c), *ACCENTS)


def shape_of(local: Column) -> Column:
    """How a local part is built: first.last, f.last or first_last; null for others."""
    return F.when(local.rlike(r"^[a-z]{2,}\.[a-z]{2,}$"), "first.last").when(local.rlike(r"^[a-z]\.[a-z]{2,}$"), "f.last").when(local.rlike(r"^[a-z]{2,}_[a-z]{2,}$"), "first_last")


def build_local(shape: Column, first: Column, last: Column) -> Column:
    f, l = ascii_fold(first), ascii_fold(last)
    return F.when(shape == "first.last", F.concat(f, F.lit("."), l)).when(shape == "f.last", F.concat(F.substring(f, 1, 1), F.lit("."), l)).when(shape == "first_last", F.concat(f, F.lit("_"), l))


def outcome(c: Column) -> Column:
    """The canonical name of an outcome: by synonym, else as a slug."""
    key = F.trim(F.lower(c))
    pairs = [F.lit(x) for kv in OUTCOMES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.trim(F.regexp_replace(key, "[^a-z0-9]+", "_"), F.lit("_")))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def near_words(text: Column, a: str, b: str, within: int) -> Column:
    """Whether two words stand within so many words of each other, either first: one pass of an expression."""
    gap = rf"(?:[^a-z0-9]+[a-z0-9]+){{0,{within - 1}}}[^a-z0-9]+"
    either = [rf"(?<![a-z0-9]){x}{gap}{y}(?![a-z0-9])" for x, y in ((a, b), (b, a))]
    return F.lower(text).rlike("|".join(either))
