"""What a crawled page shows: addresses, profiles, booking, its age, systems in use, departments, headcount, triggers, people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .rules import decode_hidden_email

#: Parts of an address that show it to be none, hosts of link lists and social networks, booking platforms and words.
JUNK_HOSTS = ["example.", "sentry.", "wixpress.", "@2x", ".png", ".jpg", ".gif", ".webp"]
LINK_LISTS = ["linktr.ee", "beacons.ai", "linkin.bio", "lnk.bio", "w3w.co"]
SOCIAL_HOSTS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "tiktok.com", "youtube.com", "youtu.be", "pinterest.com", "threads.net", "snapchat.com", "whatsapp.com",
    "wa.me", "m.me", "t.me", "telegram.me", "bsky.app", "mastodon.social",
]
BOOKING_PLATFORMS = {
    "bookmygarage": ["bookmygarage"], "whocanfixmycar": ["whocanfixmycar"], "autodata": ["autodata"], "kwik-fit": ["kwik-fit", "kwikfit"], "calendly": ["calendly.com"],
    "acuity": ["acuityscheduling.com"], "squarespace-scheduling": ["squarespacescheduling.com", "squarespace-scheduling"], "setmore": ["setmore.com"],
    "simplybook": ["simplybook.me", "simplybook.it", "simplybook.com"], "fresha": ["fresha.com"], "treatwell": ["treatwell.co.uk", "treatwell.com", "treatwell.de", "treatwell.fr"],
}
BOOKING_WORDS = ["now", "online", "appointment", "service", "mot", "your", "slot", "test"]
#: Patterns of systems in use, departments, headcounts and triggers (by industry, the last for any other).
CRM = {"hubspot": r"js\.hs-scripts\.com|hubspot\.com|hs-analytics", "salesforce": r"salesforce\.com|force\.com|pardot\.com", "zoho": r"zoho\.com|zohocdn|zohopublic", "dynamics": r"dynamics\.com|crm\d*\.dynamics"}
ERP = {"odoo": r"\bodoo\b", "netsuite": r"\bnetsuite\b", "sap": r"\bsap\s*business\s*one\b|sapb1", "dynamics365": r"dynamics\s*365|business\s*central"}
OTHER_SYSTEMS = {
    "wms": r"\bWMS\b|warehouse management system", "tms": r"\bTMS\b|transport(ation)? management system", "ehr_emr": r"\bEHR\b|\bEMR\b|electronic (health|medical) record",
    "customer_portal": r"customer portal|client portal|patient portal", "project_management": r"\bjira\b|\basana\b|monday\.com|\bclickup\b|\bwrike\b",
}
DEPARTMENTS = "operations|logistics|supply chain|it|technology|engineering|finance|sales|marketing|hr|human resources|customer service|production|quality|procurement"
DEPARTMENT = rf"(?i)\b(?:head of|director of|vp of|manager,?|department of|our)\s+({DEPARTMENTS})\b|\b({DEPARTMENTS})\s+(?:team|department|division|manager|director)\b"
HEADCOUNT = r"(?i)\b(?:team of|over|more than|employs?|staff of)\s+(\d{2,5})\b|\b(\d{2,5})\+?\s+(?:employees|staff|people|team members)\b"
TRIGGERS = {
    "manufacturing": (
        r"factory expansion|new (production line|factory|plant)|erp (replacement|upgrade|implementation)|industry 4\.0|acquisition",
        r"production bottleneck|supply.chain disruption|quality (issue|problem)|equipment downtime|compliance requirement",
    ),
    "logistics": (
        r"fleet expansion|(new|expanded) warehouse|tms implementation|wms implementation|cross.border expansion|merger|acquisition",
        r"route optimi[sz]ation|shipment visibility|real.time tracking|manual dispatch|labou?r shortage",
    ),
    "healthcare": (
        r"(clinic|hospital) expansion|ehr moderni[sz]ation|emr moderni[sz]ation|digital transformation|telehealth",
        r"patient volume|scheduling inefficien|interoperability|accreditation|staff shortage",
    ),
    "professional services": (
        r"crm implementation|merger|acquisition|rapid (growth|expansion)|new office",
        r"resource allocation|manual (proposal|reporting)|utili[sz]ation|client portal|workflow standardi[sz]ation",
    ),
    "construction": (
        r"(major|large) (project|contract) (won|awarded)|bim adoption|digital transformation|regional expansion",
        r"project delay|subcontractor coordination|document management|equipment tracking|cost overrun|safety compliance",
    ),
    "saas": (
        r"funding round|series [a-d]\b|international expansion|soc ?2|iso ?27001|enterprise customers",
        r"technical debt|legacy (software|system)|api integration|infrastructure scaling|churn",
    ),
    "": (r"expansion|new (office|branch|location)|funding|acquisition|merger|major contract", r"hiring|growing team|new market|digital transformation"),
}
#: Titles, the shape of a name, words that no name holds, marks of reviews and of team pages.
TITLES = (
    r"(?i)\b(owner|co-owner|founder|co-founder|ceo|president|principal|partner|general manager|managing director|director|manager|gm|broker|realtor|supervisor|head of|chief"
    r"|proprietor|geschäftsführer|inhaber)\b"
)
NAME = r"\b([A-Z][a-z]{1,15}(?:[ \t]+[A-Z]\.)?(?:[ \t]+[A-Z][a-z]{1,20}){1,2})\b"
NO_NAMES = ["our team", "the team", "contact us", "about us", "read more", "learn more", "get in", "call us", "monday friday", "customer service", "quality service", "family owned"]
NO_NAME_WORDS = [
    "and", "the", "our", "your", "best", "prices", "price", "guaranteed", "team", "quality", "service", "services", "meet", "welcome", "about", "contact", "call", "today", "free",
    "estimate", "estimates", "shop", "auto", "repair", "hours", "open", "book", "now", "name", "email", "message", "phone", "subject",
]
REVIEW_STRONG = r"(?i)★|/5\b|\brating\b|\b\d+\s+(?:days?|weeks?|months?)\s+ago\b|\bi took\b|\bmy car\b|\bthey fixed\b|\bwould recommend\b"
REVIEW_WEAK = r"(?i)\breviews?\b|\bstars?\b|\brecommend\b|\bthank you\b|\bgreat service\b|\bgoogle\b|\btrustpilot\b"
TEAM_TEXT = r"(?i)\b(our|the|meet)\s+team\b|\bstaff\b|\babout us\b|\bour (people|crew)\b"
TEAM_URL = r"(?i)/(team|staff|about|people)\b"

AT_DOT = r"(?i)\b([A-Za-z0-9._%+\-]+)\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\sat\s)\s*([A-Za-z0-9\-]+)\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\sdot\s)\s*([A-Za-z]{2,})\b"
LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
FRAME = r"""(?is)<iframe\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']"""


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _firsts(xs: Column, key, most: int | None = None) -> Column:
    """Of elements of one key the first, in order, and at most so many of them; by one sort, whatever their number."""
    def first(keyed: Column) -> Column:
        new = F.filter(keyed, lambda x, j: (j == 0) | (F.get(keyed, j - 1)["k"] != x["k"]))
        at = F.array_sort(F.transform(new, lambda x: x["i"]))
        return F.transform(F.slice(at, 1, most) if most else at, lambda i: F.get(xs, i))

    return T.let(F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))), first)


def running(xs: Column, rounds: int = 7) -> Column:
    """Running sums of an array of up to 8 ** rounds numbers: each round adds what stands 1 to 7 steps of 8 ** k before."""
    for k in range(rounds):
        before = lambda a, i, n=8**k: sum((F.coalesce(F.get(a, i - F.lit(j * n)), F.lit(0)) for j in range(2, 8)), F.coalesce(F.get(a, i - F.lit(n)), F.lit(0)))
        step = lambda a, n=8**k, before=before: F.when(F.size(a) > n, F.transform(a, lambda x, i: x + before(a, i))).otherwise(a)
        xs = T.let(xs, step)
    return xs


def visible_text(html: Column) -> Column:
    """The text of markup; tags within a line join what they stand between, all others part it."""
    inline = F.regexp_replace(T.strip_noise(html), r"(?i)</?(a|b|em|font|i|small|span|strong|u)\b[^>]*>", "")
    return T.clean_name(F.regexp_replace(inline, r"(?s)<[^>]*>", " "))


def links(html: Column) -> Column:
    return F.transform(_all(html, LINK), lambda u: F.trim(u))


def emails(html: Column) -> Column:
    """An array of (email, label), label role or personal: deliberate addresses first, then as they appear.

    Links to addresses and hidden addresses count wherever they stand, plain
    ones outside scripts and styles. An address that ends another one goes if
    only raw markup shows it, or if the longer one is a role's. Null markup: null.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "&#64;|&#x40;|&commat;", "@"), "&amp;", "&")
    h, local = html, lambda e: F.substring_index(e, "@", 1)
    tidy = lambda a: F.transform(a, lambda e: F.lower(F.regexp_replace(e, r"""^[\s.,;:<>()\[\]"']+|[\s.,;:<>()\[\]"']+$""", "")))
    junk = lambda e: F.exists(F.array(*map(F.lit, JUNK_HOSTS)), lambda j: F.contains(e, j))
    sound = lambda a: F.array_distinct(F.filter(tidy(a), lambda e: e.rlike(f"^{T.EMAIL}$") & ~junk(e) & ~local(e).isin(T.PLACEHOLDERS)))
    deliberate = F.concat(_all(plain(h), r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']mailto:([^"'?]*)"""), F.array_compact(F.transform(_all(h, 'data-cfemail="([0-9a-fA-F]+)"'), decode_hidden_email)))
    spoken = lambda text: F.transform(_all(text, AT_DOT, 0), lambda m: F.regexp_replace(m, AT_DOT, "$1@$2.$3"))

    def found(text: Column) -> Column:
        shown = F.concat(_all(text, T.EMAIL, 0), spoken(text))
        return F.struct(sound(F.concat(deliberate, shown)).alias("sure"), sound(F.concat(deliberate, _all(plain(T.strip_noise(h)), T.EMAIL, 0), shown)).alias("all"))

    def kept(x: Column) -> Column:
        longer = lambda e: F.exists(x["all"], lambda o: (o != e) & F.endswith(o, e) & (~F.array_contains(x["sure"], e) | local(o).isin(T.ROLES)))
        return F.filter(x["all"], lambda e: ~longer(e))

    labelled = lambda e: F.struct(e.alias("email"), F.when(local(e).isin(T.ROLES), "role").otherwise("personal").alias("label"))
    return F.transform(T.let(T.let(plain(visible_text(h)), found), kept), labelled)


def socials(html: Column) -> Column:
    """The first link of each social network, without parameters: an array of (network, url)."""
    known = F.filter(F.transform(F.filter(links(html), lambda u: u.startswith("http")), lambda u: F.struct(T.social_network(u).alias("network"), F.substring_index(u, "?", 1).alias("url"))), lambda x: x["network"].isNotNull())
    return T.let(known, lambda xs: _firsts(xs, lambda x: x["network"]))


def _within(host: Column, hosts: list[str]) -> Column:
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (bare == h) | F.endswith(bare, F.concat(F.lit("."), h)))


def is_link_list(url: Column) -> Column:
    return _within(T.host(url), LINK_LISTS)


def first_real_link(base: Column, html: Column) -> Column:
    """The first link of a page that leads neither to a link list nor to a social network; null without one."""
    origin = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    full = lambda u: F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), u)).when(u.startswith("/"), F.concat(origin, u)).otherwise(F.concat(origin, F.lit("/"), u))
    open_ = F.filter(links(html), lambda u: ~u.rlike("^(#|mailto:|tel:|javascript:|$)"))
    real = F.filter(F.transform(open_, full), lambda u: (T.host(u) != "") & ~_within(T.host(u), LINK_LISTS + SOCIAL_HOSTS))
    return F.get(real, F.lit(0))


def booking_platform(html: Column) -> Column:
    """The platform that the first such link or frame leads to."""
    name = lambda u: F.coalesce(*[F.when(u.rlike("|".join(n.replace(".", r"\.") for n in needles)), k) for k, needles in BOOKING_PLATFORMS.items()])
    return F.get(F.array_compact(F.transform(F.concat(_all(html, LINK), _all(html, FRAME)), lambda u: name(F.lower(u)))), F.lit(0))


def booking_text(text: Column) -> Column:
    """Whether a word of booking stands within four words of "book"."""
    def shown(w: Column) -> Column:
        near = lambda i: F.concat(F.slice(w, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4))), F.slice(w, i + 2, 4))
        return F.exists(F.transform(w, lambda x, i: (x == "book") & F.arrays_overlap(near(i), F.array(*map(F.lit, BOOKING_WORDS)))), lambda b: b)

    return T.let(F.transform(_all(text, "[A-Za-z']+", 0), F.lower), shown)


def signals(html: Column, url: Column, year: int, stale_after: int) -> dict[str, Column]:
    """copyright_year and stale_site (null without a year), careers, booking_source (null: no booking is shown)."""
    latest = F.array_max(F.transform(_all(html, r"(?i)(?:©|&copy;|copyright)\D{0,20}(20\d{2})"), lambda y: y.cast("int")))
    platform = booking_platform(html)
    hint = booking_text(visible_text(html)) | html.rlike("(?i)schedule (an )?appointment")
    return {
        "copyright_year": latest, "stale_site": latest < year - stale_after, "careers": url.rlike(r"/(careers?|jobs?)\b"),
        "booking_source": F.when(platform.isNotNull(), F.concat(F.lit("platform:"), platform)).when(hint, "regex"),
    }


def _first_of(patterns: dict[str, str], c: Column) -> Column:
    return F.coalesce(*[F.when(c.rlike(f"(?i){p}"), k) for k, p in patterns.items()])


def office_suite(mx: Column) -> tuple[Column, Column]:
    """Whether mail exchanges show Microsoft 365 (yes, no, null) and how sure that is; another provider only suggests it."""
    joined = F.lower(F.array_join(mx, " "))
    yes, other = F.contains(joined, F.lit("outlook")), joined.rlike("google|aspmx")
    return F.when(yes, "yes").when(other, "no"), F.when(yes, "CONFIRMED").when(other, "INFERRED").otherwise("UNKNOWN")


def crm(html: Column) -> Column:
    return _first_of(CRM, html)


def erp(html: Column, text: Column) -> Column:
    return _first_of(ERP, F.concat_ws(" ", html, text))


def other_systems(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), k) for k, p in OTHER_SYSTEMS.items()]))


def departments(text: Column) -> Column:
    """Distinct departments in order; technology counts as it."""
    name = lambda m: F.lower(F.coalesce(T.absent(F.regexp_extract(m, DEPARTMENT, 1)), F.regexp_extract(m, DEPARTMENT, 2)))
    return F.array_distinct(F.transform(_all(text, DEPARTMENT, 0), lambda m: F.when(name(m) == "technology", "it").otherwise(name(m))))


def headcount(text: Column) -> Column:
    """The first headcount from 1 to 100,000 that a text gives."""
    n = lambda m: F.coalesce(T.absent(F.regexp_extract(m, HEADCOUNT, 1)), F.regexp_extract(m, HEADCOUNT, 2)).cast("int")
    return F.get(F.filter(F.transform(_all(text, HEADCOUNT, 0), n), lambda x: x.between(1, 100_000)), F.lit(0))


def headcount_range(n: Column) -> Column:
    return F.when(n.isNull(), "unknown").when(n < 20, "<20").when(n < 50, "20-49").when(n <= 500, "50-500").otherwise(">500")


def windows(text: Column, pattern: str, most: int | None = None) -> Column:
    """(start from 0, match) of a pattern's matches, the first ones where most is given; linear in the text."""
    def placed(x: Column) -> Column:
        found = F.slice(x["found"], 1, most) if most else x["found"]
        steps = F.transform(found, lambda m, i: F.length(F.get(x["parts"], i)) + F.coalesce(F.length(F.get(x["found"], i - 1)), F.lit(0)))
        return T.let(running(steps), lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), m.alias("match"))))

    return T.let(F.struct(F.split(text, pattern, -1).alias("parts"), _all(text, pattern, 0).alias("found")), placed)


#: Characters of a piece of a text, and those that it repeats of its neighbours; a passage is cut from its piece, as a cut walks from the beginning.
PIECE, PAD = 2048, 512


def pieces(text: Column) -> Column:
    each = lambda i: F.substring(text, F.greatest(i * PIECE - PAD, F.lit(0)) + 1, F.lit(PIECE + 2 * PAD))
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), each)


def passage(pieces: Column, start: Column, length: Column) -> Column:
    """The characters from start (from 0) on, up to PAD of them, by the pieces of a text."""
    i = F.floor(start / PIECE).cast("int")
    return F.substring(F.get(pieces, i), start - F.greatest(i * PIECE - PAD, F.lit(0)) + 1, length)


def _around(text: Column, w: Column, before: int, after: int) -> Column:
    start = F.greatest(w["start"] - before, F.lit(0))
    return F.substring(text, start + 1, w["start"] + F.length(w["match"]) + after - start)


def triggers(text: Column, industry: Column, most: int = 3) -> Column:
    """At most so many (text, strength, date), strong ones first; the date is the latest year beside a match, null without one."""
    def of(t: Column, pattern: str, strength: str) -> Column:
        year = lambda s: F.array_max(_all(s, r"\b(20\d{2})\b"))
        snippets = F.transform(windows(t, f"(?i){pattern}", most), lambda w: T.clean_name(_around(t, w, 80, 80)))
        return F.transform(snippets, lambda s: F.struct(F.substring(s, 1, 240).alias("text"), F.lit(strength).alias("strength"), F.concat(year(s), F.lit("-01-01")).alias("date")))

    def found(t: Column) -> Column:
        both = {k: F.concat(of(t, strong, "strong"), of(t, medium, "medium")) for k, (strong, medium) in TRIGGERS.items()}
        name = F.lower(F.coalesce(industry, F.lit("")))
        return F.slice(F.coalesce(*[F.when(name == k, v) for k, v in both.items()], both[""]), 1, most)

    return T.let(text, found)


def freshness(date: Column, today: Column) -> Column:
    days = F.datediff(today.cast("date"), F.try_to_date(F.substring(date, 1, 10)))
    return F.when(days.isNull(), "UNKNOWN").when(days <= 90, "VERY_STRONG").when(days <= 180, "STRONG").when(days <= 365, "MEDIUM").otherwise("LOW")


def review_noise(window: Column) -> Column:
    """Whether a passage is a review's: one strong mark or two weak ones."""
    return window.rlike(REVIEW_STRONG) | (F.regexp_count(window, F.lit(REVIEW_WEAK)) >= 2)


def people(text: Column, url: Column, most: int = 8) -> Column:
    """Names beside titles: an array of (name, title, context), context team or other. A name behind its title is preferred to one before it."""
    good = lambda zone: F.filter(_all(zone, NAME), lambda n: ~F.lower(n).isin(NO_NAMES) & ~n.rlike(TITLES) & ~F.exists(F.split(F.lower(n), r"\s+"), lambda t: t.isin(NO_NAME_WORDS)))

    def found(x: Column) -> Column:
        cut = lambda start, end: passage(x["pieces"], start, F.least(end - start, F.lit(PAD)))
        end = lambda w: w["start"] + F.length(w["match"])
        after = lambda w: F.get(good(cut(end(w), end(w) + 60)), F.lit(0))
        zone = lambda w: cut(F.greatest(w["start"] - 60, F.lit(0)), w["start"])
        name = lambda w: F.coalesce(after(w), F.try_element_at(good(zone(w)), F.lit(-1)))
        around = lambda w: cut(F.greatest(w["start"] - 120, F.lit(0)), end(w) + 120)
        team = lambda w: around(w).rlike(TEAM_TEXT) | F.coalesce(url.rlike(TEAM_URL), F.lit(False))
        hits = F.filter(x["hits"], lambda w: ~review_noise(around(w)))
        people = F.transform(hits, lambda w: F.struct(name(w).alias("name"), F.initcap(w["match"]).alias("title"), F.when(team(w), "team").otherwise("other").alias("context")))
        return F.filter(people, lambda p: p["name"].isNotNull())

    parted = T.let(text, lambda t: F.struct(pieces(t).alias("pieces"), windows(t, TITLES).alias("hits")))
    return T.let(T.let(parted, found), lambda ps: _firsts(ps, lambda p: F.lower(p["name"]), most))
