"""Phone numbers by numbering plans: which country, whether a number can be dialled, what kind it is, and numbers in text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Plan:
    """code: of the country; trunk: what stands before national numbers at home; kinds: pattern of national numbers by kind, the first that holds counts."""

    code: str
    trunk: str
    kinds: dict[str, str]


#: Area codes of Canada; those of freephone and premium numbers in North America.
CANADA = (
    "204|226|236|249|250|257|263|289|306|343|354|365|367|368|382|387|403|416|418|428|431|437|438|450|468|474|506|514|519|548|579|581|584|587|604|613|639|647|672|683|705|709|742|753|778"
    "|780|782|807|819|825|867|873|879|902|905|942"
)
FREE = "800|833|844|855|866|877|888"

#: Numbering plans. Kinds: toll_free, premium, shared, mobile, fixed, either (fixed or mobile, which numbers there don't tell), voip.
PLANS = {
    "US": Plan("1", "1", {"toll_free": rf"(?:{FREE})[2-9]\d{{6}}", "premium": r"900[2-9]\d{6}", "either": r"[2-9](?:[02-8]\d|1[02-9])[2-9]\d{6}"}),
    "CA": Plan("1", "1", {"toll_free": rf"(?:{FREE})[2-9]\d{{6}}", "premium": r"900[2-9]\d{6}", "either": rf"(?:{CANADA})[2-9]\d{{6}}"}),
    "GB": Plan("44", "0", {
        "toll_free": r"80[08]\d{7}|800\d{6}|8001111", "premium": r"(?:8[47][1-3]|9[018]\d)\d{7}", "mobile": r"7(?:[1-57-9]\d\d|624)\d{6}", "voip": r"56\d{8}", "shared": r"3[0347]\d{8}",
        "fixed": r"2[03489]\d{8}|1[1-9]1\d{7}|11[3-8]\d{7}|1[2-9]\d{8}|1[2-9]\d{7}",
    }),
    "AU": Plan("61", "0", {"toll_free": r"180(?:0\d{3}|2)\d{3}", "premium": r"190[0-26]\d{6}", "shared": r"13(?:00\d{6}|\d{4})", "mobile": r"4\d{8}", "fixed": r"[2378]\d{8}"}),
    "DE": Plan("49", "0", {"toll_free": r"800\d{7,12}", "premium": r"(?:137[7-9]|900[135])\d{5,7}", "shared": r"180\d{5,11}", "mobile": r"15\d{9}|1(?:6[023]|7\d)\d{7,8}", "voip": r"32\d{9,10}", "fixed": r"[2-9]\d{4,11}"}),
    "FR": Plan("33", "0", {"toll_free": r"80[0-5]\d{6}", "premium": r"8[129]\d{7}", "mobile": r"[67]\d{8}", "voip": r"9\d{8}", "fixed": r"[1-5]\d{8}"}),
    "ES": Plan("34", "", {"toll_free": r"[89]00\d{6}", "premium": r"80[367]\d{6}", "shared": r"90[12]\d{6}", "mobile": r"6\d{8}|7[1-9]\d{7}", "fixed": r"[89][1-8]\d{7}"}),
    "IT": Plan("39", "", {"toll_free": r"80(?:0\d{3}|3)\d{3}", "premium": r"89[259]\d{3,6}", "shared": r"84[078]\d{3,6}", "mobile": r"3[1-9]\d{7,8}", "fixed": r"0[1-9]\d{4,9}"}),
    "NL": Plan("31", "0", {"toll_free": r"800\d{4,7}", "premium": r"90[069]\d{4,7}", "mobile": r"6[1-58]\d{7}", "voip": r"8[58]\d{7}", "fixed": r"(?:1[0135-8]|2[02-69]|3[0-68]|4[0135-9]|5\d|7[0-9])\d{7}"}),
    "EG": Plan("20", "0", {"toll_free": r"800\d{7}", "premium": r"900\d{7}", "mobile": r"1[0-25]\d{8}", "fixed": r"2[2-4]\d{7}|3\d{7}|(?:1[35]|4[05-8]|5[05-7]|6[24-9]|8[2468]|9[2-7])\d{7}"}),
    "AE": Plan("971", "0", {"toll_free": r"800\d{2,9}", "premium": r"900[02]\d{5}", "shared": r"(?:600[25]|700[05])\d{5}", "mobile": r"5[024-68]\d{7}", "fixed": r"[2-4679][2-8]\d{6}"}),
    "SA": Plan("966", "0", {"toll_free": r"800\d{7}", "premium": r"925\d{6}", "shared": r"92\d{7}", "mobile": r"5[013-9]\d{7}", "fixed": r"1[1-7]\d{7}"}),
    "MX": Plan("52", "", {"toll_free": r"8(?:00|88)\d{7}", "premium": r"900\d{7}", "either": r"[2-9]\d{9}"}),
    "BR": Plan("55", "0", {"toll_free": r"800\d{6,7}", "premium": r"[359]00\d{6,7}", "shared": r"(?:30[03]\d{3}|4(?:0(?:0\d|20)|370))\d{4}", "mobile": r"[1-9][1-9]9\d{8}", "fixed": r"[1-9][1-9][2-5]\d{7}"}),
    "IN": Plan("91", "0", {"toll_free": r"1800\d{6,9}", "shared": r"1860\d{7}", "fixed": r"(?:11|2[02]|33|4[04]|79|80)[2-7]\d{7}", "mobile": r"[6-9]\d{9}", "either": r"[1-5]\d{9}"}),
    "NZ": Plan("64", "0", {"toll_free": r"508\d{6,7}|80\d{6,8}", "premium": r"900\d{5,7}", "mobile": r"2[0-27-9]\d{6,8}", "fixed": r"[34679]\d{7}"}),
    "IE": Plan("353", "0", {"toll_free": r"1800\d{6}", "premium": r"15[1-8]\d{7}", "shared": r"18[59]0\d{6}", "voip": r"76\d{7}", "mobile": r"8[2-9]\d{7}", "fixed": r"(?:1|21)\d{7}|[24-79]\d{6,8}"}),
}
#: Country codes that are given out, of one, two and three digits.
CODES = (
    r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2-6]\d|29[017-9]|35\d|37\d|38[0-35-79]|42[013]|50\d|59\d|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[0138]|88[0-36-8]|96[0-8]"
    r"|97[0-79]|99[2-68]"
)
#: What stands before numbers of other countries, by region; elsewhere 00.
ABROAD = {"US": "011", "CA": "011", "AU": "0011"}

#: What may be numbers in text: runs of digits with the usual marks between them; a run that is none as a whole is parted.
IN_TEXT, PARTED = r"[+(]{0,2}[0-9][0-9(). /\-]{5,}[0-9]", r" {2,}|/| - "
EXTENSION = r"(?i)(?:;ext=|\s*(?:extension|ext\.?|x|#|~)\s*)\d{1,7}\s*$"


def digits(raw: Column) -> Column:
    """The digits of a number, without its extension, the marks of tel: links and (0) behind a country code; a plus stays in front."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^tel:", ""), r"(?i);(?!ext=).*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, EXTENSION, ""), r"^(\(?\+[\d\s().-]*?)\(0\)", "$1")
    plus = F.when(bare.rlike(r"^[(\s]*[+＋]"), "+").otherwise("")
    return F.concat(plus, F.regexp_replace(F.translate(bare, "０１２３４５６７８９", "0123456789"), r"[^0-9]", ""))


def kind_in(region: str, national: Column) -> Column:
    """The kind of a national number by a region's plan; null if the plan has none for it."""
    return F.coalesce(*[F.when(national.rlike(f"^(?:{p})$"), k) for k, p in PLANS[region].kinds.items()])


def _found(region: str, national: Column) -> Column:
    """A struct of a national number by a plan; null if it isn't one."""
    plan = PLANS[region]
    kind = kind_in(region, national)
    whole = F.concat(F.lit("+" + plan.code), national)
    return F.when(kind.isNotNull(), F.struct(F.lit(region).alias("region"), F.lit(plan.code).alias("code"), whole.alias("e164"), kind.alias("kind")))


def _without(prefix: str, c: Column) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 20))


def _at_home(region: str, d: Column) -> Column:
    """A number written without its country: without the trunk prefix, as it is, or behind its country's code."""
    plan = PLANS[region]
    tries = [_without(plan.trunk, d)] if plan.trunk else []
    tries += [d, _without(plan.code, d)]
    if plan.trunk:
        tries.append(_without(plan.code + plan.trunk, d))
    own = "CA" if region == "US" else "US" if region == "CA" else None
    found = [_found(r, t) for t in tries for r in ((["CA", "US"] if own else [region]))]
    return F.coalesce(*found)


def _abroad(d: Column) -> Column:
    """A number that begins with a country code: by its plan, with or without the trunk prefix; of other countries by its length."""
    found = []
    for region in sorted(PLANS, key=lambda r: (r != "CA", r)):  # Canada's area codes come before those of the whole plan
        rest = _without(PLANS[region].code, d)
        tries = [rest] + ([_without(PLANS[region].trunk, rest)] if PLANS[region].trunk else [])
        if region == "MX":
            tries.append(_without("1", rest))  # mobile numbers had a 1 there
        found += [F.when(d.startswith(PLANS[region].code), _found(region, t)) for t in tries]
    planned = "|".join(sorted({p.code for p in PLANS.values()}))
    code = F.regexp_extract(d, rf"^({CODES})", 1)
    other = F.when((code != "") & ~code.rlike(f"^(?:{planned})$") & F.length(d).between(8, 15), F.struct(F.lit(None).cast("string").alias("region"), code.alias("code"), F.concat(F.lit("+"), d).alias("e164"), F.lit("unknown").alias("kind")))
    return F.coalesce(*found, other)


def parsed(raw: Column, region: str | Column | None = None) -> Column:
    """(region, code, e164, kind) of a number as it is written in a region; null where it can't be dialled.

    region: a key of PLANS, a column of them, or null for numbers that give their
    country.  Numbers of countries without a plan here count by their code and
    length.
    """
    def read(d: Column) -> Column:
        names = [] if region is None else [region] if isinstance(region, str) else list(PLANS)
        here = lambda r: F.lit(True) if isinstance(region, str) else F.coalesce(region == r, F.lit(False))
        plus = d.startswith("+")
        home = [F.when(~plus & here(r), _at_home(r, d)) for r in names]
        given = F.coalesce(F.when(plus, F.substring(d, 2, 20)), *[F.when(here(r), _without(ABROAD.get(r, "00"), d)) for r in names])
        return F.coalesce(*home, T.let(given, _abroad))

    return T.let(digits(raw), read)


def e164(raw: Column, region: str | Column | None = None) -> Column:
    """E.164 of a number that can be dialled; else null."""
    return parsed(raw, region)["e164"]


def is_valid(stored: Column) -> Column:
    """Whether a stored number (with its plus) can be dialled; null can't."""
    return F.coalesce(parsed(stored)["e164"] == stored, F.lit(False))


def kind(stored: Column) -> Column:
    """The kind of a stored number; unknown where it can't be dialled."""
    return F.coalesce(parsed(stored)["kind"], F.lit("unknown"))


def in_text(html: Column, text: Column, region: str) -> Column:
    """Different numbers that can be dialled, of tel: links first, then as the text shows them."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?tel:([^"'>]*)"""), F.lit(1))
    linked = F.transform(links, lambda x: e164(F.replace(x, F.lit("%20"), F.lit(" ")), region))
    runs = F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0))
    shown = F.transform(runs, lambda r: T.let(e164(r, region), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.split(r, PARTED), lambda x: e164(x, region)))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(linked, none), F.coalesce(F.flatten(shown), none))))
