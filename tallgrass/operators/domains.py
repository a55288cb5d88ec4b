"""Sites of registered companies: guessed from their names, and taken where the page itself bears witness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words of names that no site has; endings in the order in which they are tried.
LEGAL = ["limited", "ltd", "llp", "llc", "plc", "lp", "cic", "cio", "inc", "incorporated", "corp", "corporation", "co", "company", "the"]
ENDINGS = (".co.uk", ".com", ".uk")


def content_words(name: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), lambda w: ~w.isin(LEGAL))


def candidates(words: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    """Domains to try, in order: the words joined, with dashes, and the first two, each with every ending."""
    slugs = F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(F.slice(words, 1, 2), "")))
    return F.when(F.size(words) > 0, F.flatten(F.transform(slugs, lambda s: F.array(*[F.concat(s, F.lit(e)) for e in endings])))).otherwise(F.array().cast("array<string>"))


def unresolved(companies: DataFrame) -> DataFrame:
    """Companies of the register that have no domain and were not tried before, by name (columns source, domain, tried, name)."""
    return companies.filter((F.col("source") == "register") & F.col("domain").isNull() & F.col("tried").isNull()).orderBy("name")


def resolved(companies: DataFrame, pages: DataFrame, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(id, domain, matched_on, tried) of companies (id, name, postal, number); domain null where no page bears witness.

    pages: domain, html, text, place (the order of a site's pages; its first one
    counts).  A page bears witness by the postal code, whatever blanks stand in
    it, by the name without legal words, or by the register's number, in this
    order.  The first candidate with a witness wins; tried counts those asked
    up to it.  Companies meet pages by domain, and only pages that somebody
    asks for are looked into.
    """
    words = content_words(F.col("name"))
    asked = companies.select("id", "postal", "number", words.alias("words")).withColumn("all", candidates(F.col("words"), endings))
    each = asked.select("id", "postal", "number", "words", F.posexplode("all").alias("i", "domain"))
    wanted = each.select("domain").distinct()
    roots = pages.select(F.lower("domain").alias("domain"), "place", "html", "text").join(wanted, "domain", "left_semi")
    roots = roots.groupBy("domain").agg(F.min_by(F.struct("html", "text"), "place").alias("page"))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    hay = F.lower(F.concat(F.coalesce(F.col("page.text"), F.lit("")), F.lit(" "), F.coalesce(F.col("page.html"), F.lit(""))))
    close = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    named = F.array_join("words", " ")
    witness = (
        F.when((low(F.col("postal")) != "") & F.contains(close(F.col("hay")), close(low(F.col("postal")))), F.trim("postal")).when((named != "") & F.contains(F.col("hay"), named), named)
        .when((low(F.col("number")) != "") & F.contains(F.col("hay"), low(F.col("number"))), F.trim("number"))
    )
    met = each.join(roots, "domain").withColumn("hay", hay).withColumn("on", witness).filter(T.absent(F.col("on")).isNotNull())
    best = met.groupBy("id").agg(F.min(F.struct("i", "domain", F.col("on").alias("matched_on"))).alias("m"))
    tried = F.coalesce(F.col("m.i") + 1, F.size("all"))
    return asked.join(best, "id", "left").select("id", F.col("m.domain").alias("domain"), F.col("m.matched_on").alias("matched_on"), tried.alias("tried"))
