"""Names that resemble each other: a set-similarity join, and the register lookup that rests on it.

Two names are as similar as the larger of the share of words they have in
common and the matching-blocks ratio of their sorted words, rounded to three
digits.  Candidates come from prefixes: of sets that share enough elements,
those that come first in a common order share one.  Words are ordered by
rarity and asked for each pair of sizes apart, so that common words only meet
where nearly all words must agree.  Characters (each with its number of
occurrence) bound the matching-blocks ratio from above and have prefixes of
their own.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..sources.scratch import kept

#: Words that say nothing about which company is meant.
LEGAL_TOKENS = ["ltd", "limited", "llp", "plc", "the", "and", "co", "company", "uk", "group", "holdings", "services"]
#: Characters from rare to common; any order would be right.
RARE_FIRST = "qzjxvkwybhfmpgucdltinsorae9876543210"
#: Characters of a bucket of lengths.
BUCKET = 4
#: What rounding to three digits may add.
ROUNDING = 0.0005


def name_key(name: Column) -> Column:
    """The distinct words of a name without legal ones, sorted and joined by a space; the empty text for null and for names of no words."""
    folded = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("ß"), F.lit("ss"))
    words = F.filter(F.split(folded, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*LEGAL_TOKENS))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def characters(key: Column) -> Column:
    """Each character of a key's words with the number of its occurrence, rare ones and late occurrences first."""
    each = lambda c: F.transform(F.sequence(F.lit(1), F.regexp_count(key, F.lit(c))), lambda k: F.struct((-k).alias("k"), F.lit(RARE_FIRST.index(c)).alias("at")))
    found = F.concat(*[F.when(F.contains(key, F.lit(c)), each(c)).otherwise(F.array().cast("array<struct<k:int,at:int>>")) for c in RARE_FIRST])
    return F.transform(F.array_sort(found), lambda x: x["at"] * 4096 - x["k"])


def likeness(jaccard: float, a: str, b: str, least: float) -> float:
    """The larger of jaccard and the matching-blocks ratio of two keys; the ratio only where their lengths and characters let it count."""
    x, y, floor = a.replace(" ", ""), b.replace(" ", ""), max(jaccard, least)
    if 2 * min(len(x), len(y)) >= floor * (len(x) + len(y)):
        m = difflib.SequenceMatcher(None, x, y)
        if m.quick_ratio() >= floor:  # what their characters in common allow
            jaccard = max(jaccard, m.ratio())
    return round(jaccard, 3)


def _verified(pairs: DataFrame, jaccard: Column, threshold: float, least: float) -> DataFrame:
    """Pairs with their similarity, those of the threshold or more; each is worked out once, where a function of columns would be for the filter, too."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([likeness(j, a, b, least) for j, a, b in zip(*(batch.column(c).to_pylist() for c in ("_jaccard", "a", "b")))], np.float64)
            keep = pa.array(np.flatnonzero(found >= threshold))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in names), pa.array(found).take(keep)], names=[*names, "similarity"])

    # Pairs are small and dear: by their bytes alone they would be gathered in a few tasks.
    dealt = pairs.withColumn("_jaccard", jaccard).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return dealt.mapInArrow(run, StructType([*pairs.schema.fields, StructField("similarity", DoubleType())]))


def _ceil(c: Column) -> Column:
    return F.ceil(c - 1e-9).cast("int")


def _floor(c: Column) -> Column:
    return F.floor(c + 1e-9).cast("int")


def _by_words(left: DataFrame, right: DataFrame, block: list[str], least: float) -> DataFrame:
    """(block, a, b): keys that share a word of their prefixes for the sizes of both."""
    rows = left.select(*block, F.col("key"), F.lit(0).alias("side")).unionByName(right.select(*block, F.col("key"), F.lit(1).alias("side")))
    words = rows.withColumn("word", F.explode(F.split("key", " ")))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ordered = words.join(frequency, "word").groupBy(*block, "key", "side").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws"))  # a key's own words
    ordered = ordered.withColumn("n", F.size("ws"))
    sizes = ordered.select(F.col("side").alias("_side"), F.col("n").alias("m")).distinct()
    low, high = _ceil(F.lit(least) * F.col("n")), _floor(F.col("n") / least)
    asked = ordered.withColumn("m", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    asked = asked.join(sizes, ["m"]).filter("side <> _side")
    shared = _ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("m")))
    asked = asked.withColumn("word", F.explode(F.slice("ws", F.lit(1), F.greatest(F.col("n") - shared + 1, F.lit(0))))).withColumn("word", F.col("word.word"))
    a = asked.filter("side = 0").select(*block, "word", F.col("n").alias("na"), F.col("m").alias("nb"), F.col("key").alias("a"))
    b = asked.filter("side = 1").select(*block, "word", F.col("m").alias("na"), F.col("n").alias("nb"), F.col("key").alias("b"))
    return a.join(b, [*block, "word", "na", "nb"]).select(*block, "a", "b").distinct()


def _by_characters(left: DataFrame, right: DataFrame, block: list[str], least: float) -> DataFrame:
    """(block, a, b): keys whose common characters allow the ratio."""
    def side(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        cs = rows.select(*block, F.col("key").alias(name), characters(F.col("key")).alias("cs")).withColumn("n", F.size("cs"))
        # The other's length lies between these; its bucket's least length gives the longest prefix.
        low, high = _ceil(F.col("n") * least / (2 - least)), _floor(F.col("n") * (2 - least) / least)
        cs = cs.withColumn(other, F.explode(F.sequence(_floor(low / BUCKET), _floor(high / BUCKET))))
        shared = _ceil(F.lit(least / 2) * (F.col("n") + F.greatest(F.col(other) * BUCKET, low)))
        cs = cs.withColumn(own, _floor(F.col("n") / BUCKET)).withColumn("c", F.explode(F.slice("cs", F.lit(1), F.greatest(F.col("n") - shared + 1, F.lit(0)))))
        return cs.select(*block, name, own, other, "c")

    keys = [*block, "la", "lb", "c"]
    return side(left, "a", "la", "lb").join(side(right, "b", "lb", "la"), keys).select(*block, "a", "b").distinct()


def similar_keys(left: DataFrame, right: DataFrame, threshold: float, block: list[str] = (), ratio: bool = True) -> DataFrame:
    """(block, a, b, similarity): every pair of a key of left and one of right, in one block, that are as similar as the threshold (over 0) or more.

    left and right: (block, key), keys as of name_key, each pair once; empty
    keys and null blocks resemble nothing.  ratio False: words alone count.
    With a low threshold characters sift little, and blocks should be narrow.
    """
    block, least = list(block), threshold - ROUNDING
    there = F.col("key") != ""
    left, right = kept(left.filter(there), "names"), kept(right.filter(there), "names")
    pairs = _by_words(left, right, block, least)
    if ratio:
        pairs = pairs.unionByName(_by_characters(left, right, block, least)).distinct()
    a, b = F.split("a", " "), F.split("b", " ")
    common = F.size(F.array_intersect(a, b))
    jaccard = common / (F.size(a) + F.size(b) - common)
    if not ratio:
        return pairs.withColumn("similarity", F.bround(jaccard, 3)).filter(F.col("similarity") >= threshold)
    return _verified(pairs, jaccard, threshold, least)


def place_keys(city: Column, postal: Column) -> Column:
    """What a listing may be found by: its city and its postal code, in lower case."""
    return F.array_distinct(F.array_compact(F.array(T.absent(F.lower(F.trim(city))), T.absent(F.lower(F.trim(postal))))))


def _grams(text: Column, n: Column) -> Column:
    """The different substrings of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n)))


def substrings_held(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): which texts hold which others, both tables of different non-empty texts.

    A part is sought among the holders of its rarest run of three characters
    (all of it where it is shorter), and only those are compared.
    """
    index = wholes.select("whole", F.explode(F.concat(*[_grams(F.col("whole"), F.lit(n)) for n in (1, 2, 3)])).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    asked = parts.select("part", F.explode(_grams(F.col("part"), F.least(F.lit(3), F.length("part")))).alias("gram"))
    rarest = asked.join(frequency, "gram").groupBy("part").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    return index.join(rarest, "gram").filter(F.contains("whole", F.col("part"))).select("part", "whole").distinct()


def registry_lookup(listings: DataFrame, companies: DataFrame, min_similarity: float = 0.45, active_only: bool = True) -> DataFrame:
    """(id, number, legal_name, similarity, candidates): the company of the register that each listing is, at most one.

    listings: id, name, city, postal; companies: number, name, address, status.
    A company counts when its address names the listing's city or postal code,
    when the names are similar enough, and, if active_only, when it is known to
    be active.  The most similar one is taken, ties by the smaller number.
    Listings that meet none are left out; companies without a number, and rows
    without a name, meet nothing.
    """
    known = companies.filter(T.absent(F.col("number")).isNotNull())
    if active_only:
        known = known.filter(F.lower("status") == "active")
    a = listings.select("id", name_key(F.col("name")).alias("key"), F.explode(place_keys(F.col("city"), F.col("postal"))).alias("place"))
    b = known.select("number", F.col("name").alias("legal_name"), name_key(F.col("name")).alias("key"), F.lower("address").alias("whole"))
    places = substrings_held(a.select(F.col("place").alias("part")).distinct(), b.select("whole").filter("whole <> ''").distinct())
    b = kept(b.join(places.withColumnRenamed("part", "place"), "whole").drop("whole"), "companies")
    pairs = similar_keys(a.select("place", "key").distinct(), b.select("place", "key").distinct(), min_similarity, ["place"])
    # Of the companies of one key and place the smallest number is as good as any.
    best = b.groupBy("place", F.col("key").alias("b")).agg(F.min(F.struct("number", "legal_name")).alias("c"), F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(best, ["place", "b"]).select("place", F.col("a").alias("key"), F.struct((-F.col("similarity")).alias("s"), F.col("c.number").alias("number"), F.col("c.legal_name").alias("legal_name")).alias("m"))
    first = a.join(ranked.groupBy("place", "key").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("candidates")), ["place", "key"])
    one = first.groupBy("id").agg(F.min("m").alias("m"), F.max("candidates").alias("candidates"))
    return one.select("id", "m.number", "m.legal_name", (-F.col("m.s")).alias("similarity"), "candidates")


def officers(found: DataFrame, people: DataFrame) -> DataFrame:
    """(id, number, person, role): those who hold an office of the companies found (id, number); people: number, name, role, left (null: still there).

    Names are put in natural order and title case; roles lose their dashes.
    """
    role = F.initcap(F.trim(F.translate(F.coalesce(F.col("role"), F.lit("officer")), "-_", "  ")))
    there = people.filter(F.col("left").isNull() & T.absent(F.trim("name")).isNotNull())
    return found.select("id", "number").join(there, "number").select("id", "number", F.initcap(T.natural_name(F.col("name"))).alias("person"), role.alias("role"))
