"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A document is cut into chunks where its own content says so, distinct chunks
get verified identifiers, and documents are equal when their ordered lists of
identifiers are.  A chunk's text is shuffled once per task and distinct value;
documents themselves never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_one, stash

#: Runs of white space that aren't one plain space already.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: A chunk has 512 to 4096 characters and ends after the first space behind one of a third of the letters; the text's end ends the last.
_CHUNK = r"(?s).{512,4095}?[a-dnsty.] |.{1,4096}"


def normalised(text: Column) -> Column:
    """One space for each run of white space (space, tab to carriage return); null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; they join up to it. Empty: none."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalised`; of equal ones the row
    with the smallest doc_id stays, and only one of several with that id.  Null
    and empty texts are equal.  Rows that repeat a doc_id count each for
    themselves in group_size; a null doc_id never stays unless all ids of its
    group are null.  Columns besides doc_id and text are ignored; an empty table
    gives none.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("_text"))
    hashes = F.transform(chunks(F.col("_text")), lambda c: F.xxhash64(c))
    cut = stash(text.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.sha2("_text", 256).alias("text_sha256"), hashes.alias("_hashes")), "recipes")
    # Distinct chunks with their hash; where texts share one, they are told apart by rank.
    distinct = text.select(F.explode(chunks(F.col("_text"))).alias("_chunk")).select(F.xxhash64("_chunk").alias("_h"), "_chunk").distinct()
    shared = stash(distinct.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared")
    recipe = cut.withColumn("_recipe", F.transform("_hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("r")))).drop("_hashes")
    if not shared.isEmpty():
        places = text.select(F.sha2("_text", 256).alias("_sha"), F.posexplode(chunks(F.col("_text"))).alias("_pos", "_chunk")).withColumn("_h", F.xxhash64("_chunk"))
        recipe = _told_apart(recipe, places, distinct, shared)
    # The row that stays: of the smallest id that isn't null, the first.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), "_row"))
    groups = recipe.groupBy("_recipe").agg(first.alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    groups = stash(groups.withColumnRenamed("_recipe", "_list"), "groups")
    joined = recipe.join(groups, recipe["_recipe"] == groups["_list"], "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep.id"))
    kept = F.col("_size").isNull() | (F.col("_row") == F.col("_keep._row"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def _told_apart(recipe: DataFrame, places: DataFrame, distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes in which chunks of one hash have a rank by their text; only texts with such a hash are touched."""
    rank = F.row_number().over(Window.partitionBy("_h").orderBy("_chunk"))
    ranks = stash(distinct.join(shared, "_h", "left_semi").select("_h", "_chunk", rank.alias("_r")), "ranks")
    hit = places.join(shared, "_h", "left_semi").join(ranks, ["_h", "_chunk"]).select("_sha", "_pos", "_r").distinct()
    fixes = stash(hit.groupBy("_sha").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_r"))).alias("_fix")), "fixes")
    mended = F.transform("_recipe", lambda x, i: F.struct(x["h"].alias("h"), F.coalesce(F.element_at("_fix", i), F.lit(0)).alias("r")))
    joined = recipe.join(fixes, F.col("text_sha256") == F.col("_sha"), "left")
    return joined.withColumn("_recipe", F.when(F.col("_fix").isNull(), F.col("_recipe")).otherwise(mended)).drop("_sha", "_fix")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts, as exact_groups says.

    An id that stands on several texts loses only those that are copies.
    """
    decided = exact_groups(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), "kept")
    return keep_one(docs, F.sha2(normalised(F.col("text")), 256), decided)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""
