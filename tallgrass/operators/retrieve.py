"""Retrieval: a stated set of queries against all rows, by keywords and by vectors; chunks and what an index has to take in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import shared_path

QUERY_TILE, ROW_TILE = 1_024, 4_096


def _long_words(text: str, least: int) -> Column:
    return F.filter(T.words(F.col(text)), lambda w: F.length(w) >= least)


def terms(rows: DataFrame, id_: str, text: str, least: int = 3) -> DataFrame:
    """(id, term) for each occurrence of a word of some length."""
    return rows.select(F.col(id_).alias("id"), F.explode(_long_words(text, least)).alias("term"))


def postings(rows: DataFrame, id_: str, text: str, queries: DataFrame, least: int = 3) -> DataFrame:
    """(id, term, n), a written table: how often each term of queries (id, term) stands in a row, and by a null term each row's number of words.

    Each text is split once. Rows of one id count together; null texts give nothing.
    """
    split = rows.select(F.col(id_).alias("id"), _long_words(text, least).alias("ws"))
    each = split.select("id", F.size("ws").alias("size"), F.concat("ws", F.array(F.lit(None).cast("string"))).alias("ws"))
    each = each.select("id", "size", F.explode_outer("ws").alias("term"))
    wanted = queries.select(F.col("term").alias("key")).distinct().withColumn("hit", F.lit(True))
    # Sizes get keys of their own, so that a shuffled join doesn't bring them all to one task.
    keyed = each.withColumn("key", F.coalesce("term", F.concat(F.lit(" "), F.col("id").cast("string"))))
    kept = keyed.join(wanted, "key", "left").filter("size >= 0 AND (term IS NULL OR hit)")
    counts = kept.groupBy("id", "term").agg(F.sum(F.when(F.col("term").isNull(), F.col("size")).otherwise(1)).alias("n"))
    path = shared_path(rows.sparkSession, "postings")
    counts.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def weights(kept: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, term, df, weight) of written postings; statistics cover all rows that have a term."""
    sizes = kept.filter("term IS NULL AND n > 0").select("id", F.col("n").alias("size"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("size").alias("mean"))
    hits = kept.filter("term IS NOT NULL")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, "term").join(sizes, "id").join(F.broadcast(totals), F.lit(True))  # totals: one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return rows.select("id", "term", "df", (idf * tf).alias("weight"))


def bm25(weighted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, score) for every document that has a term of a query; query terms count once."""
    q = queries.select(F.col("id").alias("query"), "term").distinct()
    return weighted.join(q, "term").groupBy("query", F.col("id").alias("doc")).agg(F.sum("weight").alias("score"))


def holders(weighted: DataFrame, docs: DataFrame, passages: DataFrame, least: int = 3) -> DataFrame:
    """(query, doc): documents (id, text) that hold the whole text of a passage (id, text) and have a term of it.

    A passage's inner words stand whole in each holder, so candidates are the
    postings of its rarest inner word (of all its words where it has no inner
    one of enough letters); whole texts are read for candidates only.
    """
    ws = T.words(F.col("text"))
    inner = T.let(ws, lambda w: F.filter(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda x: F.length(x) >= least))
    words = T.let(inner, lambda i: F.when(F.size(i) > 0, i).otherwise(F.filter(ws, lambda x: F.length(x) >= least)))
    each = passages.select(F.col("id").alias("query"), (F.size(inner) > 0).alias("one"), F.explode(F.array_distinct(words)).alias("term"))
    df = weighted.groupBy("term").agg(F.first("df").alias("df"))
    known = each.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = known.groupBy("query", "one").agg(F.min_by("term", F.struct("df", "term")).alias("rare"))
    anchors = known.join(rarest, ["query", "one"]).filter("NOT one OR term = rare").select("query", "term")
    pairs = weighted.select(F.col("id").alias("doc"), "term").join(anchors, "term").select("query", "doc").distinct()
    texts = pairs.join(passages.select(F.col("id").alias("query"), F.col("text").alias("passage")), "query").join(docs.select(F.col("id").alias("doc"), "text"), "doc")
    return texts.filter(F.contains("text", F.col("passage"))).select("query", "doc").distinct()


def best_places(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(query, place): the place that the best found (query, doc) has among all scores; ties by the smaller document.

    Rows before it are counted, so no task ranks all documents of a query.
    """
    best = scores.join(found, ["query", "doc"]).groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("doc").alias("d"))).alias("b"))
    before = scores.join(best, "query").filter(F.struct((-F.col("score")).alias("s"), F.col("doc").alias("d")) <= F.col("b"))
    return before.groupBy("query").agg(F.count(F.lit(1)).alias("place"))


def top_k(scores: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each query; ties by the smaller document. The rank limit is applied before the shuffle too."""
    w = Window.partitionBy("query").orderBy(*(order or [F.desc("score"), "doc"]))
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def reachable(plain: DataFrame, leaders: DataFrame, k: int, columns: float = 0.0, slack: float = 1e-5) -> DataFrame:
    """(query, docs, most, least): the most that a row outside docs can have without its keyword part, and what it needs to be among the k best.

    plain: (query, doc, score), the best of all rows without that part, as many
    as one likes; leaders: whole scores of some rows; columns: the most of rows
    without a vector. Fewer than k rows bound nothing. The slack is more than
    what rounding takes away.
    """
    most = plain.groupBy("query").agg(F.min("score").alias("most"), F.collect_set("doc").alias("docs"))
    known = plain.unionByName(leaders).groupBy("query", "doc").agg(F.max("score").alias("score"))
    last = top_k(known, k).filter(F.col("place") == k).select("query", (F.col("score") - slack).alias("least"))
    every = known.select("query").distinct().join(most, "query", "left").join(last, "query", "left")
    return every.select("query", F.coalesce("docs", F.array().cast("array<long>")).alias("docs"), F.greatest("most", F.lit(columns)).alias("most"), F.coalesce("least", F.lit(float("-inf"))).alias("least"))


def sound(vector: Column) -> Column:
    """A vector in double precision; null if it is null or zero, or has null or non-finite parts."""
    v = vector.cast("array<double>")
    return F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), v)


def nearest(queries: DataFrame, rows: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """(query, doc, score) that hold the k best rows of each query: scale * cosine + bonus, to six places.

    queries: id, vector; rows: id, vector, bonus. Vectors that aren't sound take no
    part; lengths meet their like only.
    Queries are dealt in blocks and rows in groups, which meet by an equi-join
    on the places of a grid; each task keeps the k best of a query in its tile.
    """
    queries, rows = (x.withColumn("vector", sound(F.col("vector"))).filter("vector IS NOT NULL").withColumn("dim", F.size("vector")) for x in (queries, rows))
    n_blocks = max(1, -(-queries.count() // QUERY_TILE))
    n_groups = max(1, -(-rows.count() // ROW_TILE))
    salts = min(n_groups, max(1, 4 * queries.sparkSession.sparkContext.defaultParallelism // n_blocks))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    blocks = queries.groupBy("dim", deal(n_blocks).alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    groups = rows.groupBy("dim", deal(n_groups).alias("group")).agg(F.collect_list(F.struct("id", "vector", "bonus")).alias("rows"))
    groups = groups.withColumn("salt", F.pmod("group", F.lit(salts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, tile in zip(batch.column("queries"), batch.column("rows"), strict=True):
                q_ids, q, _ = _unit_rows(qs.values)
                ids, d, bonus = _unit_rows(tile.values)
                score = np.round(scale * (q @ d.T) + bonus, 6)
                n = min(k, len(ids))
                best = np.argsort(-score, axis=1, kind="stable")[:, :n]  # rows stand in the order of their ids
                found = [np.repeat(q_ids, n), ids[best].ravel(), np.take_along_axis(score, best, axis=1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query", "doc", "score"])

    return blocks.join(groups, ["dim", "block", "salt"]).select("queries", "rows").mapInArrow(run, "query long, doc long, score double")


def _unit_rows(structs: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, their vectors at length one, and what is added to their scores."""
    ids = structs.field("id").to_numpy(zero_copy_only=False)
    x = structs.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    bonus = structs.field("bonus").to_numpy(zero_copy_only=False) if structs.type.get_field_index("bonus") >= 0 else np.zeros(len(ids))
    order = np.argsort(ids, kind="stable")
    return ids[order], (x / np.sqrt((x * x).sum(axis=1, keepdims=True)))[order], bonus[order]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def heading_chunks(text: Column, name: Column, most: int = 2_000) -> Column:
    """Chunks of a text by its headings (# or ##): array of (name, start_line, end_line, body).

    Lines before the first heading go by the given name; chunks without a body
    are dropped; a text without any is one chunk. Bodies are cut at most
    characters, which is the feature.
    """
    heading = r"^#{1,2}\s+(.*)$"

    def cut(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: x["l"].rlike(heading))
        starts = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("l"))), heads)

        def chunk(s: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1)["i"], F.size(lines))
            body = F.regexp_replace(F.array_join(F.slice(lines, s["i"] + 2, end - s["i"] - 1), "\n"), r"^\s+|\s+$", "")
            title = F.when(s["i"] < 0, name).otherwise(F.trim(F.regexp_extract(s["l"], heading, 1)))
            return F.struct(title.alias("name"), F.greatest(s["i"] + 1, F.lit(1)).alias("start_line"), end.alias("end_line"), F.substring(body, 1, most).alias("body"))

        whole = F.array(F.struct(name.alias("name"), F.lit(1).alias("start_line"), F.size(lines).alias("end_line"), F.substring(text, 1, most).alias("body")))
        return T.let(F.filter(F.transform(starts, chunk), lambda c: c["body"] != ""), lambda cs: F.when(F.size(cs) > 0, cs).otherwise(whole))

    return F.when(text.isNotNull(), T.let(F.split(text, r"\r?\n"), cut))


def index_changes(rows: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): what an index (key, digest) must do with each row: new, changed, unchanged, or gone where only the index has it."""
    now = rows.select(key, F.col(digest).alias("now"), F.lit(True).alias("here"))
    then = index.select(key, F.col(digest).alias("then"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    return now.join(then, key, "full").select(key, state.alias("state"))
