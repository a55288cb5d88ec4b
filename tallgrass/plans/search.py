"""Retrieval: keyword, vector and hybrid ranking, and how good it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import retrieve as R
from ..sources.scratch import kept
from .base import query, table

#: A query's best rows by keywords, and by vector and columns, whose scores bound the others'.
LEADERS = 50

BM25_SQL = """
WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents), d AS (SELECT * FROM w WHERE length(term) >= 3), tf AS (SELECT id, term, count(*) AS tf FROM d GROUP BY 1, 2), sizes AS (SELECT id, count(*) AS size FROM d GROUP BY 1),
tot AS (SELECT count(*) AS n_docs, avg(size) AS mean FROM sizes), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qw AS (SELECT item_id AS query, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark), q AS (SELECT DISTINCT * FROM qw WHERE length(term) >= 3),
bm AS (SELECT query, tf.id AS doc, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN sizes ON sizes.id = tf.id, tot GROUP BY 1, 2)"""


def keyword_weights(spark, sf_dir):
    """Weighed postings of all terms of the benchmark, and its terms."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    asked = R.terms(items, "item_id", "text")
    return R.weights(R.postings(docs, "doc_id", "text", asked)), asked


def keyword_scores(spark, sf_dir):
    return R.bm25(*keyword_weights(spark, sf_dir))


@query(BM25_SQL + " SELECT query, doc, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents of every benchmark item by keywords."""
    s = keyword_scores(spark, sf_dir).withColumn("score", F.round("score", 6))
    return R.top_k(s, 10).select("query", "doc", "score")


@query(BM25_SQL + ", r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS place, doc FROM bm), g AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT r.query, min(place) AS first_place, bool_or(place <= 1) AS hit1, bool_or(place <= 5) AS hit5 FROM r JOIN g ON r.query = g.query AND r.doc = g.doc GROUP BY 1")
def hit_at_k(spark, sf_dir):
    """At which place the keyword ranking has a document that holds the whole passage."""
    docs, items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    weighted, asked = keyword_weights(spark, sf_dir)
    s = R.bm25(weighted, asked).withColumn("score", F.round("score", 6))
    place = R.best_places(s, R.holders(weighted, docs, items))
    return place.select("query", F.col("place").alias("first_place"), (F.col("place") <= 1).alias("hit1"), (F.col("place") <= 5).alias("hit5"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query, doc, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 10""")
def cosine_topk(spark, sf_dir):
    """The ten nearest vectors of each queried one."""
    v = vectors(spark, sf_dir)
    near = R.nearest(v.filter("id % 50 = 0"), v.withColumn("bonus", F.lit(0.0)), 11).filter("query <> doc")
    return R.top_k(near, 10).select("query", "doc", "score")


@query(BM25_SQL + """, m AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM bm),
p AS (SELECT item_id AS query, doc_id AS doc, 0.08 * (CASE WHEN lang = 'en' THEN 1 ELSE 0 END) + 0.04 * (CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS bonus FROM benchmark, documents),
h AS (SELECT p.query, p.doc, round(0.55 * coalesce(m.score / best, 0) + 0.45 * coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) + bonus, 6) AS score
  FROM p LEFT JOIN m USING (query, doc) LEFT JOIN embeddings a ON a.vec_id = p.query LEFT JOIN embeddings b ON b.vec_id = p.doc)
SELECT query, doc, score FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 5""")
def hybrid_topk(spark, sf_dir):
    """Keyword scores against the query's best, cosines, and what the document's columns add, over all documents.

    The vector of a document or item is the one of its number. A document can
    only be among a query's best with its keyword score, or as one of the best
    by vector and columns, or of those without a vector by columns alone. The
    best of these and of the best by keywords bound what all others must reach,
    and only rows whose keyword score lets them reach it are joined to vectors.
    """
    k = 5
    v, s = vectors(spark, sf_dir).withColumn("vector", R.sound(F.col("vector"))), kept(keyword_scores(spark, sf_dir), "keywords")
    bonus = 0.08 * F.when(F.col("lang") == "en", 1).otherwise(0) + 0.04 * F.when(F.col("n_chars") > 2000, 1).otherwise(0)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), bonus.alias("bonus")).join(v, "id", "left")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).join(v, "id", "left")

    def scored(rows):
        """(query, doc, score) of rows (query, doc, score, best) with keyword scores."""
        pairs = rows.join(d.select(F.col("id").alias("doc"), "bonus", F.col("vector").alias("b")), "doc").join(q.select(F.col("id").alias("query"), F.col("vector").alias("a")), "query")
        return pairs.select("query", "doc", F.round(0.55 * F.col("score") / F.col("best") + 0.45 * F.coalesce(R.cosine(F.col("a"), F.col("b")), F.lit(0.0)) + F.col("bonus"), 6).alias("score"))

    near = kept(R.top_k(R.nearest(q, d, LEADERS, scale=0.45), LEADERS).select("query", "doc", "score"), "near")
    # k rows that columns alone put first: of all documents for a query without a vector, else of those without one.
    first = lambda rows: F.broadcast(rows.orderBy(F.desc("bonus"), "id").limit(k).select(F.col("id").alias("doc"), F.round("bonus", 6).alias("score")))
    asked = q.select(F.col("id").alias("query"), F.col("vector").isNull().alias("none"))
    bare = asked.filter("NOT none").join(first(d.filter("vector IS NULL")), F.lit(True)).unionByName(asked.filter("none").join(first(d), F.lit(True))).drop("none")
    top = kept(R.top_k(s, LEADERS).select("query", "doc", "score"), "leaders")
    best = top.groupBy("query").agg(F.max("score").alias("best"))
    leaders = scored(top.join(best, "query"))
    bounds = kept(R.reachable(near, leaders, k, 0.12).join(best, "query"), "bounds")
    reach = 0.55 * F.col("score") / F.col("best") + F.col("most") >= F.col("least")
    words = scored(s.join(bounds, "query").filter(reach | F.array_contains("docs", F.col("doc"))).select("query", "doc", "score", "best"))
    every = words.unionByName(near).unionByName(bare).groupBy("query", "doc").agg(F.max("score").alias("score"))
    return R.top_k(every, k).select("query", "doc", "score")


@query("""
SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS seen FROM documents GROUP BY 1""")
def content_hash_incremental(spark, sf_dir):
    """The rows that an index by content takes in: the first of each digest; later ones are skipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("seen"))


@query("""
SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'new' WHEN d IS NULL THEN 'gone' WHEN lower(text) = text THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT coalesce(doc_id, vec_id) AS doc_id, doc_id AS d, vec_id, text FROM documents FULL JOIN embeddings ON vec_id = doc_id) x""")
def index_changes(spark, sf_dir):
    """What an index of the texts in lower case, which holds the rows that have a vector, must do with each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.lower("text"), 256).alias("low"))
    held = vectors(spark, sf_dir).select(F.col("id").alias("doc_id")).join(d.select("doc_id", F.col("low").alias("digest")), "doc_id", "left")
    return R.index_changes(d, held, "doc_id", "digest")


@query(r"""
WITH t AS (SELECT conv_id, turn, unnest(string_split('before ' || turn || chr(10) || '# ' || role || chr(10) || text || chr(10) || '## end' || chr(10) || 'turn ' || turn, chr(10))) AS l, unnest(range(1, 2 + len(string_split('before ' || turn || chr(10) || '# ' || role || chr(10) || text || chr(10) || '## end' || chr(10) || 'turn ' || turn, chr(10))))) AS i FROM conversations),
h AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^#{1,2}\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS part, regexp_matches(l, '^#{1,2}\s+') AS head FROM t WHERE l IS NOT NULL)
SELECT conv_id, turn, coalesce(max(CASE WHEN head THEN trim(regexp_replace(l, '^#{1,2}\s+', '')) END), 'conversation') AS name, min(i)::INTEGER AS start_line, max(i)::INTEGER AS end_line, trim(string_agg(l, chr(10) ORDER BY i) FILTER (NOT head), ' ' || chr(9) || chr(10) || chr(13)) AS body
FROM h GROUP BY conv_id, turn, part HAVING trim(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT head), ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def heading_chunks(spark, sf_dir):
    """Turns as small documents with headings, cut by these."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    turn = F.col("turn").cast("string")
    text = F.concat(F.lit("before "), turn, F.lit("\n# "), "role", F.lit("\n"), "text", F.lit("\n## end\nturn "), turn)
    found = c.select("conv_id", "turn", F.explode_outer(R.heading_chunks(text, F.lit("conversation"), 1 << 30)).alias("c")).filter("c IS NOT NULL")
    return found.select("conv_id", "turn", "c.name", "c.start_line", "c.end_line", "c.body")


@query(r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\n+')) AS part FROM documents) SELECT doc_id, count(*) AS chunks, max(length(part)) AS longest FROM w WHERE part <> '' GROUP BY 1""")
def text_chunks(spark, sf_dir):
    """Paragraphs of documents as chunks."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\n+")).alias("part")).filter("part <> ''")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("part")).cast("long").alias("longest"))


STOP_SQL = ", ".join(f"'{w}'" for w in C.STOP)
_LETTERS = "regexp_replace(text, '[^A-Za-z]+', '_', 'g')"


def sources(spark, sf_dir):
    """Turns as source files: a module with a class, a method with a function in it, and a coroutine; every seventh has an error."""
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id")
    name = F.concat(F.lit("src/c"), k, F.lit("/t"), F.col("turn"), F.lit(".py"))
    lines = ['"""Turn of {role}."""', "import os", "", "class Conv{k}(dict):", '    """Holds {k}."""', "    def say(self, x, *rest, flag=1, **more):", "        def inner():", "            return 1", "        return x", "", "async def go{turn}(a, /, b):", '    return "{text}"']
    text = F.lit("\n".join(lines) + "\n")
    for slot, value in {"{role}": F.col("role"), "{k}": k.cast("string"), "{turn}": F.col("turn").cast("string"), "{text}": F.regexp_replace("text", "[^A-Za-z]+", "_")}.items():
        text = F.replace(text, F.lit(slot), value)
    return c.filter("text IS NOT NULL").select(name.alias("path"), F.concat(text, F.when(k % 7 == 0, "def (").otherwise("")).alias("text"))


@query(f"""
WITH c AS (SELECT conv_id AS k, turn, role, {_LETTERS} AS t, 'src/c' || conv_id || '/t' || turn || '.py' AS path FROM conversations WHERE text IS NOT NULL AND conv_id % 7 <> 0),
go AS (SELECT *, 'async def go' || turn || '(a, /, b):' || chr(10) || '    return "' || t || '"' AS body FROM c),
x AS (SELECT path, 'module' AS kind, 1 AS a, 12 AS b, 't' || turn AS name, 0 AS words, length(path) FROM c UNION ALL SELECT path, 'class', 4, 9, 'Conv' || k, 0, 0 FROM c UNION ALL SELECT path, 'method', 6, 9, 'Conv' || k || '.say', 0, 0 FROM c
  UNION ALL SELECT path, 'method', 7, 8, 'Conv' || k || '.inner', 0, 0 FROM c UNION ALL SELECT path, 'function', 11, 12, 'go' || turn, length(path || chr(10) || 'go' || turn || chr(10) || 'async def go' || turn || '(a, b)' || chr(10) || body), 0 FROM go)
SELECT path || ':' || kind || ':' || CASE WHEN kind = 'module' THEN '1' ELSE name || ':' || a END AS id, kind, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, name, CAST(CASE WHEN kind = 'function' THEN words END AS INT) AS size FROM x""")
def code_chunks(spark, sf_dir):
    """Modules, classes and functions of source files, with their lines."""
    return C.file_chunks(sources(spark, sf_dir)).select("id", "kind", "start_line", "end_line", "name", F.when(F.col("kind") == "function", F.length("text")).alias("size"))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(replace(text, 'on ', 'on_')), '[a-z_][a-z0-9_]*'), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL})) AS ws FROM documents),
t AS (SELECT doc_id, flatten(list_transform(ws, lambda x: CASE WHEN contains(x, '_') THEN list_prepend(x, list_filter(string_split(x, '_'), lambda p: length(p) > 1 AND p NOT IN ({STOP_SQL}))) ELSE [x] END)) AS ts FROM w)
SELECT doc_id, CAST(len(ts) AS INT) AS terms, CAST(len(list_distinct(ts)) AS INT) AS different, sha256(array_to_string(ts, ' ')) AS digest FROM t""")
def identifier_terms(spark, sf_dir):
    """Words of identifiers and their parts, in order."""
    ts = C.identifiers(F.replace("text", F.lit("on "), F.lit("on_")))
    return table(spark, sf_dir, "documents").select("doc_id", ts.alias("ts")).select("doc_id", F.size("ts").alias("terms"), F.size(F.array_distinct("ts")).alias("different"), F.sha2(F.array_join("ts", " "), 256).alias("digest"))
