"""Entity resolution as joins and grouped picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def dedupe_key(place_id: Column, cid: Column, name: Column, street: Column, city: Column) -> Column:
    """Place id, else listing id, else a digest of name, street and city."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    digest = F.sha1(F.concat_ws("|", T.norm_name(F.coalesce(name, F.lit(""))), part(street), part(city)))
    return F.coalesce(F.concat(F.lit("pid:"), T.absent(place_id)), F.concat(F.lit("cid:"), T.absent(cid)), F.concat(F.lit("na:"), F.substring(digest, 1, 12)))


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("biz_"), F.substring(F.sha1(key), 1, 12))


def first_filled(c: str, order: str) -> Column:
    """The value of the earliest row in which it isn't absent."""
    v = T.absent(F.col(c)) if c else F.col(c)
    return F.min_by(v, F.when(v.isNotNull(), F.col(order)))


def richest_merge(rows: DataFrame, key: str, order: str, fill: list[str], newest: list[str], sets: list[str] = ()) -> DataFrame:
    """One row per key: fill columns by the earliest value that is there, newest ones by the latest, sets as sorted distinct values.

    Every pick is an aggregate with a partial phase, so a key with very many
    rows shrinks before the shuffle.
    """
    picks = [first_filled(c, order).alias(c) for c in fill]
    picks += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in newest]
    picks += [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in sets]
    return rows.groupBy(key).agg(*picks, F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first_seq"))


def chain_map(rows: DataFrame, id_: str, domain: str, phone: str) -> DataFrame:
    """(id, chain): the domain that two or more rows share, else the phone."""
    shared = lambda c, tag: rows.filter(T.absent(F.col(c)).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(c).alias(f"_{tag}"))
    d, p = shared(domain, "d"), shared(phone, "p")
    joined = rows.join(d, F.col(domain) == F.col("_d"), "left").join(p, F.col(phone) == F.col("_p"), "left")
    chain = F.coalesce(F.concat(F.lit("domain:"), "_d"), F.concat(F.lit("phone:"), "_p"))
    return joined.select(id_, chain.alias("chain")).filter("chain IS NOT NULL")


def same_business(name_a: Column, postal_a: Column, name_b: Column, postal_b: Column) -> Column:
    """A shared name token of three letters or more, or the same postal district."""
    tokens = F.arrays_overlap(T.name_tokens(name_a), T.name_tokens(name_b))
    return tokens | (F.substring_index(postal_a, " ", 1) == F.substring_index(postal_b, " ", 1))


def phone_matches(listings: DataFrame, registers: DataFrame) -> DataFrame:
    """(drop_id, keep_id): each register row gets at most one listing of its phone, the earliest that may be the same business.

    Listings are an index of one row per phone and token or postal district, so
    a phone that many share makes no pairs of rows.  Of listings of one seq the
    smallest id counts.
    """
    district = F.concat(F.lit("\t"), F.substring_index(F.col("postal"), " ", 1))  # no token has a tab
    marks = F.explode(F.array_distinct(F.concat(F.coalesce(F.array_compact(T.name_tokens(F.col("name"))), F.array().cast("array<string>")), F.array_compact(F.array(district)))))
    index = listings.filter("phone IS NOT NULL").select("id", "seq", "phone", marks.alias("mark"))
    index = index.groupBy("phone", "mark").agg(F.min(F.when(F.col("seq").isNotNull(), F.struct("seq", "id"))).alias("_first"))
    hits = registers.filter("phone IS NOT NULL").select(F.col("id").alias("drop_id"), "phone", marks.alias("mark")).join(index, ["phone", "mark"])
    return hits.groupBy("drop_id").agg(F.min("_first").alias("_first")).select("drop_id", F.col("_first.id").alias("keep_id"))


def repoint(children: DataFrame, mapping: DataFrame, column: str, unique: list[str]) -> DataFrame:
    """Children whose parent was dropped go to the kept one; what then repeats a unique key goes, the smallest id staying."""
    moved = children.join(mapping, F.col(column) == F.col("drop_id"), "left").withColumn(column, F.coalesce("keep_id", column)).drop("drop_id", "keep_id")
    return moved.groupBy(*unique).agg(F.min("child_id").alias("child_id"))


def unique_hits(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Matches rows by the first key that hits exactly one target; a key that hits several ends the search as ambiguous.

    Adds match_id and reason (a key's name, ambiguous:<key> or unmatched).
    """
    out = rows
    for k in keys:
        hits = target.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_{k}")).agg(F.count(F.lit(1)).alias(f"_n_{k}"), F.min("id").alias(f"_id_{k}"))
        out = out.join(hits, F.col(k) == F.col(f"_{k}"), "left")
    reason, match = F.lit("unmatched"), F.lit(None).cast("string")
    for k in reversed(keys):
        n = F.col(f"_n_{k}")
        reason = F.when(n == 1, F.lit(k)).when(n > 1, F.lit(f"ambiguous:{k}")).otherwise(reason)
        match = F.when(n == 1, F.col(f"_id_{k}")).when(n > 1, F.lit(None).cast("string")).otherwise(match)
    return out.select(*rows.columns, match.alias("match_id"), reason.alias("reason"))


def newest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 3)).otherwise(0.0)


def match_cascade(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, match_id, how): which stored row each incoming one merges into: by key, by place, by phone; else new.

    Both hold id, key, place_id, phone, name, postal; stored rows also seq,
    their order. A phone only counts with a shared name token or postal
    district, and a row with a place never joins another with one; a register
    row (no place) also takes the only stored row of its phone. Tokens and
    districts are an index of one row each per phone, so a switchboard shared
    by many rows makes no pairs of rows.
    """
    s = stored.select("id", "key", "place_id", "phone", "name", "postal", "seq")
    first = lambda when=None: F.min_by("id", F.col("seq") if when is None else F.when(when, F.col("seq")))
    by_key = s.filter("key IS NOT NULL").groupBy("key").agg(first().alias("_k"))
    by_place = s.filter("place_id <> ''").groupBy("place_id").agg(first().alias("_p"))
    lone = s.filter("phone <> ''").groupBy("phone").agg(F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("_only"))
    district = lambda: F.concat(F.lit("\t"), F.lower(F.substring_index(F.col("postal"), " ", 1)))
    marks = lambda: F.array_distinct(F.concat(F.coalesce(T.name_tokens(F.col("name")), F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("postal") != "", district())))))
    index = s.filter("phone <> ''").withColumn("mark", F.explode(marks())).groupBy("phone", "mark").agg(
        F.min(F.struct("seq", "id")).alias("_any"), F.min(F.when(F.col("place_id").isNull() | (F.col("place_id") == ""), F.struct("seq", "id"))).alias("_bare")
    )
    i = incoming.select("id", "key", "place_id", "phone", "name", "postal")
    hits = i.filter("phone <> ''").select(F.col("id"), "phone", "place_id", F.explode(marks()).alias("mark")).join(index, ["phone", "mark"])
    hits = hits.groupBy("id").agg(F.min(F.when(F.coalesce(F.col("place_id"), F.lit("")) != "", F.col("_bare")).otherwise(F.col("_any"))).alias("h"))
    j = i.join(by_key, "key", "left").join(by_place, "place_id", "left").join(hits, "id", "left").join(lone, "phone", "left")
    register = F.coalesce(F.col("place_id"), F.lit("")) == ""
    phone = F.coalesce("h.id", F.when(register, F.col("_only")))
    how = F.when(F.col("_k").isNotNull(), "key").when(F.col("_p").isNotNull(), "place").when(phone.isNotNull(), "phone").otherwise("new")
    return j.select("id", F.coalesce("_k", "_p", phone).alias("match_id"), how.alias("how"))


def repair_by_phone(rows: DataFrame) -> DataFrame:
    """(drop_id, keep_id): register rows that fold into the listing of their phone, the one of most reviews, where both may be the same business.

    Rows: id, place_id, phone, name, postal, reviews. Listings never fold.
    One listing per phone is kept in mind, so a shared phone makes no pairs.
    """
    listed = F.coalesce(F.col("place_id"), F.lit("")) != ""
    a = rows.filter(listed & (F.col("phone") != "")).groupBy("phone").agg(F.max_by(F.struct(F.col("id").alias("i"), F.col("name").alias("n"), F.col("postal").alias("p")), F.struct(F.coalesce("reviews", F.lit(0)), "id")).alias("k"))
    b = rows.filter(~listed).join(a, "phone").filter(F.coalesce(same_business(F.col("name"), F.col("postal"), F.col("k.n"), F.col("k.p")), F.lit(False)))
    return b.select(F.col("id").alias("drop_id"), F.col("k.i").alias("keep_id"))


def facts_merged(old: Column, new: Column, last_wins: bool) -> Column:
    """Two maps of facts as one; of a fact in both the new one stays if last_wins, else the old one."""
    keep, other = (new, old) if last_wins else (old, new)
    empty = F.create_map().cast("map<string,string>")
    keep, other = F.coalesce(keep, empty), F.coalesce(other, empty)
    return F.map_concat(keep, F.map_filter(other, lambda k, _: ~F.map_contains_key(keep, k)))
