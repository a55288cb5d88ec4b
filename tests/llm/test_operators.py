"""Each operator against a brute-force version, with nulls, empties, copies, long texts, no rows and clashing columns."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallgrass.llm import bpe, common, dac, embeddings, exact, packing, queries, repeats, secrets, simhash, token_counts, toxicity

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_secrets(docs, none, texts):
    got = {r.doc_id: r for r in secrets.span_digest(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        base = []
        for n, rule in enumerate(secrets.BASE):
            base += [(m.start(), n, f"{rule.kind}:{m.start()}:{m.end()}") for m in re.finditer(rule.pattern, t or "") if len(m[rule.group]) >= rule.least]
        want = ",".join(s for _, _, s in sorted(base))
        assert got[i].base_sha256 == sha(want.encode())
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(n == k for _, k, _ in base) for n in range(3))
    assert (got[4008].n_assign, got[4008].n_access, got[4008].n_hex) == (2, 1, 1)
    assert secrets.span_digest(none).count() == 0


def test_secret_queries_and_masks(docs):
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == frozenset({frozenset({"aki", "kia"})})
    assert secrets.trigram_query(r"(foo|bar)baz?") is not None
    masked = {r.doc_id: r for r in secrets.mask_secrets(docs).collect()}
    assert "hunter2" not in masked[4008].text and masked[4008].n_chars == len(masked[4008].text)
    assert masked[4006].text == "a b c d" and masked[4000].text is None and masked[0].keep_id == "extra"
    assert all(not s for s in secrets.find_secrets(__import__("pyarrow").array([r.text for r in masked.values()]), secrets.BASE))


def test_exact(docs, none, texts):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r.doc_id: r for r in exact.exact_groups(docs).collect()}
    for i, t in norm.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(groups[t]), len(groups[t]), min(groups[t]) == i, sha(t.encode()))
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {min(g) for g in groups.values()}
    assert exact.exact_groups(none).count() == 0


def test_exact_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect())
    assert got == [("1", 1, 3, False), ("1", 1, 3, True), ("2", 2, 2, True), ("3", 2, 2, False), ("None", 1, 3, False)]


EDGES = [(1, "a b c d e"), (1, "a b c d e"), (2, "x y z"), (2, "a b c d e"), (None, "a b c d e"), (None, "n n"), (None, "n n"), (3, None), (4, "")]


@pytest.mark.parametrize("dedup", [exact.exact_dedup, simhash.near_dedup])
def test_dedup_keeps_one_row_of_each_text_whatever_the_ids(spark, dedup):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(EDGES)], "doc_id long, text string, _key long").repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in dedup(df).select("doc_id", "text").collect())
    assert got == [("1", "a b c d e"), ("2", "x y z"), ("3", None), ("None", "n n")]
    assert dedup(df).columns == df.columns


def test_edge_rows_in_every_operator(spark, library, tmp_path):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "digest", "ids", "start", "n_tokens", "spans", "_u", "score")})
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in EDGES}
    ids = Counter(str(i) for i, _ in EDGES)
    assert Counter(str(r.doc_id) for r in secrets.span_digest(df).collect()) == ids
    assert Counter((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(df, JSON).collect()) == Counter((str(i), n[t]) for i, t in EDGES)
    assert Counter((str(r.doc_id), r.length) for r in packing.packed(df, JSON).collect()) == Counter((str(i), n[t] + 1) for i, t in EDGES)
    files = dac.token_files(df, JSON, str(tmp_path / "tokens")).collect()
    assert Counter((str(r.doc_id), r.n_tokens) for r in files) == Counter((str(i), n[t] + 1) for i, t in EDGES)
    assert {r.start for r in files} == set(np.cumsum([0, *(r.n_tokens for r in sorted(files, key=lambda r: r.start))])[:-1].tolist())
    assert Counter(str(r.doc_id) for r in repeats.repeated_strings(df).collect()) == ids
    assert Counter((str(r.doc_id), r.decoded_sha256) for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()) == Counter((str(i), sha((t or "").encode())) for i, t in EDGES)
    groups = {(str(r.doc_id), r.fingerprint): r.component_id for r in simhash.near_groups(df).collect()}
    assert groups["2", f"{fingerprint(EDGES[0][1]):016x}"] == 1 and groups["4", "0" * 16] == 3
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert Counter(str(r.doc_id) for r in toxicity.toxicity(df, labels).collect()) == ids


def test_chunks_with_one_hash_are_told_apart(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None)], "doc_id long, _text string").withColumn("text_sha256", F.sha2(F.coalesce("_text", F.lit("")), 256))
    recipe = df.withColumn("_recipe", F.when(F.col("_text").isNull(), F.array().cast("array<struct<h:bigint,r:int>>")).otherwise(F.array(F.struct(F.lit(7).cast("long").alias("h"), F.lit(0).alias("r")))))
    distinct = df.filter("doc_id < 4").select(F.lit(7).cast("long").alias("_h"), F.col("_text").alias("_chunk")).distinct()
    places = df.filter("doc_id < 4").select(F.col("text_sha256").alias("_sha"), F.lit(0).alias("_pos"), F.lit(7).cast("long").alias("_h"), F.col("_text").alias("_chunk"))
    told = exact._told_apart(recipe, places, distinct, distinct.select("_h").distinct())
    recipes = {r.doc_id: r._recipe for r in told.collect()}
    assert recipes[1] == recipes[3] and recipes[1] != recipes[2] and recipes[4] == []


def test_token_counts(spark, docs, none, texts, library, tmp_path):
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second call finds everything in the cache
        got = {r.doc_id: r for r in token_counts.token_counts(docs, JSON, cache).collect()}
        for i, t in texts:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts})
    spark.read.parquet(cache).limit(5).write.mode("append").parquet(cache)  # a digest that stands twice
    assert token_counts.token_counts(docs, JSON, cache).count() == len(texts)
    assert token_counts.token_counts(none, JSON).count() == 0


def test_token_counts_of_other_files(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    w = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    small = docs.filter("doc_id >= 4004 AND doc_id < 4012")
    for path, count in ((P.path("piece_bpe_32k.model"), lambda t: len(sp.encode(t))), (P.path("word_bpe_49k.json"), lambda t: len(w.encode(t, add_special_tokens=False).ids))):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(small, path).collect()}
        assert got == {i: count(t) for i, t in texts if 4004 <= i < 4012}


def test_packing(docs, none, texts, library):
    rows = packing.packed(docs, JSON).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in texts:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(full) <= -(-sum(r.length for r in rows) // 1024) + 3
    assert packing.packed(none, JSON).count() == 0


def test_sum_of_squares_prefers_the_crowded_gap():
    bins, offsets = packing.sum_of_squares(np.array([6, 6, 7, 3]), 10)
    # Gaps 4, 4 and 3 are open: filling the single gap of 3 changes the sum by -1, one of the two of 4 by 2 (N1 - N4 + 1) = -2.
    assert bins[3] in (0, 1) and offsets[3] == 6


def test_token_files(docs, none, texts, library, tmp_path):
    got = {r.doc_id: r for r in dac.token_files(docs, JSON, str(tmp_path / "tokens")).collect()}
    at = 0
    for i, t in sorted(texts, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert dac.token_files(none, JSON, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n, most", [(0, 2), (1, 300), (4097, 50257), (3000, 1 << 20), (777, 200)])
def test_codes_random_access(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n).astype(np.uint32)
    codes = dac.Codes(dac.pack(ids))
    assert (codes.slice(0, n) == ids).all()
    if n:
        at = rng.integers(0, n, 200)
        assert (codes.take(at) == ids[at]).all()
        for a, b in np.sort(rng.integers(0, n + 1, (40, 2)), axis=1).tolist():
            assert (codes.slice(a, b) == ids[a:b]).all()
    whole = dac.TokenFile(dac.to_bytes(np.array([5]), np.array([False]), np.array([0]), ids))
    assert (whole.document(0) == ids).all()


def test_bpe(docs, none, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert {r.doc_id: len(r.ids) for r in bpe.encoded(docs, RANKS, P.PATTERN).collect()} == {i: r.n_tokens for i, r in got.items()}
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_bpe_of_very_long_words():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng = bpe.MatrixBPE(RANKS, P.PATTERN), np.random.default_rng(9)
    words = ["z" * 5001, "ab" * 3000, "".join(rng.choice(list("etaoinshrdlu"), 9000)), "the" * 2000 + "quick" * 999, "\u00e9" * 4000, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)), "a" * (1 << 20)]
    for w in words:
        ids, lens = own.merge([w.encode()])
        assert ids.tolist() == enc._encode_single_piece(w.encode()), len(w)
        assert lens.tolist() == [len(ids)] and own.decode(ids.tolist()) == w.encode()


def fingerprint(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, none, texts):
    fps = {i: fingerprint(t or "") for i, t in texts}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(links, fps)
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.near_dedup(docs)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(want.values()) and kept.columns == docs.columns
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("tile", [simhash.TILE, 16])  # 16: most entries are dealt in tiles
def test_simhash_finds_every_close_pair_in_a_crowd(spark, tile):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    values = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(1500)})
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    classes = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, node long")
    found = {r.node: r.component for r in common.components(simhash._links(simhash._entries(classes), 4, tile)).collect()}
    links = [(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 4]
    want = components(links, range(len(values)))
    assert {n: found.get(n, n) for n in range(len(values))} == want


def test_components_of_a_chain_a_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 165)}, **{i: 7 for i in [7, *range(1000, 1200)]}}


@pytest.mark.parametrize("tile", [embeddings.TILE, 16])  # 16: most labels are dealt in tiles
def test_embeddings(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(1)
    rows, centres = [], rng.normal(size=(3, 16))
    for i in range(240):
        v = centres[i % 3] + rng.normal(size=16) * rng.choice([0.02, 0.1, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2)))
    rows += [(900 + i, rows[0][1], 0) for i in range(5)]
    rows += [(950, None, 0), (951, [0.0] * 16, 0), (952, [float("nan")] * 16, 0), (953, rows[0][1], None), (954, [None] + [1.0] * 15, 0), (955, [1.0, 2.0], 0), (956, [], 0), (957, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("component_id", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    good = {i: np.array(v, float) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: l for i, _, l in rows}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and cos(good[a], good[b]) >= 0.98]
    n, want = Counter(x for l in links for x in l), components(links, [r[0] for r in rows])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}
    assert embeddings.near_vectors(df.filter("vec_id < 0")).count() == 0


def test_embeddings_of_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.01, 0.0]
    rows = [(1, a, 0), (1, a, 0), (1, b, 0), (2, b, 0), (None, a, 0), (3, c, 0), (4, c, 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got[:2] == [("1", 1, "1", True), ("1", 2, "1", True)] or got[0][0] == "1"
    by = {(i, n): c for i, n, c, _ in got}
    assert len(got) == 7 and by["None", 0] == "None" and by["3", 2] == "1" and by["4", 0] == "4" and by["2", 1] == "1"


def test_tile_comparison_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)) * np.linspace(2, 0.1, 64)
    x[150:] = x[:150] + rng.normal(size=(150, 64)) * 0.05
    x = embeddings._unit(x)
    i, j, _ = (np.concatenate(c) for c in zip(*embeddings.linked(x, x, 0.98, upper=True)))
    want = np.argwhere(np.triu(x @ x.T >= 0.98 - embeddings.NEAR, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\x01" * length
            seen.add(w)
        out[i] = (len(b), sum(mark), sum(bool(x) for x in bytes(mark).split(b"\0")), sha(bytes(x for x, m in zip(b, mark) if not m)))
    return out


@pytest.mark.parametrize("part", [repeats.PART, 3])  # 3: most cores are dealt in parts and cut finer
def test_repeats(docs, none, texts, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_strings(docs).collect()}
    assert got == brute_repeats(texts)
    assert repeats.repeated_strings(none).count() == 0


def test_repeats_of_a_gram_in_very_many_contexts(spark):
    rng = np.random.default_rng(8)
    gram, edge = "zq" * 25, ["".join(rng.choice(list("abcdefgh"), 60)) for _ in range(300)]
    rows = [(i, edge[int(a)][int(c) :] + gram + edge[int(b)][: int(d)]) for i, (a, b, c, d) in enumerate(rng.integers(0, 300, (11_000, 4)) % [300, 300, 20, 60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_strings(df).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("length", [100, 33, 40, 48, 95])
def test_merged_transforms_find_repeats_and_common_prefixes(length):
    rng = np.random.default_rng(length)
    parts = [rng.integers(97, 100, 60).astype(np.uint8) for _ in range(4)]
    strings = [np.concatenate([parts[a], parts[b], parts[c]])[: int(n)] for a, b, c, n in np.column_stack((rng.integers(0, 4, (25, 3)), rng.integers(101, 181, 25)))]
    data, sizes = np.concatenate(strings), np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    order = rng.permutation(len(data))  # any order of windows
    want = np.zeros(len(data), bool)
    first = {}
    for p in sorted((int(a) + k for a, n in zip(starts, sizes) for k in range(n - length + 1)), key=lambda p: order[p]):
        want[p] = first.setdefault(data[p : p + length].tobytes(), p) != p
    for shards in (1, 3, 4):
        again, _ = repeats.repeated_windows(data, sizes, order, length, shards)
        assert (again == want).all()
    # A shard's transform, and the common prefix of each place with its neighbours.
    suffix = lambda p, s: data[p : starts[s] + sizes[s]].tobytes()
    string = np.repeat(np.arange(len(sizes)), sizes)
    left, step = starts[string] + sizes[string] - np.arange(len(data)), repeats.STEP
    name = repeats.names(data, left, step)
    bwt, _ = repeats.transform(name, left, length)
    assert [suffix(p, string[p])[:length] for p in bwt] == sorted(suffix(p, string[p])[:length] for p in range(len(data)))
    place = np.empty(len(data), np.int64)
    place[bwt] = np.arange(len(data))
    before = np.where(bwt - starts[string[bwt]] >= step, place[np.maximum(bwt - step, 0)], -1)
    depth = (length - 1) % step + 1
    first = np.where(left[bwt] >= depth, repeats.names(data, left, depth)[bwt], 0)
    _, _, common = repeats.interleave(first, name[np.maximum(bwt - step, 0)], before, depth, length)
    for at in rng.choice(len(data), 60, replace=False):
        p = int(bwt[at])
        own = suffix(p, string[p])
        most = max(len(os.path.commonprefix([own, suffix(q, string[q])])) for q in range(len(data)) if q != p)
        assert common[at] <= most and (common[at] + step > min(most, length) or most < depth)


def test_toxicity_grammar():
    model = toxicity.Model({"scum": 2.0, "lowe*": 1.0})
    a = model.automaton()
    kinds = lambda t: {k: v for k, v in zip(toxicity.KINDS[:-1], s) if v} if (s := toxicity.clause_sums(t, a)) is not None else None
    assert kinds("nothing here") is None
    assert kinds("what a scum indeed") == {"insult": 2.0}
    assert kinds("you scum!") == {"insult": 2.0, "insult targeted": 2.0}
    assert kinds("scum are they") == {"insult": 2.0, "insult targeted": 2.0}
    assert kinds("he is not a scum. scum") == {"insult": 4.0, "insult negated": 2.0}
    assert kinds("the paper quoted the word scum") == {"insult": 2.0, "insult reported": 2.0}
    assert kinds("i will kill you") == {"threat": 1.0, "threat targeted": 1.0}
    assert kinds("loweish viscum") == {"insult": 1.0}
    assert toxicity.clause_sums("you scum a b", a)[-1] == 500
    assert 0 <= toxicity.score(model, None) < toxicity.score(model, toxicity.clause_sums("not a scum", a)) < toxicity.score(model, toxicity.clause_sums("you scum", a)) <= 1


def test_toxicity_machine_against_its_definition():
    rng, reach = np.random.default_rng(6), toxicity.SCOPE
    for n in (0, 1, 2, 5, 9, 30):
        for _ in range(40):
            s = list(rng.choice(list(toxicity.SYMBOLS), n))
            want = [tuple(k for k, m in ((1, "N" in s[max(0, i - reach) : i]), (2, "R" in s[:i]), (3, "T" in s[max(0, i - reach) : i] + s[i + 1 : i + 1 + reach])) if m) for i in range(n)]
            assert toxicity.parse(s) == want
    assert len(toxicity.FORWARD.step) <= (reach + 1) * 2 * (reach + 1)


def test_toxicity_lexicon_takes_beginnings_by_what_longer_units_leave():
    found = toxicity.lexicon([("wor*", 60, 400), ("worthless", 55, 55), ("abc*", 40, 41), ("abcd*", 2, 2), ("the", 5, 500)], 100, 10_000, 30.0)
    assert set(found) == {"worthless", "abc*"} and found["worthless"] > found["abc*"] > 0


def test_toxicity_end_to_end(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        text = list(rng.choice(words, 30))
        if toxic:
            text[int(rng.integers(30))] = str(rng.choice(["zorgle", "quiffed"]))
        rows.append((i, " ".join(text), "clash"))
        labels.append((i, 1, toxic))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "zorgle", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (5001, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert len(got) == 903
    wrong = sum(got[i].predicted != t for i, _, t in labels if got[i].held_out)
    assert wrong <= 2 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5000").count() == 1
    assert toxicity.toxicity(docs.filter("doc_id < 0"), known.filter("doc_id < 0")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    rows = docs
    for name, stage in c.STAGES[:-1]:
        rows = common.stash(stage(spark, rows, sf), name)
        assert rows.columns == docs.columns
    kept = {r.doc_id for r in rows.select("doc_id").collect()}
    out = c.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("part", [repeats.PART, 3])
def test_repeats_of_rows_that_stand_twice(spark, texts, part, parts, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    own = [(i, t) for i, t in texts if i != 4012 and i != 4014]
    own += [(i, t) for i, t in own[::2]] + [(0, own[0][1])]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(parts, F.rand(3))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_strings(df).collect())
    want = brute_repeats(list(dict(own).items()))
    assert got == Counter((i, *want[i]) for i, _ in own)


NULS = ["a \x00b", "\x00b", "a b", "\x00", " \x00", "x \x00 \x00y", "\x00\x00 \x00\x00z", "\x00a  \x00b ", "b \x00b <|endoftext|> \x00c", "", " ", "b"]


def test_segments_of_texts_with_nul(library):
    import pyarrow as pa

    from tallgrass.llm.segments import library_encoder

    want = [library.encode(t, add_special_tokens=False).ids for t in NULS]
    encoder = library_encoder(JSON)
    for texts in (NULS, NULS[::-1], NULS[:3], NULS[5:6], []):  # the memo stands from one batch to the next
        ids, lens = encoder.batch(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])][: len(texts)] == [want[NULS.index(t)] for t in texts]


def test_token_operators_keep_nul(spark, library, tmp_path):
    df = spark.createDataFrame(list(enumerate(NULS)), "doc_id long, text string").repartition(2)
    ids = [library.encode(t, add_special_tokens=False).ids for t in NULS]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, JSON).collect()} == {i: len(x) for i, x in enumerate(ids)}
    assert {r.doc_id: r.ids_crc32 for r in packing.packed(df, JSON).collect()} == {i: crc([*x, 2]) for i, x in enumerate(ids)}
    assert {r.doc_id: r.ids_crc32 for r in dac.token_files(df, JSON, str(tmp_path / "tokens")).collect()} == {i: crc([*x, 0]) for i, x in enumerate(ids)}
    got = {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()}
    assert got == {i: sha(t.encode()) for i, t in enumerate(NULS)}
