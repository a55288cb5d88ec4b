"""Hot keys, long strings, orders of rows and leftovers: what the operators must not depend on."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallgrass.llm import common, dac, packing, repeats, secrets, token_counts, toxicity

JSON = P.path("byte_bpe_50k.json")


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_token_counts_choose_one_row_of_a_digest_first(spark):
    rows = [(i, "hot text here") for i in range(300)] + [(7, "hot text here")] * 5 + [(None, "hot text here"), (None, "only null"), (1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    t = Tokenizer.from_file(JSON)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, JSON).collect())
    assert got == sorted((str(i), len((x or "").encode()), len(t.encode(x or "").ids)) for i, x in rows)


def test_token_files_split_rows_of_one_id(spark, tmp_path, whole_partitions):
    texts = [f"text number {i}" for i in range(400)]
    rows = [(5, x) for x in texts] + [(None, x) for x in texts[:50]] + [(9, "end"), (1, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = dac.write_tokens(df, JSON, str(tmp_path / "t"))
    assert manifest.filter("docs > 0").count() > 2 and manifest.agg(F.max("docs")).first()[0] < 300
    t = Tokenizer.from_file(JSON)
    got = sorted(dac.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 50 + [1] + [5] * 400 + [9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    crc = sorted(zlib.crc32(np.array([*t.encode(x).ids, 0], "<u4").tobytes()) for _, x in rows)
    assert sorted(r.ids_crc32 for r in got) == crc


@pytest.mark.parametrize("length", [100, 250])
def test_crowded_cores_of_long_strings(length):
    """More strings of one core than a merge may take: the bytes stay within a place's bits, and more are refused."""
    assert repeats.part_size(length) * (repeats.BLOCKS[0] + length - 1) * 1.8 < 1 << repeats._BITS
    assert repeats.part_size(100) == repeats.PART
    with pytest.raises(ValueError, match="too many"):
        n = (1 << repeats._BITS) // 300 + 1
        repeats.repeated_windows(np.zeros(n * 300, np.uint8), np.full(n, 300), np.arange(n * 300), length)


def test_long_strings_with_a_crowded_core(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 40)
    r = random.Random(3)
    core = "".join(r.choices("abcdef ", k=260))
    texts = ["".join(r.choices("ghij", k=r.randint(0, 20))) + core + "".join(r.choices("klmn", k=r.randint(0, 20))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        covered = set()
        for k in range(len(t) - 249):
            w = t[k : k + 250]
            if w in seen:
                covered.update(range(k, k + 250))
            seen.add(w)
        want[i] = len(covered)
    assert {x.doc_id: x.n_removed for x in repeats.repeated_strings(df, 250).collect()} == want


def test_one_model_for_any_order_of_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.join(docs, "doc_id").filter("toxic = 1").limit(5).collect()
    # Equal texts of contrary labels, in both halves.
    more = [(10_000_000 + 7 * k + j, r.text) for j, r in enumerate(known) for k in range(6)]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    labels = labels.select("doc_id", "toxic").union(spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(more)], "doc_id long, toxic int"))
    models = [toxicity.fit(docs.repartition(n, F.rand(n)), labels.repartition(n)) for n in (1, 3, 7)]
    assert models[0].units == models[1].units == models[2].units
    assert all(np.allclose([*m.coefficients, m.intercept], [*models[0].coefficients, models[0].intercept], rtol=0, atol=1e-9) for m in models)


def test_scratch_is_cleared_but_for_older_tables(spark):
    kept = common.stash(spark.range(5), "kept")
    mark = common.scratch_mark(spark)
    gone = common.stash(spark.range(5), "gone")
    assert gone.count() == 5 and common.clear_scratch(spark, mark) == 1
    assert kept.count() == 5 and common.clear_scratch(spark, mark) == 0
    with pytest.raises(Exception):
        gone.count()


SPACELESS = ["日本語テスト" * 400, "x" * 9000, "QUJDRA" * 500 + "==", "a" + "　".join(["字"] * 500)]


def test_texts_without_spaces(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(SPACELESS * 3)), "doc_id long, text string").repartition(2)
    t = Tokenizer.from_file(JSON)
    ids = [t.encode(x, add_special_tokens=False).ids for x in SPACELESS]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, JSON).collect()} == {i: len(ids[i % 4]) for i in range(12)}
    assert {r.doc_id: r.ids_crc32 for r in dac.token_files(df, JSON, str(tmp_path / "t")).collect()} == {i: crc([*ids[i % 4], 0]) for i in range(12)}
    pieces = packing.packed(df, JSON).collect()
    assert sum(r.length for r in pieces) == sum(len(x) + 1 for x in ids) * 3 and max(r.offset + r.length for r in pieces) <= 1024
    assert {r.doc_id for r in secrets.span_digest(df).collect()} == set(range(12))
