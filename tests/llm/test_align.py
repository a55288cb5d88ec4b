"""Alignment of two tokenizers against a plain version, and the memo of segments under texts without spaces."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallgrass.llm import align
from tallgrass.llm.segments import LONG, library_encoder, piece_encoder

JSON, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(rows, sides):
    """The contract written out token by token."""
    a, b = sides
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown}
    byte |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    of_piece = lambda p: bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode()
    found, count = [], Counter()
    for i, t in rows:
        t = t or ""
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a, bytes_b = [bytes(byte[c] for c in a.id_to_token(x)) for x in ids_a], [of_piece(b.id_to_piece(x)) for x in ids_b]
        want = (" " + t).encode()
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append((i, None))
            continue
        sa, sb = spans(bytes_a), spans(bytes_b)
        links, j = [], 0
        for (s, e), x in zip(sa, ids_a):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((x, ids_b[k]))
                k += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = list(zip([0, *cuts], cuts))
        text = ";".join(",".join(str(x) for (s, e), x in zip(sa, ids_a) if lo <= s and e <= hi) + "|" + ",".join(str(x) for (s, e), x in zip(sb, ids_b) if lo <= s and e <= hi) for lo, hi in groups) if len(cuts) < 3000 else None
        count.update(links)
        found.append((i, (len(ids_a), len(ids_b), len(cuts), links, text)))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, text = f
            out.append((i, n_a, n_b, n_groups, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), text and hashlib.sha256(text.encode()).hexdigest()))
    return out, count, most


ODD = [(5000, "a  b"), (5001, " lead"), (5002, "trail "), (5003, "▁under"), (5004, "<s> x </s> <0x41>"), (5005, "a\n\nb\tc"), (5006, "x" * 3000), (5007, "日本語" * 500), (5007, "日本語" * 500), (None, "no id")]


@pytest.mark.parametrize("sizes", [(align.RUN_BYTES, align.WIDTH, align.FRAME), (4000, 3, 50)])  # small: many runs, merged in rounds, of many frames
def test_alignment(spark, docs, texts, sides, sizes, monkeypatch):
    monkeypatch.setattr(align, "FRAME", sizes[2])
    more = spark.createDataFrame([(i, t, "en", "s", 0, "extra", 1) for i, t in ODD], docs.schema)
    got = [tuple(r) for r in align.aligned_tokens(docs.union(more), JSON, PIECES, sizes[0], sizes[1]).collect()]
    want, _, _ = plain(texts + ODD, sides)
    assert len(got) == len(want)
    digests = {w[0]: w[7] for w in want}
    same = [g[:7] + (None,) if digests[g[0]] is None else g for g in got]
    assert sorted(same, key=str) == sorted(want, key=str)


def test_alignment_edges(spark, none):
    assert align.aligned_tokens(none, JSON, PIECES).count() == 0
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, None, "x")], "doc_id long, text string, sha string")
    assert sorted(map(tuple, align.aligned_tokens(df, JSON, PIECES).collect()), key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_pair_table(docs, texts, sides):
    _, count, most = plain(texts, sides)
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in align.pair_table(docs, JSON, PIECES, 4000, 3).collect()}
    assert got == {(a, b): (n, n == most[b]) for (a, b), n in count.items()}


def test_merge_of_runs_is_a_sum_in_order():
    r = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(7):
        keys = np.unique(r.integers(0, 500, int(r.integers(1, 200)))) << 20
        counts = r.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append([align.packed(keys[i : i + 11], counts[i : i + 11]) for i in range(0, len(keys), 11)])
    parts = list(align.merged(runs))
    keys = np.concatenate([p[0] for p in parts])
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), np.concatenate([p[1] for p in parts]).tolist())) == dict(want)


def test_memo_stays_bounded_without_spaces():
    """Whole texts are single segments here; ids stay those of the library and the memo small."""
    r, tokenizer = random.Random(1), Tokenizer.from_file(JSON)
    encoder = library_encoder(JSON, most=1 << 20)
    for k in range(20):
        texts = ["".join(r.choices("日本語中文字漢テスト", k=300)) for _ in range(250)] + ["".join(r.choices("abcdefgh", k=9)) + " " + "".join(r.choices("ijkl", k=LONG - k % 3)) for _ in range(20)]
        ids, lens = encoder.batch(pa.array(texts))
        if k % 5 == 0:
            want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
        assert encoder.key_bytes < 1 << 16 and encoder.used < 1 << 16
    assert encoder.memo_bytes < 3 << 20


@pytest.mark.parametrize("texts", [["a b", "a b  c", " x ", "", "▁", "a ▁b", "c\x00 d"], ["only"], []])
def test_piece_segments_are_the_library_s(sides, texts):
    encoder = piece_encoder(PIECES)
    for _ in range(2):
        ids, lens = encoder.batch(pa.array([" " + t for t in texts], pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])][: len(texts)] == [sides[1].encode(t) for t in texts]
