"""Rules that the operators keep, written out anew: sums of squares over open bins, and spans of secrets."""

import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import packing, secrets


def by_all_squares(lengths, size):
    """Each piece goes to the open bin for which the squares over all gaps add up to least; ties by the fuller, then the later bin."""
    gaps: list[int] = []
    touched: list[int] = []
    out = []
    for step, n in enumerate(lengths):
        counts = np.bincount([g for g in gaps if g], minlength=size + 1)[: size + 1]
        best = None
        for b, g in enumerate(gaps):
            if g >= n:
                after = counts.copy()
                after[g] -= 1
                if g > n:
                    after[g - n] += 1
                key = int((after.astype(np.int64) ** 2).sum()), g, -touched[b]
                if best is None or key < best[0]:
                    best = key, b
        if best is None:
            gaps.append(size)
            touched.append(step)
            best = None, len(gaps) - 1
        b = best[1]
        out.append((b, size - gaps[b]))
        gaps[b] -= n
        touched[b] = step
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_goes_where_the_squares_are_least(seed):
    r = np.random.default_rng(seed)
    size = int(r.integers(8, 40))
    lengths = r.integers(1, size + 1, 150)
    if seed % 2:
        lengths = -np.sort(-lengths)
    bins, offsets = packing.sum_of_squares(lengths, size)
    assert list(zip(bins.tolist(), offsets.tolist())) == by_all_squares(lengths.tolist(), size)


def test_several_shards_fill_sequences_of_their_own(spark):
    r = np.random.default_rng(3)
    rows = [(i, 0, int(n)) for i, n in enumerate(np.minimum(r.geometric(0.02, 1200), 128))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(5)
    got = packing.pack_pieces(pieces, 128, shard=150).collect()
    assert len(got) == len(rows) and len({x.sequence_id >> 32 for x in got}) > 5
    bins: dict[int, list] = {}
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 128
    assert len(bins) <= 1.15 * sum(n for *_, n in rows) / 128 + 9


RULES = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
]
ADDED = {"pem", "github", "slack"}


def test_all_spans_of_every_text(docs, texts):
    got = {r.doc_id: r for r in secrets.span_digest(docs).collect()}
    for i, t in texts:
        base = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, rule, group, least) in enumerate(RULES) for m in re.finditer(rule, t or "") if len(m[group]) >= least]
        spans = [s for s in got[i].spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] not in ADDED] == [s for *_, s in sorted(base)]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(n == k for _, n, _ in base) for k in range(3))
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts) and all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(t or "") for s in spans)
