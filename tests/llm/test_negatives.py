"""Hard negatives against their SQL and a plain version."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import negatives, queries

SF = "/root/testdata/sf0.001"


def plain(rows, anchor, positives=5, k=10, low=30, high=90):
    """rows: (id, label, components)."""
    keep = []
    for i, label, v in {(i, l, None if v is None else tuple(v)) for i, l, v in rows}:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = tuple(int(np.floor(256 * float(x))) for x in v)
            if sum(x * x for x in q) < 2**56:
                keep.append((i, label, q))
    keep = list(set(keep))
    out = []
    for a in keep:
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in keep if len(a[2]) == len(b[2]))
        for s, p, _ in [x for x in scored if x[2] == a[1] and x[1] != a[0]][:positives]:
            hits = [(n, t) for t, n, label in scored if label != a[1] and low * -s <= 100 * -t <= high * -s]
            out += [(a[0], p, r, n, -s, -t) for r, (n, t) in enumerate(hits[:k], 1)]
    return sorted(out)


def clustered(seed, n, dim, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = centres[r.integers(0, 12, n)] + spread * r.normal(size=(n, dim))
    return [(int(i), int(r.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]


SCHEMA = "vec_id long, label int, embedding array<double>, score string, a string"


@pytest.fixture(params=["blocks", "one"])
def sizes(request, monkeypatch):
    if request.param == "blocks":  # many blocks of anchors, gathered about pivots, and many tiles of rows
        monkeypatch.setattr(negatives, "_shares", lambda size: F.lit({negatives.ANCHORS: 5, negatives.ROWS: 70}[size]))


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_hard_negatives(spark, sizes, dim):
    rows = clustered(dim, 500, dim) + [(900 + i, i % 3, [0.5] * dim) for i in range(40)]  # a group of equal vectors: ties
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_odd_rows(spark, sizes):
    nan, inf = float("nan"), float("inf")
    rows = clustered(1, 60, 2) + [
        (100, None, [1.0, 1.0]), (110, 1, None), (120, 1, [1.0, None]), (130, 1, [nan, 1.0]), (140, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]), (150, 1, []), (151, 1, []), (152, 2, []),
        (160, 0, [1.0, 1.0, 1.0]), (161, 0, [1.0, 1.0, 2.0]), (162, 1, [1.0, 1.0, -0.5]), (170, 1, [1e30, 1.0]), (180, 1, [2e5, 1.0]), (181, 1, [2e5, 1.0]), (182, 2, [1e5, 1.0]), (0, 2, [3.0, 1.0]),
    ]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0) and {150, 160, 180} <= {g[0] for g in got}
    assert negatives.hard_negatives(df.filter("vec_id < -1"), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(negatives.ORACLE)
    assert queries.op13_hard_negatives(spark, SF).columns == [d[0] for d in want.description]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect())) == sorted(want.fetchall())


def test_tree_is_shortest_and_bounds_spare_scores():
    rows = clustered(4, 900, 16, 0.05)
    q = np.array([np.floor(256 * np.array(v)) for _, _, v in rows]).astype("<i4")
    order, parent, edge = negatives.spanning_tree(q[:60].astype(np.int64))
    assert sorted(order.tolist()) == list(range(60)) and parent[0] == -1 and (parent[1:] < np.arange(1, 60)).all()
    x = q[:60].astype(float)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    joined, total = {0}, 0.0  # Prim's rule, pair by pair
    while len(joined) < 60:
        d, j = min((away[i, j], j) for i in joined for j in range(60) if j not in joined)
        joined.add(j)
        total += d
    assert abs(edge[1:].sum() - total) < 1e-3
    table = lambda m: pa.table({"id": np.arange(len(m)), "label": np.arange(len(m)) % 3, "dim": pa.array([16] * len(m), pa.int32()), "q": [v.tobytes() for v in m]})
    anchors = table(q[:60]).take(pa.array(order)).append_column("a", pa.array(order)).append_column("place", pa.array(np.arange(60))).append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))
    tile = negatives.Tile(table(q), anchors)
    negatives.tile_positives(tile, 5)
    assert tile.scored < 0.5 * 60 * 900
