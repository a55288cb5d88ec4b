"""Hard negatives by spanning-tree bounds.

Anchors are dealt to blocks of neighbours, and each block gets a spanning tree
of least total length.  A block meets the rows in tiles.  In a tile, what a
row scores with a parent anchor, give or take the length of the tree's edge
times the row's norm, bounds what it scores with the child; only rows whose
bounds overlap the child's window are scored.  First the window is open at the
top and starts at the k-th best of the lower bounds (positives), then it lies
between two shares of each positive's score (negatives).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Anchors of a block and rows of a tile at most, where vectors are short, and the numbers that either may hold.
ANCHORS, ROWS, NUMBERS = 4096, 8192, 1 << 21
#: Anchors about which blocks gather; they are taken by the order of a hash.
PIVOTS = 256
#: Squared length from which a row takes no part: its scores, times a hundred, needn't fit in 64 bits.
LONGEST = 2.0**56


def _shares(size: int) -> Column:
    """How many rows of a vector length go together."""
    return F.greatest(F.lit(64), F.least(F.lit(size), F.floor(F.lit(NUMBERS) / F.greatest(F.col("dim"), F.lit(1)))))


def _whole(vectors: DataFrame, is_anchor: Column, scale: float) -> DataFrame:
    """id, label, dim, q (floor(scale * x) of each component, 32 bits each) and anchor, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(dims)), dims)
            fits = np.bincount(row, np.minimum(flat * flat, LONGEST), len(dims)) < LONGEST
            flat = flat[fits[row]].astype("<i4")
            batch, dims = batch.filter(pa.array(fits)), dims[fits]
            edges = np.concatenate(([0], np.cumsum(4 * dims))).astype(np.int32)
            q = pa.Array.from_buffers(pa.binary(), len(dims), [None, pa.py_buffer(edges), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(dims, pa.int32()), q, batch.column("anchor")], names=["id", "label", "dim", "q", "anchor"])

    return rows.mapInArrow(work, "id long, label long, dim int, q binary, anchor boolean")


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a group, which have one length, as 64-bit integers."""
    return np.frombuffer(b"".join(table["q"].to_pylist()), "<i4").astype(np.int64).reshape(len(table), table["dim"][0].as_py())


def spanning_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of visits, parent of each visit (a place in that order; -1: the root) and length of the edge to it, of a shortest spanning tree.

    A node's largest branch comes last, so that few nodes wait for their
    branches at any time.
    """
    x = q.astype(np.float64)
    n, squares = len(x), (x * x).sum(axis=1)
    parent, nearest, seen = np.full(n, -1), np.full(n, np.inf), np.zeros(n, bool)
    joined, node = [], int(squares.argmin())
    for _ in range(n):
        seen[node] = True
        joined.append(node)
        away = np.maximum(squares + squares[node] - 2 * (x @ x[node]), 0)
        closer = ~seen & (away < nearest)
        nearest[closer], parent[closer] = away[closer], node
        node = int(np.where(seen, np.inf, nearest).argmin())
    weight, branches = np.ones(n, np.int64), [[] for _ in range(n)]
    for i in reversed(joined[1:]):
        weight[parent[i]] += weight[i]
        branches[parent[i]].append(i)
    order, stack = [], joined[:1]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(branches[i], key=lambda j: -weight[j])  # the lightest is taken first
    order = np.array(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    above = parent[order]
    away = x[order] - x[np.maximum(above, 0)]
    return order, np.where(above < 0, -1, place[above]), np.sqrt((away * away).sum(axis=1)) * (1 + 1e-9)


def _trees(anchors: DataFrame) -> DataFrame:
    """anchors (a, id, label, dim, q) with block, place, parent and edge."""
    blocks = anchors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.ceil(F.col("n") / _shares(ANCHORS)))).first()[0] or 0
    chosen = anchors.select("dim", "q").orderBy(F.xxhash64("id"), "a").limit(min(int(blocks), PIVOTS)).collect()
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(r.dim, []).append(np.frombuffer(r.q, "<i4").astype(np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, near = batch.column("dim").to_numpy(), np.zeros(len(batch), np.int32)
            for dim in np.unique(dims).tolist():
                if len(pivots.get(dim, [])) > 1:
                    at, p = np.flatnonzero(dims == dim), np.array(pivots[dim])
                    x = np.frombuffer(b"".join(batch.column("q").take(pa.array(at)).to_pylist()), "<i4").astype(np.float64).reshape(len(at), dim)
                    near[at] = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*batch.schema.names, "near"])

    near = stash(anchors.mapInArrow(assign, "a long, id long, label long, dim int, q binary, near int"), "near")
    # A pivot's anchors that are too many for a block are dealt to several.
    counts = near.groupBy("dim", "near").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / _shares(ANCHORS))).drop("n")
    dealt = near.join(stash(counts, "counts"), ["dim", "near"]).withColumn("block", F.concat_ws("-", "dim", "near", F.pmod(F.xxhash64("a"), "parts")))

    def grow(table: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(_matrix(table))
        table = table.take(pa.array(order))
        return table.append_column("place", pa.array(np.arange(len(order), dtype=np.int32))).append_column("parent", pa.array(parent.astype(np.int32))).append_column("edge", pa.array(edge))

    wanted = dealt.select("block", "a", "id", "label", "dim", "q")
    return stash(wanted.groupBy("block").applyInArrow(grow, "block string, a long, id long, label long, dim int, q binary, place int, parent int, edge double"), "trees")


class Tile:
    """Rows that meet a block of anchors; equal rows count once."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        anchors = anchors.sort_by("place")
        ids = rows["id"].to_numpy()
        if len(np.unique(ids)) < len(ids):
            first = {key: k for k, key in reversed(list(enumerate(zip(ids.tolist(), rows["label"].to_pylist(), rows["q"].to_pylist()))))}
            rows = rows.take(pa.array(sorted(first.values())))
        self.ids, self.labels, q = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows)
        self.anchor, self.anchor_ids, self.anchor_labels, a = anchors["a"].to_numpy(), anchors["id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors)
        self.parent, self.edge = anchors["parent"].to_numpy(), anchors["edge"].to_numpy()
        norm = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.norms, self.anchor_norms = norm(q), norm(a)
        # Doubles hold all sums of products exactly up to here.
        exact = self.norms.max(initial=0) * self.anchor_norms.max(initial=0) < 2.0**52
        self.q, self.a = (q.astype(np.float64), a.astype(np.float64)) if exact else (q, a)
        self.scored = 0

    def visit(self, find: Callable[[int, np.ndarray, np.ndarray, Callable], None]) -> None:
        """Calls find(anchor, low, high, score) in the tree's order; score(rows) gives exact scores and draws both bounds together there."""
        waiting = np.bincount(self.parent[self.parent >= 0], minlength=len(self.parent))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        every = np.arange(len(self.ids))
        for k, up in enumerate(self.parent.tolist()):
            low, high = np.empty(len(every)), np.empty(len(every))

            def score(at: np.ndarray) -> np.ndarray:
                s = self.q[at] @ self.a[k]
                low[at] = high[at] = s
                self.scored += len(at)
                return s.astype(np.int64)

            if up < 0:
                score(every)
            else:
                slack = self.edge[k] * self.norms + 1e-12 * self.anchor_norms[up] * self.norms
                np.subtract(bounds[up][0], slack, out=low)
                np.add(bounds[up][1], slack, out=high)
                waiting[up] -= 1
                if not waiting[up]:
                    del bounds[up]
            find(k, low, high, score)
            if waiting[k]:
                bounds[k] = low, high

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in `at` of its k best: high scores first, ties by the smaller id."""
        if len(at) > 4 * k:
            least = np.partition(scores, len(scores) - k)[-k]
            keep = np.flatnonzero(scores >= least)
            return keep[np.lexsort((self.ids[at[keep]], -scores[keep]))[:k]]
        return np.lexsort((self.ids[at], -scores))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _out(columns: dict[str, list[np.ndarray]]) -> pa.Table:
    return pa.table({c: np.concatenate(parts) if parts else np.empty(0, np.int64) for c, parts in columns.items()})


def tile_positives(tile: Tile, k: int) -> pa.Table:
    """a, id, score: each anchor's k best other rows of its label in a tile."""
    out: dict[str, list[np.ndarray]] = {"a": [], "id": [], "score": []}

    def find(n: int, low: np.ndarray, high: np.ndarray, score: Callable) -> None:
        same = np.flatnonzero((tile.labels == tile.anchor_labels[n]) & (tile.ids != tile.anchor_ids[n]))
        at = same[high[same] >= _kth(low[same], k)]
        s = score(at)
        top = tile.best(at, s, k)
        for c, v in (("a", np.full(len(top), tile.anchor[n])), ("id", tile.ids[at[top]]), ("score", s[top])):
            out[c].append(v)

    tile.visit(find)
    return _out(out)


def tile_negatives(tile: Tile, windows: dict[int, list[tuple[int, int, int]]], k: int) -> pa.Table:
    """a, positive (a score), id, score: for each window (positive, low, high) of an anchor the k best rows of other labels within it."""
    out: dict[str, list[np.ndarray]] = {"a": [], "positive": [], "id": [], "score": []}

    def find(n: int, low: np.ndarray, high: np.ndarray, score: Callable) -> None:
        asked = windows.get(int(tile.anchor[n]), [])
        if not asked:
            return
        other = np.flatnonzero(tile.labels != tile.anchor_labels[n])
        lo, hi = low[other], high[other]
        hit = np.zeros(len(other), bool)
        for _, least, most in asked:
            sure = lo[(lo >= least) & (hi <= most)]
            hit |= (hi >= max(least, _kth(sure, k))) & (lo <= most)
        at = other[hit]
        s = score(at)
        for positive, least, most in asked:
            within = np.flatnonzero((s >= least) & (s <= most))
            top = within[tile.best(at[within], s[within], k)]
            for c, v in (("a", np.full(len(top), tile.anchor[n])), ("positive", np.full(len(top), positive)), ("id", tile.ids[at[top]]), ("score", s[top])):
                out[c].append(v)

    tile.visit(find)
    return _out(out)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key, with rank; limited before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from rows (vec_id, embedding, label).

    Components become floor(scale * x), scores are integer inner products;
    higher ones come first, ties by the smaller vec_id.  An anchor's positives
    are its first `positives` rows of its label with other ids; for each, the
    first `negatives` rows of other labels with low * p <= 100 * score <= high *
    p, p being the positive's score, are returned.  Rows with a null vec_id,
    label or vector, with null or non-finite components, or of a squared length
    of 2^56 and more after scaling, take no part; vectors of different lengths
    never meet, those without components score 0.  Equal rows count once; rows
    that share an id and differ are rows (and anchors) of their own.  An empty
    table gives none; other columns are ignored.
    """
    rows = stash(_whole(vectors, is_anchor, scale), "rows")
    anchors = stash(rows.filter("anchor").select("id", "label", "dim", "q").distinct().withColumn("a", F.monotonically_increasing_id()).select("a", "id", "label", "dim", "q"), "anchors")
    trees = _trees(anchors)
    tiles = stash(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / _shares(ROWS)).cast("int")).drop("n"), "tiles")
    blocks = stash(trees.groupBy("dim", "block").count().drop("count"), "blocks")
    # Every block meets every tile of its length.
    dealt = rows.drop("anchor").join(tiles, "dim").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).drop("tiles").join(blocks, "dim")
    spread = trees.join(tiles, "dim").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    keys = ["block", "tile"]

    def near(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return tile_positives(Tile(left, right), positives) if len(left) and len(right) else _out({"a": [], "id": [], "score": []})

    found = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(near, "a long, id long, score long")
    chosen = stash(_first(found, ["a"], positives).select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive")), "positives")
    asked = chosen.filter("positive >= 0").groupBy("a").agg(F.collect_set("positive").alias("asked"))  # at most `positives` of an anchor
    spread = spread.join(asked, "a", "left")

    def far(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _out({"a": [], "positive": [], "id": [], "score": []})
        windows = {a: [(p, -(-low * p // 100), high * p // 100) for p in ps] for a, ps in zip(right["a"].to_pylist(), right["asked"].to_pylist()) if ps}
        return tile_negatives(Tile(left, right), windows, negatives)

    found = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(far, "a long, positive long, id long, score long")
    best = _first(found, ["a", "positive"], negatives)
    ids = anchors.select("a", F.col("id").alias("anchor_id"))
    return chosen.join(best, ["a", "positive"]).join(ids, "a").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
