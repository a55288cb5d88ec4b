"""Near-dedup of embeddings by PCA-ordered, tiled comparison.

Unit vectors are turned onto the principal axes of all vectors, so that leading
coordinates hold most of a product.  Tiles are compared a few coordinates at a
time; what the rest can add is bounded by the product of the suffix norms, and
a pair is given up when even that bound stays under the threshold.  The first
coordinates also deal vectors into cells of which only neighbours can link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import components, forest, runs, stash, tiled

#: Coordinates after which the bound is looked at.
CUTS = (8, 16, 32)
#: Vectors of a tile, and of a block of it that is compared at a time.
TILE, BLOCK = 4096, 1024
#: Coordinates that deal vectors into cells.
AXES = 2
#: Cells of all matrices of products that are turned into axes; vectors of lengths beyond keep the axes they have.
CELLS = 1 << 24
#: Products this near to the threshold are taken again from the vectors as given.
NEAR = 1e-9


def _usable(v: Column) -> Column:
    """Whether every component is a finite number and one isn't zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the eigenvectors of the summed products of coordinates over all rows, largest first.

    Each task sums its own rows; what reaches the driver is one square matrix
    for each length, of CELLS cells in all; longer ones have no axes here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                u = _unit(_matrix(batch.column("embedding").filter(pa.array(sizes == dim))))
                sums[int(dim)] = sums.get(int(dim), 0) + u.T @ u
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(s), pa.list_(pa.float64()))], names=["dim", "i", "row"])

    wanted, room = [], CELLS
    for (dim,) in sorted(tuple(r) for r in classes.select("dim").distinct().collect()):
        if dim * dim <= room:
            wanted.append(dim)
            room -= dim * dim
    few = classes.select("dim", "embedding").filter(F.col("dim").isin(wanted)) if wanted else classes.select("dim", "embedding").limit(0)
    rows = few.mapInArrow(run, "dim int, i int, row array<double>")
    cells = rows.select("dim", "i", F.posexplode("row").alias("j", "s")).groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    found = cells.toPandas()
    axes = {}
    for dim, part in found.groupby("dim"):
        m = np.zeros((dim, dim))
        m[part["i"], part["j"]] = part["s"]
        axes[int(dim)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return axes


def turned(vectors: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Vectors at length one, on the principal axes of their length if it has some."""
    x, own = _unit(vectors), axes.get(vectors.shape[1])
    return x if own is None else x @ own


def tails(x: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Norms of what each row has behind each cut."""
    return [np.sqrt((x[:, c:] ** 2).sum(axis=1)) for c in cuts]


def reachable(x: np.ndarray, tx: np.ndarray, y: np.ndarray, ty: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows can have a product of `least`, by leading coordinates and the norms of the rest."""
    return x @ y.T + tx[:, None] * ty >= least


def linked(x: np.ndarray, y: np.ndarray, threshold: float, upper: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of x and y, with their products, that can reach the threshold, by blocks of x; upper: only i < j."""
    dim = x.shape[1]
    cuts = [c for c in CUTS if c < dim] + [dim]
    ends, least, lead = list(zip(tails(x, cuts), tails(y, cuts), strict=True)), threshold - NEAR, cuts[0]
    for low in range(0, len(x), BLOCK):
        part = slice(low, low + BLOCK)
        alive = reachable(x[part, :lead], ends[0][0][part], y[:, :lead], ends[0][1], least)
        if upper:
            alive &= np.arange(low, low + len(alive))[:, None] < np.arange(len(y))
        i, j = np.nonzero(alive)
        i, found = i + low, []
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            p, done = np.einsum("ij,ij->i", x[a, :lead], y[b, :lead]), lead
            for c, (tx, ty) in zip(cuts[1:], ends[1:], strict=True):
                p = p + np.einsum("ij,ij->i", x[a, done:c], y[b, done:c])
                keep, done = p + tx[a] * ty[b] >= least, c
                a, b, p = a[keep], b[keep], p[keep]
            keep = p >= least
            found.append((a[keep], b[keep], p[keep]))
        if found:
            yield tuple(np.concatenate(f) for f in zip(*found, strict=True))


KEYS = ["label", "dim", "c0", "c1", "lo", "hi"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one pair of tiles from batches sorted by KEYS."""
    for table in runs(batches, KEYS, least=1):
        new = np.zeros(len(table), bool)
        new[0] = True
        for c in (table[k].to_numpy() for k in KEYS):
            new[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(new).tolist(), len(table)]
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                yield table.slice(a, b - a)


def _sides(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Which rows of a pair of tiles meet; True: the same rows on both sides.

    A row's side says by its bits along which axes it comes from the cell above;
    two rows that both do along one axis meet in another cell.
    """
    side, tile = table["side"].to_numpy(), table["tile"].to_numpy()
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    own = {(s, t): np.flatnonzero((side == s) & (tile == t)) for s in range(1 << AXES) for t in {lo, hi}}
    both = [(a, b) for a in range(1 << AXES) for b in range(1 << AXES) if not a & b and (lo != hi or a <= b)]
    pairs = [(own[a, lo], own[b, hi], lo == hi and a == b) for a, b in both]
    return [p for p in pairs if len(p[0]) and len(p[1])]


def _candidates(dealt: DataFrame, threshold: float) -> DataFrame:
    """The rows of each pair of tiles whose leading coordinates (lead, the last one the norm of the rest) can reach the threshold with another's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            lead = np.frombuffer(b"".join(table["lead"].to_pylist()), np.float64).reshape(len(table), -1)
            hit = np.zeros(len(table), bool)
            for left, right, same in _sides(table):
                for at in range(0, len(left), BLOCK):
                    rows = left[at : at + BLOCK]
                    alive = reachable(lead[rows, :-1], lead[rows, -1], lead[right, :-1], lead[right, -1], threshold - NEAR)
                    if same:
                        alive[np.arange(len(rows)), at + np.arange(len(rows))] = False
                    hit[rows] |= alive.any(axis=1)
                    hit[right] |= alive.any(axis=0)
            if hit.any():
                yield from table.drop_columns(["lead"]).filter(pa.array(hit)).combine_chunks().to_batches()

    fields = [f for f in dealt.schema if f.name != "lead"]
    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, StructType(fields))


def _found(dealt: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """For each class (row) and pair of tiles in which it has links: row, links (vectors linked), root (smallest row of its part there)."""

    def group(table: pa.Table) -> pa.RecordBatch | None:
        given = _matrix(table["embedding"].combine_chunks())
        data = turned(given, axes)
        node, copies = table["row"].to_numpy(), table["copies"].to_numpy()
        links, a, b = np.zeros(len(node), np.int64), [node[:0]], [node[:0]]
        for left, right, upper in _sides(table):
            for i, j, p in linked(data[left], data[right], threshold, upper):
                i, j = left[i], right[j]
                close = np.flatnonzero(p < threshold + NEAR)
                keep = np.ones(len(i), bool)
                for at in range(0, len(close), 1 << 15):
                    c = close[at : at + (1 << 15)]
                    x, y = given[i[c]], given[j[c]]
                    keep[c] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold
                i, j = i[keep], j[keep]
                links += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
                if len(i):
                    x, y = forest(node[i], node[j])
                    a.append(x)
                    b.append(y)
        hit = np.flatnonzero(links)
        if not len(hit):
            return None
        x, y = forest(np.concatenate(a), np.concatenate(b))
        root = node[hit].copy()
        at = np.minimum(np.searchsorted(x, root), len(x) - 1)
        root = np.where(x[at] == root, y[at], root)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(root)], names=["row", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            if (out := group(table)) is not None:
                yield out

    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "row long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label).

    Rows link when their labels (integers) are equal and not null and their
    cosine reaches the threshold.  Null and zero vectors, and those with null
    or non-finite components, link with nothing, as do rows with a null
    vec_id; vectors of different lengths never link.  Equal vectors of a label
    are one class with a number of copies; rows that repeat a vec_id stay, and
    link with each other as different vectors do.
    """
    usable = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    key = [F.col("label").cast("long").alias("label"), "embedding"]
    classes = usable.select("vec_id", *key).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    # Classes of one smallest vec_id, which repeated ids make, are told apart by a number.
    classes = stash(classes.withColumns({"dim": F.size("embedding"), "row": F.monotonically_increasing_id()}), "classes")
    axes = principal_axes(classes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                data = turned(_matrix(part.column("embedding")), axes)
                cut = min(CUTS[0], int(dim))
                lead = pa.array([r.tobytes() for r in np.column_stack((data[:, :cut], tails(data, [cut])[0]))])
                cells = np.zeros((len(part), AXES), np.int32)
                cells[:, : min(AXES, int(dim))] = np.floor(data[:, :AXES] / width)
                for side in range(1 << AXES):  # a cell meets itself and, along each axis, the next one
                    at = [pa.array(cells[:, k] - (side >> k & 1)) for k in range(AXES)]
                    yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), *at, pa.array(np.full(len(part), side, np.int32)), part.column("row"), lead], names=["label", "dim", "c0", "c1", "side", "row", "lead"])

    entries = classes.select("label", "dim", "row", "embedding").mapInArrow(turn, "label long, dim int, c0 int, c1 int, side int, row long, lead binary")
    dealt = tiled(entries, ["label", "dim", "c0", "c1"], F.col("row"), TILE, F.bit_and("side") == 0)
    near = stash(_candidates(dealt, threshold), "candidates")
    # Whole vectors go only to the pairs of tiles in which they may link.
    whole = near.join(classes.select("row", "copies", "embedding"), "row")
    found = stash(_found(whole, axes, threshold), "links")
    parts = components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "row")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    linked_ = stash(classes.join(links, "row", "left").join(parts, "row", "left").filter("copies > 1 OR links > 0"), "parts")
    least = linked_.filter("component IS NOT NULL").groupBy("component").agg(F.min("node").alias("_least"))
    named = linked_.join(least, "component", "left").withColumn("component", F.col("_least"))
    named = stash(named.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "node").alias("_component")), "named")
    rows = vectors.select("vec_id", *key).withColumn("_on", F.when(F.col("vec_id").isNotNull() & _usable(F.col("embedding")), F.col("label")))
    joined = rows.join(named, (F.col("_on") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT t.vec_id, coalesce(n.n_links, 0) AS n_links, least(t.vec_id, coalesce(c.least, t.vec_id)) AS component_id, t.vec_id = least(t.vec_id, coalesce(c.least, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN n ON n.a = t.vec_id LEFT JOIN c ON c.a = t.vec_id"""
