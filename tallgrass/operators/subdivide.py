"""Searches that are split where they are full: a frontier of tiles, round by round, over written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

KEY = ["text", "depth", "ix", "iy"]


def cell(v: Column, low: float, high: float, n: Column) -> Column:
    """The cell of a value among n equal ones; those outside lie at the rim."""
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((v - low) / (high - low) * n))).cast("long")


def subdivided(planned: DataFrame, places: DataFrame, box: tuple[float, float, float, float], grid: tuple[int, int], full: int = 100, least_new: int = 1, deepest: int = 2, resumed: DataFrame | None = None) -> DataFrame:
    """(text, depth, ix, iy, place, results, new, split): every search of a campaign, with what it found and whether it was split.

    planned: text, ix, iy, place (their order) of the first searches, tiles of a
    grid over the box; places: id, text, x, y, a row for each text that finds a
    place.  A search that finds `full` places or more, `least_new` of them new
    to the campaign, gives four searches of its quarters, to `deepest` levels.
    A place is new to the earliest search that finds it; the searches of a round
    come in the order of their parents and quarters.  resumed: searches (KEY)
    that were made before; they are not made again, and what they found counts
    as known.  Each round reads the tables of the one before and writes its
    own, so a lost executor costs one round; places meet tiles by arithmetic.
    """
    x0, y0, x1, y1 = box
    nx, ny = grid

    def hits(searches: DataFrame, depth: int) -> DataFrame:
        scale = 1 << depth
        at = places.select("id", "text", F.lit(depth).alias("depth"), cell(F.col("x"), x0, x1, F.lit(nx * scale)).alias("ix"), cell(F.col("y"), y0, y1, F.lit(ny * scale)).alias("iy"))
        return searches.join(at, KEY)

    seen, done = None, []
    if resumed is not None:
        for depth in range(deepest + 1):
            found = hits(resumed.filter(F.col("depth") == depth).select(*KEY), depth).select("id")
            seen = found if seen is None else seen.unionByName(found)
        seen = kept(seen.distinct(), "seen")
    frontier = planned.select("text", F.lit(0).alias("depth"), F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("place").cast("long").alias("place"))
    for depth in range(deepest + 1):
        if resumed is not None:
            frontier = frontier.join(resumed.select(*KEY), KEY, "left_anti")
        frontier = kept(frontier, "frontier")
        if frontier.isEmpty():
            break
        found = kept(hits(frontier, depth).select("id", "place"), "found")
        fresh = found if seen is None else found.join(seen, "id", "left_anti")
        fresh = kept(fresh.groupBy("id").agg(F.min("place").alias("place")), "fresh")
        results, new = (df.groupBy("place").agg(F.count(F.lit(1)).alias(name)) for df, name in ((found, "results"), (fresh, "new")))
        round_ = frontier.join(results, "place", "left").join(new, "place", "left").fillna(0, ["results", "new"])
        round_ = kept(round_.withColumn("split", (F.col("results") >= full) & (F.col("new") >= max(0, least_new)) & F.lit(depth < deepest)).select(*KEY, "place", "results", "new", "split"), "round")
        done.append(round_)
        seen = fresh.select("id") if seen is None else kept(seen.unionByName(fresh.select("id")), "seen")
        quarter = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(q % 2).alias("dx"), F.lit(q // 2).alias("dy")) for q in range(4)]))
        parts = round_.filter("split").withColumn("part", quarter)
        frontier = parts.select("text", (F.col("depth") + 1).alias("depth"), (2 * F.col("ix") + F.col("part.dx")).alias("ix"), (2 * F.col("iy") + F.col("part.dy")).alias("iy"), (4 * F.col("place") + F.col("part.q")).alias("place"))
    if not done:
        return planned.select("text", F.lit(0).alias("depth"), F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("place").cast("long").alias("place"), F.lit(0).cast("long").alias("results"), F.lit(0).cast("long").alias("new"), F.lit(False).alias("split")).limit(0)
    out = done[0]
    for round_ in done[1:]:
        out = out.unionByName(round_)
    return out
