"""Tilings of the plane and plans of queries; cells follow by arithmetic, never by joining points to tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KM_PER_DEGREE = 110.574


def grid_shape(bbox: tuple[float, float, float, float], cell_km: float, cap: int) -> tuple[int, int, float]:
    """Columns, rows and cell size that cover a box (min_lng, min_lat, max_lng, max_lat); cells grow by half until there are at most cap."""
    x0, y0, x1, y1 = bbox
    height = (y1 - y0) * KM_PER_DEGREE
    width = (x1 - x0) * KM_PER_DEGREE * max(0.1, math.cos(math.radians((y0 + y1) / 2)))
    while True:
        nx, ny = max(1, math.ceil(width / cell_km)), max(1, math.ceil(height / cell_km))
        if nx * ny <= cap:
            return nx, ny, cell_km
        cell_km *= 1.5


def tiles(spark: SparkSession, bbox: tuple[float, float, float, float], cell_km: float, cap: int) -> DataFrame:
    """ix, iy, the box of each tile, cell_km and depth 0."""
    nx, ny, cell = grid_shape(bbox, cell_km, cap)
    x0, y0, x1, y1 = bbox
    w, h = (x1 - x0) / nx, (y1 - y0) / ny
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    return cells.select("ix", "iy", (x0 + F.col("ix") * w).alias("min_x"), (y0 + F.col("iy") * h).alias("min_y"), (x0 + (F.col("ix") + 1) * w).alias("max_x"), (y0 + (F.col("iy") + 1) * h).alias("max_y"), F.lit(cell).alias("cell_km"), F.lit(0).alias("depth"))


def assign(x: Column, y: Column, box: tuple[float, float, float, float], nx: int, ny: int) -> tuple[Column, Column]:
    """The cell of a point, those outside at the rim."""
    x0, y0, x1, y1 = box
    cell = lambda v, a, b, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - a) / F.lit((b - a) / n)))).cast("long")
    return cell(x, x0, x1, nx), cell(y, y0, y1, ny)


def children(rows: DataFrame) -> DataFrame:
    """Four quarters of each box, one level deeper."""
    mx, my = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    box = lambda q, a, b, c, d: F.struct(F.lit(q).alias("quarter"), a.alias("min_x"), b.alias("min_y"), c.alias("max_x"), d.alias("max_y"))
    quarters = F.array(box(0, F.col("min_x"), F.col("min_y"), mx, my), box(1, mx, F.col("min_y"), F.col("max_x"), my), box(2, F.col("min_x"), my, mx, F.col("max_y")), box(3, mx, my, F.col("max_x"), F.col("max_y")))
    keep = [c for c in rows.columns if c not in ("min_x", "min_y", "max_x", "max_y", "depth")]
    return rows.select(*keep, (F.col("depth") + 1).alias("depth"), F.explode(quarters).alias("q")).select(*keep, "depth", "q.*")
