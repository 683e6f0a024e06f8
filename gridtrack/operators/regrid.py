"""Other grids: weights, nearest cells, blocks, and spherical cells of equal area."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted means on a target grid: weights (y, x, dst, w); missing source pixels take no weight."""
    w = pixels.where(F.col("v").isNotNull()).join(weights, ["y", "x"])
    return w.groupBy("frame_id", "dst").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def block_weights(spark, ny: int, nx: int, factor: int) -> DataFrame:
    """Conservative weights onto blocks of ``factor`` x ``factor`` cells shifted by half a cell: a source cell may lie in up to four."""
    src = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x"))
    part = F.explode(F.array(*[F.struct(F.lit(dy / 2).alias("py"), F.lit(dx / 2).alias("px")) for dy in (0, 1) for dx in (0, 1)]))
    half = src.withColumn("p", part)
    to = lambda c, p: F.floor((F.col(c) + F.col(p)) / factor)
    return half.groupBy("y", "x", (to("y", "p.py") * math.ceil((nx + 1) / factor) + to("x", "p.px")).alias("dst")).agg((F.count("*") / 4).alias("w"))


def coarsened(pixels: DataFrame, factor: int) -> DataFrame:
    """Block means; blocks are cut at the edge as they fall."""
    return pixels.groupBy("frame_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def nearest(points: DataFrame, grid: DataFrame, lat0: float, dlat: float, lon0: float, dlon: float, tolerance: float) -> DataFrame:
    """Each point with the regular grid's nearest cell (y, x), if within ``tolerance`` degrees of its centre in both directions."""
    y, x = F.floor((F.col("plat") - lat0) / dlat + 0.5).cast("int"), F.floor((F.col("plon") - lon0) / dlon + 0.5).cast("int")
    near = points.withColumns({"y": y, "x": x}).where((F.abs(F.col("plat") - (lat0 + F.col("y") * dlat)) <= tolerance) & (F.abs(F.col("plon") - (lon0 + F.col("x") * dlon)) <= tolerance))
    return near.join(grid, ["y", "x"])


def sphere_cell(lat: Column, lon: Column, order: int) -> Column:
    """Nested index of the equal-area cell (12 * 4^order on the sphere) that holds a place in degrees."""
    side = 1 << order
    z, phi = F.sin(F.radians(lat)), F.pmod(F.radians(lon), F.lit(2 * math.pi))
    tt = F.pmod(phi / (math.pi / 2), F.lit(4.0))
    a, b = side * (0.5 + tt), side * z * 0.75
    jp, jm = F.floor(a - b), F.floor(a + b)
    fp, fm = F.floor(jp / side), F.floor(jm / side)
    face = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)
    ix, iy = F.pmod(jm, F.lit(side)), side - F.pmod(jp, F.lit(side)) - 1
    quarter = F.least(F.floor(tt), F.lit(3))
    tp, root = tt - quarter, side * F.sqrt(3 * (1 - F.abs(z)))
    up, um = F.least(F.floor(tp * root), F.lit(side - 1)), F.least(F.floor((1 - tp) * root), F.lit(side - 1))
    polar = F.abs(z) > 2 / 3
    face = F.when(polar, F.when(z >= 0, quarter).otherwise(quarter + 8)).otherwise(face).cast("long")
    ix = F.when(polar, F.when(z >= 0, side - um - 1).otherwise(up)).otherwise(ix).cast("long")
    iy = F.when(polar, F.when(z >= 0, side - up - 1).otherwise(um)).otherwise(iy).cast("long")
    bits = F.lit(0).cast("long")
    for k in range(order):
        bits = bits + F.shiftright(ix, k).bitwiseAND(F.lit(1)) * (1 << 2 * k) + F.shiftright(iy, k).bitwiseAND(F.lit(1)) * (1 << 2 * k + 1)
    return face * side * side + bits


def geo_box(pixels: DataFrame, grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Pixels in the index box around the cells within the limits, counted from the box's corner."""
    inside = grid.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    box = inside.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    both = pixels.join(F.broadcast(box), F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    return both.select("frame_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")
