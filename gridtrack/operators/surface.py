"""Fixed fields of the grid: land, terrain, cells; and what is joined with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grids of up to this many cells go to all executors; larger ones are joined by a shuffle.
SMALL_GRID = 1_000_000


def on_grid(pixels: DataFrame, grid: DataFrame, columns: list[str], small: int = SMALL_GRID) -> DataFrame:
    """``pixels`` with ``columns`` of the grid table (y, x, ...), null off the grid; only a grid counted as small is broadcast."""
    own = grid.select("y", "x", *columns)
    n = own.limit(small + 1).count()
    return pixels.join(F.broadcast(own) if n <= small else own.hint("merge"), ["y", "x"], "left")


def land_share(pixels: DataFrame, keys: list[str], land: str = "land") -> DataFrame:
    """(keys, npix, landfrac): the share of an object's pixels over land, unknown surface left out."""
    return pixels.groupBy(*keys).agg(F.count("*").alias("npix"), F.avg(F.when(F.col(land).isNotNull(), (F.col(land) > 0).cast("double"))).alias("landfrac"))


def within_land(objects: DataFrame, low: float, high: float) -> DataFrame:
    """Objects with a land share from ``low`` to ``high``."""
    return objects.where(F.col("landfrac").between(low, high))


def by_surface(rows: DataFrame, land_over: float, ocean_under: float, first: int = 3, column: str = "landfrac") -> DataFrame:
    """(track, landfrac_mean, landfrac_start, surface): tracks by their mean land share, with that of their first times; those between the limits are mixed."""
    g = rows.groupBy("track").agg(F.avg(column).alias("landfrac_mean"), F.avg(F.when(F.col("t_idx") < first, F.col(column))).alias("landfrac_start"))
    kind = F.when(F.col("landfrac_mean") > land_over, "land").when(F.col("landfrac_mean") < ocean_under, "ocean").otherwise("mixed")
    return g.withColumn("surface", kind)


def above_terrain(volume: DataFrame, grid: DataFrame, clearance: float, terrain: str = "terrain") -> DataFrame:
    """Levels (y, x, height, ...) more than ``clearance`` over the ground; where the ground is unknown it counts as 0."""
    return on_grid(volume, grid, [terrain]).where(F.col("height") > F.coalesce(terrain, F.lit(0.0)) + clearance).drop(terrain)


def bilinear_weights(points: DataFrame, lat0: float, dlat: float, lon0: float, dlon: float, ny: int, nx: int) -> DataFrame:
    """(y, x, dst, w): for target points (dst, plat, plon) the four cells of a regular grid around each, by bilinear weight; points outside the cell centres have none."""
    v, u = (F.col("plat") - lat0) / dlat, (F.col("plon") - lon0) / dlon
    inside = points.where(v.between(0, ny - 1) & u.between(0, nx - 1))
    y0, x0 = F.least(F.floor(v), F.lit(ny - 2)), F.least(F.floor(u), F.lit(nx - 2))
    corner = [F.struct((y0 + b).cast("int").alias("y"), (x0 + a).cast("int").alias("x"), ((v - y0 if b else 1 - (v - y0)) * (u - x0 if a else 1 - (u - x0))).alias("w")) for b in (0, 1) for a in (0, 1)]
    return inside.select("dst", F.explode(F.array(*corner)).alias("c")).select("c.y", "c.x", "dst", "c.w").where("w > 0")


def gathered(values: DataFrame, lookup: DataFrame) -> DataFrame:
    """Values by cell (frame_id, cell, v) put on a grid by its table (y, x, cell): (frame_id, y, x, v)."""
    return lookup.join(values, "cell").select("frame_id", "y", "x", "v")


def quality_masked(v: Column, quality: Column, least: float = 0.5) -> Column:
    """v where the quality index reaches ``least``, else null."""
    return F.when(quality >= least, v)


def surface_based(layers: DataFrame, level: int) -> DataFrame:
    """Layers whose lowest level is the surface's."""
    return layers.where(F.col("z_base") == level)
