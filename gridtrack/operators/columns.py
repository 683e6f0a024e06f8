"""Operators along the vertical: first layers, echo tops, depths, profile crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_layer(profile: DataFrame, keys: list[str], test: Column, gap: int = 1) -> DataFrame:
    """The lowest run of levels that meet ``test``, steps of z up to ``gap``: rows of that run only."""
    order = Window.partitionBy(*keys).orderBy("z")
    on = profile.where(test).withColumn("_run", F.sum(F.when(F.col("z") - F.lag("z").over(order) > gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return on.where("_run = 0").drop("_run")


def echo_tops(profile: DataFrame, keys: list[str], thresholds: list[float], gap: int = 1) -> DataFrame:
    """Height of the top of the lowest layer with v >= threshold, a row for each column and threshold."""
    each = profile.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return first_layer(each, [*keys, "threshold"], F.col("v") >= F.col("threshold"), gap).groupBy(*keys, "threshold").agg(F.max("height").alias("echo_top"))


def cold_pool_depth(profile: DataFrame, keys: list[str], below: float, least_depth: float) -> DataFrame:
    """base, top, depth (over ``least_depth``) and intensity sqrt(-2 I) of the lowest layer with buoyancy under ``below``; I integrates by Simpson's rule (:func:`simpson_terms`)."""
    layer = simpson_terms(first_layer(profile, keys, F.col("v") < below), keys)
    g = layer.groupBy(*keys).agg(F.min("height").alias("base"), F.max("height").alias("top"), F.sum("term").alias("i"), F.min("z").alias("z_base"))
    g = g.withColumn("depth", F.col("top") - F.col("base")).where(F.col("depth") > least_depth)
    return g.select(*keys, "base", "top", "depth", "z_base", F.sqrt(F.greatest(-2 * F.col("i"), F.lit(0.0))).alias("intensity"))


def simpson_terms(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``term``: the sum over a column is the integral of v over height by Simpson's rule for uneven steps.

    Each pair of steps has a parabola; an odd step at the end takes its share of the one
    through the last three levels, and a single step is a trapezoid.
    """
    order = Window.partitionBy(*keys).orderBy("z")
    v, h = (lambda k: F.lead("v", k).over(order)), (lambda k: F.lead("height", k).over(order))
    x = profile.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*keys)), "_v1": v(1), "_v2": v(2), "_a": h(1) - F.col("height"), "_b": h(2) - h(1)})
    a, b, y, y1, y2 = (F.col(c) for c in ("_a", "_b", "v", "_v1", "_v2"))
    pair = (a + b) / 6 * (y * (2 - b / a) + y1 * (a + b) * (a + b) / (a * b) + y2 * (2 - a / b))
    last = (2 * b * b + 3 * a * b) / (6 * (a + b)) * y2 + (b * b + 3 * a * b) / (6 * a) * y1 - b * b * b / (6 * a * (a + b)) * y
    whole = (F.col("_k") % 2 == 1) & (F.col("_k") + 2 <= F.col("_n"))
    odd_end = (F.col("_n") % 2 == 0) & (F.col("_k") + 2 == F.col("_n"))
    term = F.when(F.col("_n") == 2, (y + y1) / 2 * a).otherwise(F.when(whole, pair).otherwise(0) + F.when(odd_end, last).otherwise(0))
    return x.withColumn("term", F.coalesce(term, F.lit(0.0))).drop("_k", "_n", "_v1", "_v2", "_a", "_b")


def composite(profile: DataFrame, keys: list[str], above_surface: Column, floor: float, low_z: int) -> DataFrame:
    """Highest value of a column over all levels kept and over those up to ``low_z``; values under ``floor`` are missing."""
    kept = profile.where(above_surface)
    return kept.groupBy(*keys).agg(F.max(F.when(F.col("v") >= floor, F.col("v"))).alias("composite"), F.max(F.when((F.col("z") <= low_z) & (F.col("v") >= floor), F.col("v"))).alias("low_level"))


def crossing_height(profile: DataFrame, keys: list[str], level: float = 0.0) -> DataFrame:
    """Height at which v falls through ``level``, by linear interpolation; the highest crossing counts."""
    order = Window.partitionBy(*keys).orderBy("z")
    up, h = F.lead("v").over(order), F.lead("height").over(order)
    x = profile.withColumn("h0", F.when((F.col("v") > level) & (up <= level), F.col("height") + (F.col("v") - level) / (F.col("v") - up) * (h - F.col("height"))))
    return x.groupBy(*keys).agg(F.max("h0").alias("crossing"))


def at_levels(profile: DataFrame, keys: list[str], heights: list[float]) -> DataFrame:
    """v interpolated linearly to heights between levels."""
    order = Window.partitionBy(*keys).orderBy("z")
    x = profile.withColumns({"v1": F.lead("v").over(order), "h1": F.lead("height").over(order)})
    x = x.withColumn("level", F.explode(F.array(*[F.lit(float(h)) for h in heights]))).where((F.col("level") >= F.col("height")) & (F.col("level") < F.col("h1")))
    return x.select(*keys, "level", (F.col("v") + (F.col("v1") - F.col("v")) * (F.col("level") - F.col("height")) / (F.col("h1") - F.col("height"))).alias("v"))


def column_class(profile: DataFrame, keys: list[str], melting: float, conv: float, deep: float) -> DataFrame:
    """1 updraft (v >= conv above the melting level), 2 convective (v >= conv), 3 stratiform with rain, 4 without, 5 anvil (echo aloft only), 0 none."""
    c = profile.groupBy(*keys).agg(F.max(F.when(F.col("height") > melting, F.col("v"))).alias("aloft"), F.max(F.when(F.col("height") <= melting, F.col("v"))).alias("below"), F.max("height").alias("top"))
    cls = F.when((F.col("aloft") >= conv) & (F.col("top") >= deep), 1).when(F.greatest("aloft", "below") >= conv, 2).when(F.col("below") >= conv / 2, 3).when(F.col("below") > 0, 4).when(F.col("aloft") > 0, 5).otherwise(0)
    return c.select(*keys, cls.alias("sl_class"))
