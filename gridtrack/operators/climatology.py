"""Maps, sections, histograms, composites and cycles over frames and tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .scratch import accumulated, stored


def monthly_map(pixels: DataFrame, month: Column, mask: Column, rain: float = 0.0) -> DataFrame:
    """For each month and pixel: the sum of v, the sum and count within ``mask``, and how many frames have v over ``rain``."""
    v = F.col("v")
    return pixels.groupBy(month.alias("month"), "y", "x").agg(F.sum(v).alias("precipitation"), F.sum(F.when(mask, v).otherwise(0)).alias("masked_precipitation"), F.sum(F.when(mask & (v > rain), 1).otherwise(0)).cast("long").alias("masked_count"), F.count_distinct("frame_id").alias("ntimes"))


def quantiles(rows: DataFrame, keys: list[str], v: Column, shares: dict[str, float]) -> DataFrame:
    """(keys and a column for each of ``shares``): exact quantiles of v by group, between the two values around each place in proportion; missing values do not count.

    Values are counted first, so equal ones are one row; counts are summed in order of the values over ranges
    (:func:`scratch.accumulated`), and of each group only the two rows around a place are kept.  No task holds a group or a
    buffer that grows with it.
    """
    counted = stored(rows.select(*keys, v.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n")), "values")
    whole = stored(counted.groupBy(*keys).agg(F.sum("_n").alias("_total")), "totals")
    upto = accumulated(counted, [*keys, "_v"], keys, "_n", "_upto")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    at = upto.alias("a").join(whole.alias("b"), same).select(*[F.col(f"a.{c}") for c in keys], "_v", "_n", "_upto", "_total")
    place = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    holds = lambda i: (F.col("_upto") > i) & (F.col("_upto") - F.col("_n") <= i)
    ends = {(name, side): holds(f(place(p))) for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    near = at.where(F.greatest(*[c.cast("int") for c in ends.values()]) == 1) if len(ends) > 1 else at
    found = near.groupBy(*keys).agg(F.max("_total").alias("_total"), *[F.max(F.when(c, F.col("_v"))).alias(f"_{name}_{side}") for (name, side), c in ends.items()])
    between = {name: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (place(p) - F.floor(place(p))) for name, p in shares.items()}
    return found.select(*keys, *[c.alias(name) for name, c in between.items()])


def stats_map(pixels: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Track attributes averaged over the tracks that touch a pixel: distinct tracks, times, mean and percentiles of lifetime."""
    both = pixels.join(tracks, "track")
    each = both.select(*keys, "track", "lifetime").distinct()
    once = each.groupBy(*keys).agg(F.count("*").alias("n_tracks"), F.avg("lifetime").alias("lifetime_mean"))
    once = once.join(quantiles(each, keys, F.col("lifetime"), {f"lifetime_p{p}": p / 100 for p in (50, 75, 90, 95)}), keys, "left")
    return both.groupBy(*keys).agg(F.count("*").alias("n_times"), F.avg("speed").alias("speed_mean")).join(once, keys)


def hovmoller(pixels: DataFrame, time: Column, mask: Column) -> DataFrame:
    """Means over y by time and x, of v and of v within ``mask`` (0 elsewhere)."""
    return pixels.groupBy(time.alias("time"), "x").agg(F.avg("v").alias("mean_v"), F.avg(F.when(mask, F.col("v")).otherwise(0)).alias("mean_masked"))


def histogram(rows: DataFrame, v: Column, low: float, high: float, bins: int, keys: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Counts by bin of equal width, the last closed; share, and running share from the first bin."""
    keys = keys or []
    k = F.when(v == high, bins - 1).otherwise(F.floor((v - low) / ((high - low) / bins)))
    n = F.count("*") if weight is None else F.sum(weight)
    h = rows.where((v >= low) & (v <= high)).groupBy(*keys, k.cast("long").alias("bin")).agg(n.alias("n"))
    all_ = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return h.select(*keys, "bin", "n", (F.col("n") / F.sum("n").over(all_)).alias("share"), (F.sum("n").over(run) / F.sum("n").over(all_)).alias("cumulative"))


def histogram2d(rows: DataFrame, a: Column, b: Column, step_a: float, step_b: float) -> DataFrame:
    return rows.groupBy(F.floor(a / step_a).alias("bin_a"), F.floor(b / step_b).alias("bin_b")).agg(F.count("*").alias("n"))


def unique_density(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """How many different tracks visit each rounded place (halves to even)."""
    return rows.select("track", F.bround(a, 0).cast("long").alias("ra"), F.bround(b, 0).cast("long").alias("rb")).distinct().groupBy("ra", "rb").agg(F.count("*").alias("n_tracks"))


def box_statistics(rows: DataFrame, box: list[Column], v: Column, least: int) -> DataFrame:
    """Mean, median, highest and 95th percentile by box; null in boxes with under ``least`` rows."""
    named = rows.select(*box, v.alias("_value"))
    keys = named.columns[:-1]
    g = named.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_value").alias("mean"), F.max("_value").alias("highest"))
    g = g.join(quantiles(named, keys, F.col("_value"), {"median": 0.5, "p95": 0.95}), keys, "left").select(*keys, "n", "mean", "median", "highest", "p95")
    ok = F.col("n") >= least
    return g.withColumns({c: F.when(ok, F.col(c)) for c in ("mean", "median", "highest", "p95")})


def harmonics(rows: DataFrame, keys: list[str], hour: Column, v: Column, count: int, period: float = 24.0) -> DataFrame:
    """Amplitude, hour of the peak and share of variance of the first harmonics of the mean cycle."""
    cycle = rows.groupBy(*keys, hour.alias("h")).agg(F.avg(v).alias("m"))
    out = cycle.withColumn("harmonic", F.explode(F.sequence(F.lit(1), F.lit(count))))
    angle = 2 * math.pi * F.col("harmonic") * F.col("h") / period
    g = out.groupBy(*keys, "harmonic").agg((2 * F.avg(F.col("m") * F.cos(angle))).alias("a"), (2 * F.avg(F.col("m") * F.sin(angle))).alias("b"), F.var_pop("m").alias("var"))
    amp = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    peak = F.pmod(F.atan2("b", "a"), F.lit(2 * math.pi)) / (2 * math.pi) * period / F.col("harmonic")
    return g.select(*keys, F.col("harmonic").cast("long").alias("harmonic"), amp.alias("amplitude"), peak.alias("peak_hour"), (amp * amp / 2 / F.expr("nullif(var, 0)")).alias("variance_share"))


def seasonal_ratio(rows: DataFrame, month: Column, keys: list[str], mask: Column) -> DataFrame:
    """Amount, share, frequency and intensity of v within ``mask`` by season."""
    v = F.col("v")
    g = rows.groupBy(S.season(month).alias("season"), *keys).agg(F.sum(v).alias("total"), F.sum(F.when(mask, v).otherwise(0)).alias("amount"), F.avg(F.when(mask, 1.0).otherwise(0.0)).alias("frequency"), F.avg(F.when(mask, v)).alias("intensity"))
    return g.withColumn("fraction", F.col("amount") / F.expr("nullif(total, 0)"))


def seasonal_cycle(starts: DataFrame) -> DataFrame:
    """Mean and population deviation, over the years from the first to the last, of counts by month, months without any as 0."""
    n = starts.groupBy("year", "month").agg(F.count("*").alias("n"))
    grid = n.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return grid.join(n, ["year", "month"], "left").fillna(0, ["n"]).groupBy("month").agg(F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("std_n"))


def composite(rows: DataFrame, v: Column, lifetimes: tuple[int, int]) -> DataFrame:
    """Mean and quartiles of v by relative time over tracks with a lifetime in range."""
    keep = rows.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n").between(*lifetimes)).select("track")
    kept = rows.join(keep, "track").select("t_idx", v.alias("_value"))
    mean = kept.groupBy("t_idx").agg(F.count("*").alias("n"), F.avg("_value").alias("mean"))
    return mean.join(quantiles(kept, ["t_idx"], F.col("_value"), {f"q{p}": p / 100 for p in (25, 50, 75)}), "t_idx", "left")


def density(rows: DataFrame, v: Column, grid: list[float], width: float, keys: list[str] | None = None) -> DataFrame:
    """Gaussian kernel density on a fixed grid."""
    at = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("at")
    each = rows.select(*(keys or []), v.alias("_v"), at)
    return each.groupBy(*(keys or []), "at").agg((F.avg(F.exp(-F.pow((F.col("at") - F.col("_v")) / width, 2) / 2)) / (width * math.sqrt(2 * math.pi))).alias("density"))


def in_region(rows: DataFrame, lat: tuple[float, float], lon: tuple[float, float], least: int, months: list[int], month: Column) -> DataFrame:
    """Tracks that start in a box and in given months and last ``least`` times, with merge and split flags."""
    first = rows.where((F.col("t_idx") == 0) & F.col("lat").between(*lat) & F.col("lon").between(*lon) & month.isin(*months)).select("track")
    life = rows.groupBy("track").agg(F.count("*").alias("lifetime"), F.max(F.col("merge_track").isNotNull()).alias("merges"), F.max(F.col("split_track").isNotNull()).alias("splits"))
    return life.where(F.col("lifetime") >= least).join(first, "track")


def density2d(rows: DataFrame, a: Column, b: Column, grid_a: list[float], grid_b: list[float], width_a: float, width_b: float) -> DataFrame:
    """Joint Gaussian kernel density on a fixed grid (at_a, at_b)."""
    ga, gb = (F.explode(F.array(*[F.lit(float(g)) for g in grid])) for grid in (grid_a, grid_b))
    each = rows.select(a.alias("_a"), b.alias("_b")).withColumn("at_a", ga).withColumn("at_b", gb)
    z = F.pow((F.col("at_a") - F.col("_a")) / width_a, 2) + F.pow((F.col("at_b") - F.col("_b")) / width_b, 2)
    return each.groupBy("at_a", "at_b").agg((F.avg(F.exp(-z / 2)) / (2 * math.pi * width_a * width_b)).alias("density"))


def initiation_map(rows: DataFrame, keys: list[str], hours: float) -> DataFrame:
    """By place: hours with a track there, tracks that start there, and the mean speed."""
    return rows.groupBy(*keys).agg((F.count_distinct("base_time") * hours).alias("track_hours"), F.sum((F.col("t_idx") == 0).cast("long")).alias("n_started"), F.avg("speed").alias("speed_mean"))
