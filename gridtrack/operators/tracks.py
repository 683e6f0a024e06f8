"""Statistics, classification and lifecycle of tracks: tables keyed by (track, t_idx)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .scratch import numbered


def feature_stats(pixels: DataFrame, value: str = "v", core: float | None = None, cell_km2: float = 1.0) -> DataFrame:
    """One row for each (frame_id, feature): npix, area, mean place, mean, lowest and highest value, the place of the highest (first in raster order on ties), pixels over ``core``."""
    v = F.col(value)
    core_test = v > (core if core is not None else float("inf"))
    top = F.min_by(F.struct("y", "x"), F.struct(-v, "y", "x"))
    out = pixels.groupBy("frame_id", "feature").agg(
        F.count("*").alias("npix"), (F.count("*") * cell_km2).alias("area"), F.avg("y").alias("mean_y"), F.avg("x").alias("mean_x"),
        F.avg(v).alias("mean_v"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), top.alias("top"),
        F.sum(core_test.cast("long")).alias("core_px"), F.avg(F.when(core_test, v)).alias("core_mean"),
    )
    return out.withColumns({"top_y": F.col("top.y"), "top_x": F.col("top.x")}).drop("top")


def time_index(rows: DataFrame, time: str = "frame_id") -> DataFrame:
    """t_idx from 0 along each track."""
    return rows.withColumn("t_idx", (F.row_number().over(Window.partitionBy("track").orderBy(time)) - 1).cast("long"))


def start_end(rows: DataFrame, max_times: int | None = None) -> DataFrame:
    """duration, first and last time and status of each track; the end is null where a track fills ``max_times``."""
    out = rows.groupBy("track").agg(F.count("*").alias("duration"), F.min_by("base_time", "t_idx").alias("start_basetime"), F.max_by("base_time", "t_idx").alias("end_basetime"), F.min_by("status", "t_idx").alias("start_status"), F.max_by("status", "t_idx").alias("end_status"))
    if max_times:
        whole = F.col("duration") < max_times
        out = out.withColumns({"end_basetime": F.when(whole, F.col("end_basetime")), "end_status": F.when(whole, F.col("end_status"))})
    return out


def without_short(rows: DataFrame, least: int) -> DataFrame:
    """Tracks of ``least`` times or more, renumbered from 1 in order (track keeps its old number as old_track)."""
    keep = rows.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    new = numbered(keep.select(F.col("track").alias("old_track")), "old_track", "track")
    return rows.withColumnRenamed("track", "old_track").join(new, "old_track")


def renumbered_targets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces old track numbers in ``columns`` by the new ones; those of dropped tracks become null."""
    new = rows.select("old_track", "track").distinct()
    for c in columns:
        rows = rows.join(new.select(F.col("old_track").alias(c), F.col("track").alias("_to")), c, "left").drop(c).withColumnRenamed("_to", c)
    return rows


def islands(rows: DataFrame, test: Column, gap: int) -> DataFrame:
    """(track, run, first_idx, last_idx, length, n): runs of rows that meet ``test`` with steps of t_idx up to ``gap``; length counts the gaps in."""
    order = Window.partitionBy("track").orderBy("t_idx")
    on = rows.where(test).select("track", "t_idx")
    on = on.withColumn("run", F.sum(F.when(F.col("t_idx") - F.lag("t_idx").over(order) > gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return on.groupBy("track", "run").agg(F.min("t_idx").alias("first_idx"), F.max("t_idx").alias("last_idx"), (F.max("t_idx") - F.min("t_idx") + 1).alias("length"), F.count("*").alias("n"))


def long_systems(rows: DataFrame, area: str, over: float, gap: int, least: float, hours: float = 1.0) -> DataFrame:
    """(track, main_hours, n_runs): tracks with a run of ``area`` > ``over`` that lasts ``least`` hours or more."""
    runs = islands(rows, F.col(area) > over, gap).where(F.col("length") * hours >= least)
    return runs.groupBy("track").agg(F.max(F.col("length") * hours).alias("main_hours"), F.count("*").alias("n_runs"))


def main_tracks(rows: DataFrame, least_times: int, area: str, least_area: float) -> DataFrame:
    """Tracks of ``least_times`` times or more whose largest ``area`` reaches ``least_area``."""
    return rows.groupBy("track").agg(F.count("*").alias("lifetime"), F.max(area).alias("max_area")).where((F.col("lifetime") >= least_times) & (F.col("max_area") >= least_area))


def attached(rows: DataFrame, main: DataFrame, shorter: int, per_time: int) -> DataFrame:
    """(track, base_time, kind, rank, small_track, feature, area): short tracks that merge into or split from main ones, the first ``per_time`` by number at each time of the main track."""
    life = rows.groupBy("track").agg(F.count("*").alias("life"), F.max("merge_track").alias("into"), F.min("split_track").alias("of"))
    small = life.where(F.col("life") < shorter).join(main.select("track"), "track", "left_anti")
    both = small.where("into IS NOT NULL").select(F.col("track").alias("small_track"), F.col("into").alias("main"), F.lit("merge").alias("kind")).union(small.where("of IS NOT NULL").select("track", "of", F.lit("split")))
    found = both.join(main.select(F.col("track").alias("main")), "main").join(rows.select(F.col("track").alias("small_track"), "base_time", "feature", "area"), "small_track")
    found = found.join(rows.select(F.col("track").alias("main"), "base_time"), ["main", "base_time"])
    rank = F.row_number().over(Window.partitionBy("main", "base_time", "kind").orderBy("small_track", "feature"))
    return found.select(F.col("main").alias("track"), "base_time", "kind", rank.cast("long").alias("rank"), "small_track", "feature", "area").where(F.col("rank") <= per_time)


def near_in_time(left: DataFrame, right: DataFrame, time: str, seconds: int) -> DataFrame:
    """Pairs with |left time - right time| < ``seconds``: an equi-join on time buckets, each left row in its own and both next ones."""
    key = F.floor(F.col(time) / seconds)
    a = left.withColumn("_b", F.explode(F.array(key - 1, key, key + 1)))
    b = right.withColumnRenamed(time, f"{time}_right").withColumn("_b", F.floor(F.col(f"{time}_right") / seconds))
    return a.join(b, "_b").where(F.abs(F.col(time) - F.col(f"{time}_right")) < seconds).drop("_b")


def rain_totals(pixels: DataFrame, heavy: float, wet: float = 0.0) -> DataFrame:
    """(frame_id, feature, total_rain, total_heavyrain, rain_npix, max_rain, max_y, max_x): amounts over the whole object, whether in a rain feature or not, and the place of its highest rain (first in raster order on ties)."""
    v = F.col("v").cast("double")
    g = pixels.groupBy("frame_id", "feature").agg(
        F.sum(F.when(v > wet, v).otherwise(0)).alias("total_rain"), F.sum(F.when(v > heavy, v).otherwise(0)).alias("total_heavyrain"),
        F.sum((v > wet).cast("long")).alias("rain_npix"), F.max(v).alias("max_rain"), F.min_by(F.struct("y", "x"), F.struct(-v, "y", "x")).alias("_at"),
    )
    return g.withColumns({"max_y": F.col("_at.y"), "max_x": F.col("_at.x")}).drop("_at")


def rain_stats(pixels: DataFrame, heavy: float, top: int, land: str | None = None) -> DataFrame:
    """For the ``top`` largest rain features of each object: size, mean, highest, skewness, heavy amount, 95th percentile; with a column ``land``, its share of land."""
    v = F.col("v").cast("double")
    f = pixels.groupBy("frame_id", "feature", "pf").agg(F.count("*").alias("pf_npix"), F.avg(v).alias("pf_rainrate"), F.max(v).alias("pf_maxrate"), F.skewness(v).alias("pf_skewness"), F.sum(v).alias("pf_accum"), F.sum(F.when(v > heavy, v).otherwise(0)).alias("pf_heavy"), F.percentile(v, 0.95).alias("pf_p95"),
        *([F.avg((F.col(land) > 0).cast("double")).alias("pf_landfrac")] if land else []))
    order = Window.partitionBy("frame_id", "feature").orderBy(F.desc("pf_npix"), "pf")
    return f.withColumn("pf_rank", F.row_number().over(order).cast("long")).where(F.col("pf_rank") <= top)


def shapes(pixels: DataFrame, keys: list[str], km: float = 1.0) -> DataFrame:
    """Axes, eccentricity, orientation and weighted centroid of each object from the second moments of its pixels."""
    w = F.col("v").cast("double")
    m = pixels.groupBy(*keys).agg(F.count("*").alias("npix"), (F.var_pop("x") + 1 / 12).alias("a"), (F.var_pop("y") + 1 / 12).alias("c"), F.covar_pop("x", "y").alias("b"), (F.sum(w * F.col("y")) / F.sum(w)).alias("wy"), (F.sum(w * F.col("x")) / F.sum(w)).alias("wx"))
    root = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    major, minor = (F.col("a") + F.col("c")) / 2 + root, (F.col("a") + F.col("c")) / 2 - root
    return m.select(*keys, "npix", (4 * km * F.sqrt(major)).alias("majoraxis"), (4 * km * F.sqrt(F.greatest(minor, F.lit(0.0)))).alias("minoraxis"), F.sqrt(1 - F.greatest(minor, F.lit(0.0)) / major).alias("eccentricity"), (0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("orientation"), F.col("wy").alias("weighted_y"), F.col("wx").alias("weighted_x"))


def robust(rows: DataFrame, axis: tuple[float, float], gap: int, least: float, area: tuple[float, float], rate: tuple[float, float], skew: tuple[float, float], heavy: tuple[float, float], hours: float = 1.0) -> DataFrame:
    """Tracks with a long enough run of the largest rain feature's axis in range in which it is long enough over thresholds linear in the run's length.

    ``rows``: track, t_idx, pf_axis, pf_area, pf_rate, pf_skew, pf_heavy, pf_total; each
    threshold is intercept + slope * hours.  A track is looked at if its times with the axis
    in range last over ``least`` hours in all; a run if it lasts ``least``, gaps counted in.  Of a run's own
    times, those with area, rate and skewness over their thresholds together have to last ``least`` hours, and
    the run's heavy rain, in percent of its total, has to be over its threshold.
    """
    own = rows.where(F.col("pf_axis").between(*axis))
    order = Window.partitionBy("track").orderBy("t_idx")
    own = own.withColumns({"_run": F.sum(F.when(F.col("t_idx") - F.lag("t_idx").over(order) > gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_times": F.count("*").over(Window.partitionBy("track"))})
    run = Window.partitionBy("track", "_run")
    own = own.where(F.col("_times") * hours > least).withColumn("pf_hours", (F.max("t_idx").over(run) - F.min("t_idx").over(run) + 1) * F.lit(float(hours)))
    line = lambda p: F.lit(float(p[0])) + F.lit(float(p[1])) * F.col("pf_hours")
    together = (F.col("pf_area") > line(area)) & (F.col("pf_rate") > line(rate)) & (F.col("pf_skew") > line(skew))
    g = own.where(F.col("pf_hours") >= least).groupBy("track", "_run", "pf_hours").agg((F.sum(together.cast("long")) * hours).alias("_over"), (100 * F.sum("pf_heavy") / F.expr("nullif(sum(pf_total), 0)")).alias("_heavy"))
    return g.where((F.col("_over") >= least) & (F.col("_heavy") > line(heavy))).groupBy("track").agg(F.max("pf_hours").alias("pf_hours"), F.count("*").alias("n_runs"))


def lifetime_over(rows: DataFrame, column: str, over: float, hours: float = 1.0) -> DataFrame:
    """Hours at which ``column`` is over a threshold; a value equal to it does not count."""
    return rows.groupBy("track").agg((F.sum((F.col(column) > over).cast("long")) * hours).alias("pf_lifetime"))


def lifecycle(rows: DataFrame, stage: Column, gap: int = 2) -> DataFrame:
    """(track, stages, complete, idx1..idx5): the longest run of classified times, how many stages it has (complete: 4 or more), and where each starts."""
    s = rows.withColumn("stage", stage)
    runs = islands(s, F.col("stage").between(1, 5), gap)
    best = runs.groupBy("track").agg(F.max_by(F.struct("first_idx", "last_idx"), F.struct("length", -F.col("run"))).alias("r"))
    inside = s.join(best, "track").where(F.col("t_idx").between(F.col("r.first_idx"), F.col("r.last_idx")) & F.col("stage").between(1, 5))
    first = [F.min(F.when(F.col("stage") == k, F.col("t_idx"))).alias(f"idx{k}") for k in range(1, 6)]
    return inside.groupBy("track").agg(F.count_distinct("stage").alias("stages"), *first).withColumn("complete", F.col("stages") >= 4)


def painted(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(frame_id, y, x, tracknumber, incl_attached): a pixel's track, and the one that its track merges into or splits from, if any."""
    n = nodes.select("frame_id", "feature", "track", F.coalesce("merge_track", "split_track", "track").alias("incl_attached"))
    return labels.join(n, ["frame_id", "feature"]).select("frame_id", "y", "x", F.col("track").alias("tracknumber"), "incl_attached")


def unwrapped(rows: DataFrame, column: str, length: float, jump: float) -> DataFrame:
    """A path in a periodic domain made continuous: a step over ``jump`` adds or takes ``length`` from there on. Adds <column>_path and wraps."""
    order = Window.partitionBy("track").orderBy("t_idx")
    step = F.col(column) - F.lag(column).over(order)
    turn = F.when(step > jump, -1).when(step < -jump, 1).otherwise(0)
    return rows.withColumn("wraps", F.sum(turn).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn(f"{column}_path", F.col(column) + F.col("wraps") * length)


def speeds(rows: DataFrame, lag: int = 1) -> DataFrame:
    """distance (km), speed (km/h) and direction from each time of a track to the one ``lag`` later."""
    order = Window.partitionBy("track").orderBy("t_idx")
    lat, lon, t = (F.lead(c, lag).over(order) for c in ("lat", "lon", "base_time"))
    km = S.haversine(F.col("lat"), F.col("lon"), lat, lon)
    return rows.withColumns({"distance": km, "speed": km / ((t - F.col("base_time")) / 3600), "direction": S.bearing_of((lon - F.col("lon")) * F.cos(F.radians("lat")), lat - F.col("lat"))})


def interpolated(rows: DataFrame, column: str, time: str = "base_time") -> DataFrame:
    """Missing values between valid ones of a track filled linearly in time; ends stay missing."""
    back = Window.partitionBy("track").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("track").orderBy("t_idx").rowsBetween(0, Window.unboundedFollowing)
    has = F.col(column).isNotNull()
    v0, t0 = F.last(column, True).over(back), F.last(F.when(has, F.col(time)), True).over(back)
    v1, t1 = F.first(column, True).over(on), F.first(F.when(has, F.col(time)), True).over(on)
    return rows.withColumn(f"{column}_filled", F.coalesce(F.col(column), v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0)))


def circular_mean(rows: DataFrame, keys: list[str], column: str, low: float, high: float) -> DataFrame:
    """Mean of a coordinate with period high - low."""
    angle = (F.col(column) - low) / (high - low) * 2 * math.pi
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))
    return rows.groupBy(*keys).agg((F.pmod(mean, F.lit(2 * math.pi)) / (2 * math.pi) * (high - low) + low).alias(f"{column}_mean"))


def rain_systems(rows: DataFrame, rate: float, volume: float, gap: int, least: float, hours: float = 1.0) -> DataFrame:
    """(track, rain_hours): tracks with a long enough run of times whose highest rate and rain volume are both over their thresholds."""
    runs = islands(rows, (F.col("pf_maxrate") > rate) & (F.col("pf_volume") > volume), gap).where(F.col("length") * hours >= least)
    return runs.groupBy("track").agg(F.max(F.col("length") * hours).alias("rain_hours"))


def radar_systems(rows: DataFrame, axis: float, gap: int, least: float, hours: float = 1.0) -> DataFrame:
    """(track, line_hours): tracks with a long enough run of times whose feature is ``axis`` long or more and holds an intense core."""
    runs = islands(rows, (F.col("pf_axis") >= axis) & (F.col("core_area") > 0), gap).where(F.col("length") * hours >= least)
    return runs.groupBy("track").agg(F.max(F.col("length") * hours).alias("line_hours"))


def split_rain(pixels: DataFrame, keys: list[str], convective: Column) -> DataFrame:
    """Size, mean and amount of v for convective and other pixels of each object, and the convective share."""
    v = F.col("v")
    other = ~convective
    g = pixels.groupBy(*keys).agg(
        F.sum(convective.cast("long")).alias("conv_px"), F.avg(F.when(convective, v)).alias("conv_mean"), F.sum(F.when(convective, v).otherwise(0)).alias("conv_total"),
        F.sum(other.cast("long")).alias("strat_px"), F.avg(F.when(other, v)).alias("strat_mean"), F.sum(F.when(other, v).otherwise(0)).alias("strat_total"),
    )
    return g.withColumn("conv_share", F.col("conv_px") / (F.col("conv_px") + F.col("strat_px")))


def with_attached(nodes: DataFrame, small: DataFrame) -> DataFrame:
    """(frame_id, feature, track): a main track's objects and those of the tracks attached to it; ``small`` (track, small_track)."""
    own = nodes.select("frame_id", "feature", "track")
    more = nodes.withColumnRenamed("track", "small_track").join(small.select("track", "small_track").distinct(), "small_track").select("frame_id", "feature", "track")
    return own.unionByName(more)


def last_valid(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The last value of each column that is not missing, by track."""
    return rows.groupBy("track").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t_idx"))).alias(f"last_{c}") for c in columns])


def running_median(rows: DataFrame, keys: list[str], order: str, column: str, window: int) -> DataFrame:
    """Median over ``window`` (odd) consecutive rows, with zeros beyond the ends."""
    k = window // 2
    around = F.collect_list(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k))
    padded = F.array_sort(F.concat(around, F.array_repeat(F.lit(0.0), F.lit(window) - F.size(around))))
    return rows.withColumn(f"{column}_median", F.element_at(padded, k + 1))


def boxes(labels: DataFrame, nx: int, wrap: bool = False) -> DataFrame:
    """(frame_id, feature, y0, y1, x0, x1): bounding boxes; with ``wrap`` an object over the edge has x1 < x0 + its width counted on past nx.

    The columns that an object has are ordered round the circle; its box starts after the widest gap.
    """
    rows = labels.groupBy("frame_id", "feature").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    if not wrap:
        return rows
    cols = labels.select("frame_id", "feature", "x").distinct()
    order = Window.partitionBy("frame_id", "feature").orderBy("x")
    nxt = F.coalesce(F.lead("x").over(order), F.first("x").over(order) + nx)
    gap = cols.withColumns({"start": nxt, "gap": nxt - F.col("x")})
    start = gap.groupBy("frame_id", "feature").agg(F.max(F.struct("gap", "start")).alias("g"))
    both = rows.join(start, ["frame_id", "feature"])
    x0 = F.pmod(F.col("g.start"), F.lit(nx))
    return both.select("frame_id", "feature", "y0", "y1", x0.alias("x0"), (x0 + nx - F.col("g.gap")).alias("x1"))


def started_between(rows: DataFrame, start: int, end: int, smooth: str = "lat_smooth") -> DataFrame:
    """Rows of tracks that begin within the times, with the smoothed latitude where there is one."""
    first = rows.where(F.col("t_idx") == 0).where(F.col("base_time").between(start, end)).select("track")
    lat = F.coalesce(F.col(smooth), F.col("lat")) if smooth in rows.columns else F.col("lat")
    return rows.join(first, "track", "left_semi").withColumn("lat", lat)


def painted_in_full(labels: DataFrame, nodes: DataFrame, rain: DataFrame, over: float) -> DataFrame:
    """The pixel mask with all its variants.

    (frame_id, y, x, tracknumber, track_status, merge_tracknumber, split_tracknumber, pcp_tracknumber): the track, its
    status at the time, the track that it merges into or splits from, and the track where ``rain`` (frame_id, y, x,
    v) is over a limit, 0 elsewhere.
    """
    n = nodes.select("frame_id", "feature", F.col("track").alias("tracknumber"), F.col("status").alias("track_status"), F.col("merge_track").alias("merge_tracknumber"), F.col("split_track").alias("split_tracknumber"))
    wet = rain.where(F.col("v") > over).select("frame_id", "y", "x", F.lit(True).alias("_wet"))
    out = labels.join(n, ["frame_id", "feature"]).join(wet, ["frame_id", "y", "x"], "left")
    return out.select("frame_id", "y", "x", "tracknumber", "track_status", F.coalesce("merge_tracknumber", F.lit(0)).alias("merge_tracknumber"), F.coalesce("split_tracknumber", F.lit(0)).alias("split_tracknumber"), F.when(F.col("_wet"), F.col("tracknumber")).otherwise(0).alias("pcp_tracknumber"))


def merge_split_index(rows: DataFrame) -> DataFrame:
    """(track, merge_track, end_merge_idx, end_merge_feature, split_track, start_split_idx, start_split_feature).

    Where a track ends by merging, the time index in the other track is one after the one at
    the same time, and the feature is that of the other track then; where it starts by a split, one before.  Null where the
    other track has no such time.
    """
    last = rows.groupBy("track").agg(F.max_by(F.struct("base_time", "merge_track"), "t_idx").alias("e"), F.min_by(F.struct("base_time", "split_track"), "t_idx").alias("s"))
    last = last.select("track", F.col("e.merge_track").alias("merge_track"), F.col("e.base_time").alias("end_time"), F.col("s.split_track").alias("split_track"), F.col("s.base_time").alias("start_time"))
    at = rows.select("track", "base_time", "t_idx", "feature")

    def met(other: str, time: str, step: int, index: str, feature: str) -> DataFrame:
        same = last.where(F.col(other).isNotNull()).select(F.col("track").alias("of"), F.col(other).alias("track"), F.col(time).alias("base_time")).join(at, ["track", "base_time"])
        return same.select("of", "track", (F.col("t_idx") + step).alias("t_idx")).join(at.drop("base_time"), ["track", "t_idx"]).select(F.col("of").alias("track"), F.col("t_idx").alias(index), F.col("feature").alias(feature))

    return last.select("track", "merge_track", "split_track").join(met("merge_track", "end_time", 1, "end_merge_idx", "end_merge_feature"), "track", "left").join(met("split_track", "start_time", -1, "start_split_idx", "start_split_feature"), "track", "left")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, within: float) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of the same keys that is nearest in time and less than ``within`` seconds away, the earlier of two as near; rows without one stay away.

    An equi-join on time buckets of the different keys and times of ``left``, whose best match then goes to every row that has
    them, repeated rows too; the right side's columns come as a struct ``nearest``.
    """
    bucket = F.floor(F.col(time) / within)
    a = left.select(*keys, time).distinct().withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    names = [c for c in right.columns if c not in keys]
    b = right.select(*keys, F.struct(*names).alias("_r"), bucket.alias("_b"))
    dt = F.abs(F.col(time) - F.col(f"_r.{time}"))
    both = a.join(b, [*keys, "_b"]).where(dt < within)
    best = both.groupBy(*keys, time).agg(F.min_by("_r", F.struct(dt, F.col(f"_r.{time}"))).alias("nearest"))
    return left.join(best, [*keys, time]).select(*left.columns, "nearest")


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables by their keys, rows of either kept; a column that both have is the left one's, and the right one's where that is missing."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"_{c}") if c in both else F.col(c) for c in right.columns if c not in keys])
    out = left.join(r, keys, "full")
    return out.select(*keys, *[F.coalesce(c, f"_{c}").alias(c) if c in both else F.col(c) for c in left.columns if c not in keys], *[F.col(c) for c in right.columns if c not in left.columns])


def at_common_times(left: DataFrame, right: DataFrame, time: str = "base_time") -> DataFrame:
    """Rows of ``left`` and ``right`` at the times that both have: columns of the right side end in _right."""
    r = right.select(time, *[F.col(c).alias(f"{c}_right") for c in right.columns if c != time])
    return left.join(r, time)


def echo_areas(columns: DataFrame, keys: list[str], heights: list[float], cell_km2: float = 1.0) -> DataFrame:
    """Area of an object's pixels whose echo top is over each height, mean and highest echo top."""
    top = F.col("echo_top")
    return columns.groupBy(*keys).agg(*[(F.count(F.when(top > h, 1)) * cell_km2).alias(f"area_eth{h:g}") for h in heights], F.avg(top).alias("eth_mean"), F.max(top).alias("eth_max"))


def core_stats(pixels: DataFrame, keys: list[str], core: str, top: int, km: float = 1.0) -> DataFrame:
    """The ``top`` largest cores of each object: rank, pixels, axes, eccentricity, mean and highest value, weighted centre."""
    inside = pixels.where(F.col(core) > 0)
    shape = shapes(inside, [*keys, core], km)
    value = inside.groupBy(*keys, core).agg(F.avg("v").alias("core_mean"), F.max("v").alias("core_max"))
    order = Window.partitionBy(*keys).orderBy(F.desc("npix"), core)
    return shape.join(value, [*keys, core]).withColumn("core_rank", F.row_number().over(order).cast("long")).where(F.col("core_rank") <= top)


def guarded(rows: DataFrame, keys: list[str], limit: int, what: str) -> DataFrame:
    """``rows``, with an error as soon as a group of ``keys`` has over ``limit`` of them."""
    n = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit(f"over {limit} {what}: "), n.cast("string"))
    return rows.withColumn("_n", F.when(n > limit, F.raise_error(message).cast("long")).otherwise(n)).where("_n IS NOT NULL").drop("_n")


def merge_split_kinds(rows: DataFrame) -> DataFrame:
    """(track, ms, nms, nm, ns): whether a track merges or splits, does neither, does not merge, does not split."""
    g = rows.groupBy("track").agg(F.max(F.col("merge_track").isNotNull()).alias("m"), F.max(F.col("split_track").isNotNull()).alias("s"))
    m, s = F.col("m"), F.col("s")
    return g.select("track", (m | s).alias("ms"), (~m & ~s).alias("nms"), (~m).alias("nm"), (~s).alias("ns"))


def perimeters(labels: DataFrame) -> DataFrame:
    """(frame_id, feature, perimeter): the length of an object's edge.

    Edge pixels have one of their four neighbours outside; each counts 1, root 2 or their mean by how many edge
    pixels are beside it and across its corners, as a path through it does.
    """
    own = labels.select("frame_id", "feature", "y", "x")

    def around(rows: DataFrame, steps: list[tuple[int, int]], name: str) -> DataFrame:
        moved = rows.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
        return moved.select("frame_id", "feature", (F.col("y") + F.col("_s.a")).alias("y"), (F.col("x") + F.col("_s.b")).alias("x")).groupBy("frame_id", "feature", "y", "x").agg(F.count("*").alias(name))

    cross, corners = [(-1, 0), (0, -1), (0, 1), (1, 0)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    keys = ["frame_id", "feature", "y", "x"]
    edge = own.join(around(own, cross, "n"), keys, "left").where(F.coalesce("n", F.lit(0)) < 4).select(*keys)
    code = edge.join(around(edge, cross, "c"), keys, "left").join(around(edge, corners, "d"), keys, "left")
    # One for itself, two for each edge pixel beside it, ten for each across a corner.
    code = code.withColumn("k", 1 + 2 * F.coalesce("c", F.lit(0)) + 10 * F.coalesce("d", F.lit(0)))
    length = F.when(F.col("k").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("k").isin(21, 33), math.sqrt(2)).when(F.col("k").isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return code.groupBy("frame_id", "feature").agg(F.sum(length).alias("perimeter"))


def snapped(box: DataFrame, ny: int, nx: int, near: int = 10) -> DataFrame:
    """Boxes (y0, y1, x0, x1) drawn out to the frame's edges that they come within ``near`` pixels of."""
    low = lambda c: F.when(F.col(c) < near, 0).otherwise(F.col(c)).alias(c)
    high = lambda c, n: F.when(F.col(c) > n - 1 - near, n - 1).otherwise(F.col(c)).alias(c)
    return box.select("frame_id", "feature", low("y0"), high("y1", ny), low("x0"), high("x1", nx))


def rolled(labels: DataFrame, nx: int, shift: int) -> DataFrame:
    """Pixels moved by ``shift`` columns round the domain."""
    return labels.withColumn("x", F.pmod(F.col("x") + shift, F.lit(nx)).cast("int"))
