"""Motion of objects and fields between frames, and smoothing of paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalar as S
from .identify import frame_array


def pair_shifts(labels: DataFrame, pairs: DataFrame, shape: tuple[int, int], km: float = 1.0, hours: float = 1.0) -> DataFrame:
    """(frame_id, next_id, feature, dy, dx, distance, speed, direction): shift of each object present in both frames of a pair, by the peak of the cross-correlation of its two masks."""
    a = labels.join(pairs, "frame_id").select("frame_id", "next_id", "feature", "y", "x", F.lit(0).alias("late"))
    b = labels.withColumnRenamed("frame_id", "next_id").join(pairs, "next_id").select("frame_id", "next_id", "feature", "y", "x", F.lit(1).alias("late"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[["frame_id", "next_id", "feature"]].iloc[0].tolist()
        if pdf["late"].nunique() < 2:
            return pd.DataFrame(columns=["frame_id", "next_id", "feature", "dy", "dx"])
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        box = (pdf["y"].max() - y0 + 1, pdf["x"].max() - x0 + 1)
        fields = []
        for late in (0, 1):
            m = np.zeros(box)
            own = pdf[pdf["late"] == late]
            m[own["y"] - y0, own["x"] - x0] = 1
            fields.append(m)
        return pd.DataFrame([[*key, *K.displacement(*fields)]], columns=["frame_id", "next_id", "feature", "dy", "dx"])

    got = a.union(b).groupBy("frame_id", "next_id", "feature").applyInPandas(kernel, "frame_id long, next_id long, feature long, dy double, dx double")
    distance = km * F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    return got.select("*", distance.alias("distance"), (distance / hours).alias("speed"), S.bearing_of(F.col("dx"), F.col("dy")).alias("direction"))


def advection(pixels: DataFrame, pairs: DataFrame, shape: tuple[int, int], tile: int, fastest: float, window: int = 3) -> DataFrame:
    """(frame_id, tile_y, tile_x, dy, dx, magnitude, magnitude_median): shift of each tile between the frames of a pair by masked correlation; shifts over ``fastest`` pixels count as none; medians over ``window`` pairs, 0 beyond the ends."""
    a = pixels.join(pairs, "frame_id").select("frame_id", "next_id", "y", "x", F.col("v").cast("double").alias("v"), F.lit(0).alias("late"))
    b = pixels.withColumnRenamed("frame_id", "next_id").join(pairs, "next_id").select("frame_id", "next_id", "y", "x", F.col("v").cast("double").alias("v"), F.lit(1).alias("late"))
    rows = a.union(b).withColumns({"tile_y": F.floor(F.col("y") / tile), "tile_x": F.floor(F.col("x") / tile)})

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = pdf["tile_y"].iloc[0], pdf["tile_x"].iloc[0]
        pdf = pdf.assign(y=pdf["y"] - ty * tile, x=pdf["x"] - tx * tile)
        one, two = (frame_array(pdf[pdf["late"] == k], "v", (tile, tile)) for k in (0, 1))
        dy, dx = K.masked_correlation_shift(one, two, ~np.isnan(one), ~np.isnan(two)) if pdf["late"].nunique() == 2 else (0, 0)
        if np.hypot(dy, dx) > fastest:
            dy, dx = 0, 0
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "tile_y": [ty], "tile_x": [tx], "dy": [float(dy)], "dx": [float(dx)]})

    got = rows.groupBy("frame_id", "tile_y", "tile_x").applyInPandas(kernel, "frame_id long, tile_y long, tile_x long, dy double, dx double")
    got = got.withColumn("magnitude", F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")))
    k = window // 2
    around = F.collect_list("magnitude").over(Window.partitionBy("tile_y", "tile_x").orderBy("frame_id").rowsBetween(-k, k))
    padded = F.array_sort(F.concat(around, F.array_repeat(F.lit(0.0), F.lit(window) - F.size(around))))
    return got.withColumn("magnitude_median", F.element_at(padded, k + 1))


def smoothed_paths(rows: DataFrame, fastest: float) -> DataFrame:
    """(track, t_idx, lat_smooth, lon_smooth): paths without points that imply a speed over ``fastest`` km/h, gaps filled linearly."""

    def km(a, b, c, e):
        p, q = np.radians(a), np.radians(c)
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(e - b) / 2) ** 2
        return 2 * S.EARTH_KM * np.arcsin(np.sqrt(min(h, 1.0)))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        lat, lon = K.smoothed_path(pdf["base_time"].to_numpy(float), pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), fastest, km)
        return pd.DataFrame({"track": pdf["track"], "t_idx": pdf["t_idx"], "lat_smooth": lat, "lon_smooth": lon})

    return rows.select("track", "t_idx", "base_time", "lat", "lon").groupBy("track").applyInPandas(kernel, "track long, t_idx long, lat_smooth double, lon_smooth double")


def filtered_speeds(rows: DataFrame, fastest: float) -> DataFrame:
    """(track, t_idx, speed): speeds of ``fastest`` or more replaced by a quadratic spline through the others of the track."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        return pd.DataFrame({"track": pdf["track"], "t_idx": pdf["t_idx"], "speed": K.quadratic_filled(pdf["t_idx"].to_numpy(), pdf["speed"].to_numpy(float), fastest)})

    return rows.select("track", "t_idx", "speed").groupBy("track").applyInPandas(kernel, "track long, t_idx long, speed double")
