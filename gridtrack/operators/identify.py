"""Objects in snapshots: labels by threshold, seeds or flooding, one frame to a group; sizes and numbers in Catalyst."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

LABELS = "frame_id long, y int, x int, feature long"
Kernel = Callable[[np.ndarray], np.ndarray]


def frame_array(pdf: pd.DataFrame, column: str, shape: tuple[int, int], missing: float = np.nan) -> np.ndarray:
    out = np.full(shape, missing)
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[column].to_numpy()
    return out


def by_frame(pixels: DataFrame, shape: tuple[int, ...], kernel: Callable[[np.ndarray], np.ndarray], value: str = "v", out: str = LABELS, keep: bool = False) -> DataFrame:
    """Runs ``kernel`` (a frame's values, missing as NaN) on each frame; non-zero, non-missing results come back as rows of ``out``'s last column, with ``keep`` together with the pixel's value.

    Frames are dealt to tasks and come one after the other as Arrow batches, of which a task
    cuts its frames; it holds one frame and one batch at a time.  A shape of three sizes takes a
    volume (frame_id, z, y, x) to a frame.
    """
    name, kind = out.split(", ")[-1].split(" ")
    axes = ("z", "y", "x")[-len(shape) :]
    of = {"double": pa.float64(), "long": pa.int64()}[kind]

    def cut(frame: int, parts: list[tuple]) -> pa.RecordBatch:
        a = np.full(shape, np.nan)
        for *at, v in parts:
            a[tuple(at)] = v
        got = kernel(a)
        y, x = np.nonzero(~np.isnan(got) if kind == "double" else got)
        cols = [pa.array(np.full(len(y), frame)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(got[y, x], of)]
        if keep:
            cols.append(pa.array(a[y, x], from_pandas=True))
        return pa.RecordBatch.from_arrays(cols, names=["frame_id", "y", "x", name, *([value] if keep else [])])

    def run(batches):
        frame, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            ids, *at = (b.column(k).to_numpy() for k in range(len(axes) + 1))
            v = b.column(len(axes) + 1).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            done = []
            for lo, hi in zip(ends, ends[1:]):
                if ids[lo] != frame and frame is not None:
                    done.append(cut(frame, parts))
                    parts = []
                frame = int(ids[lo])
                parts.append(tuple(c[lo:hi].copy() for c in (*at, v)))
            yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
        if frame is not None:
            yield cut(frame, parts)

    rows = pixels.select(F.col("frame_id").cast("long").alias("frame_id"), *[F.col(c).cast("int").alias(c) for c in axes], F.col(value).cast("double").alias(value))
    return rows.repartition("frame_id").sortWithinPartitions("frame_id").mapInArrow(run, f"{out}, {value} double" if keep else out)


def threshold_kernel(low: float, high: float = float("inf"), eight: bool = False, wrap: bool | str = False) -> Kernel:
    def kernel(a: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return K.components((a > low) & (a < high), eight, wrap)

    return kernel


def watershed_kernel(least: float, peak: float, distance: int, line: bool = True, wrap: bool | str = False, compactness: float = 0.0) -> Kernel:
    def kernel(a: np.ndarray) -> np.ndarray:
        v = np.where(np.isnan(a), -np.inf, a)
        return K.watershed(v, K.local_maxima(v, distance, peak, wrap), v > least, line, wrap, compactness)

    return kernel


def label_grow_kernel(core: float, cold: float, least_core: int, least_cold: int, smooth: int = 1, wrap: bool | str = False) -> Kernel:
    def kernel(a: np.ndarray) -> np.ndarray:
        s = K.box_mean(a, smooth) if smooth > 1 else a
        with np.errstate(invalid="ignore"):
            cores, colds = K.components(s < core, wrap=wrap), a < cold
        count = np.bincount(cores.ravel())
        cores[np.isin(cores, np.flatnonzero(count < least_core))] = 0
        out = K.grown(cores, colds, wrap)
        rest = K.components(colds & (out == 0), wrap=wrap)
        count = np.bincount(rest.ravel())
        rest[np.isin(rest, np.flatnonzero(count <= least_cold))] = 0
        return K.by_size(np.where(rest > 0, rest + out.max(), out))

    return kernel


def convective_kernel(radius: float, truncation: float, weak: float, least: int, dilate: tuple[float, ...]) -> Kernel:
    def kernel(a: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(a) & (a >= weak)
        bkg = K.background(np.nan_to_num(a), ok, radius)
        with np.errstate(invalid="ignore"):
            peak = np.where(bkg < 0, 8.0, np.where(bkg < 64, 8.0 * np.cos(np.pi * bkg / 128), 0.0))
            core = ok & ((a >= truncation) | (a - bkg >= peak))
        return K.widened(K.by_size(K.components(core), least), dilate)

    return kernel


def cold_pool_kernel(sigma: float, least: float, peak: float, distance: int) -> Kernel:
    def kernel(a: np.ndarray) -> np.ndarray:
        v = K.gaussian_filter(np.nan_to_num(a), sigma)
        return K.watershed(v, K.local_maxima(v, distance, peak), v > least)

    return kernel


def threshold_labels(pixels: DataFrame, shape: tuple[int, int], low: float, high: float = float("inf"), eight: bool = False, wrap: bool | str = False, value: str = "v", keep: bool = False) -> DataFrame:
    """Connected pixels with low < value < high, numbered in raster order; only these pixels are shuffled."""
    kept = pixels.where((F.col(value) > low) & (F.col(value) < high))
    return by_frame(kept, shape, threshold_kernel(low, high, eight, wrap), value, keep=keep)


def watershed_labels(pixels: DataFrame, shape: tuple[int, int], least: float, peak: float, distance: int, line: bool = True, value: str = "v", wrap: bool | str = False, keep: bool = False, compactness: float = 0.0) -> DataFrame:
    """Flooding of pixels over ``least`` from local maxima over ``peak``; the edges of the axes of ``wrap`` meet."""
    return by_frame(pixels, shape, watershed_kernel(least, peak, distance, line, wrap, compactness), value, keep=keep)


def label_and_grow(pixels: DataFrame, shape: tuple[int, int], core: float, cold: float, least_core: int, least_cold: int, smooth: int = 1, value: str = "v", wrap: bool | str = False, keep: bool = False) -> DataFrame:
    """Cold cores (value < core after smoothing) of ``least_core`` pixels or more, grown over pixels < cold; cold areas left over with more than ``least_cold`` pixels are objects too; numbered by size."""
    return by_frame(pixels, shape, label_grow_kernel(core, cold, least_core, least_cold, smooth, wrap), value, keep=keep)


def convective_cells(pixels: DataFrame, shape: tuple[int, int], radius: float, truncation: float, weak: float, least: int, dilate: tuple[float, ...], value: str = "v", keep: bool = False) -> DataFrame:
    """Cells of reflectivity that reaches ``truncation`` or exceeds its background by the peakedness curve.

    Cores are four-connected; those of ``least`` pixels or fewer go, the others are numbered by
    size (:func:`kernels.by_size`) and widened (:func:`kernels.widened`) to each of the radii ``dilate``.
    """
    return by_frame(pixels, shape, convective_kernel(radius, truncation, weak, least, dilate), value, keep=keep)


def cold_pools(pixels: DataFrame, shape: tuple[int, int], sigma: float, least: float, peak: float, distance: int, value: str = "v", keep: bool = False) -> DataFrame:
    """Flooding of the smoothed cold-pool intensity."""
    return by_frame(pixels, shape, cold_pool_kernel(sigma, least, peak, distance), value, keep=keep)


def smoothed(pixels: DataFrame, shape: tuple[int, int], n: int, value: str = "v") -> DataFrame:
    return by_frame(pixels, shape, lambda a: K.box_mean(a, n), value, "frame_id long, y int, x int, s double")


def outline(labels: DataFrame, shape: tuple[int, int], radius: int = 1) -> DataFrame:
    """Labelled pixels that touch another label or none."""

    def kernel(a: np.ndarray) -> np.ndarray:
        n = np.nan_to_num(a).astype(np.int64)
        return np.where(K.perimeter_pixels(n, radius), n, 0)

    return by_frame(labels, shape, kernel, "feature")


def renumbered(labels: DataFrame, least: float = 0, area: Column | None = None) -> DataFrame:
    """Labels by falling pixel count (ties: later label first) within each frame; sizes not over ``least`` go. Adds npix."""
    size = F.count("*") if area is None else F.sum(area)
    f = labels.groupBy("frame_id", "feature").agg(F.count("*").alias("npix"), size.alias("_size")).where(F.col("_size") > least)
    order = Window.partitionBy("frame_id").orderBy(F.desc("npix"), F.desc("feature"))
    f = f.select("frame_id", F.col("feature").alias("_old"), F.row_number().over(order).cast("long").alias("_new"), "npix")
    both = labels.join(f, (labels["frame_id"] == f["frame_id"]) & (labels["feature"] == f["_old"])).drop(f["frame_id"])
    return both.drop("feature", "_old").withColumnRenamed("_new", "feature").select(*labels.columns, "npix")


def absorbed(labels: DataFrame, rain: DataFrame) -> DataFrame:
    """Objects under one rain feature become one: (frame_id, y, x, feature).

    ``labels`` (frame_id, y, x, feature), ``rain`` (frame_id, y, x, pf).  Rain features are
    taken in order.  Each gives the objects that it overlaps the number of the one that is largest by
    then (the lowest number on ties), and its pixels outside all objects too; an object
    takes a new number, or keeps its own, once only.  Joins find the overlaps; the order is followed within a frame,
    over one row for each overlap.
    """
    size = labels.groupBy("frame_id", "feature").agg(F.count("*").alias("n"))
    over = rain.join(labels, ["frame_id", "y", "x"], "left")
    touch = over.groupBy("frame_id", "pf", "feature").agg(F.count("*").alias("shared")).join(size, ["frame_id", "feature"], "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        now, weight, fixed, heirs = {}, {}, set(), []
        for f, n in pdf.loc[pdf["feature"].notna(), ["feature", "n"]].drop_duplicates().itertuples(index=False):
            now[int(f)], weight[int(f)] = int(f), int(n)
        for pf, own in pdf.groupby("pf"):
            met = sorted(int(f) for f in own["feature"].dropna())
            if not met:
                continue
            heir = max(sorted({now[f] for f in met}), key=lambda k: weight[k])
            sizes = dict(pdf.loc[pdf["feature"].isin(met), ["feature", "n"]].drop_duplicates().itertuples(index=False))
            for f in met:
                if f not in fixed:
                    weight[now[f]] -= int(sizes[f])
                    weight[heir] = weight.get(heir, 0) + int(sizes[f])
                    now[f] = heir
                    fixed.add(f)
            weight[heir] += int(own.loc[own["feature"].isna(), "shared"].sum())
            heirs.append((int(pf), heir))
        frame = int(pdf["frame_id"].iloc[0])
        rows = [(frame, None, f, to) for f, to in now.items()] + [(frame, pf, None, to) for pf, to in heirs]
        return pd.DataFrame(rows, columns=["frame_id", "pf", "feature", "into"]).astype("Int64")

    moves = touch.groupBy("frame_id").applyInPandas(follow, "frame_id long, pf long, feature long, into long")
    own = labels.join(moves.where("feature IS NOT NULL").drop("pf"), ["frame_id", "feature"], "left").select("frame_id", "y", "x", F.coalesce("into", "feature").alias("feature"))
    bare = over.where("feature IS NULL").drop("feature")
    return own.unionByName(bare.join(moves.where("pf IS NOT NULL").drop("feature"), ["frame_id", "pf"]).select("frame_id", "y", "x", F.col("into").alias("feature")))


def clouds_with_rain(pixels: DataFrame, rain: DataFrame, shape: tuple[int, int], cold: dict, rain_over: float, rain_smooth: int, least: float = 0, wrap: bool = False) -> DataFrame:
    """Cold clouds (:func:`label_and_grow` with the settings ``cold``) that rain features join, numbered by size: (frame_id, y, x, feature, npix).

    Rain features are connected pixels over ``rain_over`` of the smoothed ``rain`` (frame_id, y, x, v).
    """
    clouds = label_and_grow(pixels, shape, wrap=wrap, **cold)
    wet = smoothed(rain, shape, rain_smooth).withColumnRenamed("s", "v") if rain_smooth > 1 else rain
    features = threshold_labels(wet, shape, rain_over, wrap=wrap).withColumnRenamed("feature", "pf")
    return renumbered(absorbed(clouds, features), least)


def renumbered_with(labels: DataFrame, other: DataFrame, least: float = 0) -> tuple[DataFrame, DataFrame]:
    """``labels`` by :func:`renumbered`, and a second mask (frame_id, y, x, feature) with the same old numbers given the same new ones; objects that go are gone from both."""
    new = renumbered(labels, least)
    pairs = labels.select("frame_id", "y", "x", F.col("feature").alias("old")).join(new.select("frame_id", "y", "x", "feature"), ["frame_id", "y", "x"]).select("frame_id", "old", "feature").distinct()
    return new, other.withColumnRenamed("feature", "old").join(pairs, ["frame_id", "old"]).select("frame_id", "y", "x", "feature")


#: Identifiers by name; others can be added. With keep they give the pixels' values too.
IDENTIFIERS: dict[str, Callable[..., DataFrame]] = {"threshold": threshold_labels, "watershed": watershed_labels, "label_grow": label_and_grow, "convective": convective_cells, "cold_pool": cold_pools}

#: What labels a frame's array, by the same names.
KERNELS: dict[str, Callable[..., Kernel]] = {"threshold": threshold_kernel, "watershed": watershed_kernel, "label_grow": label_grow_kernel, "convective": convective_kernel, "cold_pool": cold_pool_kernel}
