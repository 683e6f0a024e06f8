"""Links between the objects of consecutive snapshots by the pixels that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_pairs(frames: DataFrame, timegap: float, lag: int = 1) -> DataFrame:
    """(frame_id, next_id): frames by base_time and the ``lag``-th after each, less than ``timegap`` hours apart.

    ``frames`` has a row for each snapshot, so this is the one step that orders them all.
    """
    order = Window.orderBy("base_time")
    nxt = frames.select("frame_id", F.lead("frame_id", lag).over(order).alias("next_id"), ((F.lead("base_time", lag).over(order) - F.col("base_time")) / 3600).alias("hours"))
    return nxt.where((F.col("hours") > 0) & (F.col("hours") < timegap)).select("frame_id", "next_id")


def segments(frames: DataFrame, timegap: float) -> DataFrame:
    """frames with segment (counting breaks of ``timegap`` hours or more) and is_first, is_last of their segment."""
    order = Window.orderBy("base_time")
    new = (F.col("base_time") - F.lag("base_time").over(order)) / 3600 >= timegap
    out = frames.withColumn("segment", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    ends = out.groupBy("segment").agg(F.min("base_time").alias("t0"), F.max("base_time").alias("t1"))
    return out.join(ends, "segment").select(*frames.columns, "segment", (F.col("base_time") == F.col("t0")).alias("is_first"), (F.col("base_time") == F.col("t1")).alias("is_last"))


def overlaps(labels: DataFrame, pairs: DataFrame, least: float, drift: DataFrame | None = None) -> DataFrame:
    """(frame_id, next_id, direction, ref, new, overlap_px, frac): links that share more than ``least`` of the object's pixels.

    forward: of the earlier object's, backward: of the later one's.  ``drift`` (frame_id of the
    later frame, y, x) first moves the earlier frame's pixels; frames without a row stay.
    """
    a = labels.join(pairs, "frame_id").select("frame_id", "next_id", "y", "x", F.col("feature").alias("ref"))
    if drift is not None:
        d = drift.select(F.col("frame_id").alias("next_id"), F.col("y").alias("_dy"), F.col("x").alias("_dx"))
        a = a.join(d, "next_id", "left").withColumns({"y": F.col("y") + F.coalesce("_dy", F.lit(0)), "x": F.col("x") + F.coalesce("_dx", F.lit(0))}).drop("_dy", "_dx")
    b = labels.select(F.col("frame_id").alias("next_id"), "y", "x", F.col("feature").alias("new"))
    size = labels.groupBy("frame_id", "feature").agg(F.count("*").alias("n"))
    shared = a.join(b, ["next_id", "y", "x"]).groupBy("frame_id", "next_id", "ref", "new").agg(F.count("*").alias("overlap_px"))
    shared = shared.join(size.select("frame_id", F.col("feature").alias("ref"), F.col("n").alias("n_ref")), ["frame_id", "ref"])
    shared = shared.join(size.select(F.col("frame_id").alias("next_id"), F.col("feature").alias("new"), F.col("n").alias("n_new")), ["next_id", "new"])
    both = shared.withColumn("way", F.explode(F.array(F.struct(F.lit("forward").alias("direction"), (F.col("overlap_px") / F.col("n_ref")).alias("frac")), F.struct(F.lit("backward").alias("direction"), (F.col("overlap_px") / F.col("n_new")).alias("frac")))))
    return both.select("frame_id", "next_id", "way.direction", "ref", "new", "overlap_px", "way.frac").where(F.col("frac") > least)
