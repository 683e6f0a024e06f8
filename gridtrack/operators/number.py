"""Track numbers: each pair of frames is resolved on its own, new numbers are placed by a running sum, inheritance by pointer jumping."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .link import frame_pairs, segments
from .scratch import stored

# Statuses of an earlier object (stop, goes on, larger and smaller part of a merge, splits) and
# of a later one (larger and smaller part of a split); those of both kinds add up.
STOP, GOES_ON, MERGES, MERGES_SMALL, SPLITS, SPLIT_LARGE, SPLIT_SMALL = 0, 1, 2, 21, 13, 3, 31


def resolve_pair(links: Iterable[tuple[str, int, int]], size_ref: dict[int, int], size_new: dict[int, int]) -> list[tuple]:
    """What becomes of the objects of two frames: rows (side, feature, status, inherits, mint, other).

    ``links`` are (direction, ref, new).  Objects are taken in order; a group grows over both
    kinds of link to later objects and over forward links back to earlier ones.  ``inherits`` is the earlier
    object whose number a later one takes; ``mint`` the place of its new number among the
    pair's; ``other`` the earlier object merged into or split from.  A later group overwrites
    what an earlier one set, and a number once minted is used up.
    """
    ahead: dict[int, set[int]] = {r: set() for r in size_ref}
    forward: dict[int, set[int]] = {}
    for way, r, n in links:
        ahead[r].add(n)
        if way == "forward":
            forward.setdefault(n, set()).add(r)
    biggest = lambda group, size: max(group, key=lambda k: (size[k], -k))
    ref, new, done, minted = {}, {}, set(), 0
    for r in sorted(size_ref):
        if r in done:
            continue
        refs, news, before = {r}, set(), 0
        while len(refs) > before:
            before = len(refs)
            news = set().union(*(ahead[k] for k in refs))
            refs |= set().union(*(forward.get(n, set()) for n in news))
        if not news:
            ref[r] = (STOP, None)
            done.add(r)
            continue
        main, heir = biggest(refs, size_ref), biggest(news, size_new)
        merge, split = len(refs) > 1, len(news) > 1
        if not merge and not split:
            ref[r] = (GOES_ON, None)
            done.add(r)
            new[heir] = (new.get(heir, (0,))[0], r, None, new.get(heir, (0, 0, 0, None))[3])
            continue
        extra = SPLITS if split else 0
        for k in refs:
            ref[k] = (extra + (MERGES if merge and k == main else MERGES_SMALL if merge else 0), main if merge and k != main else ref.get(k, (0, None))[1])
            if merge:
                done.add(k)
        for n in sorted(news):
            kept = new.get(n, (0, None, None, None))
            if n == heir:
                new[n] = (SPLIT_LARGE if split else kept[0], main, None, kept[3])
            else:
                new[n] = (SPLIT_SMALL, None, minted, main)
                minted += 1
    for n in sorted(size_new):
        if n not in new:
            new[n] = (0, None, minted, None)
            minted += 1
    rows = [("ref", k, s, None, None, other) for k, (s, other) in ref.items()]
    return rows + [("new", k, s, of, place, other) for k, (s, of, place, other) in new.items()] + [("mints", 0, minted, None, None, None)]


def _resolved(features: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    f = features.select("frame_id", "feature", "npix")
    rows = (
        f.join(pairs, "frame_id").select("frame_id", "next_id", F.lit("ref").alias("kind"), "feature", "npix")
        .union(f.withColumnRenamed("frame_id", "next_id").join(pairs, "next_id").select("frame_id", "next_id", F.lit("new"), "feature", "npix"))
        .union(links.join(pairs, ["frame_id", "next_id"], "left_semi").select("frame_id", "next_id", "direction", F.col("ref"), F.col("new")))
    )

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: g for k, g in pdf.groupby("kind")}
        sizes = [dict(zip(part[k]["feature"], part[k]["npix"])) if k in part else {} for k in ("ref", "new")]
        links = [(k, r, n) for k in ("forward", "backward") if k in part for r, n in zip(part[k]["feature"], part[k]["npix"])]
        out = pd.DataFrame(resolve_pair(links, *sizes), columns=["side", "feature", "status", "inherits", "mint", "other"])
        for c in ("inherits", "mint", "other"):
            out[c] = out[c].astype("Int64")
        out.insert(0, "next_id", pdf["next_id"].iloc[0])
        out.insert(0, "frame_id", pdf["frame_id"].iloc[0])
        return out

    return rows.groupBy("frame_id", "next_id").applyInPandas(kernel, "frame_id long, next_id long, side string, feature long, status int, inherits long, mint long, other long")


#: Frames whose inheritance is followed in one task before the rounds of pointer jumping between tasks.
BLOCK = 64


def _within_blocks(nodes: DataFrame, seg: DataFrame) -> DataFrame:
    """``nodes`` with each pointer followed to a number, or out of its block of consecutive frames."""
    place = seg.select("frame_id", F.floor((F.row_number().over(Window.orderBy("base_time")) - 1) / BLOCK).alias("block"), "base_time")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[tuple[int, int], tuple] = {}
        out = []
        for _, f, x, ff, fx, n in pdf.sort_values(["base_time", "feature"])[["base_time", "frame_id", "feature", "from_frame", "from_feature", "track"]].itertuples(index=False):
            up = (None, None, int(n)) if not pd.isna(n) else known.get((int(ff), int(fx)), (int(ff), int(fx), None))
            known[int(f), int(x)] = up
            out.append((int(f), int(x), *up))
        got = pd.DataFrame(out, columns=["frame_id", "feature", "from_frame", "from_feature", "track"])
        return got.astype({c: "Int64" for c in got.columns})

    return nodes.join(place, "frame_id").groupBy("block").applyInPandas(follow, "frame_id long, feature long, from_frame long, from_feature long, track long")


def track_numbers(frames: DataFrame, features: DataFrame, links: DataFrame, timegap: float) -> DataFrame:
    """(frame_id, feature, track, status, merge_track, split_track, reset) of all objects in frames with a neighbour.

    ``frames`` (frame_id, base_time in seconds), ``features`` (frame_id, feature, npix),
    ``links`` as :func:`gridtrack.operators.link.overlaps` gives them.  Numbers run from 1 in frame order: all
    objects of a segment's first frame, then each pair's new ones.  reset is 1 in a
    segment's first frame, 2 in its last, 0 for other new numbers.
    """
    pairs = frame_pairs(frames, timegap)
    alone = pairs.select("frame_id").union(pairs.select("next_id")).distinct()
    seg = stored(segments(frames, timegap).join(alone, "frame_id", "left_semi"))
    got = stored(_resolved(features, links, pairs))
    own = features.join(seg.where("is_first").select("frame_id"), "frame_id")
    first = Window.partitionBy("frame_id").orderBy("feature")
    first = own.select("frame_id", "feature", (F.row_number().over(first) - 1).cast("long").alias("mint"), F.lit(None).cast("long").alias("from_frame"), F.lit(None).cast("long").alias("from_feature"))
    later = got.where("side = 'new'").select(F.col("next_id").alias("frame_id"), "feature", "mint", F.when(F.col("inherits").isNotNull(), F.col("frame_id")).alias("from_frame"), F.col("inherits").alias("from_feature"))
    mints = first.groupBy("frame_id").agg(F.count("*").alias("n")).union(got.where("side = 'mints'").select(F.col("next_id").alias("frame_id"), F.col("status").cast("long").alias("n"))).groupBy("frame_id").agg(F.sum("n").alias("n"))
    order = Window.orderBy("base_time").rowsBetween(Window.unboundedPreceding, -1)
    base = seg.join(mints, "frame_id", "left").select("frame_id", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    nodes = first.union(later).join(base, "frame_id").withColumn("track", F.when(F.col("mint").isNotNull(), F.col("base") + F.col("mint") + 1)).drop("base", "mint")
    nodes = stored(_within_blocks(nodes, seg))
    while not nodes.where("track IS NULL").limit(1).isEmpty():
        up = nodes.select(F.col("frame_id").alias("from_frame"), F.col("feature").alias("from_feature"), F.col("track").alias("t"), F.col("from_frame").alias("ff"), F.col("from_feature").alias("fx"))
        open_ = nodes.where("track IS NULL").join(up, ["from_frame", "from_feature"]).select("frame_id", "feature", F.col("ff").alias("from_frame"), F.col("fx").alias("from_feature"), F.col("t").alias("track"))
        nodes = stored(nodes.where("track IS NOT NULL").select(*open_.columns).union(open_))
    track = nodes.select("frame_id", "feature", "track")
    was = got.where("side = 'ref'").select("frame_id", "feature", F.col("status").alias("s_ref"), F.col("other").alias("into"))
    is_ = got.where("side = 'new'").select(F.col("next_id").alias("frame_id"), "feature", F.col("status").alias("s_new"), F.col("frame_id").alias("before"), F.col("other").alias("of"), F.col("mint").isNotNull().alias("minted"))
    into = track.select("frame_id", F.col("feature").alias("into"), F.col("track").alias("merge_track"))
    of = track.select(F.col("frame_id").alias("before"), F.col("feature").alias("of"), F.col("track").alias("split_track"))
    out = track.join(was, ["frame_id", "feature"], "left").join(is_, ["frame_id", "feature"], "left").join(into, ["frame_id", "into"], "left").join(of, ["before", "of"], "left").join(seg.select("frame_id", "is_first", "is_last"), "frame_id")
    reset = F.when(F.col("is_first"), 1).when(F.col("is_last"), 2).when(F.col("minted"), 0)
    return out.select("frame_id", "feature", "track", (F.coalesce("s_ref", F.lit(0)) + F.coalesce("s_new", F.lit(0))).alias("status"), "merge_track", "split_track", reset.alias("reset"))
