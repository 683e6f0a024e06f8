"""The whole run: objects, links, numbers, statistics, main tracks, masks; a stored table after each costly step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identify, link, number, tracks
from ..operators.scratch import bucketed, stored
from .config import Config


def run(pixels: DataFrame, frames: DataFrame, cfg: Config, drift: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a run over ``pixels`` (frame_id, y, x, v) and ``frames`` (frame_id, base_time).

    labels, features, links, nodes, track_stats, tracks, main, attached, masks.
    """
    found = identify.IDENTIFIERS[cfg.feature_type](pixels, (cfg.ny, cfg.nx), keep=True, **cfg.identify)
    # In buckets by object: statistics, sizes and masks read it as it lies.
    labels = bucketed(identify.renumbered(found, cfg.least_pixels), ["frame_id", "feature"], "labels")
    features = stored(tracks.feature_stats(labels, cell_km2=cfg.pixel_km**2))
    links = stored(link.overlaps(labels.drop("v"), link.frame_pairs(frames, cfg.timegap), cfg.othresh, drift))
    nodes = stored(number.track_numbers(frames, features, links, cfg.timegap))
    rows = nodes.join(features, ["frame_id", "feature"]).join(frames, "frame_id")
    rows = tracks.without_short(rows, cfg.least_times)
    rows = tracks.renumbered_targets(rows, ["merge_track", "split_track"])
    stats = stored(tracks.time_index(rows, "base_time"))
    main = tracks.main_tracks(stats, cfg.main_times, "area", cfg.main_area)
    kept = stats.select("frame_id", "feature", "track", "merge_track", "split_track")
    return {
        "labels": labels,
        "features": features,
        "links": links,
        "nodes": nodes,
        "track_stats": stats,
        "tracks": tracks.start_end(stats),
        "main": main,
        "attached": tracks.attached(stats, main, cfg.attach_shorter, cfg.attach_per_time),
        "masks": tracks.painted(labels.select("frame_id", "y", "x", F.col("feature")), kept),
    }
