"""Frames as a stream: statistics of objects per time window, and links to the frame before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(pixels: DataFrame, width: str, late: str, time: str = "ts") -> DataFrame:
    """Count, sum and highest value by window of ``width``; frames later than ``late`` are dropped."""
    return pixels.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("highest")).select(F.col("window.start").alias("start"), "n", "total", "highest")


def linked(labels: DataFrame, least: float, domain: str = "domain", max_step: int | None = None) -> DataFrame:
    """Links of each frame to the one before it in its domain, as frames arrive in order.

    ``labels`` (domain, frame_id, y, x, feature); the state of a domain is the open frame and the one before it.
    A frame stays open, over any number of batches, until a row of a later one arrives; only then
    its links come out.  A row without a feature says no more than that its frame has begun, so a
    source can close its last frame.  Rows of frames before the open one are late and dropped.  Frames more
    than ``max_step`` apart are not linked.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["y", "x", "feature"]
        last, now, *old = state.get if state.exists else (-1, -1, *[[]] * 6)
        before, open_ = (pd.DataFrame(dict(zip(names, old[k : k + 3]))) for k in (0, 3))
        rows = pd.concat(list(batches)).sort_values("frame_id", kind="stable")
        out = []
        for frame, own in rows.groupby("frame_id"):
            own = own.loc[own["feature"].notna(), names].astype("int64")
            if frame < now:
                continue
            if frame == now:
                open_ = pd.concat([open_, own]) if len(open_) else own
                continue
            if now >= 0:
                if last >= 0 and (max_step is None or now - last <= max_step):
                    out.append(_shared(before, open_, key[0], last, now, least))
                last, before = now, open_
            now, open_ = int(frame), own
        state.update((int(last), int(now), *[d[c].astype(int).tolist() for d in (before, open_) for c in names]))
        found = [x for x in out if len(x)]
        if found:
            yield pd.concat(found)

    shape = f"{domain} string, frame_id long, next_id long, ref long, new long, overlap_px long, frac double"
    kept = ", ".join(f"{c}{k} array<{t}>" for k in (0, 1) for c, t in (("y", "int"), ("x", "int"), ("f", "long")))
    return labels.groupBy(domain).applyInPandasWithState(update, shape, f"last long, now long, {kept}", "append", GroupStateTimeout.NoTimeout)


def _shared(before: pd.DataFrame, now: pd.DataFrame, domain: str, last: int, frame: int, least: float) -> pd.DataFrame:
    both = before.rename(columns={"feature": "ref"}).merge(now.rename(columns={"feature": "new"}), on=["y", "x"])
    n = both.groupby(["ref", "new"]).size().reset_index(name="overlap_px") if len(both) else pd.DataFrame(columns=["ref", "new", "overlap_px"])
    n["frac"] = n["overlap_px"] / n["ref"].map(before.groupby("feature").size()) if len(n) else []
    n = n[n["frac"] > least] if len(n) else n
    for place, (name, value) in enumerate((("domain", domain), ("frame_id", last), ("next_id", frame))):
        n.insert(place, name, value)
    return n
