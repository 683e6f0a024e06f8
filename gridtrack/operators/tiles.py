"""Labels of frames of any size: tile by tile, and joined across the seams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .scratch import numbered, stored


def cut(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, the other columns) of each group of a stream that is sorted by its first ``keys`` columns; one group and one batch are held at a time."""
    held, parts = None, []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        changed = np.zeros(len(cols[0]), bool)
        changed[0] = True
        for c in cols[:keys]:
            changed[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changed).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(cols[0])]):
            key = tuple(int(c[lo]) for c in cols[:keys])
            if key != held and held is not None:
                yield held, [np.concatenate(p) for p in zip(*parts)]
                parts = []
            held = key
            parts.append([c[lo:hi].copy() for c in cols[keys:]])
    if held is not None:
        yield held, [np.concatenate(p) for p in zip(*parts)]


def least_roots(edges: DataFrame, keys: list[str], max_rounds: int = 40) -> DataFrame:
    """(keys, node, root): the smallest node that each node of the graph of ``edges`` (keys, u, v) reaches, apart for each value of ``keys``; nodes without an edge are absent.

    Every node points to the least it knows.  In each round the neighbours above a node are hung on the least of its
    neighbours, then all its lower ones; that is an aggregation of minima and a join by node, combined before they are
    shuffled.  The rounds grow with the logarithm of the longest chain; each is stored, and a count and a digest come to the driver.
    All sides grow with the frames, and files of numbers are much smaller than their rows, so joins are merges: a side that
    looks small enough to be broadcast would come to the driver whole.
    """
    down = lambda e: e.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(down(edges), "edges"), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        up = both.where("v > u").join(least.hint("merge"), [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stored(up.groupBy(*keys, "u").agg(F.min("v").alias("m")), "least")
        hung = up.join(least.hint("merge"), [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = stored(down(hung), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def numbered_within(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 1 within ``key`` in the order of ``by``; no group is gathered in one task."""
    placed = stored(numbered(rows, [key, by], "_nth"), "placed")
    first = placed.groupBy(key).agg((F.min("_nth") - 1).alias("_first"))
    return placed.join(first.hint("merge"), key).withColumn(name, F.col("_nth") - F.col("_first")).drop("_nth", "_first")


def labels(pixels: DataFrame, shape: tuple[int, int], tile: tuple[int, int], eight: bool = False, wrap: str = "", value: str | None = None) -> DataFrame:
    """(frame_id, y, x, feature): connected ``pixels`` (rows frame_id, y, x that belong to objects), numbered 1 to n in raster order of their first pixels.

    Frames of ``shape`` are cut to tiles, which are labelled on their own; objects that touch across a seam are joined
    by :func:`least_roots`, so no task holds more than a tile.  ``wrap`` names the axes whose edges touch, of "x", "y" and "xy".
    With ``value`` that column comes along.
    """
    (ny, nx), (h, w) = shape, tile
    kept = [value] if value else []
    rows = pixels.select(F.col("frame_id").cast("long").alias("frame_id"), F.floor(F.col("y") / h).cast("int").alias("ty"), F.floor(F.col("x") / w).cast("int").alias("tx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("double").alias(c) for c in kept])

    def kernel(batches):
        for (frame, ty, tx), (y, x, *v) in cut(batches, 3):
            on = np.zeros((h, w), bool)
            on[y - ty * h, x - tx * w] = True
            found = K.components(on, eight)[y - ty * h, x - tx * w]
            place = y.astype(np.int64) * nx + x
            node = np.full(found.max() + 1, ny * nx)
            np.minimum.at(node, found, place)
            cols = [np.full(len(y), frame), y, x, node[found], *v]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["frame_id", "y", "x", "node", *kept])

    dealt = rows.repartition("frame_id", "ty", "tx").sortWithinPartitions("frame_id", "ty", "tx")
    own = stored(dealt.mapInArrow(kernel, "frame_id long, y int, x int, node long" + "".join(f", {c} double" for c in kept)), "tiles")

    rim = (F.col("y") % h).isin(0, h - 1) | (F.col("x") % w).isin(0, w - 1) | F.col("y").isin(0, ny - 1) | F.col("x").isin(0, nx - 1)
    rim = own.where(rim).select("frame_id", "y", "x", "node")
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    over = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps]))
    to = rim.select("frame_id", F.col("node").alias("u"), over.alias("to"))
    at = {c: F.pmod(F.col(f"to.{c}"), F.lit(n)).cast("int") if c in wrap else F.col(f"to.{c}") for c, n in (("y", ny), ("x", nx))}
    seams = to.select("frame_id", "u", at["y"].alias("y"), at["x"].alias("x")).join(rim.withColumnRenamed("node", "v").hint("merge"), ["frame_id", "y", "x"]).select("frame_id", "u", "v")
    roots = stored(least_roots(seams, ["frame_id"]), "roots")

    nodes = own.select("frame_id", "node").distinct().join(roots.hint("merge"), ["frame_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stored(nodes, "nodes")
    objects = numbered_within(nodes.select("frame_id", "root").distinct(), "frame_id", "root", "feature")
    named = stored(nodes.join(objects.hint("merge"), ["frame_id", "root"]).select("frame_id", "node", "feature"), "named")
    return own.join(named.hint("merge"), ["frame_id", "node"]).select("frame_id", "y", "x", "feature", *kept)


def grown(seeds: DataFrame, allowed: DataFrame, shape: tuple[int, int], wrap: str = "", rings: int | None = None) -> DataFrame:
    """(frame_id, y, x, feature, ring): objects ``seeds`` (frame_id, y, x, feature) spread over the pixels ``allowed`` (frame_id, y, x), eight neighbours, a ring at a time.

    A pixel that a ring reaches takes the commonest label of those around it by then, the smallest on ties, so the result does
    not depend on the order of the pixels, and frames of any size are dealt over tasks.  There are as many rounds as the widest
    object has rings, or ``rings`` at most; each joins the last ring's pixels with the free ones only, and is stored.
    """
    ny, nx = shape
    done = stored(seeds.select("frame_id", "y", "x", "feature", F.lit(0).cast("long").alias("ring")), "grown")
    free = allowed.select("frame_id", "y", "x").distinct()
    rim = done
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    ring = 0
    while ring != rings:
        ring += 1
        free = stored(free.join(rim.select("frame_id", "y", "x"), ["frame_id", "y", "x"], "left_anti"), "free")
        over = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in around]))
        at = {c: F.pmod(F.col(f"to.{c}"), F.lit(n)).cast("int") if c in wrap else F.col(f"to.{c}") for c, n in (("y", ny), ("x", nx))}
        spread = lambda rows: rows.select("frame_id", "feature", over.alias("to")).select("frame_id", at["y"].alias("y"), at["x"].alias("x"), "feature")  # noqa: E731,B023
        reached = stored(spread(rim).select("frame_id", "y", "x").distinct().join(free, ["frame_id", "y", "x"], "left_semi"), "reached")
        if reached.isEmpty():
            break
        votes = spread(done).join(reached, ["frame_id", "y", "x"], "left_semi").groupBy("frame_id", "y", "x", "feature").agg(F.count("*").alias("n"))
        rim = stored(votes.groupBy("frame_id", "y", "x").agg(F.max_by("feature", F.struct("n", -F.col("feature"))).alias("feature"), F.lit(ring).cast("long").alias("ring")), "ring")
        done = stored(done.unionByName(rim), "grown")
    return done


