"""The sphere: nearest of irregular points, equal-area cells and back, and conservative weights between rectilinear grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

EARTH_KM = 6371.0


def _unit(lat: Column, lon: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [(F.cos(la) * F.cos(lo)).alias("ux"), (F.cos(la) * F.sin(lo)).alias("uy"), F.sin(la).alias("uz")]


def nearest(targets: DataFrame, points: DataFrame, tolerance: float, first: float) -> DataFrame:
    """(target, point, km): for each of ``targets`` (target, lat, lon) the nearest of ``points`` (point, lat, lon), the smallest id of equally near ones; targets without a point within ``tolerance`` degrees have no row.

    Points are indexed by cubes of the space around the globe, so the date line and the poles are places like others.  Targets
    look at their cube and the 26 around it: whatever is within a cube's width is found there, so a point that near is
    proven to be the nearest.  Those without one look again at cubes twice as wide, from ``first`` degrees up to the
    tolerance.  ``first`` should be about the spacing of the points: then most targets settle among few, and only those in
    empty regions go on.  Points of one place are one.  Places without latitude or longitude take no part.
    """
    unit = lambda df, name: df.where("lat IS NOT NULL AND lon IS NOT NULL").select(name, *_unit(F.col("lat"), F.col("lon")))
    own = stored(unit(points, "point").groupBy("ux", "uy", "uz").agg(F.min("point").alias("point")), "points")
    rest, found = stored(unit(targets, "target").distinct(), "targets"), None
    chord = lambda degrees: 2 * math.sin(math.radians(min(degrees, 180.0)) / 2)
    width = first
    while True:
        width = min(width, tolerance)
        side = chord(width) * (1 + 1e-12)
        cube = {c: F.floor(F.col(f"u{c}") / side) for c in "xyz"}
        step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(s, "xyz")]) for s in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]]))
        near = rest.withColumn("s", step).select("target", "ux", "uy", "uz", *[(cube[c] + F.col(f"s.{c}")).alias(c) for c in "xyz"]).alias("a")
        there = own.select("point", "ux", "uy", "uz", *[cube[c].alias(c) for c in "xyz"]).alias("b")
        apart = sum((F.pow(F.col(f"a.u{c}") - F.col(f"b.u{c}"), F.lit(2)) for c in "xyz"), F.lit(0.0))
        pairs = near.join(there, [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in "xyz"], apart <= side * side])
        # Equally near within the rounding of the coordinates counts as equal.
        now = stored(pairs.groupBy("a.target").agg(F.min(F.struct(F.round(apart, 14).alias("d"), F.col("b.point"))).alias("x")).select("target", "x.point", "x.d"), "nearest")
        found = now if found is None else found.unionByName(now)
        if width >= tolerance:
            break
        rest, width = stored(rest.join(now.select("target"), "target", "left_anti"), "rest"), 2 * width
    return found.select("target", "point", (2 * EARTH_KM * F.asin(F.least(F.sqrt("d") / 2, F.lit(1.0)))).alias("km"))


# ---- equal-area cells in nested order -----------------------------------------------------------


def _face_xy(cell: Column, order: int) -> tuple[Column, Column, Column]:
    """A cell's base face, and its places along the face's north-east and north-west edges: every other bit of its number."""
    side = 1 << order
    bit = lambda k: F.shiftright(cell, k).bitwiseAND(F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    x = sum((F.shiftleft(bit(2 * k), k) for k in range(order)), zero)
    y = sum((F.shiftleft(bit(2 * k + 1), k) for k in range(order)), zero)
    return F.floor(cell / (side * side)), x, y


def _nested(face: Column, x: Column, y: Column, order: int) -> Column:
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long"))
    bits = sum((F.shiftleft(bit(x, k), 2 * k) + F.shiftleft(bit(y, k), 2 * k + 1) for k in range(order)), F.lit(0).cast("long"))
    return face * (1 << 2 * order) + bits


def ring_place(cell: Column, order: int) -> tuple[Column, Column, Column]:
    """(ring from 1 in the north, place on it from 1 eastward, cells in a quarter of it) of a nested cell."""
    side = 1 << order
    face, x, y = _face_xy(cell, order)
    row, quarter = F.floor(face / 4), face % 4
    ring = (row + 2) * side - x - y - 1
    cells = F.least(ring, 4 * side - ring, F.lit(side))
    # Rings between the caps begin on the meridian or half a cell east of it in turn.
    late = F.when((ring >= side) & (ring <= 3 * side), (ring - side) % 2).otherwise(F.lit(0))
    middle = 2 * quarter + (row != 1).cast("long")
    place = F.floor((middle * cells + x - y + 1 + late) / 2)
    return ring, F.when(place > 4 * cells, place - 4 * cells).when(place < 1, place + 4 * cells).otherwise(place), cells


def ring_index(cell: Column, order: int) -> Column:
    """Number of a nested cell when all are counted ring by ring from the north pole, eastward."""
    side = 1 << order
    ring, place, cells = ring_place(cell, order)
    before = F.when(ring < side, 2 * cells * (cells - 1)).when(ring > 3 * side, 12 * side * side - 2 * cells * (cells + 1)).otherwise(2 * side * (side - 1) + (ring - side) * 4 * side)
    return (before + place - 1).cast("long")


def _ring_centre(ring: Column, place: Column, cells: Column, side: int) -> tuple[Column, Column]:
    cap = F.pow(cells.cast("double"), F.lit(2)) / (3.0 * side * side)
    z = F.when(ring < side, 1 - cap).when(ring > 3 * side, cap - 1).otherwise((2 * side - ring) * 2.0 / (3.0 * side))
    shift = F.when((ring >= side) & (ring <= 3 * side) & ((ring - side) % 2 == 1), F.lit(1.0)).otherwise(F.lit(0.5))
    return F.degrees(F.asin(z)), (place - shift) * 90.0 / cells


def cell_centre(cell: Column, order: int) -> tuple[Column, Column]:
    """(lat, lon) in degrees, lon from 0 to 360, of a nested cell's centre: what :func:`regrid.sphere_cell` takes back to the cell."""
    return _ring_centre(*ring_place(cell, order), 1 << order)


def ring_centre(index: Column, order: int) -> tuple[Column, Column]:
    """(lat, lon) of the centre of the cell with a ring number: the inverse of :func:`ring_index` goes by way of it."""
    side = 1 << order
    last, cap = 12 * side * side - 1, 2 * side * (side - 1)
    # The ring of a place in a cap: its cells before are 2 r (r - 1).
    of = lambda i: F.floor((1 + F.sqrt(1 + 2 * i.cast("double"))) / 2)
    north, south = index < cap, index > last - cap
    ring = F.when(north, of(index)).when(south, 4 * side - of(last - index)).otherwise(F.floor((index - cap) / (4 * side)) + side)
    cells = F.least(ring, 4 * side - ring, F.lit(side))
    before = F.when(north, 2 * cells * (cells - 1)).when(south, 12 * side * side - 2 * cells * (cells + 1)).otherwise(cap + (ring - side) * 4 * side)
    return _ring_centre(ring, index - before + 1, cells, side)


#: Directions of neighbours as steps along a face's two edges.
AROUND = {"sw": (-1, 0), "w": (-1, 1), "nw": (0, 1), "n": (1, 1), "ne": (1, 0), "e": (1, -1), "se": (0, -1), "s": (-1, -1)}


#: Where a step over edges of a base face leads: for rows of faces 0 (north cap), 1 (equator) and 2 (south cap) the row and the turn
#: eastward of the face there; None where only three faces meet.  Keys are the edges passed along x and y.
CROSSED = {
    (-1, 0): ((1, 0), (2, 3), (2, 3)), (1, 0): ((0, 1), (0, 0), (1, 1)), (0, -1): ((1, 1), (2, 0), (2, 1)), (0, 1): ((0, 3), (0, 3), (1, 0)),
    (-1, -1): ((2, 0), None, (2, 2)), (1, 1): ((0, 2), None, (0, 0)), (-1, 1): (None, (1, 3), None), (1, -1): (None, (1, 1), None), (0, 0): ((0, 0), (1, 0), (2, 0)),
}


def neighbours(cells: DataFrame, cell: str, order: int) -> DataFrame:
    """``cells`` with a struct ``around`` of the eight cells around a nested one: sw, w, nw, n, ne, e, se and s, null where three faces meet and there is none.

    Base faces lie in three rows of four: the north cap's, those around the equator (each between two of the caps' faces), the
    south cap's.  Steps over an edge go to the face next in that direction; between faces of one cap the axes turn by a quarter.
    """
    side, at = 1 << order, dict(zip(("_face", "_x", "_y"), _face_xy(F.col(cell), order)))
    rows = cells.withColumns(at).withColumns({"_row": F.floor(F.col("_face") / 4), "_k": F.col("_face") % 4})
    passed = lambda c: F.when(c < 0, -1).when(c >= side, 1).otherwise(0)
    rows = rows.withColumns({f"_{name}": F.struct((F.col("_x") + dx).alias("x"), (F.col("_y") + dy).alias("y"), passed(F.col("_x") + dx).alias("bx"), passed(F.col("_y") + dy).alias("by")) for name, (dx, dy) in AROUND.items()})
    faces = [CROSSED[bx, by][row] for bx in (-1, 0, 1) for by in (-1, 0, 1) for row in (0, 1, 2)]
    table = F.array(*[F.lit(None if f is None else f[0] * 4 + f[1]).cast("int") for f in faces])
    moved = {}
    for name in AROUND:
        p = {c: F.col(f"_{name}.{c}") for c in ("x", "y", "bx", "by")}
        to = F.get(table, (((p["bx"] + 1) * 3 + p["by"] + 1) * 3 + F.col("_row")).cast("int"))
        face = F.floor(to / 4) * 4 + (F.col("_k") + to % 4) % 4
        x, y = p["x"] - p["bx"] * side, p["y"] - p["by"] * side
        turned = ((F.col("_row") == 0) & ((p["bx"] > 0) | (p["by"] > 0))) | ((F.col("_row") == 2) & ((p["bx"] < 0) | (p["by"] < 0)))
        both = (p["bx"] != 0) & (p["by"] != 0)
        tx = F.when(~turned, x).when(both, side - 1 - x).when(p["bx"] != 0, y).otherwise(side - 1 - y)
        ty = F.when(~turned, y).when(both, side - 1 - y).when(p["bx"] != 0, side - 1 - x).otherwise(x)
        moved[f"_{name}"] = F.struct(face.cast("long").alias("face"), tx.cast("long").alias("x"), ty.cast("long").alias("y"))
    rows = rows.withColumns(moved)
    found = {name: _nested(F.col(f"_{name}.face"), F.col(f"_{name}.x"), F.col(f"_{name}.y"), order) for name in AROUND}
    return rows.withColumns({f"_{name}": c for name, c in found.items()}).withColumn("around", F.struct(*[F.col(f"_{name}").alias(name) for name in AROUND])).drop(*at, "_row", "_k", *moved)


# ---- conservative weights -----------------------------------------------------------------------


def overlaps(a: DataFrame, b: DataFrame, bucket: float, period: float | None = None) -> DataFrame:
    """(i, j, lo, hi): the common parts of intervals ``a`` (i, lo, hi) and ``b`` (j, lo, hi), around the circle where there is a ``period``.

    Intervals are dealt to buckets of their line and joined by bucket; a pair counts in the first bucket that it shares.
    """
    if period:
        b = b.withColumn("turn", F.explode(F.array(*[F.lit(k * period) for k in (-2, -1, 0, 1, 2)]))).select("j", (F.col("lo") + F.col("turn")).alias("lo"), (F.col("hi") + F.col("turn")).alias("hi"))
        turns = F.floor(F.col("lo") / period) * period
        a = a.select("i", (F.col("lo") - turns).alias("lo"), (F.col("hi") - turns).alias("hi"))
    dealt = lambda df: df.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    pairs = dealt(a).alias("a").join(dealt(b).alias("b"), [F.col("a.k") == F.col("b.k"), F.col("a.lo") < F.col("b.hi"), F.col("b.lo") < F.col("a.hi"), F.floor(F.greatest("a.lo", "b.lo") / bucket) == F.col("a.k")])
    return pairs.select("a.i", "b.j", F.greatest("a.lo", "b.lo").alias("lo"), F.least("a.hi", "b.hi").alias("hi"))


def conservative(pixels: DataFrame, source: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], bucket: float = 1.0) -> DataFrame:
    """(frame_id, y, x, v, mass, area): means of ``pixels`` (frame_id, y, x, v) on another rectilinear grid, by the exact area that each source cell has in each target cell.

    Grids are two tables of edges in degrees, (y, lo, hi) of latitude and (x, lo, hi) of longitude, in any spacing and
    order; longitudes meet around the globe.  ``area`` (km2) is what valid cells cover of the target cell, ``mass`` the sum
    of v * area, v their quotient.  Missing (null) pixels cover nothing.  A cell's part is its share of latitude
    (difference of sines) times its share of longitude, so rows are summed to target latitudes first and then to
    longitudes: no table of all pairs of cells is made.
    """
    lat = overlaps(source[0].toDF("i", "lo", "hi"), target[0].toDF("j", "lo", "hi"), bucket)
    lat = lat.select(F.col("i").alias("y"), F.col("j").alias("ty"), (F.sin(F.radians("hi")) - F.sin(F.radians("lo"))).alias("w"))
    lon = overlaps(source[1].toDF("i", "lo", "hi"), target[1].toDF("j", "lo", "hi"), bucket, 360.0)
    lon = lon.groupBy(F.col("i").alias("x"), F.col("j").alias("tx")).agg(F.sum(F.radians(F.col("hi") - F.col("lo"))).alias("w"))
    by_lat = pixels.where("v IS NOT NULL").join(lat, "y").groupBy("frame_id", "x", "ty").agg(F.sum(F.col("v") * F.col("w")).alias("mass"), F.sum("w").alias("area"))
    whole = by_lat.join(lon, "x").groupBy("frame_id", F.col("ty").alias("y"), F.col("tx").alias("x"))
    square = EARTH_KM * EARTH_KM
    out = whole.agg((F.sum(F.col("mass") * F.col("w")) * square).alias("mass"), (F.sum(F.col("area") * F.col("w")) * square).alias("area"))
    return out.select("frame_id", "y", "x", (F.col("mass") / F.col("area")).alias("v"), "mass", "area")
