import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.operators import regrid, sphere


def unit(lat, lon):
    la, lo = math.radians(lat), math.radians(lon)
    return np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])


def test_nearest_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    near = lambda lat, lon, s: (max(-90.0, min(90.0, lat + rng.gauss(0, s))), lon + rng.gauss(0, s))
    points = [near(0, 179.9, 1) for _ in range(40)] + [near(89.5, rng.uniform(-180, 180), 0.4) for _ in range(20)] + [near(-30, 20, 15) for _ in range(60)] + [(10.0, 10.0), (10.0, 10.0)]
    targets = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(120)] + [near(0, -179.9, 1) for _ in range(40)] + [(90.0, 0.0), (-90.0, 77.0), (10.0, 370.0)]
    p = spark.createDataFrame([(k, *c) for k, c in enumerate(points)] + [(900, None, 1.0)], "point long, lat double, lon double")
    t = spark.createDataFrame([(k, *c) for k, c in enumerate(targets)] + [(901, 1.0, None)], "target long, lat double, lon double")
    for tolerance, first in ((180.0, 0.5), (12.0, 1.0), (12.0, 12.0)):
        found = sphere.nearest(t, p, tolerance, first)
        assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
        got = {r.target: (r.point, round(r.km, 6)) for r in found.collect()}
        want = {}
        for k, c in enumerate(targets):
            d = [round(float(((unit(*c) - unit(*q)) ** 2).sum()), 14) for q in points]
            best = min(range(len(points)), key=lambda i: (d[i], i))
            if d[best] <= (2 * math.sin(math.radians(tolerance) / 2)) ** 2:
                want[k] = (best, round(2 * sphere.EARTH_KM * math.asin(math.sqrt(d[best]) / 2), 6))
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-2 for k in want)


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4, 5])
def test_centres_rings_and_neighbours(spark, order):
    n, side = 12 * 4**order, 1 << order
    cells = spark.range(n).withColumnRenamed("id", "cell")
    cells = cells.withColumns(dict(zip(("lat", "lon"), sphere.cell_centre(F.col("cell"), order)))).withColumn("ring", sphere.ring_index(F.col("cell"), order))
    cells = cells.withColumn("back", regrid.sphere_cell(F.col("lat"), F.col("lon"), order)).withColumns(dict(zip(("rlat", "rlon"), sphere.ring_centre(F.col("ring"), order))))
    rows = sphere.neighbours(cells, "cell", order).collect()
    assert all(r.cell == r.back and abs(r.lat - r.rlat) < 1e-9 and abs(r.lon - r.rlon) < 1e-9 for r in rows)
    by_ring = sorted(rows, key=lambda r: r.ring)
    assert [r.ring for r in by_ring] == list(range(n)) and all(a.lat > b.lat + 1e-9 or a.lon < b.lon for a, b in zip(by_ring, by_ring[1:]))
    around = [{k: v for k, v in r.around.asDict().items() if v is not None} for r in rows]
    at = [unit(r.lat, r.lon) for r in rows]
    # Each is the neighbour of its neighbours; all eight are there but where three faces meet; none is far away.
    assert all(k in around[j].values() and np.linalg.norm(at[k] - at[j]) * math.sqrt(n) < 8 for k, own in enumerate(around) for j in own.values())
    count = [len(set(own.values())) for own in around]
    assert (count.count(7), count.count(8)) == (24, n - 24) if side > 1 else set(count) == {6}
    # To the north-east and north-west it goes up, to the south-west and south-east down.
    assert all(at[own["ne"]][2] > at[k][2] - 1e-9 for k, own in enumerate(around) if k // side**2 in (4, 5, 6, 7) and "ne" in own)


def edges(spark, values, name):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(values, values[1:]))], f"{name} int, lo double, hi double")


def test_mass_is_kept(spark):
    """Over the whole globe, between two uneven grids that begin at different meridians; each target's parts fill it."""
    rng = np.random.default_rng(1)
    source = edges(spark, [-90, -50.5, -20, 0, 11, 47, 90], "y"), edges(spark, np.linspace(-30, 330, 13), "x")
    target = edges(spark, [-90, -66, -1, 13, 60, 90], "y"), edges(spark, [170.0, 185, 200, 290, 411.5, 530], "x")
    v = rng.random((6, 12))
    pixels = spark.createDataFrame([(1, y, x, float(v[y, x])) for y in range(6) for x in range(12)], "frame_id long, y int, x int, v double")
    got = sphere.conservative(pixels, source, target, 7.0).collect()
    square = sphere.EARTH_KM**2
    band = lambda e: np.diff(np.sin(np.radians(e)))
    mass = (v * band([-90, -50.5, -20, 0, 11, 47, 90])[:, None] * math.radians(30)).sum() * square
    assert abs(sum(r.mass for r in got) / mass - 1) < 1e-9 and len(got) == 25
    whole = band([-90, -66, -1, 13, 60, 90])[:, None] * np.radians(np.diff([170.0, 185, 200, 290, 411.5, 530])) * square
    assert all(abs(r.area / whole[r.y, r.x] - 1) < 1e-9 for r in got)


def test_missing_cells_cover_nothing(spark):
    grid = edges(spark, [0, 10, 20], "y"), edges(spark, [350, 360, 370], "x")
    one = edges(spark, [0, 20], "y"), edges(spark, [-10, 10], "x")
    pixels = spark.createDataFrame([(1, 0, 0, 3.0), (1, 0, 1, None), (1, 1, 1, 3.0), (2, 0, 0, None)], "frame_id long, y int, x int, v double")
    (r,) = sphere.conservative(pixels, grid, one).collect()
    assert r.frame_id == 1 and abs(r.v - 3) < 1e-12
    share = (math.sin(math.radians(10)) + math.sin(math.radians(20)) - math.sin(math.radians(10))) / (2 * math.sin(math.radians(20)))
    assert abs(r.area - share * math.sin(math.radians(20)) * math.radians(20) * sphere.EARTH_KM**2) < 1e-3
