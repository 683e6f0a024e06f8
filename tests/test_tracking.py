import random

import pytest
from pyspark.sql import functions as F

from gridtrack.operators import identify as I
from gridtrack.operators import link as L
from gridtrack.operators import number as N
from gridtrack.sources import rasters


def tracked(spark, centres, ny=40, nx=40, timegap=1.5, hours=None, drift=None, wrap=False, threshold=0):
    p = rasters.blobs(spark, centres, ny, nx, wrap)
    labels = I.renumbered(I.threshold_labels(p, (ny, nx), threshold, wrap=wrap)).cache()
    features = labels.groupBy("frame_id", "feature").agg(F.max("npix").alias("npix"))
    frames = sorted({c[0] for c in centres})
    f = spark.createDataFrame([(k, int(3600 * (hours or {}).get(k, k))) for k in frames], "frame_id long, base_time long")
    links = L.overlaps(labels, L.frame_pairs(f, timegap), 0.3, drift)
    return sorted(map(tuple, N.track_numbers(f, features, links, timegap).collect()))


def test_translate(spark):
    got = tracked(spark, [(t, 10 + t, 10 + t, 4) for t in range(6)])
    assert [(r[0], r[2], r[3], r[6]) for r in got] == [(0, 1, 1, 1), (1, 1, 1, None), (2, 1, 1, None), (3, 1, 1, None), (4, 1, 1, None), (5, 1, 0, 2)]


def test_merge(spark):
    got = tracked(spark, [(0, 15, 10, 6), (0, 15, 22, 5), (1, 15, 12, 7), (1, 15, 20, 6)])
    first = {r[1]: r for r in got if r[0] == 0}
    assert first[1][3] == 2 and first[2][3] == 21 and first[2][4] == first[1][2]
    assert [r[2] for r in got if r[0] == 1] == [first[1][2]]


def test_split(spark):
    got = tracked(spark, [(0, 15, 12, 7), (0, 15, 20, 6), (1, 15, 10, 6), (1, 15, 22, 5), (2, 15, 10, 6), (2, 15, 22, 5)])
    assert [r[3] for r in got if r[0] == 0] == [13]
    second = {r[1]: r for r in got if r[0] == 1}
    assert second[1][3] == 3 + 1 and second[2][3] == 31 + 1
    assert second[1][2] == 1 and second[2][2] == 2 and second[2][5] == 1


def test_gap_starts_new_numbers(spark):
    got = tracked(spark, [(t, 10, 10 + t, 4) for t in range(4)], hours={0: 0, 1: 1, 2: 5, 3: 6})
    assert [(r[0], r[2], r[6]) for r in got] == [(0, 1, 1), (1, 1, 2), (2, 2, 1), (3, 2, 2)]


def test_lone_frame_is_absent(spark):
    got = tracked(spark, [(t, 10, 10, 4) for t in range(3)], hours={0: 0, 1: 1, 2: 9})
    assert sorted({r[0] for r in got}) == [0, 1]


def test_drift(spark):
    centres = [(t, 10, 6 + 10 * t, 3) for t in range(3)]
    assert len({r[2] for r in tracked(spark, centres)}) == 3
    drift = spark.createDataFrame([(1, 0, 10), (2, 0, 10)], "frame_id long, y int, x int")
    assert {r[2] for r in tracked(spark, centres, drift=drift)} == {1}


def test_wrap(spark):
    p = rasters.blobs(spark, [(0, 10, 0, 4)], 20, 20, True)
    assert I.threshold_labels(p, (20, 20), 0, wrap=True).select("feature").distinct().count() == 1
    assert I.threshold_labels(p, (20, 20), 0).select("feature").distinct().count() == 2


def test_nothing_over_the_threshold(spark):
    p = rasters.blobs(spark, [(0, 10, 10, 3)], 20, 20)
    assert I.threshold_labels(p, (20, 20), 1000).count() == 0


def sequential(frames, sizes, links, timegap):
    """Numbers frame after frame, as one loop; only what pairs decide is shared with the library."""
    out, status, nxt, last = {}, {}, 1, None
    for (a, ta), (b, tb) in zip(frames, frames[1:]):
        if not 0 < (tb - ta) / 3600 < timegap:
            last = None
            continue
        if last != a:
            for f in sorted(sizes[a]):
                out[a, f] = nxt
                nxt += 1
        rows = N.resolve_pair(links[a], sizes[a], sizes[b])
        for side, f, s, of, place, _ in rows:
            if side == "new":
                out[b, f] = out[a, of] if of is not None else nxt + place
                status[b, f] = status.get((b, f), 0) + s
            elif side == "ref":
                status[a, f] = status.get((a, f), 0) + s
        nxt += next(s for side, _, s, *_ in rows if side == "mints")
        last = b
    return {k: (v, status.get(k, 0)) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_parallel_numbers_equal_sequential(spark, seed):
    rng = random.Random(seed)
    frames, t = [], 0
    for k in range(14):
        t += rng.choice([3600, 3600, 3600, 5400, 20000])
        frames.append((k, t))
    sizes = {k: {f: rng.randint(1, 5) for f in range(1, rng.randint(1, 5) + 1)} for k, _ in frames}
    links = {a: sorted({(rng.choice(["forward", "backward"]), rng.choice(list(sizes[a])), rng.choice(list(sizes[b]))) for _ in range(rng.randint(0, 7))}) for (a, _), (b, _) in zip(frames, frames[1:])}
    f = spark.createDataFrame(frames, "frame_id long, base_time long")
    features = spark.createDataFrame([(k, i, n) for k, s in sizes.items() for i, n in s.items()], "frame_id long, feature long, npix long")
    rows = [(a, a + 1, w, r, n, 1, 1.0) for a, ls in links.items() for w, r, n in ls]
    df = spark.createDataFrame(rows, "frame_id long, next_id long, direction string, ref long, new long, overlap_px long, frac double")
    got = {(r.frame_id, r.feature): (r.track, r.status) for r in N.track_numbers(f, features, df, 1.5).collect()}
    assert got == sequential(frames, sizes, links, 1.5)


def test_pair_rules():
    rows = {(r[0], r[1]): r for r in N.resolve_pair([("forward", 1, 1), ("forward", 1, 2), ("forward", 2, 2)], {1: 9, 2: 5}, {1: 3, 2: 4})}
    assert rows["ref", 1][2] == 15 and rows["ref", 2][2] == 34 and rows["ref", 2][5] == 1
    assert rows["new", 2][2:4] == (3, 1) and rows["new", 1][2] == 31 and rows["new", 1][5] == 1
    only_back = {(r[0], r[1]): r for r in N.resolve_pair([("backward", 1, 1)], {1: 9}, {1: 3})}
    assert only_back["ref", 1][2] == 1 and only_back["new", 1][3] == 1
    ties = {(r[0], r[1]): r for r in N.resolve_pair([("forward", 1, 1), ("forward", 2, 1)], {1: 5, 2: 5}, {1: 3})}
    assert ties["ref", 1][2] == 2 and ties["ref", 2][2] == 21


def test_robust_systems_need_their_criteria_together(spark):
    """Track 1 exceeds each line at some time, never all at one; track 2 together and long enough; track 3 has too little heavy rain."""
    from gridtrack.operators import tracks as T

    rows = []
    for t in range(6):
        odd = t % 2
        rows += [(1, t, 5.0, 20.0 if odd else 0.0, 0.0 if odd else 9.0, 9.0, 50.0, 100.0), (2, t, 5.0, 20.0, 9.0, 9.0, 50.0, 100.0), (3, t, 5.0, 20.0, 9.0, 9.0, 5.0 if t else 99.0, 100.0)]
    df = spark.createDataFrame(rows, "track long, t_idx long, pf_axis double, pf_area double, pf_rate double, pf_skew double, pf_heavy double, pf_total double")
    got = T.robust(df, (1, 10), 1, 4, (10, 0), (5, 0), (5, 0), (40, 0))
    assert [tuple(r) for r in got.collect()] == [(2, 6.0, 1)]


def test_rain_features_are_taken_in_order_with_current_sizes(spark):
    """Cloud 2 joins 1 by the first rain feature; the second then finds 1 larger than 3 only with it; a renumbered cloud stays."""
    from gridtrack.operators import identify as I

    line = [(0, 0, x, 1) for x in range(4)] + [(0, 0, x, 2) for x in range(5, 8)] + [(0, 0, x, 3) for x in range(9, 14)] + [(0, 2, x, 4) for x in range(3)]
    rain = [(0, 0, x, 1) for x in (3, 4, 5)] + [(0, 0, x, 2) for x in (7, 8, 9)] + [(0, 5, 5, 3)]
    got = I.absorbed(spark.createDataFrame(line, "frame_id long, y int, x int, feature long"), spark.createDataFrame(rain, "frame_id long, y int, x int, pf long"))
    where = {(r.y, r.x): r.feature for r in got.collect()}
    assert {where[0, x] for x in range(14)} == {1} and {where[2, x] for x in range(3)} == {4} and (5, 5) not in where


def test_cells_are_four_connected_and_more_than_the_least(spark):
    from gridtrack.operators import identify as I

    v = [(0, 1, 1, 60.0), (0, 1, 2, 60.0), (0, 1, 3, 60.0), (0, 2, 4, 60.0), (0, 3, 4, 60.0), (0, 4, 4, 60.0), (0, 8, 8, 60.0), (0, 8, 9, 60.0)]
    got = I.convective_cells(spark.createDataFrame(v, "frame_id long, y int, x int, v double"), (12, 12), 2, 45, 5, 2, (0.5,))
    assert sorted((r.y, r.x, r.feature) for r in got.collect()) == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (2, 4, 1), (3, 4, 1), (4, 4, 1)]


def test_folder_of_stored_tables():
    from gridtrack.operators import scratch

    assert scratch.folder("hdfs://x/y/", "spark://a:1") == "hdfs://x/y"
    assert scratch.folder(None, "local[4]").startswith("file:///")
    for master in ("spark://a:1", "yarn", "local-cluster[2,1,1024]", "k8s://b"):
        with pytest.raises(ValueError):
            scratch.folder(None, master)


def test_numbers_by_order_without_one_task(spark):
    from gridtrack.operators import scratch

    rows = spark.range(0, 5000, 1, 13).selectExpr("(id * 7919) % 5003 AS k")
    got = [(r.k, r.n) for r in scratch.numbered(rows, "k", "n").collect()]
    assert sorted(n for _, n in got) == list(range(1, 5001)) and [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)


def test_sphere_cells_have_equal_areas(spark):
    """Each of the 48 cells of order 1 holds its share of evenly spread points, and finer cells lie within them."""
    import numpy as np
    from pyspark.sql import functions as F

    from gridtrack.operators import regrid

    n = 48000
    k = np.arange(n) + 0.5
    lat, lon = np.degrees(np.arcsin(1 - 2 * k / n)), np.degrees(np.pi * (1 + 5**0.5) * k) % 360
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lat, lon)], "lat double, lon double")
    cells = df.select(regrid.sphere_cell(F.col("lat"), F.col("lon"), 1).alias("c"), regrid.sphere_cell(F.col("lat"), F.col("lon"), 3).alias("f"))
    count = {r.c: r["count"] for r in cells.groupBy("c").count().collect()}
    assert set(count) == set(range(48)) and all(abs(v - n / 48) < 0.06 * n / 48 for v in count.values())
    assert cells.where("f div 16 <> c").count() == 0 and cells.select("f").distinct().count() == 768


def test_clouds_with_rain(spark):
    from gridtrack.operators import identify as I

    cold = [(0, y, x, 20.0) for y in range(2, 6) for x in [*range(2, 8), *range(10, 13)]]
    rain = [(0, 3, x, 9.0) for x in range(6, 12)]
    schema = "frame_id long, y int, x int, v double"
    got = I.clouds_with_rain(spark.createDataFrame(cold, schema), spark.createDataFrame(rain, schema), (10, 16), {"core": 25, "cold": 45, "least_core": 2, "least_cold": 2}, 5.0, 1)
    assert {(r.y, r.x): (r.feature, r.npix) for r in got.collect()} == {(y, x): (1, 38) for _, y, x, _ in cold + rain}
