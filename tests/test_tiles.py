import numpy as np
import pyarrow as pa
import pytest

from gridtrack.functions import kernels as K
from gridtrack.operators import tiles

PIXELS = "frame_id long, y int, x int, v double"


def rows_of(a):
    return [(f, int(y), int(x), float(f + y)) for f in range(len(a)) for y, x in zip(*np.nonzero(a[f]))]


def frames(got, shape):
    out = np.zeros(shape, np.int64)
    for r in got:
        out[r.frame_id, r.y, r.x] = r.feature
    return out


@pytest.mark.parametrize("tile,eight,wrap", [((3, 3), False, ""), ((4, 5), True, ""), ((7, 2), True, "x"), ((3, 4), False, "y"), ((5, 5), True, "xy"), ((40, 40), False, "xy")])
def test_as_the_labels_of_whole_frames(spark, tile, eight, wrap):
    a = np.random.default_rng(sum(tile)).random((3, 19, 17)) < (0.35 if eight else 0.55)
    got = tiles.labels(spark.createDataFrame(rows_of(a), PIXELS), (19, 17), tile, eight, wrap, "v").collect()
    assert len(got) == a.sum() and all(r.v == r.frame_id + r.y for r in got)
    assert (frames(got, a.shape) == np.stack([K.components(f, eight, wrap) for f in a])).all()


def test_one_object_over_all_tiles(spark):
    """A spiral through every tile is one object; beside it stands another."""
    a = np.zeros((1, 40, 40), bool)
    for k in range(0, 20, 4):
        a[0, k, k : 40 - k] = a[0, k : 40 - k, 39 - k] = a[0, 39 - k, k : 40 - k] = True
        a[0, k + 4 : 40 - k, k] = True
        if k:
            a[0, k, k - 4 : k] = True
    want = K.components(a[0])
    got = tiles.labels(spark.createDataFrame(rows_of(a), PIXELS), (40, 40), (4, 4)).collect()
    assert (frames(got, a.shape)[0] == want).all() and np.bincount(want.ravel())[1:].max() > 400


def test_groups_of_a_stream():
    """Groups that run over batches come whole, one at a time."""
    keys = np.repeat([3, 3, 4, 4, 4], [4, 1, 2, 7, 1])
    table = pa.table({"a": keys, "b": np.repeat([1, 2, 2, 3, 4], [4, 1, 2, 7, 1]), "v": np.arange(15)})
    for size in (1, 2, 5, 20):
        got = [(k, v.tolist()) for k, (v,) in tiles.cut(iter(table.to_batches(size)), 2)]
        assert got == [((3, 1), [0, 1, 2, 3]), ((3, 2), [4]), ((4, 2), [5, 6]), ((4, 3), list(range(7, 14))), ((4, 4), [14])]


def test_no_pixels(spark):
    assert tiles.labels(spark.createDataFrame([], PIXELS), (8, 8), (3, 3)).count() == 0
    assert tiles.grown(spark.createDataFrame([], "frame_id long, y int, x int, feature long"), spark.createDataFrame([], PIXELS), (8, 8)).count() == 0


def plain_growth(seeds, ok, wy, wx):
    """Ring by ring in loops over pixels."""
    out, (ny, nx) = seeds.copy(), seeds.shape

    def near(y, x):
        for dy, dx in K.SQUARE:
            b, a = y + dy, x + dx
            if (wy or 0 <= b < ny) and (wx or 0 <= a < nx):
                yield b % ny, a % nx

    while True:
        ring = {}
        for y, x in np.argwhere(ok & (out == 0)):
            votes = [out[p] for p in near(y, x) if out[p]]
            if votes:
                values, n = np.unique(votes, return_counts=True)
                ring[y, x] = values[n.argmax()]
        if not ring:
            return out
        for p, k in ring.items():
            out[p] = k


@pytest.mark.parametrize("wrap", ["", "x", "xy"])
def test_growth_by_rings(spark, wrap):
    rng = np.random.default_rng(len(wrap))
    seeds = np.where(rng.random((2, 14, 11)) < 0.05, rng.integers(1, 5, (2, 14, 11)), 0)
    ok = rng.random((2, 14, 11)) < 0.7
    frame = spark.createDataFrame([(f, int(y), int(x), int(seeds[f, y, x])) for f in range(2) for y, x in np.argwhere(seeds[f])], "frame_id long, y int, x int, feature long")
    got = tiles.grown(frame, spark.createDataFrame(rows_of(ok), PIXELS), (14, 11), wrap).collect()
    assert (frames(got, ok.shape) == np.stack([plain_growth(seeds[f], ok[f], "y" in wrap, "x" in wrap) for f in range(2)])).all()


def test_rolled_frames_have_rolled_labels():
    """With both edges joined every roll of a frame rolls its objects: labels, growth and flooding."""
    rng = np.random.default_rng(4)
    mask = rng.random((6, 7)) < 0.5
    objects = lambda a: {frozenset(map(tuple, np.argwhere(a == k))) for k in range(1, a.max() + 1)}
    hill = rng.permutation(6 * 7).reshape(6, 7).astype(float)
    want = K.components(mask, True, "xy"), K.watershed(hill, K.local_maxima(hill, 1, 5, "xy"), hill > 8, False, "xy"), K.grown((hill == 41).astype(int), hill > 12, "xy")
    for dy in range(6):
        for dx in range(7):
            roll = lambda a, k=1: np.roll(a, (k * dy, k * dx), (0, 1))  # noqa: E731,B023
            h = roll(hill)
            got = K.components(roll(mask), True, "xy"), K.watershed(h, K.local_maxima(h, 1, 5, "xy"), h > 8, False, "xy"), K.grown((h == 41).astype(int), h > 12, "xy")
            for a, b in zip(got, want):
                assert objects(roll(a, -1)) == objects(b)
    # An object over the corner is one only where both axes meet.
    corner = np.zeros((5, 5), bool)
    corner[[0, 0, -1, -1], [0, -1, 0, -1]] = True
    assert [K.components(corner, False, w).max() for w in ("xy", "x", "y", "")] == [1, 2, 2, 4]


def test_compact_flooding():
    """A large compactness parts two basins in the middle between their markers, whatever the heights; none leaves the valley."""
    v = np.tile(np.array([9.0, 3, 8, 8, 8, 8, 8, 8, 9]), (5, 1))
    markers = [(2, 0), (2, 8)]
    free = K.watershed(v, markers, v > 0, False)
    compact = K.watershed(v, markers, v > 0, False, compactness=1000.0)
    assert free[2].tolist() == [1, 1, 2, 2, 2, 2, 2, 2, 2] and (compact[:, :4] == 1).all() and (compact[:, 5:] == 2).all()
    assert (K.watershed(v, markers, v > 0, False, compactness=0.0) == free).all()


def test_no_side_of_a_join_comes_to_the_driver(spark, monkeypatch):
    """Sides that grow with the frames are merged however small they look; only the counts of the ranges are broadcast."""
    plans, own = {}, tiles.stored
    monkeypatch.setattr(tiles, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and own(df, name))
    a = np.random.default_rng(5).random((2, 9, 9)) < 0.5
    got = tiles.labels(spark.createDataFrame(rows_of(a), PIXELS), (9, 9), (3, 3))
    plans["labels"] = got._jdf.queryExecution().executedPlan().toString()
    assert {"least", "edges", "nodes", "named"} <= set(plans)
    assert [k for k, p in plans.items() if "BroadcastExchange" in p and k != "placed"] == []
    assert (frames(got.collect(), a.shape) == np.stack([K.components(f) for f in a])).all()
