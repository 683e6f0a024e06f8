import numpy as np
import pytest

from gridtrack.functions import kernels as K


def brute_labels(mask, eight=False, wrap=False):
    out, n = np.zeros(mask.shape, int), 0
    steps = K.SQUARE if eight else K.CROSS
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            b, a = todo.pop()
            if out[b, a]:
                continue
            out[b, a] = n
            for dy, dx in steps:
                p, q = b + dy, a + dx
                q = q % mask.shape[1] if wrap else q
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                    todo.append((p, q))
    return out


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("wrap", [False, True])
def test_components(eight, wrap):
    rng = np.random.default_rng(1)
    for shape, p in (((1, 1), 1.0), ((7, 9), 0.5), ((40, 30), 0.58), ((20, 20), 0.0), ((1, 12), 0.7)):
        mask = rng.random(shape) < p
        assert (K.components(mask, eight, wrap) == brute_labels(mask, eight, wrap)).all()


def test_sizes():
    labels = np.array([[1, 1, 0, 2], [1, 0, 3, 3], [4, 0, 0, 0]])
    assert (K.by_size(labels, 1) == np.array([[1, 1, 0, 0], [1, 0, 2, 2], [0, 0, 0, 0]])).all()


def test_box_mean_skips_missing():
    v = np.arange(20.0).reshape(4, 5)
    v[1, 2] = np.nan
    got, p = K.box_mean(v, 3), np.pad(v, 1, mode="edge")
    want = np.array([[np.nanmean(p[y : y + 3, x : x + 3]) for x in range(5)] for y in range(4)])
    want[1, 2] = np.nan
    np.testing.assert_allclose(got, want)


def test_background_and_shift():
    rng = np.random.default_rng(2)
    v = rng.uniform(0, 50, (9, 8))
    got = K.background(v, v > 5, 2)
    for y, x in ((0, 0), (4, 4), (8, 7)):
        near = [10 ** (v[b, a] / 10) for b in range(9) for a in range(8) if (b - y) ** 2 + (a - x) ** 2 <= 4 and v[b, a] > 5]
        if v[y, x] > 5:
            assert got[y, x] == pytest.approx(10 * np.log10(np.mean(near)))


def test_displacement():
    a = np.zeros((30, 30))
    a[5:12, 6:14] = 1
    assert K.displacement(a, np.roll(a, (4, -3), (0, 1))) == (4.0, -3.0)


def test_masked_shift():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(24, 24))
    b = np.roll(a, (3, -2), (0, 1))
    ok = rng.random((24, 24)) < 0.9
    assert K.masked_correlation_shift(a, b, ok, np.ones_like(ok)) == (3, -2)


def test_watershed_splits_two_hills():
    y, x = np.mgrid[:20, :30]
    v = np.maximum(20 - (y - 10) ** 2 - (x - 8) ** 2, 15 - (y - 10) ** 2 - (x - 14) ** 2).astype(float)
    peaks = K.local_maxima(v, 2, 0)
    got = K.watershed(v, peaks, v > 0)
    assert peaks == [(10, 8), (10, 14)]
    assert set(np.unique(got)) == {0, 1, 2} and got[10, 8] == 1 and got[10, 14] == 2
    line = K.watershed(v, peaks, v > 0, line=False)
    assert ((line > 0) == (v > 0)).all()


def test_growth_covers_what_is_reached():
    seeds, allowed = np.zeros((5, 7), int), np.ones((5, 7), bool)
    seeds[2, 1], seeds[2, 5] = 1, 2
    allowed[:, 3] = False
    got = K.grown(seeds, allowed)
    assert (got[:, :3] == 1).all() and (got[:, 4:] == 2).all() and (got[:, 3] == 0).all()


def test_quadratic_fill_is_exact_on_parabolas():
    t = np.arange(10)
    v = 2.0 * t * t - 3 * t + 1
    broken = v.copy()
    broken[[3, 4, 7]] = 1e6
    np.testing.assert_allclose(K.quadratic_filled(t, broken, 1000), v)
    assert np.isnan(K.quadratic_filled(t[:4], np.array([1, 1e6, 1e6, 2]), 10)).all()


def test_gaussian_keeps_the_mean():
    v = np.random.default_rng(4).random((12, 15))
    assert K.gaussian_filter(v, 1.5).mean() == pytest.approx(v.mean(), abs=0.02)
    np.testing.assert_allclose(K.gaussian_filter(np.full((9, 9), 3.0), 2), 3.0)


def test_dilation_by_background():
    core, bkg = np.zeros((9, 20), bool), np.full((9, 20), 10.0)
    core[4, 4] = core[4, 14] = True
    bkg[:, 10:] = 40.0
    got = K.dilated_by_background(core, bkg, [(-np.inf, 1), (30, 2)])
    assert got[:, :10].sum() == 5 and got[:, 10:].sum() == 13


def test_small_tables():
    from gridtrack.functions import scalar as S

    assert S.radius_steps(20, 5, 1, 1, 3) == [(-np.inf, 1), (25, 2), (30, 3)]
    assert S.symmetric_positions(5) == [-2, -1, 0, 1, 2] and S.symmetric_positions(4) == [-2, -1, 0, 1]


def test_growth_and_flooding_over_the_edge():
    """With the edges joined the result turns with the frame."""
    rng = np.random.default_rng(8)
    v = rng.random((12, 16)) * 10
    seeds = np.where(rng.random((12, 16)) < 0.04, np.arange(192).reshape(12, 16) + 1, 0)
    ok = (rng.random((12, 16)) < 0.7) | (seeds > 0)
    assert (K.grown(seeds, ok, True) > 0).sum() >= (K.grown(seeds, ok) > 0).sum()
    hill = np.zeros((9, 16))
    hill[4, [15, 0, 1]] = 5, 9, 6
    for turn in range(16):
        h = np.roll(hill, turn, 1)
        got = K.watershed(h, K.local_maxima(h, 2, 1, True), h > 1, True, True)
        assert got.max() == 1 and (got > 0).sum() == 3
        one = K.grown(np.where(h == 9, 1, 0), h > 1, True)
        assert (one > 0).sum() == 3
    for turn in (3, 7):
        a = K.grown(np.roll(np.where(seeds > 0, 1, 0), turn, 1), np.roll(ok, turn, 1), True)
        assert (np.roll(a, -turn, 1) == K.grown(np.where(seeds > 0, 1, 0), ok, True)).all()


def brute_growth(seeds, ok):
    from collections import deque

    out = seeds.copy()
    queue = deque(map(tuple, np.argwhere(seeds > 0)))
    while queue:
        y, x = queue.popleft()
        for dy, dx in K.SQUARE:
            b, a = y + dy, x + dx
            if 0 <= b < out.shape[0] and 0 <= a < out.shape[1] and ok[b, a] and out[b, a] == 0:
                around = [out[b + p, a + q] for p, q in K.SQUARE if 0 <= b + p < out.shape[0] and 0 <= a + q < out.shape[1] and out[b + p, a + q] > 0]
                values, count = np.unique(around, return_counts=True)
                out[b, a] = values[count.argmax()]
                queue.append((b, a))
    return out


def test_growth_equals_pixel_by_pixel():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        seeds = np.where(rng.random((15, 13)) < 0.06, rng.integers(1, 5, (15, 13)), 0)
        ok = rng.random((15, 13)) < 0.75
        assert (K.grown(seeds, ok) == brute_growth(seeds, ok)).all()


def test_widening_takes_radii_and_cores_in_turn():
    labels = np.zeros((9, 12), np.int64)
    labels[4, 2], labels[4, 7] = 1, 2
    got = K.widened(labels, (1, 3))
    want = labels.copy()
    for radius in (1, 3):
        for k in (1, 2):
            near = np.zeros(labels.shape, bool)
            for y, x in np.argwhere(labels == k):
                for b in range(9):
                    for a in range(12):
                        near[b, a] |= (b - y) ** 2 + (a - x) ** 2 <= radius * radius
            want[near & (want == 0)] = k
    assert (got == want).all() and got[4, 5] == 1 and got[4, 6] == 2


def test_flooding_equals_pixel_by_pixel():
    """By a list that is searched for its highest, oldest pixel each time."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        v = rng.random((11, 13))
        mask = v > 0.2
        marks = K.local_maxima(v, 2, 0.5)
        out, todo = np.zeros(v.shape, int), []
        for k, (y, x) in enumerate(marks, 1):
            out[y, x] = k
            todo.append((y, x))
        seen = set(todo)
        order = {p: k for k, p in enumerate(todo)}
        while todo:
            p = min(todo, key=lambda q: (-v[q], order[q]))
            todo.remove(p)
            around = [(p[0] + dy, p[1] + dx) for dy, dx in K.CROSS if 0 <= p[0] + dy < 11 and 0 <= p[1] + dx < 13]
            if not out[p]:
                near = {out[q] for q in around if out[q]}
                if len(near) > 1:
                    continue
                out[p] = near.pop()
            for q in around:
                if mask[q] and q not in seen:
                    seen.add(q)
                    order[q] = len(order)
                    todo.append(q)
        assert (K.watershed(v, marks, mask) == out).all() and len(marks) > 2


def test_maxima_are_apart_and_highest():
    for wrap in (False, True):
        rng = np.random.default_rng(4)
        v = rng.integers(0, 30, (20, 24)).astype(float)
        got = K.local_maxima(v, 3, 5, wrap)
        gap = lambda a, b: min(abs(a - b), 24 - abs(a - b)) if wrap else abs(a - b)
        for y, x in got:
            assert all(v[b, a] <= v[y, x] for b in range(20) for a in range(24) if abs(b - y) <= 3 and gap(a, x) <= 3)
        assert all(max(abs(y - b), gap(x, a)) > 3 for i, (y, x) in enumerate(got) for b, a in got[:i])


def test_paths_without_outliers_by_loops():
    """The kept points are those within the speed of the last kept one, from the best of three starts."""
    km = lambda a, b, c, d: float(np.hypot(a - c, b - d) * 111)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        t = np.arange(12) * 3600
        lat, lon = np.cumsum(rng.normal(0, 0.2, 12)), np.cumsum(rng.normal(0, 0.2, 12))
        lat[rng.integers(0, 12, 2)] += 9
        tries = []
        for first in range(3):
            keep = [first]
            for i in range(first + 1, 12):
                if km(lat[keep[-1]], lon[keep[-1]], lat[i], lon[i]) <= 100 * (t[i] - t[keep[-1]]) / 3600:
                    keep.append(i)
            tries.append((first > 0, 12 - len(keep), keep))
        keep = min(tries, key=lambda x: x[:2])[2]
        a, b = K.smoothed_path(t, lat, lon, 100.0, km)
        np.testing.assert_allclose(a, np.interp(t, t[keep], lat[keep]))
        np.testing.assert_allclose(b, np.interp(t, t[keep], lon[keep]))


def test_even_box_has_half_weight_at_its_rim():
    rng = np.random.default_rng(3)
    v = rng.random((7, 8))
    v[2, 3] = np.nan
    got = K.box_mean(v, 4)
    weight = np.array([0.5, 1, 1, 1, 0.5])
    for y in range(7):
        for x in range(8):
            total = n = 0.0
            for i, dy in enumerate(range(-2, 3)):
                for j, dx in enumerate(range(-2, 3)):
                    a = v[min(max(y + dy, 0), 6), min(max(x + dx, 0), 7)]
                    if not np.isnan(a):
                        total, n = total + weight[i] * weight[j] * a, n + weight[i] * weight[j]
            assert np.isnan(got[y, x]) if (y, x) == (2, 3) else abs(got[y, x] - total / n) < 1e-12
