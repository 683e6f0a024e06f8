import numpy as np
import pytest

from gridtrack.operators import storms


def plain_storm_class(v, z, melting, reach):
    """Column by column, from the description."""
    nz, ny, nx = v.shape
    v = v.copy()
    nan = np.isnan
    at = lambda km: max(k for k in range(nz) if z[k] <= km)
    k3, k4, k5, k9 = at(3), at(4), at(5), at(9)
    around = lambda y, x, r: [(min(max(b, 0), ny - 1), min(max(a, 0), nx - 1)) for b in range(y - r, y + r + 1) for a in range(x - r, x + r + 1)]
    cells = [(y, x) for y in range(ny) for x in range(nx)]
    for y, x in cells:
        if nan(v[k3, y, x]) and v[k4, y, x] >= 20:
            v[k3, y, x] = v[k4, y, x]
    out = np.zeros((ny, nx), int)
    echo = {c: any(v[k][c] >= 0 for k in range(k3, nz)) for c in cells}
    most = {c: max([v[k][c] for k in range(nz) if not nan(v[k][c])], default=-np.inf) for c in cells}
    for c in cells:
        own = [k for k in range(k9 + 1) if not nan(v[k][c])]
        stands = 0
        for k in own:
            vals = sorted(v[k][p] for p in around(*c, reach) if not nan(v[k][p]))
            stands += v[k][c] - np.median(vals) > max(10 - v[k][c] ** 2 / 337.5, 4)
        aloft = max([v[k][c] if z[k] > melting + 1 else 0.0 for k in range(nz) if not nan(v[k][c])], default=-np.inf)
        top = max([z[k] for k in range(nz) if v[k][c] >= 25], default=0)
        if own and stands >= 0.3 * len(own) or aloft >= 45 or top >= 10:
            out[c] = 2
    share = lambda o, k: {c: sum(o[p] == k for p in around(*c, 1)) / 9 for c in cells}
    s = share(out, 2)
    for c in cells:
        if out[c] == 2 and s[c] <= 0.15:
            out[c] = 0
    s = share(out, 2)
    for c in cells:
        if s[c] > 0.001 and most[c] >= 25:
            out[c] = 2
    for c in cells:
        if out[c] == 0 and (v[k3][c] >= 20 or any(v[k][c] >= 10 for k in range(k3))):
            out[c] = 3
        if out[c] == 0 and echo[c] and not v[k3][c] >= 20:
            out[c] = 4
        if out[c] in (0, 4) and echo[c] and all(nan(v[k][c]) for k in range(k3, k5 + 1)):
            out[c] = 5
    before = out.copy()
    for c in cells:
        rises = any(v[k + 1][c] - v[k][c] >= 8 and z[k] <= 7 and sum(not nan(v[k][p]) for p in around(*c, 1)) / 9 >= 0.7 for k in range(nz - 1))
        if rises and most[c] >= 40 and before[c] == 2:
            out[c] = 1
    s, before = share(out, 1), out.copy()
    for c in cells:
        if before[c] == 1 and s[c] <= 0.15:
            out[c] = int(np.median([before[p] for p in around(*c, 1)]))
    edge = np.ones((ny, nx), bool)
    edge[reach : ny - reach, reach : nx - reach] = False
    out[edge] = 0
    return out


@pytest.mark.parametrize("reach", [1, 2])
def test_storm_classes_equal_column_by_column(spark, reach):
    z = [0.5 + k for k in range(14)]
    height, rows, want, found = np.array(z)[:, None, None], [], set(), set()
    for seed in range(12):
        rng = np.random.default_rng(seed)
        y, x = np.mgrid[:14, :16]
        v = rng.normal(5, 8, (14, 14, 16)) + 45 * np.exp(-((y - 6) ** 2 + (x - 7) ** 2) / (4 + seed)) * np.exp(-((height - rng.uniform(2, 9)) ** 2) / 30)
        v[rng.random(v.shape) < 0.1] = np.nan
        v[:, :, 12:][: rng.integers(3, 9)] = np.nan
        rows += [(seed, int(k), int(b), int(a), None if np.isnan(v[k, b, a]) else float(v[k, b, a])) for k, b, a in np.ndindex(v.shape)]
        plain = plain_storm_class(v, np.array(z), 4.0, reach)
        found |= set(np.unique(plain).tolist())
        want |= {(seed, int(b), int(a), int(plain[b, a])) for b, a in zip(*np.nonzero(plain))}
    volume = spark.createDataFrame(rows, "frame_id long, z int, y int, x int, v double")
    got = storms.storm_classes(volume, (14, 16), z, 4.0, reach)
    assert {tuple(r) for r in got.collect()} == want and found == {0, 1, 2, 3, 4, 5}


def test_no_echo_no_class(spark):
    empty = spark.createDataFrame([(0, 0, 0, 0, None)], "frame_id long, z int, y int, x int, v double")
    assert storms.storm_classes(empty, (8, 8), [0.5, 1.5, 2.5, 3.5], 2.0, 1).count() == 0
