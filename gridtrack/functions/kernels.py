"""Neighbourhood kernels on one frame, in numpy; operators run them one frame to a group."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))
SQUARE = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


def axes_of(wrap: bool | str) -> tuple[bool, bool]:
    """Whether the edges meet along y and along x; ``wrap`` names the axes ("x", "y", "xy"), True stands for x."""
    return ("y" in wrap, "x" in wrap) if isinstance(wrap, str) else (False, wrap)


def components(mask: np.ndarray, eight: bool = False, wrap: bool | str = False) -> np.ndarray:
    """Labels 1..n of connected pixels in raster order of their first pixel, 0 elsewhere.

    Neighbouring pixels are hooked to the smaller root until nothing changes; the edges
    of the axes of ``wrap`` (:func:`axes_of`) meet.
    """
    ny, nx = mask.shape
    wy, wx = axes_of(wrap)
    ids = np.arange(ny * nx).reshape(ny, nx)
    pairs = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)) if eight else ((0, 1), (1, 0)):
        back = lambda m: np.roll(m, (-dy, -dx), (0, 1))  # noqa: E731,B023
        both = mask & back(mask)
        if dy and not wy:
            both[-1] = False
        if dx and not wx:
            both[:, -1 if dx > 0 else 0] = False
        pairs.append(np.stack([ids[both], back(ids)[both]]))
    a, b = np.concatenate(pairs, 1)
    root = np.arange(ny * nx)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            break
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(ny * nx, np.int64)
    on = mask.ravel()
    out[on] = np.unique(root[on], return_inverse=True)[1] + 1
    return out.reshape(ny, nx)


def by_size(labels: np.ndarray, least: float = 0, area: np.ndarray | None = None) -> np.ndarray:
    """Labels renumbered 1..n by falling pixel count (ties: the later raster label first); sizes not over ``least`` go."""
    count = np.bincount(labels.ravel())
    size = np.bincount(labels.ravel(), weights=None if area is None else area.ravel())
    keep = [k for k in range(1, len(count)) if count[k] and size[k] > least]
    keep.sort(key=lambda k: (-count[k], -k))
    new = np.zeros(len(count), np.int64)
    new[keep] = np.arange(1, len(keep) + 1)
    return new[labels]


def box_mean(v: np.ndarray, n: int) -> np.ndarray:
    """Mean of the valid pixels in a window of n x n, edges extended; missing pixels stay missing. An even n is n + 1 wide with half weight at the rim."""
    k = n // 2
    ok = ~np.isnan(v)
    total = np.pad(np.where(ok, v, 0.0), k, mode="edge")
    weight = np.pad(ok.astype(float), k, mode="edge")

    def window(a: np.ndarray, axis: int, width: int) -> np.ndarray:
        c = np.insert(a.cumsum(axis), 0, 0, axis)
        ends = np.arange(width, c.shape[axis])
        return np.take(c, ends, axis) - np.take(c, ends - width, axis)

    def summed(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            wide = window(a, axis, 2 * k + 1)
            # The half rim is the mean of the window with it and the one without.
            inner = window(np.take(a, np.arange(1, a.shape[axis] - 1), axis), axis, 2 * k - 1) if n % 2 == 0 else wide
            a = (wide + inner) / 2
        return a

    w = summed(weight)
    return np.where(ok, summed(total) / np.maximum(w, 1e-12), np.nan)


def median_filter(v: np.ndarray, n: int, fill: float | None = 0.0) -> np.ndarray:
    """Median of n x n windows; outside is ``fill``, or the edge where that is None."""
    k = n // 2
    p = np.pad(v, k, mode="edge") if fill is None else np.pad(v, k, constant_values=fill)
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (n, n)), axis=(2, 3))


def median_filled(v: np.ndarray, n: int) -> np.ndarray:
    """Missing pixels replaced by the window's median of the frame with missing as 0."""
    return np.where(np.isnan(v), median_filter(np.nan_to_num(v), n), v)


def gaussian_filter(v: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """Separable Gaussian, edges mirrored with the edge pixel repeated."""
    r = int(reach * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        p = np.pad(v, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        v = sum(w[k] * np.take(p, range(k, k + v.shape[axis]), axis) for k in range(2 * r + 1))
    return v


def disk(radius: float) -> list[tuple[int, int]]:
    r = int(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def shifted(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    out = np.full_like(a, fill)
    ny, nx = a.shape
    if abs(dy) < ny and abs(dx) < nx:
        out[max(0, dy) : ny + min(0, dy), max(0, dx) : nx + min(0, dx)] = a[max(0, -dy) : ny - max(0, dy), max(0, -dx) : nx - max(0, dx)]
    return out


def dilated(mask: np.ndarray, offsets) -> np.ndarray:
    out = mask.copy()
    for dy, dx in offsets:
        out |= shifted(mask, dy, dx, False)
    return out


def perimeter_pixels(labels: np.ndarray, radius: int = 1) -> np.ndarray:
    """Labelled pixels with another label or the outside within the disk."""
    edge = np.zeros(labels.shape, bool)
    for dy, dx in disk(radius):
        edge |= shifted(labels, dy, dx, -1) != labels
    return edge & (labels > 0)


def background(dbz: np.ndarray, valid: np.ndarray, radius: float) -> np.ndarray:
    """Mean reflectivity of the valid pixels within ``radius`` pixels, averaged in linear units."""
    z = np.where(valid, 10 ** (dbz / 10), 0.0)
    total, n = np.zeros(z.shape), np.zeros(z.shape)
    for dy, dx in disk(radius):
        total += shifted(z, dy, dx, 0.0)
        n += shifted(valid.astype(float), dy, dx, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(valid & (n > 0), 10 * np.log10(total / n), np.nan)


def dilated_by_background(core: np.ndarray, bkg: np.ndarray, steps: list[tuple[float, float]]) -> np.ndarray:
    """Core pixels widened by a radius (pixels) that depends on their background: ``steps`` (lower bound, radius), rising."""
    out = core.copy()
    bounds = [b for b, _ in steps] + [np.inf]
    for (low, radius), high in zip(steps, bounds[1:]):
        with np.errstate(invalid="ignore"):
            own = core & (bkg >= low) & (bkg < high)
        if own.any():
            out |= dilated(own, disk(radius))
    return out


def strided(v: np.ndarray, factor: int) -> np.ndarray:
    """Mean over factor x factor windows (odd), taken at every ``factor``-th pixel from the first whole window."""
    w = np.lib.stride_tricks.sliding_window_view(v, (factor, factor)).mean(axis=(2, 3))
    return w[::factor, ::factor]


def grown(seeds: np.ndarray, allowed: np.ndarray, wrap: bool | str = False) -> np.ndarray:
    """Seeds spread over ``allowed`` pixels breadth first, eight neighbours; a pixel takes the commonest label around it, the smallest on ties.

    Labels stand in a flat frame with a border that nothing enters; the edges of the axes
    of ``wrap`` meet by their places in it.
    """
    ny, nx = seeds.shape
    wy, wx = axes_of(wrap)
    width = nx + 2
    out = np.pad(seeds, 1).ravel().tolist()
    open_ = (np.pad(allowed, 1) & (np.pad(seeds, 1) == 0)).ravel().tolist()
    steps = [dy * width + dx for dy, dx in SQUARE]

    def near(p: int) -> list[int]:
        row, col = divmod(p, width)
        if not (wx and col in (1, nx) or wy and row in (1, ny)):
            return [p + s for s in steps]
        return [((row + dy - 1) % ny + 1 if wy else row + dy) * width + ((col + dx - 1) % nx + 1 if wx else col + dx) for dy, dx in SQUARE]

    queue = deque(np.flatnonzero(np.pad(seeds, 1).ravel()).tolist())
    while queue:
        for p in near(queue.popleft()):
            if open_[p]:
                open_[p] = False
                count: dict[int, int] = {}
                for q in near(p):
                    if out[q]:
                        count[out[q]] = count.get(out[q], 0) + 1
                most = max(count.values())
                out[p] = min(k for k, n in count.items() if n == most)
                queue.append(p)
    return np.array(out, seeds.dtype).reshape(ny + 2, width)[1:-1, 1:-1]


def widened(labels: np.ndarray, radii) -> np.ndarray:
    """Labels spread to each radius in turn, in order of their numbers: a pixel that another has by then stays with it."""
    out = labels.copy()
    ny, nx = labels.shape
    order = np.argsort(labels.ravel(), kind="stable")
    ends = np.searchsorted(labels.ravel()[order], np.arange(1, labels.max() + 2))
    cores = [order[a:b] for a, b in zip(ends, ends[1:])]
    for radius in radii:
        steps = np.array(disk(radius))
        for k, core in enumerate(cores, 1):
            y = (core // nx)[:, None] + steps[:, 0]
            x = (core % nx)[:, None] + steps[:, 1]
            inside = (y >= 0) & (y < ny) & (x >= 0) & (x < nx)
            y, x = y[inside], x[inside]
            free = out[y, x] == 0
            out[y[free], x[free]] = k
    return out


def local_maxima(v: np.ndarray, distance: int, least: float, wrap: bool | str = False) -> list[tuple[int, int]]:
    """Pixels over ``least`` that are highest within ``distance`` (square), of equal ones too near the first in raster order; highest first."""
    meets, padded = axes_of(wrap), v
    for axis in (0, 1):
        rim = [(distance, distance) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(padded, rim, mode="wrap") if meets[axis] else np.pad(padded, rim, constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(padded, (2 * distance + 1,) * 2).max(axis=(2, 3))
    found = sorted(((-v[y, x], y, x) for y, x in np.argwhere((v == top) & (v > least))))
    out: list[tuple[int, int]] = []
    taken = np.zeros(np.array(v.shape) + 2 * distance, bool)
    for _, y, x in found:
        if not taken[y + distance, x + distance]:
            out.append((int(y), int(x)))
            places = [(p - n, p, p + n) if meet else (p,) for p, n, meet in zip((y, x), v.shape, meets)]
            for row in places[0]:
                for col in places[1]:
                    taken[max(0, row) : max(0, row + 2 * distance + 1), max(0, col) : max(0, col + 2 * distance + 1)] = True
    return out


def watershed(v: np.ndarray, markers: list[tuple[int, int]], mask: np.ndarray, line: bool = True, wrap: bool | str = False, compactness: float = 0.0) -> np.ndarray:
    """Flooding from the markers over ``mask``, highest values first and then by age; with ``line`` a pixel between two labels stays 0.  The edges of the axes of ``wrap`` meet.

    With ``compactness`` a pixel is flooded the later the farther it is from its marker, by that factor times the distance;
    pixels that two markers reach are taken by the one that reaches them first.  The frame is flat, with a border that nothing enters.
    """
    ny, nx = v.shape
    wy, wx = axes_of(wrap)
    width = nx + 2
    out = [0] * ((ny + 2) * width)
    level = (-np.pad(v, 1)).ravel().tolist()
    open_ = np.pad(mask, 1).ravel().tolist()
    heap: list[tuple[float, int, int, int]] = []
    age = 0

    def far(p: int, k: int) -> float:
        apart = [abs(a - b) for a, b in zip(divmod(p, width), (markers[k - 1][0] + 1, markers[k - 1][1] + 1))]
        apart = [min(d, n - d) if meet else d for d, n, meet in zip(apart, (ny, nx), (wy, wx))]
        return (apart[0] ** 2 + apart[1] ** 2) ** 0.5

    def around(p: int) -> tuple[int, int, int, int]:
        row, col = divmod(p, width)
        return (
            p + (ny - 1) * width if wy and row == 1 else p - width, p + nx - 1 if wx and col == 1 else p - 1,
            p - nx + 1 if wx and col == nx else p + 1, p - (ny - 1) * width if wy and row == ny else p + width,
        )

    for k, (y, x) in enumerate(markers, 1):
        p = (y + 1) * width + x + 1
        out[p] = k
        open_[p] = False
        heap.append((level[p], age, p, k))
        age += 1
    heapq.heapify(heap)
    while heap:
        _, _, p, k = heapq.heappop(heap)
        if compactness and out[p] not in (0, k):
            continue
        if not out[p]:
            near = {out[q] for q in around(p) if out[q]}
            if line and len(near) > 1:
                open_[p] = False
                continue
            out[p] = k if compactness else min(near)
        for q in around(p):
            if open_[q] and not out[q]:
                # Without compactness a pixel waits once; with it each label that reaches it has its own turn.
                open_[q] = bool(compactness)
                heapq.heappush(heap, (level[q] + compactness * far(q, out[p]), age, q, out[p]))
                age += 1
    return np.array(out, np.int64).reshape(ny + 2, width)[1:-1, 1:-1]


def displacement(first: np.ndarray, second: np.ndarray, share: float = 0.005) -> tuple[float, float]:
    """(dy, dx) from the first field to the second: the mean place of the top ``share`` of their full cross-correlation."""
    shape = [a + b - 1 for a, b in zip(first.shape, second.shape)]
    f = np.fft.irfft2(np.fft.rfft2(second, shape) * np.fft.rfft2(first[::-1, ::-1], shape), shape)
    n = max(1, int(round(share * f.size)))
    top = np.argpartition(f.ravel(), -n)[-n:]
    y, x = np.unravel_index(top, f.shape)
    return float(y.mean() - (first.shape[0] - 1)), float(x.mean() - (first.shape[1] - 1))


def masked_correlation_shift(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, overlap: float = 0.7) -> tuple[int, int]:
    """(dy, dx) of the highest normalised correlation of b against a over valid pixels, among shifts that overlap in ``overlap`` of the most."""
    shape = [p + q - 1 for p, q in zip(a.shape, b.shape)]
    fwd = lambda m: np.fft.rfft2(m, shape)
    inv = lambda m: np.fft.irfft2(m, shape)
    flip = lambda m: m[::-1, ::-1]
    a0, b0, ma, mb = np.where(va, a, 0.0), np.where(vb, b, 0.0), va.astype(float), vb.astype(float)
    fa, fb, fma, fmb = fwd(flip(a0)), fwd(b0), fwd(flip(ma)), fwd(mb)
    n = np.round(inv(fma * fmb))
    ok = n > 0
    nn = np.where(ok, n, 1)
    sa, sb = inv(fa * fmb), inv(fma * fb)
    num = inv(fa * fb) - sa * sb / nn
    da = inv(fwd(flip(a0 * a0)) * fmb) - sa * sa / nn
    db = inv(fma * fwd(b0 * b0)) - sb * sb / nn
    den = np.sqrt(np.maximum(da, 0) * np.maximum(db, 0))
    good = ok & (den > 1e-9 * max(den.max(), 1e-30)) & (n >= overlap * n.max())
    score = np.where(good, num / np.where(den > 0, den, 1), -np.inf)
    y, x = np.unravel_index(score.argmax(), score.shape)
    return int(y - (a.shape[0] - 1)), int(x - (a.shape[1] - 1))


def smoothed_path(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, max_speed: float, km) -> tuple[np.ndarray, np.ndarray]:
    """A path without points that imply a speed over ``max_speed`` (km/h) from the last kept one, gaps interpolated linearly.

    Tried from the first, second and third point; the try that keeps the first point and drops the
    fewest is taken.
    """
    best = None
    for start in range(min(3, len(t))):
        keep, last = [start], start
        for i in range(start + 1, len(t)):
            if km(lat[last], lon[last], lat[i], lon[i]) <= max_speed * (t[i] - t[last]) / 3600:
                keep.append(i)
                last = i
        rank = (start > 0, len(t) - len(keep))
        if best is None or rank < best[0]:
            best = (rank, keep)
    keep = best[1]
    return np.interp(t, t[keep], lat[keep]), np.interp(t, t[keep], lon[keep])


def quadratic_filled(t: np.ndarray, v: np.ndarray, limit: float) -> np.ndarray:
    """Values of ``limit`` or more replaced by the quadratic spline through the others (null beyond their ends); all null with under three others."""
    ok = np.isfinite(v) & (v < limit)
    if ok.sum() < 3:
        return np.full(len(v), np.nan)
    x, y = t[ok].astype(float), v[ok].astype(float)
    n = len(x)
    # Quadratic B-splines with knots midway between inner points interpolate at the points.
    knots = np.concatenate([[x[0]] * 3, (x[1:-2] + x[2:-1]) / 2, [x[-1]] * 3])

    def basis(at: np.ndarray) -> np.ndarray:
        b = ((at[:, None] >= knots[:-1]) & (at[:, None] < knots[1:])).astype(float)
        b[at == x[-1], n - 1] = 1
        for d in (1, 2):
            left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
            with np.errstate(divide="ignore", invalid="ignore"):
                one = np.where(left > 0, (at[:, None] - knots[: -d - 1]) / left, 0) * b[:, :-1]
                two = np.where(right > 0, (knots[d + 1 :] - at[:, None]) / right, 0) * b[:, 1:]
            b = one + two
        return b

    weights = np.linalg.solve(basis(x), y)
    out = np.full(len(v), np.nan)
    inside = (t >= x[0]) & (t <= x[-1])
    out[inside] = basis(t[inside].astype(float)) @ weights
    return np.where(ok, v, out)
