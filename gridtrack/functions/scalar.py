"""Column expressions of the pixel and track level."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Stefan-Boltzmann constant and the two coefficients of the flux-to-window temperature relation.
SIGMA, FLUX_A, FLUX_B = 5.67e-8, 1.228, -1.106e-3
EARTH_KM = 6371.0
DESTINATION_KM = 6374.2


def brightness_temperature(olr: Column) -> Column:
    """Brightness temperature (K) from outgoing long-wave radiation (W/m2)."""
    flux = F.pow(olr / F.lit(SIGMA), F.lit(0.25))
    return (F.sqrt(F.lit(FLUX_A**2) + F.lit(4 * FLUX_B) * flux) - FLUX_A) / (2 * FLUX_B)


def rate_per_hour(total: Column, seconds: Column, order: WindowSpec) -> Column:
    """Hourly rate from an accumulated amount: the increase to the next time over the time between."""
    return 3600 * (F.lead(total).over(order) - total) / (F.lead(seconds).over(order) - seconds)


def valid(v: Column, low: float, high: float) -> Column:
    """Null outside [low, high]; null and NaN stay null."""
    return F.when(v.between(low, high) & ~F.isnan(v), v)


def positive(v: Column, factor: float = 1.0) -> Column:
    """Unit conversion, negative amounts as 0."""
    return F.greatest(v * factor, F.lit(0.0))


def pixel_class(v: Column, core: float, cold: float, warm: float, cloud: float) -> Column:
    """1 core, 2 cold anvil, 3 warm anvil, 4 other cloud, 5 clear; lower bounds inclusive."""
    return F.when(v < core, 1).when(v < cold, 2).when(v < warm, 3).when(v < cloud, 4).otherwise(5)


def to_linear(dbz: Column) -> Column:
    return F.pow(F.lit(10.0), dbz / 10)


def to_dbz(z: Column) -> Column:
    return F.when(z > 0, 10 * F.log10(z))


def cell_area(lat: Column, dlat: float, dlon: float, radius: float = EARTH_KM) -> Column:
    """Area (km2) of a grid cell of the given extent in degrees."""
    return radius**2 * F.cos(F.radians(lat)) * math.radians(dlat) * math.radians(dlon)


def anomaly_buoyancy(v: Column, level: WindowSpec) -> Column:
    """Buoyancy (m/s2) of a density temperature against its mean over the level."""
    mean = F.avg(v).over(level)
    return 9.81 * (v - mean) / mean


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def destination(lat: Column, lon: Column, km: Column, bearing: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached after ``km`` on a bearing in degrees from north."""
    d, b, la = km / DESTINATION_KM, F.radians(bearing), F.radians(lat)
    lat2 = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def bearing_of(dx: Column, dy: Column) -> Column:
    """Direction of a displacement, degrees clockwise from north in [0, 360); null where there is none."""
    angle = 90 - F.degrees(F.atan2(dy, dx))
    return F.when((dx != 0) | (dy != 0), F.when(angle < 0, angle + 360).otherwise(angle))


def wrapped_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon - 180, F.lit(360)) - 180


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def nearest_second(ts: Column) -> Column:
    return F.date_trunc("second", ts + F.expr("INTERVAL '0.5' SECOND"))


def equivalent_diameter(area: Column) -> Column:
    return 2 * F.sqrt(area / math.pi)


def convective_peakedness(background: Column, a: float = 8.0, b: float = 64.0) -> Column:
    """How far a reflectivity must exceed its background to be convective: a cosine that falls from ``a`` to 0 at ``b``."""
    return F.when(background < 0, F.lit(a)).when(background < b, a * F.cos(math.pi * background / (2 * b))).otherwise(0.0)


def token_time(name: Column, start: int) -> Column:
    """Epoch seconds of a time written yyyyMMdd_HHmm at a fixed place of a file name; null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(name, start, 13), F.lit("yyyyMMdd_HHmm")))


def calendar_seconds(year: Column, month: Column, day: Column, hour: Column, calendar: str = "standard") -> Column:
    """Seconds since year 0 in a calendar of 365 days (``noleap``) or 360 days, or epoch seconds (``standard``)."""
    if calendar == "360_day":
        days = year * 360 + (month - 1) * 30 + day - 1
    elif calendar == "noleap":
        before = F.element_at(F.array(*[F.lit(d) for d in (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)]), month)
        days = year * 365 + before + day - 1
    else:
        return F.unix_date(F.make_date(year, month, day)).cast("long") * 86400 + hour * 3600
    return days.cast("long") * 86400 + hour * 3600


def masks_within(x: Column, y: Column, radii: list[float]) -> list[Column]:
    """A flag for each radius: the point lies within it of the origin."""
    r = F.sqrt(x * x + y * y)
    return [(r <= km).alias(f"within_{km:g}") for km in radii]


def radius_steps(least: float, increment: float, start: float, step: float, most: float) -> list[tuple[float, float]]:
    """(background dBZ from, radius km): the radius grows by ``step`` for each ``increment`` of background from ``least``, up to ``most``."""
    out = [(-math.inf, start)]
    while out[-1][1] + step <= most:
        out.append((least + increment * len(out), out[-1][1] + step))
    return out


def symmetric_positions(n: int) -> list[int]:
    """n whole steps around 0, one more below it than above where n is even."""
    return list(range(-(n // 2), n - n // 2))


def echo_type(dbz: Column, core: Column, low: float, weak: float) -> Column:
    """0 without a valid value, else 3 stratiform, 4 a convective core, 2 weak (between the two limits, a core too), 1 none at the surface (under ``low``)."""
    kind = F.when(dbz < low, 1).when((dbz > low) & (dbz < weak), 2).when(core, 4).otherwise(3)
    return F.when(dbz.isNotNull(), kind).otherwise(0)


def frame_name(prefix: str, seconds: Column, form: str = "yyyyMMdd_HHmmss") -> Column:
    """The name of a frame's file: prefix, date and time, .parquet."""
    return F.concat(F.lit(prefix), F.date_format(F.timestamp_seconds(seconds), form), F.lit(".parquet"))
