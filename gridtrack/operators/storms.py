"""Storm classes of columns of reflectivity: aggregates of a column, shares of its surroundings by scattered counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Classes of a column: fixed values.
UPDRAFT, CONVECTIVE, RAINY, DRY, ANVIL = 1, 2, 3, 4, 5


@dataclass(frozen=True)
class Limits:
    """Thresholds of the published classification, in dBZ, km and shares: fixed values that can be set otherwise."""

    stands_out: float = 0.3  # share of a column's levels up to 9 km that stand out from their surroundings
    aloft: float = 45.0  # dBZ over a kilometre above the melting level
    top25: float = 10.0  # km of the highest 25 dBZ
    lone: float = 0.15  # a class with no larger share of the 3 x 3 columns is alone
    beside: float = 25.0  # dBZ somewhere in a neighbour that joins
    rain_at_3km: float = 20.0
    rain_below: float = 10.0
    filled_from_4km: float = 20.0
    steep: float = 8.0  # dBZ from a level to the next
    steep_up_to: float = 7.0  # km
    full: float = 0.7  # share of the 3 x 3 columns with echo at that level
    updraft: float = 40.0


def _beside(rows: DataFrame, shape: tuple[int, int], keys: list[str], what: dict[str, Column], reach: int = 1) -> DataFrame:
    """(keys, y, x and the sums of ``what``) over the window of 2 ``reach`` + 1 around each column; columns outside are those of the edge.

    Rows are scattered to the columns that see them.  A row at the edge counts for a column as often as steps from there
    end on it.
    """
    ny, nx = shape
    steps = F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])

    def times(c: str, n: int) -> Column:
        at, own = F.col(f"to_{c}"), F.col(c)
        low, high = F.when(own == 0, F.greatest(reach - at, F.lit(0))).otherwise(0), F.when(own == n - 1, F.greatest(reach - (n - 1 - at), F.lit(0))).otherwise(0)
        return 1 + low + high

    seen = rows.withColumn("_s", F.explode(steps)).withColumns({"to_y": F.col("y") + F.col("_s.y"), "to_x": F.col("x") + F.col("_s.x")})
    seen = seen.where(F.col("to_y").between(0, ny - 1) & F.col("to_x").between(0, nx - 1)).withColumn("_n", times("y", ny) * times("x", nx))
    return seen.groupBy(*keys, F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(*[F.sum(F.col("_n") * c).alias(name) for name, c in what.items()])


def surroundings(volume: DataFrame, shape: tuple[int, int], reach: int) -> DataFrame:
    """(frame_id, z, y, x, middle): the median of a level's values in the window around each column, edges extended."""
    ny, nx = shape
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    asked = volume.select("frame_id", "z", "y", "x", F.explode(steps).alias("s"))
    clamp = lambda c, n: F.least(F.greatest(F.col(c) + F.col(f"s.d{c}"), F.lit(0)), F.lit(n - 1)).alias(f"at_{c}")
    asked = asked.select("frame_id", "z", "y", "x", clamp("y", ny), clamp("x", nx))
    given = volume.select("frame_id", "z", F.col("y").alias("at_y"), F.col("x").alias("at_x"), "v")
    # A window has (2 reach + 1) squared values at most, which bounds the median's buffer.
    return asked.join(given, ["frame_id", "z", "at_y", "at_x"]).groupBy("frame_id", "z", "y", "x").agg(F.median("v").alias("middle"))


def storm_classes(volume: DataFrame, shape: tuple[int, int], heights: list[float], melting: float, reach: int, limits: Limits = Limits()) -> DataFrame:
    """(frame_id, y, x, sl_class): 1 updraft, 2 convective, 3 stratiform with rain, 4 stratiform without, 5 anvil; columns of no class have no row.

    ``volume`` has (frame_id, z, y, x, v), z counts ``heights`` (km, rising) from 0; missing values have no row or are
    null.  Convective columns stand out from the median of their surroundings (:func:`surroundings`, ``reach``) at many of
    their levels, are strong above the ``melting`` level or reach high; lone ones go, and echo beside convection joins.
    Rain near the ground makes the rest stratiform with rain; echo from 3 km up without it stratiform without; echo with
    nothing at 3 to 5 km an anvil.  Updrafts are convective columns with a steep rise in the midst of full echo.
    ``reach`` columns at the edge have no class.
    """
    ny, nx = shape
    at = lambda km: max([k for k, h in enumerate(heights) if h <= km], default=0)
    k3, k4, k5, k9 = (at(km) for km in (3.0, 4.0, 5.0, 9.0))
    z, v, column = F.col("z"), F.col("v"), ["frame_id", "y", "x"]
    rows = volume.where("v IS NOT NULL").select("frame_id", z.cast("int").alias("z"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), v.cast("double").alias("v"))
    # Where the 3 km level has nothing, strong echo a kilometre higher stands for it.
    gap = rows.where(z.isin(k3, k4)).groupBy(*column).agg(F.max(F.when(z == k3, v)).alias("v3"), F.max(F.when(z == k4, v)).alias("v4"))
    gap = gap.where(F.col("v3").isNull() & (F.col("v4") >= limits.filled_from_4km)).select("frame_id", F.lit(k3).alias("z"), "y", "x", F.col("v4").alias("v"))
    rows = stored(rows.unionByName(gap) if k4 != k3 else rows, "volume")
    km = F.get(F.array(*[F.lit(float(h)) for h in heights]), z)

    low = rows.where(z <= k9)
    stands = low.join(surroundings(low, shape, reach), ["frame_id", "z", "y", "x"]).groupBy(*column).agg(F.count_if(v - F.col("middle") > F.greatest(10 - v * v / 337.5, F.lit(4.0))).alias("stands"), F.count("*").alias("levels"))
    up = rows.select("frame_id", (z - 1).alias("z"), "y", "x", F.col("v").alias("over"))
    full = _beside(rows, shape, ["frame_id", "z"], {"echo": F.lit(1)}).where(F.col("echo") >= 9 * limits.full)
    rises = rows.where(km <= limits.steep_up_to).join(up, ["frame_id", "z", "y", "x"]).where(F.col("over") - v >= limits.steep).join(full, ["frame_id", "z", "y", "x"], "left_semi").select(*column).distinct().withColumn("rises", F.lit(True))
    columns = rows.groupBy(*column).agg(
        F.max("v").alias("highest"), F.max(F.when(v >= 25, km)).alias("top"), F.max(F.when(km > melting + 1, v)).alias("aloft"),
        F.max(F.when(z == k3, v)).alias("v3"), F.max(F.when(z < k3, v)).alias("below"), F.max(F.when(z >= k3, v)).alias("upper"), F.count_if(z.between(k3, k5)).alias("middle"),
    )
    columns = columns.join(stands, column, "left").join(rises, column, "left")
    peaked = F.coalesce(F.col("stands") >= limits.stands_out * F.col("levels"), F.lit(False))
    strong = peaked | F.coalesce(F.col("aloft") >= limits.aloft, F.lit(False)) | F.coalesce(F.col("top") >= limits.top25, F.lit(False))
    now = stored(columns.withColumn("c", F.when(strong, CONVECTIVE).otherwise(0)), "columns")

    def beside_convection() -> DataFrame:
        return now.join(_beside(now.where(c == CONVECTIVE), shape, ["frame_id"], {"n": F.lit(1)}), column, "left")

    c = F.col("c")
    now = stored(beside_convection().withColumn("c", F.when((c == CONVECTIVE) & (F.col("n") / 9.0 <= limits.lone), 0).otherwise(c)).drop("n"), "columns")
    now = beside_convection().withColumn("c", F.when((F.col("n") > 0) & (F.col("highest") >= limits.beside), CONVECTIVE).otherwise(c)).drop("n")
    wet = F.coalesce(F.col("v3") >= limits.rain_at_3km, F.lit(False))
    echo = F.coalesce(F.col("upper") >= 0, F.lit(False))
    rain = wet | F.coalesce(F.col("below") >= limits.rain_below, F.lit(False))
    now = now.withColumn("c", F.when((c == 0) & rain, RAINY).when((c == 0) & echo & (F.col("middle") == 0), ANVIL).when((c == 0) & echo & ~wet, DRY).otherwise(c))
    now = stored(now.withColumn("c", F.when((c == CONVECTIVE) & F.coalesce("rises", F.lit(False)) & (F.col("highest") >= limits.updraft), UPDRAFT).otherwise(c)), "columns")

    # A lone updraft takes the middle one of the nine classes around; columns without echo are of class 0.
    counts = {f"n{k}": (c == k).cast("int") for k in range(1, 6)}
    around = _beside(now.where(c > 0), shape, ["frame_id"], counts)
    out = now.join(around, column, "left")
    n = [F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(1, 6)]
    none = 9 - sum(n[1:], n[0])
    middle, upto = F.when(none >= 5, 0), none
    for k in range(1, 6):
        upto = upto + n[k - 1]
        middle = middle.when(upto >= 5, k)
    out = out.withColumn("c", F.when((c == UPDRAFT) & (n[0] / 9.0 <= limits.lone), middle).otherwise(c))
    inside = F.col("y").between(reach, ny - 1 - reach) & F.col("x").between(reach, nx - 1 - reach)
    return out.where(inside & (c > 0)).select(*column, c.cast("long").alias("sl_class"))
