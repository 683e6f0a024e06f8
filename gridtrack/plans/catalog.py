"""Queries over the driver's tables, one for each group of operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import climatology as C
from ..operators import columns as V
from ..operators import identify as I
from ..operators import link as L
from ..operators import number as N
from ..operators import regrid as R
from ..operators import tracks as T
from ..operators.scratch import stored
from ..sources import tables as tb
from ..sources import rasters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THR = 60


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def month_of() -> Column:
    return (F.pmod(F.col("frame_id") - 1, F.lit(12)) + 1).cast("int")


MONTH = "CAST((frame_id - 1) % 12 + 1 AS INTEGER)"

# ---- tables shared by the queries -------------------------------------------------------------

LABELS_SQL = f"WITH {src.SHIP_SQL}, labels AS (SELECT frame_id, y, x, v, CAST(1 + (y // 8) * 3 + x // 8 AS BIGINT) AS feature FROM ship WHERE v > {THR})"


def block_labels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels over the threshold, labelled by the block of 8 x 8 pixels in which they lie."""
    p = src.ship(spark, d).where(F.col("v") > THR)
    return p.select("frame_id", "y", "x", "v", (1 + F.floor(F.col("y") / 8) * 3 + F.floor(F.col("x") / 8)).cast("long").alias("feature"))


TRACKS_SQL = """WITH seen AS (SELECT user_id AS track, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS frame_id, count(*) AS npix, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS area,
  avg(minute(ts)) / 60 * 40 - 20 AS lat, avg(hour(ts) * 60 + minute(ts)) / 4 AS lon FROM events GROUP BY ALL),
tr AS (SELECT *, frame_id * 21600 AS base_time, CAST(row_number() OVER (PARTITION BY track ORDER BY frame_id) - 1 AS BIGINT) AS t_idx, CAST(area % 3 AS INTEGER) AS status,
  CAST(1 AS BIGINT) AS feature, CASE WHEN track % 5 = 1 THEN track - 1 END AS merge_track, CASE WHEN track % 5 = 2 THEN track - 2 END AS split_track FROM seen)"""


def user_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Each user as a track over six-hourly frames."""
    e = src.table(spark, d, "events")
    t = e.groupBy(F.col("user_id").alias("track"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600).alias("frame_id")).agg(
        F.count("*").alias("npix"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("area"),
        (F.avg(F.minute("ts")) / 60 * 40 - 20).alias("lat"),
        (F.avg(F.hour("ts") * 60 + F.minute("ts")) / 4).alias("lon"),
    )
    t = T.time_index(t.withColumn("base_time", F.col("frame_id") * 21600))
    return t.select("*", (F.col("area") % 3).cast("int").alias("status"), F.lit(1).cast("long").alias("feature"), F.when(F.col("track") % 5 == 1, F.col("track") - 1).alias("merge_track"), F.when(F.col("track") % 5 == 2, F.col("track") - 2).alias("split_track"))


# ---- sources, filters, scalars ------------------------------------------------------------------


@query("SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS ym, count(*) AS n, CAST(min(epoch(l_shipdate)) AS BIGINT) AS t0, CAST(max(epoch(l_shipdate)) AS BIGINT) AS t1 FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30' GROUP BY ALL")
def scan_time_range(spark, d):
    t = F.col("l_shipdate")
    rows = src.table(spark, d, "lineitem").where(t.between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz")))
    s = F.unix_seconds(t.cast("timestamp"))
    return rows.groupBy((F.year(t) * 100 + F.month(t)).cast("long").alias("ym")).agg(F.count("*").alias("n"), F.min(s).alias("t0"), F.max(s).alias("t1"))


@query(f"""WITH {src.SHIP_SQL}, grid AS (SELECT DISTINCT y, x, 10 + y * 0.5 + x * 0.01 AS lat, 100 + x * 0.5 - y * 0.02 AS lon FROM ship), box AS (SELECT min(y) y0, max(y) y1,
  min(x) x0, max(x) x1 FROM grid WHERE lat BETWEEN 12 AND 18 AND lon BETWEEN 102 AND 107) SELECT frame_id, y - y0 AS y, x - x0 AS x, v FROM ship, box WHERE y BETWEEN y0 AND
  y1 AND x BETWEEN x0 AND x1""")
def geo_subset(spark, d):
    p = src.ship(spark, d)
    grid = p.select("y", "x").distinct().select("y", "x", (10 + F.col("y") * 0.5 + F.col("x") * 0.01).alias("lat"), (100 + F.col("x") * 0.5 - F.col("y") * 0.02).alias("lon"))
    return R.geo_box(p, grid, (12, 18), (102, 107))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE abs(minute(ts) - 30) < 5")
def hourly_sample(spark, d):
    return src.table(spark, d, "events").where(F.abs(F.minute("ts") - 30) < 5).select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))


@query(f"WITH {src.SHIP_SQL} SELECT frame_id, y, x, round((-1.228 + sqrt(1.228 * 1.228 + 4 * -1.106e-3 * tf)) / (2 * -1.106e-3), 6) AS tb FROM (SELECT *, pow((80 + v) / 5.67e-8, 0.25) AS tf FROM ship)")
def olr_to_tb(spark, d):
    return src.ship(spark, d).select("frame_id", "y", "x", F.round(S.brightness_temperature(80 + F.col("v")), 6).alias("tb"))


@query(f"""WITH {src.EVT_SQL}, acc AS (SELECT frame_id, y, x, frame_id * 21600 AS t, sum(v) OVER (PARTITION BY y, x ORDER BY frame_id) AS total FROM evt) SELECT frame_id, y, x,
  round(3600 * CAST(lead(total) OVER o - total AS DOUBLE) / (lead(t) OVER o - t), 6) AS rate FROM acc WINDOW o AS (PARTITION BY y, x ORDER BY frame_id)""")
def accum_to_rate(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("y", "x").orderBy("frame_id")
    acc = src.evt(spark, d).withColumns({"total": F.sum("v").over(o), "t": F.col("frame_id") * 21600})
    return acc.select("frame_id", "y", "x", F.round(S.rate_per_hour(F.col("total"), F.col("t"), o), 6).alias("rate"))


@query(f"WITH {src.SHIP_SQL} SELECT frame_id, CAST(CASE WHEN v < 20 THEN 1 WHEN v < 40 THEN 2 WHEN v < 60 THEN 3 WHEN v < 80 THEN 4 ELSE 5 END AS INTEGER) AS class, count(*) AS n FROM ship GROUP BY ALL")
def pixel_class(spark, d):
    return src.ship(spark, d).groupBy("frame_id", S.pixel_class(F.col("v"), 20, 40, 60, 80).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {src.SHIP_SQL} SELECT frame_id, count(*) AS n_valid, round(1 - count(*) / 576.0, 6) AS missing FROM ship WHERE v BETWEEN 5 AND 150 GROUP BY frame_id HAVING 1 - count(*) / 576.0 < 0.35")
def missing_gate(spark, d):
    ok = src.ship(spark, d).withColumn("v", S.valid(F.col("v").cast("double"), 5, 150))
    g = ok.groupBy("frame_id").agg(F.count("v").alias("n_valid")).withColumn("missing", 1 - F.col("n_valid") / 576)
    return rounded(g.where("missing < 0.35"))


@query(f"""WITH {src.SHIP_SQL}, p AS (SELECT DISTINCT y * 8 - 90 AS lat1, x * 15 - 180 AS lon1, (23 - y) * 7 - 80 AS lat2, x * 13 - 150 AS lon2 FROM ship) SELECT lat1, lon1, lat2,
  lon2, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))),
  6) AS km, round(6371.0 * 6371.0 * cos(radians(lat1)) * radians(1) * radians(0.5), 6) AS cell_km2, CASE WHEN lon2 <> lon1 OR lat2 <> lat1 THEN round(CASE WHEN 90 -
  degrees(atan2(lat2 - lat1, lon2 - lon1)) < 0 THEN 450 - degrees(atan2(lat2 - lat1, lon2 - lon1)) ELSE 90 - degrees(atan2(lat2 - lat1, lon2 - lon1)) END, 6) END AS bearing
  FROM p""")
def haversine_distance(spark, d):
    p = src.ship(spark, d).select((F.col("y") * 8 - 90).alias("lat1"), (F.col("x") * 15 - 180).alias("lon1"), ((23 - F.col("y")) * 7 - 80).alias("lat2"), (F.col("x") * 13 - 150).alias("lon2")).distinct()
    a, b, c, e = (F.col(k) for k in ("lat1", "lon1", "lat2", "lon2"))
    return rounded(p.select("*", S.haversine(a, b, c, e).alias("km"), S.cell_area(a, 1, 0.5).alias("cell_km2"), S.bearing_of(e - b, c - a).alias("bearing")))


# ---- neighbourhoods and identification ----------------------------------------------------------


@query(f"""WITH {src.SHIP_SQL}, o AS (SELECT least(23, greatest(0, a.y + dy)) AS ny, least(23, greatest(0, a.x + dx)) AS nx, a.frame_id, a.y, a.x FROM ship a, generate_series(-1, 1)
  AS g(dy), generate_series(-1, 1) AS h(dx)) SELECT o.frame_id, o.y, o.x, round(avg(b.v), 6) AS s FROM o JOIN ship b ON b.frame_id = o.frame_id AND b.y = o.ny AND b.x =
  o.nx GROUP BY ALL""")
def box_smooth(spark, d):
    return rounded(I.smoothed(src.ship(spark, d), (24, 24), 3))


@query(f"WITH {src.SHIP_SQL} SELECT frame_id, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, round(avg(v), 6) AS v, count(*) AS n FROM ship GROUP BY ALL")
def coarsen_block(spark, d):
    return rounded(R.coarsened(src.ship(spark, d), 4))


RECURSIVE = f"""WITH RECURSIVE {src.EMB_SQL}, on_ AS (SELECT frame_id, y, x, v FROM emb WHERE v > 0),
walk AS (SELECT frame_id, y, x, y * 8 + x AS root FROM on_ UNION SELECT b.frame_id, b.y, b.x, w.root FROM walk w JOIN on_ b ON b.frame_id = w.frame_id AND abs(b.y - w.y) + abs(b.x - w.x) = 1 AND w.root < b.y * 8 + b.x),
roots AS (SELECT frame_id, y, x, min(root) AS root FROM walk GROUP BY ALL),
labels AS (SELECT frame_id, y, x, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY root) AS BIGINT) AS feature FROM roots)"""


@query(RECURSIVE + " SELECT * FROM labels")
def label_components(spark, d):
    return I.threshold_labels(src.emb(spark, d), (8, 8), 0.0)


@query(RECURSIVE + """, size AS (SELECT frame_id, feature AS old, count(*) AS npix, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, feature DESC) AS BIGINT) AS feature
  FROM labels GROUP BY frame_id, old HAVING count(*) > 2) SELECT l.frame_id, y, x, s.feature, npix FROM labels l JOIN size s ON l.frame_id = s.frame_id AND l.feature =
  s.old""")
def size_renumber(spark, d):
    return I.renumbered(I.threshold_labels(src.emb(spark, d), (8, 8), 0.0), 2)


@query(LABELS_SQL + """  SELECT frame_id, feature, count(*) AS npix, CAST(count(*) * 100 AS DOUBLE) AS area, round(avg(y), 6) AS mean_y, round(avg(x), 6) AS mean_x, round(avg(v), 6) AS mean_v,
  min(v) AS min_v, max(v) AS max_v, CAST(count(*) FILTER (v > 90) AS BIGINT) AS core_px, round(avg(v) FILTER (v > 90), 6) AS core_mean, arg_min(y, (-v) * 10000 + y * 100 +
  x) AS top_y, arg_min(x, (-v) * 10000 + y * 100 + x) AS top_x FROM labels GROUP BY ALL""")
def feature_stats(spark, d):
    return rounded(T.feature_stats(block_labels(spark, d), core=90, cell_km2=100.0))


@query(LABELS_SQL + ", m AS (SELECT frame_id, feature, atan2(avg(sin(x / 24.0 * 2 * pi())), avg(cos(x / 24.0 * 2 * pi()))) AS a FROM labels GROUP BY ALL) SELECT frame_id, feature, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END / (2 * pi()) * 24, 6) AS x_mean FROM m")
def circular_mean(spark, d):
    return rounded(T.circular_mean(block_labels(spark, d), ["frame_id", "feature"], "x", 0.0, 24.0))


@query(LABELS_SQL + """, n AS (SELECT l.frame_id, l.y, l.x, l.feature, count(*) AS same FROM labels l JOIN labels o ON o.frame_id = l.frame_id AND o.feature = l.feature AND abs(o.y - l.y) +
  abs(o.x - l.x) = 1 GROUP BY ALL) SELECT l.frame_id, l.y, l.x, l.feature FROM labels l LEFT JOIN n ON n.frame_id = l.frame_id AND n.y = l.y AND n.x = l.x WHERE
  coalesce(same, 0) < 4""")
def mask_perimeter(spark, d):
    return I.outline(block_labels(spark, d), (24, 24), 1)


@query(f"""WITH {src.SHIP_SQL}, z AS (SELECT frame_id, y, x, v, pow(10, v / 20.0) AS lin FROM ship WHERE v >= 10), b AS (SELECT a.frame_id, a.y, a.x, a.v, 10 * log10(avg(c.lin)) AS
  bkg FROM z a JOIN z c ON c.frame_id = a.frame_id AND (c.y - a.y) * (c.y - a.y) + (c.x - a.x) * (c.x - a.x) <= 9 GROUP BY ALL) SELECT frame_id, y, x, round(bkg, 6) AS bkg,
  (v / 2.0 >= 45 OR v / 2.0 - bkg >= CASE WHEN bkg < 0 THEN 8 WHEN bkg < 64 THEN 8 * cos(pi() * bkg / 128) ELSE 0 END) AS core FROM b""")
def steiner_core(spark, d):
    from ..functions import kernels as K

    def kernel(a):
        ok = ~np.isnan(a) & (a >= 10)
        return K.background(np.nan_to_num(a) / 2, ok, 3)

    p = src.ship(spark, d)
    bkg = I.by_frame(p, (24, 24), kernel, out="frame_id long, y int, x int, bkg double")
    both = p.select("frame_id", "y", "x", (F.col("v") / 2).alias("dbz")).join(bkg, ["frame_id", "y", "x"])
    return both.select("frame_id", "y", "x", F.round("bkg", 6).alias("bkg"), ((F.col("dbz") >= 45) | (F.col("dbz") - F.col("bkg") >= S.convective_peakedness(F.col("bkg")))).alias("core"))


@query()
def watershed(spark, d):
    return I.watershed_labels(src.ship(spark, d), (24, 24), 40, 80, 2)


@query()
def label_grow(spark, d):
    return I.label_and_grow(src.ship(spark, d), (24, 24), 25, 45, 2, 2)


@query()
def convective_cells(spark, d):
    return I.convective_cells(src.ship(spark, d).withColumn("v", F.col("v") / 2), (24, 24), 3, 45, 5, 2, (1, 2))


#: Two rain features a frame, taken one after the other.
@query(LABELS_SQL + """, rain AS (SELECT frame_id, y, x, CAST(1 + y // 12 AS BIGINT) AS pf FROM ship WHERE v2 > 3),
size AS (SELECT frame_id, feature, count(*) AS n FROM labels GROUP BY ALL), touch AS (SELECT DISTINCT frame_id, pf, feature FROM labels JOIN rain USING (frame_id, y, x)),
bare AS (SELECT frame_id, y, x, pf FROM rain ANTI JOIN labels USING (frame_id, y, x)), spare AS (SELECT frame_id, pf, count(*) AS n FROM bare GROUP BY ALL),
top1 AS (SELECT frame_id, arg_max(feature, n * 1000 - feature) AS top FROM touch JOIN size USING (frame_id, feature) WHERE pf = 1 GROUP BY frame_id),
now1 AS (SELECT s.frame_id, s.feature, n, t.feature IS NOT NULL AS fixed, CASE WHEN t.feature IS NOT NULL THEN top ELSE s.feature END AS cur
  FROM size s LEFT JOIN (SELECT * FROM touch WHERE pf = 1) t USING (frame_id, feature) LEFT JOIN top1 ON top1.frame_id = s.frame_id),
size1 AS (SELECT c.frame_id, cur, sum(c.n) + max(CASE WHEN cur = top THEN coalesce(p.n, 0) ELSE 0 END) AS n FROM now1 c LEFT JOIN top1 ON top1.frame_id = c.frame_id
  LEFT JOIN spare p ON p.frame_id = c.frame_id AND p.pf = 1 GROUP BY ALL),
top2 AS (SELECT t.frame_id, arg_max(cur, z.n * 1000 - cur) AS top FROM touch t JOIN now1 USING (frame_id, feature) JOIN size1 z USING (frame_id, cur) WHERE pf = 2 GROUP BY t.frame_id),
now2 AS (SELECT c.frame_id, c.feature, CASE WHEN t.feature IS NOT NULL AND NOT fixed THEN top ELSE cur END AS into_
  FROM now1 c LEFT JOIN (SELECT * FROM touch WHERE pf = 2) t USING (frame_id, feature) LEFT JOIN top2 ON top2.frame_id = c.frame_id)
SELECT l.frame_id, y, x, into_ AS feature FROM labels l JOIN now2 n ON n.frame_id = l.frame_id AND n.feature = l.feature
UNION ALL SELECT frame_id, y, x, top AS feature FROM bare JOIN (SELECT *, 1 AS pf FROM top1 UNION ALL SELECT *, 2 FROM top2) USING (frame_id, pf)""")
def rain_absorbed(spark, d):
    rain = src.ship(spark, d).where("v2 > 3").select("frame_id", "y", "x", (1 + F.floor(F.col("y") / 12)).cast("long").alias("pf"))
    return I.absorbed(block_labels(spark, d).drop("v"), rain)


# ---- links and numbers -------------------------------------------------------------------------

LINK_SQL = LABELS_SQL + """, size AS (SELECT frame_id, feature, count(*) AS n FROM labels GROUP BY ALL),
s AS (SELECT a.frame_id, b.frame_id AS next_id, a.feature AS ref, b.feature AS new, count(*) AS overlap_px FROM labels a JOIN labels b ON b.frame_id = a.frame_id + 1 AND b.y = a.y + {dy} AND b.x = a.x + {dx} GROUP BY ALL)
SELECT s.*, '{way}' AS direction, round(overlap_px / n, 6) AS frac FROM s JOIN size ON size.frame_id = s.{frame} AND size.feature = s.{side} WHERE overlap_px / n > {least}"""


def _monthly_pairs(spark, d):
    frames = src.ship(spark, d).select("frame_id").distinct().withColumn("base_time", F.col("frame_id") * 3600)
    return frames, L.frame_pairs(frames, 1.5)


def _links(spark, d, way, least, drift=None):
    return rounded(L.overlaps(block_labels(spark, d), _monthly_pairs(spark, d)[1], least, drift).where(F.col("direction") == way))


@query(LINK_SQL.format(dy=0, dx=0, way="forward", frame="frame_id", side="ref", least=0.3))
def overlap_forward(spark, d):
    return _links(spark, d, "forward", 0.3)


@query(LINK_SQL.format(dy=0, dx=0, way="backward", frame="next_id", side="new", least=0.3))
def overlap_backward(spark, d):
    return _links(spark, d, "backward", 0.3)


@query(LINK_SQL.format(dy=2, dx=-1, way="forward", frame="frame_id", side="ref", least=0.2))
def overlap_drift(spark, d):
    drift = _monthly_pairs(spark, d)[0].select("frame_id", F.lit(2).alias("y"), F.lit(-1).alias("x"))
    return _links(spark, d, "forward", 0.2, drift)


@query("""WITH f AS (SELECT DISTINCT CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS base_time FROM events),
g AS (SELECT base_time, CAST(sum(CASE WHEN base_time - l >= 360 THEN 1 ELSE 0 END) OVER (ORDER BY base_time) AS BIGINT) AS segment FROM (SELECT base_time, lag(base_time) OVER (ORDER BY base_time) AS l FROM f))
SELECT base_time, segment, base_time = min(base_time) OVER (PARTITION BY segment) AS is_first, base_time = max(base_time) OVER (PARTITION BY segment) AS is_last FROM g""")
def gap_segments(spark, d):
    f = src.table(spark, d, "events").select((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) * 60).alias("base_time")).distinct()
    return L.segments(f, 0.1)


@query()
def track_numbers(spark, d):
    """Objects of monthly frames, linked and numbered."""
    pixels = src.ship(spark, d)
    labels = stored(I.renumbered(I.threshold_labels(pixels, (24, 24), 75.0), 1))
    features = labels.groupBy("frame_id", "feature").agg(F.max("npix").alias("npix"))
    frames, pairs = _monthly_pairs(spark, d)
    return N.track_numbers(frames, features, L.overlaps(labels, pairs, 0.2), 1.5)


# ---- tracks -----------------------------------------------------------------------------------


@query(TRACKS_SQL + " SELECT track, frame_id, t_idx FROM tr")
def track_time_index(spark, d):
    return user_tracks(spark, d).select("track", "frame_id", "t_idx")


@query(TRACKS_SQL + """  SELECT track, count(*) AS duration, min(base_time) AS start_basetime, CASE WHEN count(*) < 60 THEN max(base_time) ELSE -1 END AS end_basetime, arg_min(status, t_idx) AS
  start_status, CASE WHEN count(*) < 60 THEN arg_max(status, t_idx) ELSE -1 END AS end_status FROM tr GROUP BY track""")
def track_start_end(spark, d):
    return T.start_end(user_tracks(spark, d), 60).fillna(-1)


SHORT_SQL = TRACKS_SQL + ", keep AS (SELECT track AS old_track, CAST(row_number() OVER (ORDER BY track) AS BIGINT) AS track FROM tr GROUP BY tr.track HAVING count(*) >= 50)"


@query(SHORT_SQL + " SELECT k.track, k.old_track, t.frame_id, t.t_idx FROM tr t JOIN keep k ON t.track = k.old_track")
def short_track_filter(spark, d):
    return T.without_short(user_tracks(spark, d), 50).select("track", "old_track", "frame_id", "t_idx")


@query(SHORT_SQL + " SELECT k.track, t.t_idx, coalesce(m.track, -1) AS merge_track, coalesce(s.track, -1) AS split_track FROM tr t JOIN keep k ON t.track = k.old_track LEFT JOIN keep m ON t.merge_track = m.old_track LEFT JOIN keep s ON t.split_track = s.old_track")
def mergesplit_renumber(spark, d):
    return T.renumbered_targets(T.without_short(user_tracks(spark, d), 50), ["merge_track", "split_track"]).select("track", "t_idx", "merge_track", "split_track").fillna(-1)


MAIN_SQL = TRACKS_SQL + ", main AS (SELECT track, count(*) AS lifetime, max(area) AS max_area FROM tr GROUP BY track HAVING count(*) >= 50 AND max(area) >= 20000)"


@query(MAIN_SQL + " SELECT * FROM main")
def main_tracks(spark, d):
    return T.main_tracks(user_tracks(spark, d), 50, "area", 20000)


@query(MAIN_SQL + """, small AS (SELECT track, max(merge_track) AS i, min(split_track) AS o FROM tr WHERE track NOT IN (SELECT track FROM main) GROUP BY track HAVING count(*) < 55), e AS
  (SELECT track AS small_track, i AS main, 'merge' AS kind FROM small WHERE i IS NOT NULL UNION ALL SELECT track, o, 'split' FROM small WHERE o IS NOT NULL) SELECT
  main.track, t.base_time, kind, CAST(row_number() OVER (PARTITION BY main.track, t.base_time, kind ORDER BY small_track, t.feature) AS BIGINT) AS rank, small_track,
  t.feature, t.area FROM e JOIN main ON e.main = main.track JOIN tr t ON t.track = small_track JOIN tr m ON m.track = main.track AND m.base_time = t.base_time QUALIFY rank
  <= 2""")
def merge_split_attach(spark, d):
    rows = user_tracks(spark, d)
    return T.attached(rows, T.main_tracks(rows, 50, "area", 20000), 55, 2)


ISLANDS_SQL = TRACKS_SQL + """, on_ AS (SELECT track, t_idx, sum(CASE WHEN t_idx - l > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t_idx) AS run FROM (SELECT track, t_idx, lag(t_idx)
  OVER (PARTITION BY track ORDER BY t_idx) AS l FROM tr WHERE {test})), runs AS (SELECT track, run, min(t_idx) AS first_idx, max(t_idx) AS last_idx, max(t_idx) - min(t_idx)
  + 1 AS length, count(*) AS n FROM on_ GROUP BY ALL)"""


@query(ISLANDS_SQL.format(gap=2, test="area > 5000") + " SELECT track, CAST(max(length * 6) AS DOUBLE) AS main_hours, count(*) AS n_runs FROM runs WHERE length * 6.0 >= 24 GROUP BY track")
def ccs_islands(spark, d):
    return T.long_systems(user_tracks(spark, d), "area", 5000, 2, 24, 6.0)


@query(TRACKS_SQL + """, o AS (SELECT CAST(floor(epoch(ts) / 1200) AS BIGINT) * 1200 + 60 AS base_time_right, count(*) AS n_events FROM events GROUP BY ALL)
SELECT track, base_time, n_events, base_time_right FROM tr JOIN o ON abs(base_time - base_time_right) < 1800""")
def pf_match_interval(spark, d):
    """Each time of a track with the frames, one every twenty minutes, that are less than half an hour away."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    frames = src.table(spark, d, "events").groupBy((F.floor(seconds / 1200) * 1200 + 60).alias("base_time")).agg(F.count("*").alias("n_events"))
    return T.near_in_time(user_tracks(spark, d).select("track", "base_time"), frames, "base_time", 1800).select("track", "base_time", "n_events", "base_time_right")


PF_SQL = LABELS_SQL + ", pf AS (SELECT frame_id, feature, CAST(y % 8 // 4 * 2 + x % 8 // 4 AS BIGINT) AS pf, y, x, CAST(v AS DOUBLE) AS v FROM labels)"


def _pf(spark, d):
    return block_labels(spark, d).withColumn("pf", (F.floor(F.col("y") % 8 / 4) * 2 + F.floor(F.col("x") % 8 / 4)).cast("long"))


@query(PF_SQL + """, m AS (SELECT frame_id, feature, pf, count(*) AS pf_npix, avg(v) AS mu, max(v) AS mx, sum(v) AS s, sum(CASE WHEN v > 100 THEN v ELSE 0 END) AS h, quantile_cont(v, 0.95)
  AS p FROM pf GROUP BY ALL), k AS (SELECT pf.frame_id, pf.feature, pf.pf, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 2)) AS m2 FROM pf JOIN m USING (frame_id, feature, pf)
  GROUP BY ALL) SELECT frame_id, feature, pf, pf_npix, round(mu, 6) AS pf_rainrate, mx AS pf_maxrate, CASE WHEN m2 > 0 THEN round(m3 / pow(m2, 1.5), 6) END AS pf_skewness,
  s AS pf_accum, h AS pf_heavy, round(p, 6) AS pf_p95, CAST(row_number() OVER (PARTITION BY frame_id, feature ORDER BY pf_npix DESC, pf) AS BIGINT) AS pf_rank FROM m JOIN k
  USING (frame_id, feature, pf) QUALIFY pf_rank <= 3""")
def pf_topk_stats(spark, d):
    return rounded(T.rain_stats(_pf(spark, d), 100, 3))


@query(PF_SQL + """, m AS (SELECT frame_id, feature, count(*) AS npix, var_pop(x) + 1 / 12 AS a, var_pop(y) + 1 / 12 AS c, covar_pop(x, y) AS b, sum(v * y) / sum(v) AS wy, sum(v * x) /
  sum(v) AS wx FROM pf GROUP BY ALL), r AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS p, greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0) AS
  q FROM m) SELECT frame_id, feature, npix, round(4 * sqrt(p), 6) AS majoraxis, round(4 * sqrt(q), 6) AS minoraxis, round(sqrt(1 - q / p), 4) AS eccentricity, round(wy, 6)
  AS weighted_y, round(wx, 6) AS weighted_x FROM r""")
def pf_shape(spark, d):
    return rounded(T.shapes(_pf(spark, d), ["frame_id", "feature"]).drop("orientation").withColumn("eccentricity", F.round("eccentricity", 4)))


ROBUST_SQL = TRACKS_SQL + """, own AS (SELECT *, area % 100 AS heavy FROM tr WHERE npix BETWEEN 1 AND 3),
on_ AS (SELECT *, sum(CASE WHEN t_idx - l > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t_idx) AS run, count(*) OVER (PARTITION BY track) AS times
  FROM (SELECT *, lag(t_idx) OVER (PARTITION BY track ORDER BY t_idx) AS l FROM own)),
h AS (SELECT *, CAST((max(t_idx) OVER r - min(t_idx) OVER r + 1) * 6 AS DOUBLE) AS h FROM on_ WHERE times * 6 > 30 WINDOW r AS (PARTITION BY track, run)),
g AS (SELECT track, run, h, 6 * sum(CASE WHEN area > 1000 + 2 * h AND lat > -8 + 0.01 * h AND lon > 20 + 0.02 * h THEN 1 ELSE 0 END) AS o, 100 * sum(heavy) / nullif(sum(area), 0) AS q
  FROM h WHERE h >= 30 GROUP BY ALL)
SELECT track, max(h) AS pf_hours, count(*) AS n_runs FROM g WHERE o >= 30 AND q > 0.3 + 0.0005 * h GROUP BY track"""


@query(ROBUST_SQL)
def robust_filter(spark, d):
    rows = user_tracks(spark, d).select("track", "t_idx", F.col("npix").alias("pf_axis"), F.col("area").alias("pf_area"), F.col("lat").alias("pf_rate"), F.col("lon").alias("pf_skew"), (F.col("area") % 100).alias("pf_heavy"), F.col("area").alias("pf_total"))
    return T.robust(rows, (1, 3), 2, 30, (1000, 2), (-8, 0.01), (20, 0.02), (0.3, 0.0005), 6.0)


@query(TRACKS_SQL + " SELECT track, CAST(sum(CASE WHEN area > 10000 THEN 1 ELSE 0 END) * 6 AS DOUBLE) AS pf_lifetime FROM tr GROUP BY track")
def pf_lifetime(spark, d):
    return T.lifetime_over(user_tracks(spark, d), "area", 10000, 6.0)


STAGE = "CASE WHEN area < 2000 THEN 0 WHEN area < 5000 THEN 1 WHEN area < 8000 THEN 2 WHEN area < 12000 THEN 3 WHEN area < 18000 THEN 4 ELSE 5 END"


@query(ISLANDS_SQL.format(gap=2, test=f"{STAGE} BETWEEN 1 AND 5") + f""", best AS (SELECT track, arg_max(first_idx, length * 1000 - run) AS a, arg_max(last_idx, length * 1000 - run) AS b FROM runs GROUP BY track), s AS (SELECT tr.track,
  t_idx, {STAGE} AS stage FROM tr JOIN best ON tr.track = best.track AND t_idx BETWEEN a AND b) SELECT track, count(DISTINCT stage) AS stages,
  {', '.join(f'coalesce(min(t_idx) FILTER (stage = {k}), -1) AS idx{k}' for k in range(1, 6))}, count(DISTINCT stage) >= 4 AS complete FROM s WHERE stage > 0 GROUP BY track""")
def lifecycle(spark, d):
    return T.lifecycle(user_tracks(spark, d), F.expr(STAGE)).fillna(-1)


@query(LABELS_SQL + """, n AS (SELECT DISTINCT frame_id, feature, frame_id % 7 * 10 + feature AS track, CASE WHEN feature % 4 = 0 THEN feature + 100 END AS m, CASE WHEN feature % 3 = 0 THEN
  feature + 200 END AS s FROM labels) SELECT l.frame_id, y, x, track AS tracknumber, coalesce(m, s, track) AS incl_attached FROM labels l JOIN n USING (frame_id, feature)""")
def mask_paint(spark, d):
    labels = block_labels(spark, d)
    f = F.col("feature")
    nodes = labels.select("frame_id", "feature").distinct().select("frame_id", "feature", (F.col("frame_id") % 7 * 10 + f).alias("track"), F.when(f % 4 == 0, f + 100).alias("merge_track"), F.when(f % 3 == 0, f + 200).alias("split_track"))
    return T.painted(labels, nodes)


@query(TRACKS_SQL + """, s AS (SELECT track, t_idx, lon, lon - lag(lon) OVER (PARTITION BY track ORDER BY t_idx) AS step FROM tr), w AS (SELECT *, CAST(sum(CASE WHEN step > 180 THEN -1 WHEN
  step < -180 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t_idx) AS BIGINT) AS wraps FROM s) SELECT track, t_idx, wraps, round(lon + wraps * 360, 6) AS lon_path
  FROM w""")
def path_unwrap(spark, d):
    return rounded(T.unwrapped(user_tracks(spark, d), "lon", 360.0, 180.0).select("track", "t_idx", "wraps", "lon_path"))


@query(TRACKS_SQL + """, p AS (SELECT track, t_idx, lat, lon, base_time, lead(lat) OVER o AS la, lead(lon) OVER o AS lo, lead(base_time) OVER o AS t FROM tr WINDOW o AS (PARTITION BY track
  ORDER BY t_idx)), k AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon)
  / 2), 2)))) AS km FROM p) SELECT track, t_idx, round(km, 5) AS distance, round(km / ((t - base_time) / 3600), 5) AS speed FROM k""")
def haversine_speed(spark, d):
    return rounded(T.speeds(user_tracks(spark, d)).select("track", "t_idx", "distance", "speed"), 5)


@query(TRACKS_SQL + """, h AS (SELECT track, t_idx, base_time, CASE WHEN area % 3 > 0 THEN lat END AS v FROM tr), f AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN v
  IS NOT NULL THEN base_time END IGNORE NULLS) OVER a AS t0, first_value(v IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN v IS NOT NULL THEN base_time END IGNORE NULLS)
  OVER b AS t1 FROM h WINDOW a AS (PARTITION BY track ORDER BY t_idx), b AS (PARTITION BY track ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT
  track, t_idx, round(coalesce(v, v0 + (v1 - v0) * (base_time - t0) / (t1 - t0)), 6) + 0.0 AS v_filled FROM f""")
def gap_interpolation(spark, d):
    rows = user_tracks(spark, d).withColumn("v", F.when(F.col("area") % 3 > 0, F.col("lat")))
    return rounded(T.interpolated(rows, "v").select("track", "t_idx", "v_filled")).withColumn("v_filled", F.col("v_filled") + 0.0)


# ---- climatology -------------------------------------------------------------------------------


@query(f"""WITH {src.SHIP_SQL} SELECT {MONTH} AS month, y, x, CAST(sum(v) AS BIGINT) AS precipitation, CAST(sum(CASE WHEN v2 > 2 THEN v ELSE 0 END) AS BIGINT) AS
  masked_precipitation, CAST(sum(CASE WHEN v2 > 2 AND v > {THR} THEN 1 ELSE 0 END) AS BIGINT) AS masked_count, count(DISTINCT frame_id) AS ntimes FROM ship GROUP BY ALL""")
def monthly_rainmap(spark, d):
    return C.monthly_map(src.ship(spark, d), month_of(), F.col("v2") > 2, THR)


@query(TRACKS_SQL + """, p AS (SELECT track, CAST(floor(lat / 5) AS BIGINT) AS y, CAST(floor(lon / 30) AS BIGINT) AS x, area / 6.0 AS speed FROM tr), l AS (SELECT track, count(*) AS lifetime
  FROM tr GROUP BY track), o AS (SELECT y, x, count(*) AS n_tracks, avg(lifetime) AS m, quantile_cont(lifetime, 0.5) AS a, quantile_cont(lifetime, 0.75) AS b,
  quantile_cont(lifetime, 0.9) AS c, quantile_cont(lifetime, 0.95) AS e FROM (SELECT DISTINCT track, y, x, lifetime FROM p JOIN l USING (track)) GROUP BY ALL) SELECT y, x,
  count(*) AS n_times, round(avg(speed), 6) AS speed_mean, n_tracks, round(m, 6) AS lifetime_mean, round(a, 6) AS lifetime_p50, round(b, 6) AS lifetime_p75, round(c, 6) AS
  lifetime_p90, round(e, 6) AS lifetime_p95 FROM p JOIN o USING (y, x) GROUP BY ALL""")
def monthly_statsmap(spark, d):
    rows = user_tracks(spark, d)
    p = rows.select("track", F.floor(F.col("lat") / 5).alias("y"), F.floor(F.col("lon") / 30).alias("x"), (F.col("area") / 6.0).alias("speed"))
    return rounded(C.stats_map(p, rows.groupBy("track").agg(F.count("*").alias("lifetime")), ["y", "x"]))


@query(f"WITH {src.SHIP_SQL} SELECT frame_id AS time, x, round(avg(v), 6) AS mean_v, round(avg(CASE WHEN v2 > 2 THEN v ELSE 0 END), 6) AS mean_masked FROM ship GROUP BY ALL")
def hovmoller(spark, d):
    return rounded(C.hovmoller(src.ship(spark, d), F.col("frame_id"), F.col("v2") > 2))


HIST = "h AS (SELECT {keys} CAST(CASE WHEN v = 200 THEN 39 ELSE floor(v / 5.0) END AS BIGINT) AS bin, {n} AS n FROM ship WHERE v BETWEEN 0 AND 200 GROUP BY ALL)"


@query(f"WITH {src.SHIP_SQL}, {HIST.format(keys='v2 > 2 AS wet,', n='count(*)')} SELECT wet, bin, n, round(n / sum(n) OVER (PARTITION BY wet), 6) AS share, round(sum(n) OVER (PARTITION BY wet ORDER BY bin) / sum(n) OVER (PARTITION BY wet), 6) AS cumulative FROM h")
def rain_histogram(spark, d):
    return rounded(C.histogram(src.ship(spark, d).withColumn("wet", F.col("v2") > 2), F.col("v"), 0, 200, 40, ["wet"]))


@query(f"WITH {src.SHIP_SQL}, {HIST.format(keys='', n='CAST(sum(v) AS BIGINT)')} SELECT bin, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cumulative FROM h")
def cumulative_hist(spark, d):
    return rounded(C.histogram(src.ship(spark, d), F.col("v"), 0, 200, 40, weight=F.col("v")))


@query(TRACKS_SQL + " SELECT CAST(floor(lat / 4.0) AS BIGINT) AS bin_a, CAST(floor(lon / 15.0) AS BIGINT) AS bin_b, count(*) AS n FROM tr WHERE t_idx = 0 GROUP BY ALL")
def hist2d_density(spark, d):
    return C.histogram2d(user_tracks(spark, d).where("t_idx = 0"), F.col("lat"), F.col("lon"), 4.0, 15.0)


@query(TRACKS_SQL + " SELECT ra, rb, count(*) AS n_tracks FROM (SELECT DISTINCT track, CAST(round_even(lat / 4, 0) AS BIGINT) AS ra, CAST(round_even(lon / 16, 0) AS BIGINT) AS rb FROM tr) GROUP BY ALL")
def unique_track_density(spark, d):
    return C.unique_density(user_tracks(spark, d), F.col("lat") / 4, F.col("lon") / 16)


@query(TRACKS_SQL + """  SELECT CAST(floor(lat / 10) AS BIGINT) AS a, CAST(floor(lon / 60) AS BIGINT) AS b, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(avg(area), 6) END AS mean, CASE
  WHEN count(*) >= 10 THEN round(quantile_cont(area, 0.5), 6) END AS median, CASE WHEN count(*) >= 10 THEN max(area) END AS highest, CASE WHEN count(*) >= 10 THEN
  round(quantile_cont(area, 0.95), 6) END AS p95 FROM tr GROUP BY ALL""")
def box_percentile(spark, d):
    return rounded(C.box_statistics(user_tracks(spark, d), [F.floor(F.col("lat") / 10).alias("a"), F.floor(F.col("lon") / 60).alias("b")], F.col("area"), 10))


@query("SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY ALL")
def diurnal_cycle(spark, d):
    return rounded(src.table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n")))


@query("""WITH c AS (SELECT event_type, hour(ts) AS h, avg(value) AS m FROM events GROUP BY ALL), g AS (SELECT event_type, k AS harmonic, 2 * avg(m * cos(2 * pi() * k * h / 24)) AS
  a, 2 * avg(m * sin(2 * pi() * k * h / 24)) AS b, var_pop(m) AS v FROM c, generate_series(1, 2) AS s(k) GROUP BY ALL) SELECT event_type, harmonic, round(sqrt(a * a + b *
  b), 6) AS amplitude, round((CASE WHEN atan2(b, a) < 0 THEN atan2(b, a) + 2 * pi() ELSE atan2(b, a) END) / (2 * pi()) * 24 / harmonic, 6) AS peak_hour, round((a * a + b *
  b) / 2 / nullif(v, 0), 6) AS variance_share FROM g""")
def diurnal_harmonics(spark, d):
    return rounded(C.harmonics(src.table(spark, d, "events"), ["event_type"], F.hour("ts"), F.col("value"), 2))


SEASON = "CASE WHEN {m} IN (12, 1, 2) THEN 'DJF' WHEN {m} IN (3, 4, 5) THEN 'MAM' WHEN {m} IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


@query(f"""WITH {src.SHIP_SQL} SELECT {SEASON.format(m=MONTH)} AS season, y, CAST(sum(v) AS BIGINT) AS total, CAST(sum(CASE WHEN v > {THR} THEN v ELSE 0 END) AS BIGINT) AS amount,
  round(avg(CASE WHEN v > {THR} THEN 1.0 ELSE 0.0 END), 6) AS frequency, round(avg(v) FILTER (v > {THR}), 6) AS intensity, round(sum(CASE WHEN v > {THR} THEN v ELSE 0 END)
  / nullif(sum(v), 0), 6) AS fraction FROM ship GROUP BY ALL""")
def seasonal_ratio(spark, d):
    return rounded(C.seasonal_ratio(src.ship(spark, d), month_of(), ["y"], F.col("v") > THR))


@query("""WITH n AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL),
years AS (SELECT unnest(generate_series(min(y), max(y))) AS gy FROM n)
SELECT CAST(gm AS INTEGER) AS month, round(avg(coalesce(n, 0)), 6) AS mean_n, round(stddev_pop(coalesce(n, 0)), 6) AS std_n
FROM generate_series(1, 12) AS a(gm), years LEFT JOIN n ON n.y = gy AND n.m = gm GROUP BY ALL""")
def seasonal_cycle(spark, d):
    t = F.col("o_orderdate")
    starts = src.table(spark, d, "orders").select(F.year(t).alias("year"), F.month(t).alias("month"))
    return rounded(C.seasonal_cycle(starts))


@query(TRACKS_SQL + """, k AS (SELECT track FROM tr GROUP BY track HAVING count(*) BETWEEN 40 AND 60) SELECT t_idx, count(*) AS n, round(avg(area), 6) AS mean, round(quantile_cont(area, 0.25),
  6) AS q25, round(quantile_cont(area, 0.5), 6) AS q50, round(quantile_cont(area, 0.75), 6) AS q75 FROM tr JOIN k USING (track) GROUP BY t_idx""")
def composite_evolution(spark, d):
    return rounded(C.composite(user_tracks(spark, d), F.col("area"), (40, 60)))


@query(TRACKS_SQL + " SELECT CAST(g AS DOUBLE) AS at, round(avg(exp(-pow((g - lat) / 2.5, 2) / 2)) / (2.5 * sqrt(2 * pi())), 6) AS density FROM tr, generate_series(-20, 20, 2) AS s(g) GROUP BY g")
def kde1d(spark, d):
    return rounded(C.density(user_tracks(spark, d), F.col("lat"), list(range(-20, 21, 2)), 2.5))


@query(TRACKS_SQL + """, f AS (SELECT track FROM tr WHERE t_idx = 0 AND lat BETWEEN -15 AND 15 AND lon BETWEEN 10 AND 350 AND (base_time // 86400) % 12 + 1 IN (5, 6, 7, 8, 9)) SELECT track,
  count(*) AS lifetime, bool_or(merge_track IS NOT NULL) AS merges, bool_or(split_track IS NOT NULL) AS splits FROM tr SEMI JOIN f USING (track) GROUP BY track HAVING
  count(*) >= 40""")
def track_selection(spark, d):
    return C.in_region(user_tracks(spark, d), (-15, 15), (10, 350), 40, [5, 6, 7, 8, 9], F.floor(F.col("base_time") / 86400) % 12 + 1)


# ---- other grids and columns ----------------------------------------------------------------------


@query(f"""WITH {src.SHIP_SQL}, grid AS (SELECT y, x, CAST(sum(v) AS BIGINT) AS total FROM ship GROUP BY ALL), {TRACKS_SQL.removeprefix('WITH ')}, p AS (SELECT track, t_idx, lat,
  lon, CAST(floor((lat + 20) / 1.75 + 0.5) AS INTEGER) AS y, CAST(floor(lon / 16 + 0.5) AS INTEGER) AS x FROM tr) SELECT track, t_idx, y, x, total FROM p JOIN grid USING
  (y, x) WHERE abs(lat - (-20 + y * 1.75)) <= 0.8 AND abs(lon - x * 16) <= 0.8""")
def nearest_regrid(spark, d):
    grid = src.ship(spark, d).groupBy("y", "x").agg(F.sum("v").alias("total"))
    points = user_tracks(spark, d).select("track", "t_idx", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return R.nearest(points, grid, -20.0, 1.75, 0.0, 16.0, 0.8).select("track", "t_idx", "y", "x", "total")


@query(f"""WITH {src.SHIP_SQL}, w AS (SELECT y, x, CAST(floor((y + a / 2.0) / 4) * 7 + floor((x + b / 2.0) / 4) AS BIGINT) AS dst, count(*) / 4 AS w FROM generate_series(0, 23) AS
  g(y), generate_series(0, 23) AS h(x), generate_series(0, 1) AS i(a), generate_series(0, 1) AS j(b) GROUP BY ALL) SELECT frame_id, dst, round(sum(w * v) / sum(w), 6) AS v
  FROM ship JOIN w USING (y, x) GROUP BY ALL""")
def weighted_regrid(spark, d):
    return rounded(R.weighted(src.ship(spark, d), R.block_weights(spark, 24, 24, 4)))


@query()
def sphere_cells(spark, d):
    """Users' places on an equal-area grid of the sphere."""
    rows = user_tracks(spark, d)
    return rows.groupBy(R.sphere_cell(F.col("lat") * 4, F.col("lon"), 3).alias("cell")).agg(F.count("*").alias("n"), F.count_distinct("track").alias("n_tracks"))


PROFILE_SQL = f"WITH {src.EMB_SQL}, prof AS (SELECT frame_id, x, y AS z, 0.5 + y * 1.5 AS height, v * 100 AS v FROM emb)"


def _profile(spark, d):
    return src.emb(spark, d).select("frame_id", "x", F.col("y").alias("z"), (0.5 + F.col("y") * 1.5).alias("height"), (F.col("v") * 100).alias("v"))


@query(PROFILE_SQL + """, on_ AS (SELECT frame_id, x, t AS threshold, height, sum(CASE WHEN z - l > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id, x, t ORDER BY z) AS run FROM (SELECT *,
  lag(z) OVER (PARTITION BY frame_id, x, t ORDER BY z) AS l FROM prof, (VALUES (2.0::DOUBLE), (8.0::DOUBLE)) AS s(t) WHERE v >= t)) SELECT frame_id, x, threshold,
  CAST(max(height) AS DOUBLE) AS echo_top FROM on_ WHERE run = 0 GROUP BY ALL""")
def echotop(spark, d):
    return V.echo_tops(_profile(spark, d), ["frame_id", "x"], [2.0, 8.0], 2)


@query(PROFILE_SQL + """, on_ AS (SELECT *, sum(CASE WHEN z - l > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id, x ORDER BY z) AS run
  FROM (SELECT *, lag(z) OVER (PARTITION BY frame_id, x ORDER BY z) AS l FROM prof WHERE v < -1)),
s AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY frame_id, x) AS n, lead(v) OVER o AS v1, lead(v, 2) OVER o AS v2, lead(height) OVER o - height AS a,
  lead(height, 2) OVER o - lead(height) OVER o AS b FROM on_ WHERE run = 0 WINDOW o AS (PARTITION BY frame_id, x ORDER BY z)),
t AS (SELECT *, coalesce(CASE WHEN n = 2 THEN (v + v1) / 2 * a ELSE
    CASE WHEN k % 2 = 1 AND k + 2 <= n THEN (a + b) / 6 * (v * (2 - b / a) + v1 * (a + b) * (a + b) / (a * b) + v2 * (2 - a / b)) ELSE 0 END
    + CASE WHEN n % 2 = 0 AND k + 2 = n THEN (2 * b * b + 3 * a * b) / (6 * (a + b)) * v2 + (b * b + 3 * a * b) / (6 * a) * v1 - b * b * b / (6 * a * (a + b)) * v ELSE 0 END END, 0) AS term FROM s)
SELECT frame_id, x, CAST(min(height) AS DOUBLE) AS base, CAST(max(height) AS DOUBLE) AS top, CAST(max(height) - min(height) AS DOUBLE) AS depth, min(z) AS z_base,
  round(sqrt(greatest(-2 * sum(term), 0)), 5) AS intensity FROM t GROUP BY ALL HAVING max(height) - min(height) > 1""")
def coldpool_depth(spark, d):
    return rounded(V.cold_pool_depth(_profile(spark, d), ["frame_id", "x"], -1.0, 1.0).withColumn("intensity", F.round("intensity", 5)))


@query(PROFILE_SQL + """, c AS (SELECT frame_id, x, v, height, lead(v) OVER o AS up, lead(height) OVER o AS h FROM prof WINDOW o AS (PARTITION BY frame_id, x ORDER BY z)) SELECT frame_id, x,
  round(max(CASE WHEN v > 0 AND up <= 0 THEN height + v / (v - up) * (h - height) END), 6) AS crossing FROM c GROUP BY ALL""")
def melting_level(spark, d):
    return rounded(V.crossing_height(_profile(spark, d), ["frame_id", "x"]))


@query(PROFILE_SQL + " SELECT frame_id, x, round(max(CASE WHEN v >= -5 THEN v END), 5) AS composite, round(max(CASE WHEN z <= 2 AND v >= -5 THEN v END), 5) AS low_level FROM prof WHERE height > 0.5 + 0.1 * x GROUP BY ALL")
def reflectivity_composite(spark, d):
    return rounded(V.composite(_profile(spark, d), ["frame_id", "x"], F.col("height") > 0.5 + 0.1 * F.col("x"), -5.0, 2), 5)


# ---- motion -------------------------------------------------------------------------------------


@query()
def motion_fft(spark, d):
    from ..operators import motion

    return motion.pair_shifts(block_labels(spark, d), _monthly_pairs(spark, d)[1], (24, 24))


@query()
def advection(spark, d):
    from ..operators import motion

    return motion.advection(src.ship(spark, d), _monthly_pairs(spark, d)[1], (24, 24), 12, 6.0)


@query()
def trajectory_smooth(spark, d):
    from ..operators import motion

    return motion.smoothed_paths(user_tracks(spark, d), 400.0)


# ---- further scalars, sources and statistics -----------------------------------------------------


@query(f"""WITH {src.SHIP_SQL}, p AS (SELECT DISTINCT y, x FROM ship) SELECT y, x, CASE WHEN x % 12 + 1 IN (12, 1, 2) THEN 'DJF' WHEN x % 12 + 1 IN (3, 4, 5) THEN 'MAM' WHEN x % 12
  + 1 IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, CAST(CASE WHEN (x * 30 - 180) % 360 < 0 THEN (x * 30 - 180) % 360 + 360 ELSE (x * 30 - 180) % 360 END - 180 AS
  BIGINT) AS lon, round(2 * sqrt(y * 10 / pi()), 6) AS diameter, round(pow(10, y * 2 / 10.0), 6) AS z, round(10 * log10(x + 1), 6) AS dbz, sqrt(y * y + x * x) <= 10 AS
  within_10, round(degrees(asin(sin(radians(y + 1)) * cos(x * 50 / 6374.2) + cos(radians(y + 1)) * sin(x * 50 / 6374.2) * cos(radians(x * 15)))), 6) AS lat2,
  CAST(greatest(y * 1.5 - 10, 0) AS DOUBLE) AS clamped FROM p""")
def scalar_functions(spark, d):
    y, x = F.col("y"), F.col("x")
    lat2, _ = S.destination(y + 1, F.lit(0), x * 50, x * 15)
    p = src.ship(spark, d).select("y", "x").distinct()
    out = p.select("y", "x", S.season(x % 12 + 1).alias("season"), S.wrapped_longitude(x * 30).cast("long").alias("lon"), S.equivalent_diameter(y * 10).alias("diameter"), S.to_linear(y * 2).alias("z"), S.to_dbz(x + 1).alias("dbz"), *S.masks_within(x, y, [10]), lat2.alias("lat2"), S.positive(y * 1.5 - 10).alias("clamped"))
    return rounded(out)


@query("SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS base_time, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def hourly_mean(spark, d):
    e = src.table(spark, d, "events").withColumn("base_time", F.unix_seconds(F.col("ts").cast("timestamp")))
    return rounded(tb.hourly_mean(e, ["user_id"], "value"))


@query(TRACKS_SQL + """, e AS (SELECT track, count(*) AS n, min(base_time) AS t0, max(base_time) AS t1, bool_or(merge_track IS NOT NULL) AS m FROM tr GROUP BY track) SELECT CAST(t0 // 3600 % 24
  AS BIGINT) AS start_hour, CAST(t1 // 3600 % 24 AS BIGINT) AS end_hour, count(*) AS n_all, count(*) FILTER (NOT m) AS n_without_merge, count(*) FILTER (n > 50) AS n_long
  FROM e GROUP BY ALL""")
def start_end_hours(spark, d):
    e = user_tracks(spark, d).groupBy("track").agg(F.count("*").alias("n"), F.min("base_time").alias("t0"), F.max("base_time").alias("t1"), F.max(F.col("merge_track").isNotNull()).alias("m"))
    hour = lambda c: F.floor(F.col(c) / 3600) % 24
    return e.groupBy(hour("t0").alias("start_hour"), hour("t1").alias("end_hour")).agg(F.count("*").alias("n_all"), F.count(F.when(~F.col("m"), 1)).alias("n_without_merge"), F.count(F.when(F.col("n") > 50, 1)).alias("n_long"))


@query(TRACKS_SQL + " SELECT track, round(arg_max(lat, t_idx), 6) AS last_lat, round(arg_max(lon, t_idx) FILTER (lon < 200), 6) AS last_lon_east FROM tr GROUP BY track")
def last_valid(spark, d):
    rows = user_tracks(spark, d).withColumn("lon_east", F.when(F.col("lon") < 200, F.col("lon")))
    return rounded(T.last_valid(rows, ["lat", "lon_east"]))


@query(LABELS_SQL + """  SELECT frame_id, feature, count(*) FILTER (v > 90) AS conv_px, round(avg(v) FILTER (v > 90), 6) AS conv_mean, CAST(sum(CASE WHEN v > 90 THEN v ELSE 0 END) AS BIGINT) AS
  conv_total, count(*) FILTER (v <= 90) AS strat_px, round(avg(v) FILTER (v <= 90), 6) AS strat_mean, CAST(sum(CASE WHEN v <= 90 THEN v ELSE 0 END) AS BIGINT) AS
  strat_total, round(count(*) FILTER (v > 90) / count(*), 6) AS conv_share FROM labels GROUP BY ALL""")
def convective_split(spark, d):
    return rounded(T.split_rain(block_labels(spark, d), ["frame_id", "feature"], F.col("v") > 90))


@query(ISLANDS_SQL.format(gap=2, test="area > 3000 AND npix > 1") + " SELECT track, CAST(max(length * 6) AS DOUBLE) AS rain_hours FROM runs WHERE length * 6 >= 12 GROUP BY track")
def robust_rain(spark, d):
    rows = user_tracks(spark, d).withColumns({"pf_maxrate": F.col("area"), "pf_volume": F.col("npix")})
    return T.rain_systems(rows, 3000, 1, 2, 12, 6.0)


@query(ISLANDS_SQL.format(gap=1, test="npix >= 2 AND area % 4 > 0") + " SELECT track, CAST(max(length * 6) AS DOUBLE) AS line_hours FROM runs WHERE length * 6 >= 12 GROUP BY track")
def robust_radar(spark, d):
    rows = user_tracks(spark, d).withColumns({"pf_axis": F.col("npix"), "core_area": F.col("area") % 4})
    return T.radar_systems(rows, 2, 1, 12, 6.0)


@query(TRACKS_SQL + ", s AS (SELECT DISTINCT merge_track AS track, track AS small_track FROM tr WHERE merge_track IS NOT NULL) SELECT frame_id, feature, track FROM tr UNION ALL SELECT t.frame_id, t.feature, s.track FROM tr t JOIN s ON t.track = s.small_track")
def attached_union(spark, d):
    rows = user_tracks(spark, d)
    small = rows.where("merge_track IS NOT NULL").select(F.col("merge_track").alias("track"), F.col("track").alias("small_track"))
    return T.with_attached(rows, small)


@query(TRACKS_SQL + ", w AS (SELECT track, t_idx, area, coalesce(lag(area) OVER o, 0) AS a, coalesce(lead(area) OVER o, 0) AS b FROM tr WINDOW o AS (PARTITION BY track ORDER BY t_idx)) SELECT track, t_idx, CAST(greatest(least(area, a), least(greatest(area, a), b)) AS DOUBLE) AS speed_median FROM w")
def running_median(spark, d):
    rows = user_tracks(spark, d).select("track", "t_idx", F.col("area").cast("double").alias("speed"))
    return T.running_median(rows, ["track"], "t_idx", "speed", 3).select("track", "t_idx", "speed_median")


@query(PROFILE_SQL + """, c AS (SELECT frame_id, x, max(CASE WHEN height > 5 THEN v END) AS aloft, max(CASE WHEN height <= 5 THEN v END) AS below, max(height) AS top FROM prof GROUP BY ALL)
  SELECT frame_id, x, CAST(CASE WHEN aloft >= 15 AND top >= 10 THEN 1 WHEN greatest(aloft, below) >= 15 THEN 2 WHEN below >= 7.5 THEN 3 WHEN below > 0 THEN 4 WHEN aloft > 0
  THEN 5 ELSE 0 END AS INTEGER) AS sl_class FROM c""")
def column_class(spark, d):
    return V.column_class(_profile(spark, d), ["frame_id", "x"], 5.0, 15.0, 10.0)


@query(PROFILE_SQL + """, c AS (SELECT *, lead(v) OVER o AS v1, lead(height) OVER o AS h1 FROM prof WINDOW o AS (PARTITION BY frame_id, x ORDER BY z)) SELECT frame_id, x, level, round(v + (v1 -
  v) * (level - height) / (h1 - height), 5) AS v FROM c, (VALUES (1.0::DOUBLE), (4.0::DOUBLE), (8.5::DOUBLE)) AS l(level) WHERE level >= height AND level < h1""")
def level_interpolation(spark, d):
    return rounded(V.at_levels(_profile(spark, d), ["frame_id", "x"], [1.0, 4.0, 8.5]), 5)


@query(f"WITH {src.SHIP_SQL} SELECT frame_id, y, x, round(9.81 * (300 + v - m) / m, 6) AS buoyancy FROM (SELECT *, avg(300 + v) OVER (PARTITION BY frame_id) AS m FROM ship)")
def buoyancy(spark, d):
    from pyspark.sql import Window

    return src.ship(spark, d).select("frame_id", "y", "x", F.round(S.anomaly_buoyancy(300 + F.col("v"), Window.partitionBy("frame_id")), 6).alias("buoyancy"))


@query(TRACKS_SQL + " SELECT track, t_idx, npix FROM tr")
def sparse_dense(spark, d):
    rows = stored(user_tracks(spark, d).select("track", "t_idx", "npix"))
    return tb.sparse(tb.dense(rows, ["npix"]), ["npix"])


@query(f"""WITH {src.SHIP_SQL}, p AS (SELECT DISTINCT frame_id FROM ship), g AS (SELECT p.frame_id, a.y, b.x, coalesce(s.v, 0) AS v, s.v IS NULL AS missing FROM p,
  generate_series(0, 23) AS a(y), generate_series(0, 23) AS b(x) LEFT JOIN ship s ON s.frame_id = p.frame_id AND s.y = a.y AND s.x = b.x), n AS (SELECT g.frame_id, g.y,
  g.x, coalesce(h.v, 0) AS v FROM g, generate_series(-1, 1) AS i(dy), generate_series(-1, 1) AS j(dx) LEFT JOIN g h ON h.frame_id = g.frame_id AND h.y = g.y + dy AND h.x =
  g.x + dx WHERE g.missing) SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(median(v) AS DOUBLE) AS filled FROM n GROUP BY ALL""")
def median_fill(spark, d):
    from ..functions import kernels as K

    def kernel(a):
        return np.where(np.isnan(a), K.median_filled(a, 3), np.nan)

    return I.by_frame(src.ship(spark, d), (24, 24), kernel, out="frame_id long, y int, x int, filled double")


@query(LABELS_SQL + " SELECT frame_id, feature, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM labels GROUP BY ALL")
def bounding_boxes(spark, d):
    return T.boxes(block_labels(spark, d), 24)


@query(LABELS_SQL + """, w AS (SELECT frame_id, feature, y, (x + 20) % 24 AS x FROM labels), c AS (SELECT DISTINCT frame_id, feature, x FROM w), g AS (SELECT frame_id, feature, coalesce(lead(x)
  OVER o, first_value(x) OVER o + 24) AS nxt, x FROM c WINDOW o AS (PARTITION BY frame_id, feature ORDER BY x)), m AS (SELECT frame_id, feature, arg_max(nxt, (nxt - x) *
  100 + nxt) AS nxt, max(nxt - x) AS gap FROM g GROUP BY ALL) SELECT m.frame_id, m.feature, min(y) AS y0, max(y) AS y1, any_value(nxt % 24) AS x0, any_value(nxt % 24 + 24 -
  gap) AS x1 FROM m JOIN w USING (frame_id, feature) GROUP BY ALL""")
def wrapped_boxes(spark, d):
    labels = block_labels(spark, d).withColumn("x", ((F.col("x") + 20) % 24).cast("int"))
    return T.boxes(labels, 24, wrap=True)


@query(TRACKS_SQL + " SELECT track, t_idx, round(lat, 6) AS lat FROM tr WHERE track IN (SELECT track FROM tr WHERE t_idx = 0 AND base_time BETWEEN 1704067200 AND 1704110400)")
def tracks_started(spark, d):
    return rounded(T.started_between(user_tracks(spark, d), 1704067200, 1704110400).select("track", "t_idx", "lat"))


@query(f"""WITH {src.SHIP_SQL} SELECT c.frame_id, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, round(sum(coalesce(v, 0)) / 9, 6) AS c FROM (SELECT DISTINCT frame_id FROM
  ship) c, generate_series(0, 7) AS a(gy), generate_series(0, 7) AS b(gx) LEFT JOIN ship s ON s.frame_id = c.frame_id AND s.y // 3 = gy AND s.x // 3 = gx GROUP BY ALL
  HAVING sum(coalesce(v, 0)) > 0""")
def strided_mean(spark, d):
    from ..functions import kernels as K

    def kernel(a):
        c = K.strided(np.nan_to_num(a), 3)
        return np.where(c > 0, c, np.nan)

    return rounded(I.by_frame(src.ship(spark, d), (24, 24), kernel, out="frame_id long, y int, x int, c double"))


@query()
def cold_pools(spark, d):
    return I.cold_pools(src.ship(spark, d), (24, 24), 1.0, 30.0, 40.0, 2)


@query()
def stratiform_split(spark, d):
    """Convective pixels: cores widened by a radius that grows with their background."""
    from ..functions import kernels as K

    steps = S.radius_steps(20.0, 5.0, 1.0, 1.0, 3.0)

    def kernel(a):
        ok = ~np.isnan(a) & (a >= 5)
        bkg = K.background(np.nan_to_num(a), ok, 3)
        with np.errstate(invalid="ignore"):
            core = ok & ((a >= 45) | (a - bkg >= 8 * np.cos(np.pi * np.clip(bkg, 0, 64) / 128)))
        return np.where(ok, 1 + K.dilated_by_background(core, bkg, steps), 0)

    return I.by_frame(src.ship(spark, d).withColumn("v", F.col("v") / 2), (24, 24), kernel, out="frame_id long, y int, x int, class long")


@query()
def whole_run(spark, d):
    """Objects, links, numbers, statistics and masks of the monthly frames: the mask table."""
    from . import tracking
    from .config import Config

    pixels = src.ship(spark, d)
    frames = pixels.select("frame_id").distinct().withColumn("base_time", F.col("frame_id") * 3600)
    return tracking.run(pixels, frames, Config(ny=24, nx=24, identify={"low": 75.0}, least_pixels=1, othresh=0.2, timegap=1.5))["masks"]
