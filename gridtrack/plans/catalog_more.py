"""Further queries with their SQL: surfaces, masks, merge indices, time joins, core statistics, other grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import climatology as C
from ..operators import columns as V
from ..operators import identify as I
from ..operators import link as L
from ..operators import regrid as R
from ..operators import surface as G
from ..operators import tracks as T
from ..sources import rasters as src
from .catalog import LABELS_SQL, PROFILE_SQL, TRACKS_SQL, _monthly_pairs, _pf, _profile, block_labels, query, rounded, user_tracks

#: Land in the west, a coast without data, hills by columns.
GRID_SQL = """grid AS (SELECT CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, CASE WHEN gx <> 12 THEN CAST(CASE WHEN (gx + gy) % 5 < 2 OR gx < 6 THEN 1 ELSE 0 END AS INTEGER) END AS land, CAST(gx % 4 * 0.7 AS DOUBLE) AS terrain
  FROM generate_series(0, 23) AS a(gy), generate_series(0, 23) AS b(gx))"""


def _grid(spark):
    y, x = F.floor(F.col("id") / 24).cast("int"), (F.col("id") % 24).cast("int")
    g = spark.range(576).select(y.alias("y"), x.alias("x"))
    land = F.when(F.col("x") != 12, (((F.col("x") + F.col("y")) % 5 < 2) | (F.col("x") < 6)).cast("int"))
    return g.select("y", "x", land.alias("land"), (F.col("x") % 4 * 0.7).alias("terrain"))


@query(LABELS_SQL + f""", {GRID_SQL}
SELECT frame_id, feature, count(*) AS npix, round(avg(land), 6) AS landfrac FROM labels JOIN grid USING (y, x) GROUP BY ALL HAVING avg(land) BETWEEN 0.2 AND 0.8""")
def land_fraction(spark, d):
    objects = G.land_share(G.on_grid(block_labels(spark, d), _grid(spark), ["land"]), ["frame_id", "feature"])
    return rounded(G.within_land(objects, 0.2, 0.8))


@query(TRACKS_SQL + """, g AS (SELECT track, avg(npix / 3.0) AS m, avg(npix / 3.0) FILTER (t_idx < 3) AS s FROM tr GROUP BY track)
SELECT track, round(m, 6) AS landfrac_mean, round(s, 6) AS landfrac_start, CASE WHEN m > 0.55 THEN 'land' WHEN m < 0.45 THEN 'ocean' ELSE 'mixed' END AS surface FROM g""")
def land_ocean(spark, d):
    return rounded(G.by_surface(user_tracks(spark, d).withColumn("landfrac", F.col("npix") / 3.0), 0.55, 0.45))


@query(PROFILE_SQL + ", " + GRID_SQL + ", p AS (SELECT frame_id, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS y, height, v FROM prof) SELECT frame_id, y, p.x, CAST(height AS DOUBLE) AS height, round(v, 5) AS v FROM p JOIN grid USING (y, x) WHERE CAST(height AS DOUBLE) > terrain + 0.4")
def terrain_clearance(spark, d):
    volume = _profile(spark, d).select("frame_id", F.col("z").alias("y"), "x", "height", "v")
    return rounded(G.above_terrain(volume, _grid(spark), 0.4).select("frame_id", "y", "x", "height", "v"), 5)


@query(LABELS_SQL + """, n AS (SELECT DISTINCT frame_id, feature, frame_id % 7 * 10 + feature AS track, CAST(feature % 5 AS INTEGER) AS status, CASE WHEN feature % 4 = 0 THEN feature + 100 END AS m,
  CASE WHEN feature % 3 = 0 THEN feature + 200 END AS s FROM labels)
SELECT l.frame_id, l.y, l.x, track AS tracknumber, status AS track_status, coalesce(m, 0) AS merge_tracknumber, coalesce(s, 0) AS split_tracknumber,
  CASE WHEN p.v2 > 3 THEN track ELSE 0 END AS pcp_tracknumber FROM labels l JOIN n USING (frame_id, feature) JOIN ship p ON p.frame_id = l.frame_id AND p.y = l.y AND p.x = l.x""")
def mask_variants(spark, d):
    labels, f = block_labels(spark, d), F.col("feature")
    nodes = labels.select("frame_id", "feature").distinct().select("frame_id", "feature", (F.col("frame_id") % 7 * 10 + f).alias("track"), (f % 5).cast("int").alias("status"), F.when(f % 4 == 0, f + 100).alias("merge_track"), F.when(f % 3 == 0, f + 200).alias("split_track"))
    return T.painted_in_full(labels, nodes, src.ship(spark, d).select("frame_id", "y", "x", F.col("v2").alias("v")), 3)


@query(TRACKS_SQL + """, e AS (SELECT track, arg_max(base_time, t_idx) AS t1, arg_min(base_time, t_idx) AS t0, arg_max(merge_track, t_idx) AS m, arg_min(split_track, t_idx) AS s FROM tr GROUP BY track),
mi AS (SELECT e.track, b.t_idx, b.area FROM e JOIN tr a ON a.track = e.m AND a.base_time = e.t1 JOIN tr b ON b.track = e.m AND b.t_idx = a.t_idx + 1),
si AS (SELECT e.track, b.t_idx, b.area FROM e JOIN tr a ON a.track = e.s AND a.base_time = e.t0 JOIN tr b ON b.track = e.s AND b.t_idx = a.t_idx - 1)
SELECT e.track, coalesce(m, -1) AS merge_track, coalesce(mi.t_idx, -1) AS end_merge_idx, coalesce(mi.area, -1) AS end_merge_feature, coalesce(s, -1) AS split_track, coalesce(si.t_idx, -1) AS start_split_idx,
  coalesce(si.area, -1) AS start_split_feature FROM e LEFT JOIN mi ON mi.track = e.track LEFT JOIN si ON si.track = e.track""")
def merge_split_index(spark, d):
    return T.merge_split_index(user_tracks(spark, d).drop("feature").withColumnRenamed("area", "feature")).fillna(-1)


@query(TRACKS_SQL + """, o AS (SELECT user_id AS track, CAST(floor(epoch(ts)) AS BIGINT) AS t, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT tr.track, base_time, arg_min(event_id, abs(base_time - t) * 2 + CASE WHEN t > base_time THEN 1 ELSE 0 END) AS event_id, arg_min(t, abs(base_time - t) * 2 + CASE WHEN t > base_time THEN 1 ELSE 0 END) AS at
FROM tr JOIN o ON o.track = tr.track AND abs(base_time - t) < 7200 GROUP BY ALL""")
def nearest_time(spark, d):
    seen = src.table(spark, d, "events").groupBy(F.col("user_id").alias("track"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("base_time")).agg(F.min("event_id").alias("event_id"))
    out = T.nearest_in_time(user_tracks(spark, d).select("track", "base_time"), seen, ["track"], "base_time", 7200)
    return out.select("track", "base_time", "nearest.event_id", F.col("nearest.base_time").alias("at"))


@query(TRACKS_SQL + """, b AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t_idx, CAST(floor(o_totalprice) AS BIGINT) AS area, length(o_orderpriority) AS level FROM orders)
SELECT track, t_idx, coalesce(CASE WHEN a.area % 3 > 0 THEN a.area END, b.area, -1) AS area, coalesce(npix, -1) AS npix, coalesce(level, -1) AS level FROM tr a FULL JOIN b USING (track, t_idx)""")
def outer_alignment(spark, d):
    """Users' tracks beside customers' orders in turn, a third of the former's areas missing."""
    a = user_tracks(spark, d).select("track", "t_idx", F.when(F.col("area") % 3 > 0, F.col("area")).alias("area"), "npix")
    turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    b = src.table(spark, d, "orders").select(F.col("o_custkey").alias("track"), (F.row_number().over(turn) - 1).cast("long").alias("t_idx"), F.floor("o_totalprice").alias("area"), F.length("o_orderpriority").cast("long").alias("level"))
    return T.aligned(a, b, ["track", "t_idx"]).fillna(-1)


@query(TRACKS_SQL + """, f AS (SELECT base_time, count(*) AS n FROM tr GROUP BY ALL), s AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS base_time, count(*) AS n FROM events GROUP BY ALL)
SELECT base_time, f.n, s.n AS n_right FROM f JOIN s USING (base_time)""")
def common_times(spark, d):
    f = user_tracks(spark, d).groupBy("base_time").agg(F.count("*").alias("n"))
    s = src.table(spark, d, "events").groupBy((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).alias("base_time")).agg(F.count("*").alias("n"))
    return T.at_common_times(f, s)


@query(LABELS_SQL + """ SELECT frame_id, feature, CAST(count(*) FILTER (v / 10.0 > 7) * 4 AS DOUBLE) AS area_eth7, CAST(count(*) FILTER (v / 10.0 > 10) * 4 AS DOUBLE) AS area_eth10,
  round(avg(v / 10.0), 6) AS eth_mean, max(v) / 10.0 AS eth_max FROM labels GROUP BY ALL""")
def echo_top_areas(spark, d):
    return rounded(T.echo_areas(block_labels(spark, d).withColumn("echo_top", F.col("v") / 10), ["frame_id", "feature"], [7, 10], 4.0))


@query(LABELS_SQL + """, c AS (SELECT frame_id, feature, y % 8 // 4 * 2 + x % 8 // 4 + 1 AS core, y, x, CAST(v AS DOUBLE) AS v FROM labels),
m AS (SELECT frame_id, feature, core, count(*) AS npix, avg(v) AS core_mean, max(v) AS core_max, var_pop(x) + 1 / 12 AS a, var_pop(y) + 1 / 12 AS c, covar_pop(x, y) AS b, sum(v * y) / sum(v) AS wy FROM c GROUP BY ALL)
SELECT frame_id, feature, CAST(core AS BIGINT) AS core, npix, round(core_mean, 6) AS core_mean, core_max, round(4 * sqrt((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)), 6) AS majoraxis, round(wy, 6) AS weighted_y,
  row_number() OVER (PARTITION BY frame_id, feature ORDER BY npix DESC, core) AS core_rank FROM m QUALIFY core_rank <= 2""")
def core_statistics(spark, d):
    rows = _pf(spark, d).withColumn("core", F.col("pf") + 1).withColumn("v", F.col("v").cast("double"))
    out = T.core_stats(rows, ["frame_id", "feature"], "core", 2)
    return rounded(out.select("frame_id", "feature", "core", "npix", "core_mean", "core_max", "majoraxis", "weighted_y", "core_rank"))


@query(TRACKS_SQL + """, g AS (SELECT track, bool_or(merge_track IS NOT NULL) AS m, bool_or(split_track IS NOT NULL) AS s FROM tr GROUP BY track) SELECT track, m OR s AS ms, NOT m AND NOT s AS nms, NOT m AS nm, NOT s AS ns FROM g""")
def merge_split_kinds(spark, d):
    return T.merge_split_kinds(user_tracks(spark, d))


@query(LABELS_SQL + """, e AS (SELECT l.frame_id, l.feature, l.y, l.x FROM labels l WHERE (SELECT count(*) FROM labels o WHERE o.frame_id = l.frame_id AND o.feature = l.feature AND abs(o.y - l.y) + abs(o.x - l.x) = 1) < 4),
k AS (SELECT a.frame_id, a.feature, a.y, a.x, 1 + 2 * count(*) FILTER (abs(b.y - a.y) + abs(b.x - a.x) = 1) + 10 * count(*) FILTER (abs(b.y - a.y) = 1 AND abs(b.x - a.x) = 1) AS k
  FROM e a JOIN e b ON b.frame_id = a.frame_id AND b.feature = a.feature AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL)
SELECT frame_id, feature, round(sum(CASE WHEN k IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN k IN (21, 33) THEN sqrt(2) WHEN k IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM k GROUP BY ALL""")
def perimeters(spark, d):
    return rounded(T.perimeters(block_labels(spark, d)))


@query(LABELS_SQL + """, b AS (SELECT frame_id, feature, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM labels GROUP BY ALL)
SELECT frame_id, feature, CASE WHEN y0 < 3 THEN 0 ELSE y0 END AS y0, CASE WHEN y1 > 20 THEN 23 ELSE y1 END AS y1, CASE WHEN x0 < 3 THEN 0 ELSE x0 END AS x0, CASE WHEN x1 > 20 THEN 23 ELSE x1 END AS x1 FROM b""")
def snapped_boxes(spark, d):
    return T.snapped(T.boxes(block_labels(spark, d), 24), 24, 24, 3)


@query(LABELS_SQL + " SELECT frame_id, y, CAST((x + 19) % 24 AS INTEGER) AS x, feature FROM labels")
def rolled_labels(spark, d):
    return T.rolled(block_labels(spark, d).drop("v"), 24, -5)


@query(LABELS_SQL + """, s AS (SELECT frame_id, feature AS old, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, feature DESC) AS BIGINT) AS feature FROM labels GROUP BY frame_id, old HAVING count(*) > 5)
SELECT l.frame_id, y, x, s.feature FROM labels l JOIN s ON s.frame_id = l.frame_id AND s.old = l.feature WHERE v > 80""")
def second_mask(spark, d):
    labels = block_labels(spark, d)
    return I.renumbered_with(labels.drop("v"), labels.where("v > 80").drop("v"), 5)[1]


@query(TRACKS_SQL + """ SELECT CAST(a AS DOUBLE) AS at_a, CAST(b AS DOUBLE) AS at_b, round(avg(exp(-(pow((a - lat) / 4, 2) + pow((b - lon) / 40, 2)) / 2)) / (2 * pi() * 4 * 40), 9) AS density
FROM tr, generate_series(-20, 20, 10) AS s(a), generate_series(0, 350, 70) AS t(b) GROUP BY a, b""")
def kde2d(spark, d):
    return rounded(C.density2d(user_tracks(spark, d), F.col("lat"), F.col("lon"), list(range(-20, 21, 10)), list(range(0, 351, 70)), 4, 40), 9)


@query(TRACKS_SQL + """ SELECT CAST(floor(lat / 5) AS BIGINT) AS y, CAST(floor(lon / 30) AS BIGINT) AS x, CAST(count(DISTINCT base_time) * 6 AS DOUBLE) AS track_hours,
  CAST(sum(CASE WHEN t_idx = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_started, round(avg(area / 6.0), 6) AS speed_mean FROM tr GROUP BY ALL""")
def initiation_map(spark, d):
    rows = user_tracks(spark, d).withColumns({"y": F.floor(F.col("lat") / 5), "x": F.floor(F.col("lon") / 30), "speed": F.col("area") / 6})
    return rounded(C.initiation_map(rows, ["y", "x"], 6.0))


@query(f"""WITH {src.SHIP_SQL}, t AS (SELECT CAST(i * 30 + j AS BIGINT) AS dst, i * 0.8::DOUBLE AS v, j * 0.7::DOUBLE + 0.2::DOUBLE AS u FROM generate_series(0, 29) AS a(i), generate_series(0, 29) AS b(j) WHERE i * 0.8 <= 23 AND j * 0.7 + 0.2 <= 23),
q AS (SELECT dst, v, u, least(floor(v), 22) AS y0, least(floor(u), 22) AS x0 FROM t),
w AS (SELECT dst, CAST(y0 + b AS INTEGER) AS y, CAST(x0 + a AS INTEGER) AS x, (CASE WHEN b = 1 THEN v - y0 ELSE 1 - (v - y0) END) * (CASE WHEN a = 1 THEN u - x0 ELSE 1 - (u - x0) END) AS w
  FROM q, generate_series(0, 1) AS g(b), generate_series(0, 1) AS h(a))
SELECT frame_id, dst, round(sum(w * p.v) / sum(w), 6) AS v FROM ship p JOIN w USING (y, x) WHERE w > 0 GROUP BY ALL""")
def bilinear_regrid(spark, d):
    i, j = F.floor(F.col("id") / 30), F.col("id") % 30
    points = spark.range(900).select(F.col("id").alias("dst"), (i * 0.8).alias("plat"), (j * 0.7 + 0.2).alias("plon"))
    return rounded(R.weighted(src.ship(spark, d), G.bilinear_weights(points, 0.0, 1.0, 0.0, 1.0, 24, 24)))


@query(f"""WITH {src.SHIP_SQL}, c AS (SELECT frame_id, CAST(y * 24 + x AS BIGINT) AS cell, v FROM ship), g AS (SELECT CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, (i * 7 % 24) * 24 + (j * 5 % 24) AS cell
  FROM generate_series(0, 11) AS a(i), generate_series(0, 11) AS b(j)) SELECT frame_id, y, x, v FROM g JOIN c USING (cell)""")
def gathered_cells(spark, d):
    i, j = F.floor(F.col("id") / 12).cast("int"), (F.col("id") % 12).cast("int")
    lookup = spark.range(144).select(i.alias("y"), j.alias("x"), ((i * 7 % 24) * 24 + j * 5 % 24).cast("long").alias("cell"))
    return G.gathered(src.ship(spark, d).select("frame_id", (F.col("y") * 24 + F.col("x")).cast("long").alias("cell"), "v"), lookup)


@query(f"WITH {src.SHIP_SQL} SELECT frame_id, count(*) AS n, count(v) FILTER (v2 / 10.0 >= 0.3) AS n_good, CAST(sum(v) FILTER (v2 / 10.0 >= 0.3) AS BIGINT) AS total FROM ship GROUP BY ALL")
def quality_mask(spark, d):
    ok = src.ship(spark, d).withColumn("good", G.quality_masked(F.col("v"), F.col("v2") / 10, 0.3))
    return ok.groupBy("frame_id").agg(F.count("*").alias("n"), F.count("good").alias("n_good"), F.sum("good").alias("total"))


@query(PROFILE_SQL + """, on_ AS (SELECT *, sum(CASE WHEN z - l > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id, x ORDER BY z) AS run
  FROM (SELECT *, lag(z) OVER (PARTITION BY frame_id, x ORDER BY z) AS l FROM prof WHERE v < -1))
SELECT frame_id, x, CAST(max(height) AS DOUBLE) AS top FROM on_ WHERE run = 0 GROUP BY ALL HAVING max(height) - min(height) > 1 AND min(z) = 0""")
def surface_pools(spark, d):
    return G.surface_based(V.cold_pool_depth(_profile(spark, d), ["frame_id", "x"], -1.0, 1.0), 0).select("frame_id", "x", "top")


@query("SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS base_time, 'mask_' || strftime(date_trunc('hour', ts), '%Y%m%d_%H%M%S') || '.parquet' AS name FROM events")
def frame_names(spark, d):
    hours = src.table(spark, d, "events").select((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).alias("base_time")).distinct()
    return hours.select("base_time", S.frame_name("mask_", F.col("base_time")).alias("name"))


@query(f"WITH {src.SHIP_SQL}, f AS (SELECT DISTINCT frame_id FROM ship) SELECT a.frame_id, a.frame_id + 3 AS next_id FROM f a JOIN f b ON b.frame_id = a.frame_id + 3")
def lagged_pairs(spark, d):
    return L.frame_pairs(_monthly_pairs(spark, d)[0], 3.5, 3)


@query(LABELS_SQL + " SELECT frame_id, feature, count(*) AS npix FROM labels GROUP BY ALL")
def guarded_features(spark, d):
    """Sizes of objects, after the check that no frame has over 9 of them."""
    f = block_labels(spark, d).groupBy("frame_id", "feature").agg(F.count("*").alias("npix"))
    return T.guarded(f, ["frame_id"], 9, "objects in a frame")


STEINER = """z AS (SELECT frame_id, y, x, v / 2.0 AS dbz, pow(10, v / 20.0) AS lin FROM ship WHERE v >= 10),
b AS (SELECT a.frame_id, a.y, a.x, a.dbz, 10 * log10(avg(c.lin)) AS bkg FROM z a JOIN z c ON c.frame_id = a.frame_id AND (c.y - a.y) * (c.y - a.y) + (c.x - a.x) * (c.x - a.x) <= 9 GROUP BY ALL)"""


@query(f"""WITH {src.SHIP_SQL}, {STEINER}
SELECT s.frame_id, s.y, s.x, CAST(CASE WHEN dbz IS NULL THEN 0 WHEN dbz < 8 THEN 1 WHEN dbz > 8 AND dbz < 15 THEN 2
  WHEN dbz >= 45 OR dbz - bkg >= CASE WHEN bkg < 0 THEN 8 WHEN bkg < 64 THEN 8 * cos(pi() * bkg / 128) ELSE 0 END THEN 4 ELSE 3 END AS INTEGER) AS kind
FROM ship s LEFT JOIN b ON b.frame_id = s.frame_id AND b.y = s.y AND b.x = s.x""")
def steiner_classes(spark, d):
    from ..functions import kernels as K

    def kernel(a):
        return K.background(np.nan_to_num(a), ~np.isnan(a), 3)

    p = src.ship(spark, d).select("frame_id", "y", "x", F.when(F.col("v") >= 10, F.col("v") / 2).alias("v"))
    both = p.join(I.by_frame(p, (24, 24), kernel, out="frame_id long, y int, x int, bkg double"), ["frame_id", "y", "x"], "left")
    core = (F.col("v") >= 45) | (F.col("v") - F.col("bkg") >= S.convective_peakedness(F.col("bkg")))
    return both.select("frame_id", "y", "x", S.echo_type(F.col("v"), core, 8.0, 15.0).alias("kind"))


@query()
def clouds_with_rain(spark, d):
    """Cold clouds of the monthly frames, joined by features of the item counts."""
    p = src.ship(spark, d)
    rain = p.select("frame_id", "y", "x", F.col("v2").cast("double").alias("v"))
    return I.clouds_with_rain(p, rain, (24, 24), {"core": 25, "cold": 45, "least_core": 2, "least_cold": 2}, 3.0, 3)


@query(LABELS_SQL + """ SELECT frame_id, feature, CAST(sum(CASE WHEN v > 65 THEN v ELSE 0 END) AS DOUBLE) AS total_rain, CAST(sum(CASE WHEN v > 100 THEN v ELSE 0 END) AS DOUBLE) AS total_heavyrain,
  count(*) FILTER (v > 65) AS rain_npix, CAST(max(v) AS DOUBLE) AS max_rain, arg_min(y, (-v) * 10000 + y * 100 + x) AS max_y, arg_min(x, (-v) * 10000 + y * 100 + x) AS max_x FROM labels GROUP BY ALL""")
def pf_totals(spark, d):
    return T.rain_totals(block_labels(spark, d), 100, 65)


@query(LABELS_SQL + f""", {GRID_SQL}, p AS (SELECT frame_id, feature, y % 8 // 4 * 2 + x % 8 // 4 AS pf, count(*) AS n, avg(land) AS landfrac FROM labels JOIN grid USING (y, x) GROUP BY ALL)
SELECT frame_id, feature, CAST(pf AS BIGINT) AS pf, round(landfrac, 6) AS pf_landfrac, row_number() OVER (PARTITION BY frame_id, feature ORDER BY n DESC, pf) AS pf_rank FROM p QUALIFY pf_rank <= 2""")
def pf_land(spark, d):
    rows = T.rain_stats(G.on_grid(_pf(spark, d), _grid(spark), ["land"]), 100, 2, "land")
    return rounded(rows.select("frame_id", "feature", "pf", "pf_landfrac", "pf_rank"))
