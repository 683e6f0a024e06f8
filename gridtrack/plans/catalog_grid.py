"""Queries over large, periodic, irregular and spherical grids, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import table_functions as T_FUNCTIONS
from ..operators import regrid as R
from ..operators import sphere as G
from ..operators import storms as W
from ..operators import tiles as T
from ..operators.scratch import folder
from ..sources import arrays as A
from ..sources import rasters as src
from .catalog import RECURSIVE, query, rounded


@query(RECURSIVE + " SELECT * FROM labels")
def tiled_labels(spark, d):
    """Frames of 8 x 8 cut to tiles of 3 x 3, whose labels meet across the seams."""
    return T.labels(src.emb(spark, d).where("v > 0"), (8, 8), (3, 3))


#: The same by recursion, with edges that meet: steps of one pixel round the axes.
ROUND = RECURSIVE.replace("abs(b.y - w.y) + abs(b.x - w.x) = 1", "least(abs(b.y - w.y), 8 - abs(b.y - w.y)) + least(abs(b.x - w.x), 8 - abs(b.x - w.x)) = 1")


@query(ROUND + " SELECT * FROM labels")
def periodic_labels(spark, d):
    """Labels on frames whose edges meet along both axes, over tiles of 3 x 5."""
    return T.labels(src.emb(spark, d).where("v > 0"), (8, 8), (3, 5), wrap="xy")


@query(f"""WITH {src.EMB_SQL}, cold AS (SELECT * FROM emb WHERE v > -0.05),
seed AS (SELECT frame_id, y, x, CAST(1 + (y // 4) * 2 + x // 4 AS BIGINT) AS feature FROM emb WHERE v > 0.15),
near AS (SELECT c.frame_id, c.y, c.x, s.feature, count(*) AS n FROM cold c JOIN seed s ON s.frame_id = c.frame_id AND abs(s.y - c.y) <= 1 AND abs(s.x - c.x) <= 1
  WHERE NOT EXISTS (SELECT 1 FROM seed o WHERE o.frame_id = c.frame_id AND o.y = c.y AND o.x = c.x) GROUP BY ALL),
one AS (SELECT frame_id, y, x, arg_max(feature, n * 100 - feature) AS feature FROM near GROUP BY ALL)
SELECT frame_id, y, x, feature, CAST(0 AS BIGINT) AS ring FROM seed UNION ALL SELECT frame_id, y, x, feature, 1 FROM one""")
def first_ring(spark, d):
    """Seeds, and the first ring of pixels that they grow over; the whole growth is :func:`tiles.grown`, as many such rings as it takes."""
    p = src.emb(spark, d)
    seeds = p.where("v > 0.15").select("frame_id", "y", "x", (1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("long").alias("feature"))
    return T.grown(seeds, p.where("v > -0.05"), (8, 8), rings=1)


@query()
def grown_by_rings(spark, d):
    """Growth of all seeds to its end, over edges that meet; tests compare it with a loop over pixels."""
    p = src.emb(spark, d)
    seeds = p.where("v > 0.2").select("frame_id", "y", "x", (1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("long").alias("feature"))
    return T.grown(seeds, p.where("v > -0.05"), (8, 8), wrap="xy")


#: A source grid of 5 degrees across the date line, a target grid of uneven bands: (index, lower and upper edge).
_SOURCE = ([(k, -60 + 5.0 * k, -55 + 5.0 * k) for k in range(24)], [(k, 150 + 3.0 * k, 153 + 3.0 * k) for k in range(24)])
_TARGET = ([(k, a, b) for k, (a, b) in enumerate(zip((-90.0, -61.5, -42.0, -11.0, 0.0, 23.25, 50.0), (-61.5, -42.0, -11.0, 0.0, 23.25, 50.0, 90.0)))], [(k, -180 + 7.2 * k, -172.8 + 7.2 * k) for k in range(50)])


def _edges(spark, rows, name):
    return spark.createDataFrame([(k, float(a), float(b)) for k, a, b in rows], f"{name} int, lo double, hi double")


@query(f"""WITH {src.SHIP_SQL}, sy(y, lo, hi) AS (SELECT k, -60 + 5.0 * k, -55 + 5.0 * k FROM range(24) r(k)), sx(x, lo, hi) AS (SELECT k, 150 + 3.0 * k, 153 + 3.0 * k FROM range(24) r(k)),
ty(y, lo, hi) AS (VALUES {', '.join(str(r) for r in _TARGET[0])}), tx(x, lo, hi) AS (SELECT k, -180 + 7.2 * k, -172.8 + 7.2 * k FROM range(50) r(k)),
wy AS (SELECT sy.y AS s, ty.y AS t, sin(radians(least(sy.hi, ty.hi)::DOUBLE)) - sin(radians(greatest(sy.lo, ty.lo)::DOUBLE)) AS w FROM sy JOIN ty ON sy.lo < ty.hi AND ty.lo < sy.hi),
wx AS (SELECT sx.x AS s, tx.x AS t, sum(radians((least(sx.hi, tx.hi + k) - greatest(sx.lo, tx.lo + k))::DOUBLE)) AS w FROM sx JOIN (SELECT tx.*, unnest([-360, 0, 360]) AS k FROM tx) tx ON sx.lo < tx.hi + k AND tx.lo + k < sx.hi GROUP BY ALL)
SELECT frame_id, CAST(wy.t AS INTEGER) AS y, CAST(wx.t AS INTEGER) AS x, round(sum(v * wy.w * wx.w) / sum(wy.w * wx.w), 5) AS v, round(sum(wy.w * wx.w) * 6371 * 6371, 2) AS area FROM ship JOIN wy ON wy.s = ship.y JOIN wx ON wx.s = ship.x GROUP BY ALL""")
def conservative_regrid(spark, d):
    """Monthly frames on uneven bands of latitude and 7.2 degrees of longitude, by exact areas on the sphere."""
    source, target = (tuple(_edges(spark, rows, c) for rows, c in zip(grid, "yx")) for grid in (_SOURCE, _TARGET))
    got = G.conservative(src.ship(spark, d).select("frame_id", "y", "x", "v"), source, target)
    return got.select("frame_id", "y", "x", F.round("v", 5).alias("v"), F.round("area", 2).alias("area"))


PLACES = "{k} AS {name}, ({k} * {a} % 1801) / 10.0 - 90 AS lat, ({k} * {b} % 3601) / 10.0 - 180 AS lon"
_CUSTOMERS, _SUPPLIERS = PLACES.format(k="c_custkey", name="target", a=37, b=101), PLACES.format(k="s_suppkey", name="point", a=53, b=211)


def _unit_sql(table: str, places: str, name: str) -> str:
    return f"(SELECT {name}, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM (SELECT {places} FROM {table}))"


@query(f"""SELECT target, arg_min(point, (d, point)) AS point, round(2 * 6371 * asin(sqrt(min(d)) / 2), 3) AS km FROM (SELECT target, point, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2), 14) AS d
FROM {_unit_sql('customer', _CUSTOMERS, 'target')} a, {_unit_sql('supplier', _SUPPLIERS, 'point')} b) WHERE d <= pow(2 * sin(radians(25.0) / 2), 2) GROUP BY target""")
def nearest_on_sphere(spark, d):
    """For each customer's place the nearest supplier's within 25 degrees, over the poles and the date line."""
    targets = src.table(spark, d, "customer").selectExpr(*_CUSTOMERS.replace("/ 10.0", "/ CAST(10 AS DOUBLE)").split(", "))
    points = src.table(spark, d, "supplier").selectExpr(*_SUPPLIERS.replace("/ 10.0", "/ CAST(10 AS DOUBLE)").split(", "))
    return rounded(G.nearest(targets, points, 25.0, 2.0), 3)


ORDER, SIDE = 4, 16
_BITS = lambda c, odd: " + ".join(f"((({c} >> {2 * k + odd}) & 1) << {k})" for k in range(ORDER))
CELLS_SQL = f"""cells AS (SELECT DISTINCT c_custkey * 7919 % {12 * SIDE * SIDE} AS cell FROM customer),
xy AS (SELECT cell, cell // {SIDE * SIDE} AS face, {_BITS('cell', 0)} AS x, {_BITS('cell', 1)} AS y FROM cells)"""


def _cells(spark, d):
    return src.table(spark, d, "customer").select((F.col("c_custkey") * 7919 % (12 * SIDE * SIDE)).alias("cell")).distinct()


@query(f"""WITH {CELLS_SQL}, r AS (SELECT *, (face // 4 + 2) * {SIDE} - x - y - 1 AS ring FROM xy), n AS (SELECT *, least(ring, {4 * SIDE} - ring, {SIDE}) AS per, CASE WHEN ring BETWEEN {SIDE} AND {3 * SIDE} THEN (ring - {SIDE}) % 2 ELSE 0 END AS late FROM r),
p AS (SELECT *, ((2 * (face % 4) + CASE WHEN face // 4 = 1 THEN 0 ELSE 1 END) * per + x - y + 1 + late) // 2 AS raw FROM n), q AS (SELECT *, CASE WHEN raw < 1 THEN raw + 4 * per WHEN raw > 4 * per THEN raw - 4 * per ELSE raw END AS place FROM p)
SELECT cell, ring, place, cell AS back, CASE WHEN ring < {SIDE} THEN 2 * per * (per - 1) WHEN ring > {3 * SIDE} THEN {12 * SIDE * SIDE} - 2 * per * (per + 1) ELSE {2 * SIDE * (SIDE - 1)} + (ring - {SIDE}) * {4 * SIDE} END + place - 1 AS ring_index FROM q""")
def cell_and_back(spark, d):
    """Nested cells by ring and place on it; their centres lead back to them, by way of the nested and of the ring number."""
    cells = _cells(spark, d)
    ring, place, _ = G.ring_place(F.col("cell"), ORDER)
    cells = cells.withColumns({"ring": ring, "place": place, "ring_index": G.ring_index(F.col("cell"), ORDER)})
    lat, lon = G.cell_centre(F.col("cell"), ORDER)
    by_ring = G.ring_centre(F.col("ring_index"), ORDER)
    cells = cells.withColumns({"lat": lat, "lon": lon, "rlat": by_ring[0], "rlon": by_ring[1]})
    back = cells.withColumns({"back": R.sphere_cell(F.col("lat"), F.col("lon"), ORDER), "again": R.sphere_cell(F.col("rlat"), F.col("rlon"), ORDER)})
    return back.select("cell", "ring", "place", F.when(F.col("back") == F.col("again"), F.col("back")).alias("back"), "ring_index")


_OVER = ", ".join(f"({bx}, {by}, {row}, {to[0]}, {to[1]})" for (bx, by), rows in G.CROSSED.items() for row, to in enumerate(rows) if to)
_STEPS = ", ".join(f"('{name}', {dx}, {dy})" for name, (dx, dy) in G.AROUND.items())
_NEST = "to_face * {n} + ".format(n=SIDE * SIDE) + " + ".join(f"(((tx >> {k}) & 1) << {2 * k}) + (((ty >> {k}) & 1) << {2 * k + 1})" for k in range(ORDER))


@query(f"""WITH {CELLS_SQL}, way(name, dx, dy) AS (VALUES {_STEPS}), edge(px, py, row, r, turn) AS (VALUES {_OVER}),
s AS (SELECT cell, face, name, x + dx AS sx, y + dy AS sy, CASE WHEN x + dx < 0 THEN -1 WHEN x + dx >= {SIDE} THEN 1 ELSE 0 END AS px, CASE WHEN y + dy < 0 THEN -1 WHEN y + dy >= {SIDE} THEN 1 ELSE 0 END AS py FROM xy, way),
t AS (SELECT s.*, r * 4 + (face % 4 + turn) % 4 AS to_face, sx - s.px * {SIDE} AS wx, sy - s.py * {SIDE} AS wy, (face // 4 = 0 AND (s.px > 0 OR s.py > 0)) OR (face // 4 = 2 AND (s.px < 0 OR s.py < 0)) AS turned
  FROM s JOIN edge ON edge.px = s.px AND edge.py = s.py AND edge.row = face // 4),
u AS (SELECT *, CASE WHEN NOT turned THEN wx WHEN px <> 0 AND py <> 0 THEN {SIDE - 1} - wx WHEN px <> 0 THEN wy ELSE {SIDE - 1} - wy END AS tx,
  CASE WHEN NOT turned THEN wy WHEN px <> 0 AND py <> 0 THEN {SIDE - 1} - wy WHEN px <> 0 THEN {SIDE - 1} - wx ELSE wx END AS ty FROM t)
SELECT cell, name, CAST({_NEST} AS BIGINT) AS neighbour FROM u""")
def cell_neighbours(spark, d):
    """The cells around each cell, a row for each direction that has one."""
    rows = G.neighbours(_cells(spark, d), "cell", ORDER)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"around.{n}").alias("neighbour")) for n in G.AROUND]))
    return rows.select("cell", pairs.alias("p")).select("cell", "p.name", "p.neighbour").where("neighbour IS NOT NULL")


_AT = "LEFT JOIN {t} o ON o.f = p.f AND o.y = least(greatest(p.y + a, 0), 15) AND o.x = least(greatest(p.x + b, 0), 7)"

_COUNT = "SELECT p.f, p.y, p.x, count(*) FILTER (o.c = 2) AS n FROM (SELECT * FROM {t}, step) p " + _AT + " GROUP BY ALL"


@query(f"""WITH {src.EMB_SQL}, vol AS (SELECT frame_id // 16 AS f, y AS z, frame_id % 16 AS y, x, v * 250 + 18 AS v FROM emb WHERE v * 250 + 18 > -10), step(a, b) AS (SELECT i, j FROM range(-1, 2) s(i), range(-1, 2) t(j)),
r AS (SELECT * FROM vol UNION ALL SELECT f, 1, y, x, v FROM vol b WHERE z = 2 AND v >= 20 AND NOT EXISTS (SELECT 1 FROM vol a WHERE a.f = b.f AND a.y = b.y AND a.x = b.x AND a.z = 1)),
mid AS (SELECT p.f, p.z, p.y, p.x, p.v, median(o.v) AS m FROM (SELECT * FROM r, step WHERE z <= 5) p JOIN r o ON o.f = p.f AND o.z = p.z AND o.y = least(greatest(p.y + a, 0), 15) AND o.x = least(greatest(p.x + b, 0), 7) GROUP BY ALL),
stood AS (SELECT f, y, x, count(*) FILTER (v - m > greatest(10 - v * v / 337.5, 4)) AS n, count(*) AS levels FROM mid GROUP BY ALL),
full_ AS (SELECT p.f, p.z, p.y, p.x FROM (SELECT * FROM r, step) p JOIN r o ON o.f = p.f AND o.z = p.z AND o.y = least(greatest(p.y + a, 0), 15) AND o.x = least(greatest(p.x + b, 0), 7) GROUP BY ALL HAVING count(*) >= 6.3),
rise AS (SELECT DISTINCT l.f, l.y, l.x FROM r l JOIN r u ON u.f = l.f AND u.y = l.y AND u.x = l.x AND u.z = l.z + 1 AND u.v - l.v >= 8 JOIN full_ w ON w.f = l.f AND w.z = l.z AND w.y = l.y AND w.x = l.x WHERE l.z <= 4),
col AS (SELECT f, y, x, max(v) AS highest, coalesce(max(v) FILTER (z >= 4), -99) AS aloft, max(z) FILTER (v >= 25) AS top, coalesce(max(v) FILTER (z = 1), -99) AS v3, coalesce(max(v) FILTER (z = 0), -99) AS below, coalesce(max(v) FILTER (z >= 1), -99) AS upper, count(*) FILTER (z BETWEEN 1 AND 3) AS middle FROM r GROUP BY ALL),
c0 AS (SELECT col.*, rise.f IS NOT NULL AS rises, CASE WHEN coalesce(n >= 0.3 * levels, FALSE) OR aloft >= 45 OR coalesce(top >= 7, FALSE) THEN 2 ELSE 0 END AS c FROM col LEFT JOIN stood USING (f, y, x) LEFT JOIN rise USING (f, y, x)),
c1 AS (SELECT c0.* EXCLUDE (c), CASE WHEN c = 2 AND n / 9.0 <= 0.15 THEN 0 ELSE c END AS c FROM c0 JOIN ({_COUNT.format(t="c0")}) USING (f, y, x)),
c2 AS (SELECT c1.* EXCLUDE (c), CASE WHEN n > 0 AND highest >= 25 THEN 2 ELSE c END AS c FROM c1 JOIN ({_COUNT.format(t="c1")}) USING (f, y, x)),
c3 AS (SELECT * EXCLUDE (c), CASE WHEN c = 2 THEN CASE WHEN rises AND highest >= 40 THEN 1 ELSE 2 END WHEN v3 >= 20 OR below >= 10 THEN 3 WHEN upper >= 0 AND middle = 0 THEN 5 WHEN upper >= 0 THEN 4 ELSE 0 END AS c FROM c2),
c4 AS (SELECT p.f, p.y, p.x, CASE WHEN p.c = 1 AND count(*) FILTER (o.c = 1) / 9.0 <= 0.15 THEN median(coalesce(o.c, 0)) ELSE p.c END AS c FROM (SELECT * FROM c3, step) p {_AT.format(t="c3")} GROUP BY p.f, p.y, p.x, p.c)
SELECT f AS frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(c AS BIGINT) AS sl_class FROM c4 WHERE c > 0 AND y BETWEEN 1 AND 14 AND x BETWEEN 1 AND 6""")
def storm_classes(spark, d):
    """Volumes of 16 x 8 columns with 8 levels, from the vectors."""
    v = F.col("v") * 250 + 18
    volume = src.emb(spark, d).select(F.floor(F.col("frame_id") / 16).alias("frame_id"), F.col("y").alias("z"), (F.col("frame_id") % 16).cast("int").alias("y"), "x", F.when(v > -10, v).alias("v"))
    return W.storm_classes(volume, (16, 8), [0.5 + 1.5 * k for k in range(8)], 4.0, 1)


@query(RECURSIVE + " SELECT * FROM labels")
def labels_in_sql(spark, d):
    """The labels of :func:`catalog.label_components`, asked for in SQL."""
    T_FUNCTIONS.register(spark)
    src.emb(spark, d).createOrReplaceTempView("gridtrack_pixels")
    return spark.sql("SELECT * FROM label_frames(TABLE(gridtrack_pixels) PARTITION BY frame_id, identifier => 'threshold', ny => 8, nx => 8, low => 0.0)")


@query("""WITH t AS (SELECT event_id, ts + to_microseconds(event_id * 37 % 1000 * 1000) AS moment, value FROM events)
SELECT event_id, epoch(date_trunc('second', moment + INTERVAL 500 MILLISECONDS))::BIGINT AS second, round(greatest(value * 2.5 - 40, 0), 6) AS amount FROM t""")
def rounded_seconds(spark, d):
    """Times of events to the nearest second, and an amount in other units that is never negative."""
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") * 37 % 1000 * 1000)
    rows = src.table(spark, d, "events").select("event_id", F.unix_seconds(S.nearest_second(at)).alias("second"), S.positive(F.col("value") - 16, 2.5).alias("amount"))
    return rounded(rows)


_PARTS = "year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d"


@query(f"""WITH p AS (SELECT o_orderkey, {_PARTS}, o_orderkey % 24 AS h FROM orders)
SELECT o_orderkey, CAST(y * 365 + [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][m] + d - 1 AS BIGINT) * 86400 + h * 3600 AS noleap, CAST(y * 360 + (m - 1) * 30 + d - 1 AS BIGINT) * 86400 + h * 3600 AS days360,
CAST(epoch(make_date(y, m, d)) AS BIGINT) + h * 3600 AS standard FROM p""")
def calendar_times(spark, d):
    """Seconds of an order's day and an hour in calendars of 365 and of 360 days and in the standard one."""
    day = F.col("o_orderdate")
    parts = F.year(day), F.month(day), F.day(day), F.col("o_orderkey") % 24
    return src.table(spark, d, "orders").select("o_orderkey", *[S.calendar_seconds(*parts, c).alias(name) for c, name in (("noleap", "noleap"), ("360_day", "days360"), ("standard", "standard"))])


@query(f"WITH {src.SHIP_SQL} SELECT frame_id, y, x, CAST(v AS DOUBLE) AS v, CAST(v2 AS DOUBLE) AS v2 FROM ship WHERE frame_id BETWEEN 23930 AND 23965 AND y BETWEEN 5 AND 17 AND x >= 8")
def chunked_box(spark, d):
    """Monthly frames as arrays of two variables in chunks of 12 frames by 8 x 8 pixels, and a box of three years read back from them."""
    path = f"{folder(spark.sparkContext.getConf().get('spark.checkpoint.dir'), spark.sparkContext.master)}/arrays-{uuid.uuid4().hex}"
    A.write_arrays(src.ship(spark, d), path, (24, 24), (12, 8, 8), ["v", "v2"])
    return A.read_arrays(spark, path, ["v", "v2"], frames=(23930, 23965), rows=(5, 17), columns=(8, 23), per_task=4)
