import time

import pytest
from pyspark.sql import functions as F

from gridtrack.operators import columns, motion, regrid, tracks
from gridtrack.plans import config, tracking
from gridtrack.sources import rasters, tables
from gridtrack.streaming import frames as stream


def test_whole_run(spark, tmp_path):
    (tmp_path / "run.yml").write_text("ny: 40\nnx: 60\nleast_pixels: 3\ntimegap: 1.5\nothresh: 0.3\nleast_times: 2\nmain_times: 5\nmain_area: 30\n")
    cfg = config.load(str(tmp_path / "run.yml"))
    centres = [(t, 12 + t, 10 + t, 5) for t in range(8)] + [(t, 30, 45 - t, 4) for t in range(3)] + [(5, 35, 5, 3)]
    pixels = rasters.blobs(spark, centres, 40, 60).where("v > 0")
    f = spark.range(8).select(F.col("id").alias("frame_id"), (F.col("id") * 3600).alias("base_time"))
    out = tracking.run(pixels, f, cfg)
    life = {r.track: (r.duration, r.start_basetime, r.end_basetime) for r in out["tracks"].collect()}
    assert life == {1: (8, 0, 7 * 3600), 2: (3, 0, 2 * 3600)}
    assert [r.track for r in out["main"].collect()] == [1]
    assert out["masks"].where("tracknumber = 1").select("frame_id").distinct().count() == 8
    stats = out["track_stats"].where("track = 1").orderBy("t_idx").collect()
    assert [round(r.mean_y) for r in stats] == [12 + t for t in range(8)]
    with pytest.raises(ValueError):
        (tmp_path / "bad.yml").write_text("ny: 1\nnx: 1\nunknown: 2\n")
        config.load(str(tmp_path / "bad.yml"))


def test_dense_and_sparse(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, 1), (1, 2, 7.0, 2), (2, 1, None, 4)], "track long, t_idx long, a double, b int")
    d = tables.dense(rows, ["a", "b"], 4)
    assert {r.track: (r.a, r.b) for r in d.collect()} == {1: ([5.0, None, 7.0, None], [1, None, 2, None]), 2: ([None] * 4, [None, 4, None, None])}
    assert sorted(map(str, tables.sparse(d, ["a", "b"]).collect())) == sorted(map(str, rows.collect()))


def test_scan_and_sink(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 3600).alias("base_time"), F.col("id").alias("v"), F.floor(F.col("id") / 24).alias("day"))
    tables.write(df, f"{tmp_path}/t", ["day"], ["v"])
    got = tables.scan(spark, f"{tmp_path}/t", "19700102.0000", "19700102.2300", columns=["v"])
    assert [r.v for r in got.orderBy("v").collect()] == list(range(24, 48))
    assert tables.time_span(df).first().end_basetime == 99 * 3600
    assert tables.sampled_hourly(df, 0, 1).count() == 100 and tables.sampled_hourly(df, 30, 5).count() == 0
    df.limit(3).write.parquet(f"{tmp_path}/named_20200102_0304.parquet")
    df.select("v").limit(3).coalesce(1).write.parquet(f"{tmp_path}/named")
    (part,) = (tmp_path / "named").glob("part-*.parquet")
    part.rename(tmp_path / "field_20200102_0304.parquet")
    assert tables.scan_named(spark, f"{tmp_path}/field_20200102_0304.parquet", 7).first().base_time == 1577934240
    assert tables.scan_named(spark, f"{tmp_path}/field_20200102_0304.parquet", 9).first().base_time is None


def test_cells_of_the_sphere(spark):
    """Cells have equal area, so points spread evenly over the sphere fall evenly, and order 0 has 12 faces."""
    n = 40000
    p = spark.range(n).select(F.degrees(F.asin(1 - (2 * F.col("id") + 1) / n)).alias("lat"), F.pmod(F.col("id") * 137.50776405003785, F.lit(360.0)).alias("lon"))
    for order in (0, 1, 2):
        c = p.groupBy(regrid.sphere_cell(F.col("lat"), F.col("lon"), order).alias("c")).count().collect()
        want = n / (12 * 4**order)
        assert len(c) == 12 * 4**order and {r.c for r in c} == set(range(12 * 4**order))
        assert all(abs(r["count"] - want) < 0.1 * want + 5 for r in c)
    corner = spark.range(1).select(regrid.sphere_cell(F.lit(89.9), F.lit(1.0), 1), regrid.sphere_cell(F.lit(-89.9), F.lit(1.0), 1), regrid.sphere_cell(F.lit(0.1), F.lit(0.1), 0)).first()
    assert tuple(corner) == (3, 32, 4)


def test_levels(spark):
    prof = spark.createDataFrame([("a", z, float(z), v) for z, v in enumerate([5.0, 3.0, -1.0, -2.0])], "k string, z int, height double, v double")
    assert columns.crossing_height(prof, ["k"]).first().crossing == pytest.approx(1.75)
    got = {r.level: r.v for r in columns.at_levels(prof, ["k"], [0.5, 2.25]).collect()}
    assert got == {0.5: pytest.approx(4.0), 2.25: pytest.approx(-1.25)}
    assert columns.column_class(prof, ["k"], 1.5, 4.0, 3.0).first().sl_class == 2


def test_speed_filter(spark):
    rows = spark.createDataFrame([(1, t, float(t * t) if t != 4 else 999.0) for t in range(8)], "track long, t_idx long, speed double")
    got = {r.t_idx: r.speed for r in motion.filtered_speeds(rows, 500.0).collect()}
    assert got[4] == pytest.approx(16.0)


def test_interpolation_keeps_open_ends(spark):
    rows = spark.createDataFrame([(1, t, 3600 * t, v) for t, v in enumerate([None, 1.0, None, 3.0, None])], "track long, t_idx long, base_time long, v double")
    assert [r.v_filled for r in tracks.interpolated(rows, "v").orderBy("t_idx").collect()] == [None, 1.0, 2.0, 3.0, None]


def test_streamed_links(spark, tmp_path):
    src, out = f"{tmp_path}/in", []
    schema = "domain string, frame_id long, y int, x int, feature long"
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    # Frame 1 comes in two batches, a row of frame 0 late, frame 9 after a gap; a row without a feature closes it.
    for k, rows in enumerate([[("d", 0, 1, x, 1) for x in range(4)], [("d", 1, 1, x + 1, 7) for x in range(2)], [("d", 1, 1, x + 1, 7) for x in range(2, 4)], [("d", 0, 1, x, 9) for x in range(4)], [("d", 2, 1, x, 8) for x in range(2, 6)], [("d", 9, 1, x, 3) for x in range(2, 6)], [("d", 10, 0, 0, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    q = stream.linked(read, 0.2, max_step=3).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(out) == [("d", 0, 1, 1, 7, 3, 0.75), ("d", 1, 2, 7, 8, 3, 0.75)]


def test_calendars(spark):
    from gridtrack.functions import scalar as S

    one = spark.range(1)
    day = lambda y, m, d, c: one.select(S.calendar_seconds(F.lit(y), F.lit(m), F.lit(d), F.lit(0), c)).first()[0]
    assert day(2001, 3, 1, "noleap") - day(2000, 3, 1, "noleap") == 365 * 86400
    assert day(2000, 3, 1, "noleap") - day(2000, 2, 28, "noleap") == 86400
    assert day(2000, 3, 1, "360_day") - day(2000, 2, 1, "360_day") == 30 * 86400
    assert day(1970, 1, 2, "standard") == 86400


def test_run_is_written_by_date(spark, tmp_path):
    from gridtrack.sources import tables

    frames = spark.createDataFrame([(0, 0), (1, 86400), (2, 90000)], "frame_id long, base_time long")
    labels = spark.createDataFrame([(k, 1, x, 1) for k in range(3) for x in range(4)], "frame_id long, y int, x int, feature long")
    once = spark.createDataFrame([(1, 3)], "track long, duration long")
    tables.write_run({"labels": labels, "tracks": once}, frames, f"{tmp_path}/run")
    back = spark.read.parquet(f"{tmp_path}/run/labels")
    assert {(str(r.date), r.frame_id) for r in back.collect()} == {("1970-01-01", 0), ("1970-01-02", 1), ("1970-01-02", 2)} and back.count() == 12
    tables.write_run({"tracks": once.limit(0)}, frames, f"{tmp_path}/run", mode="ignore")
    assert spark.read.parquet(f"{tmp_path}/run/tracks").count() == 1


def test_guards_stop_a_run(spark):
    from gridtrack.operators import tracks

    rows = spark.createDataFrame([(0, k) for k in range(5)] + [(1, 0)], "frame_id long, feature long")
    assert tracks.guarded(rows, ["frame_id"], 5, "objects").count() == 6
    with pytest.raises(Exception, match="over 4 objects: 5"):
        tracks.guarded(rows, ["frame_id"], 4, "objects").count()


def test_masks_read_labels_as_they_lie(spark):
    """Labels are stored in buckets by object: neither statistics nor masks shuffle them."""
    from gridtrack.operators import tracks
    from gridtrack.plans import tracking
    from gridtrack.plans.config import Config
    from gridtrack.sources import rasters

    pixels = rasters.blobs(spark, [(t, 6 + t, 8, 4) for t in range(5)], 24, 24)
    frames = spark.createDataFrame([(t, 3600 * t) for t in range(5)], "frame_id long, base_time long")
    out = tracking.run(pixels, frames, Config(ny=24, nx=24, least_pixels=1, othresh=0.3, timegap=1.5))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else a small side goes to all tasks, and nothing is shuffled anyway
    try:
        for df in (tracks.feature_stats(out["labels"]), tracks.painted(out["labels"].select("frame_id", "y", "x", "feature"), out["track_stats"].select("frame_id", "feature", "track", "merge_track", "split_track"))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scan = next(line for line in plan.split("\n") if "scratch_labels" in line or "Bucketed: true" in line)
            above = plan[: plan.index(scan)].split("\n")
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            path, at = [], depth(scan)
            for line in reversed(above):
                if line.strip() and depth(line) < at:
                    path.append(line)
                    at = depth(line)
            assert "Bucketed: true" in plan and not any("Exchange" in line for line in path), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.tracknumber for r in out["masks"].collect()} == {1}
