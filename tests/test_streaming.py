import datetime as dt
import random

import pytest

from gridtrack.operators import link, number
from gridtrack.streaming import numbers

SCHEMA = "domain string, frame_id long, base_time long, y int, x int, feature long, ts timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def frames(rng, count=14):
    """Boxes that drift, meet, part, come and go; some frames are empty, and the time between two is at times over the gap."""
    t, boxes, out = 3600, [[rng.randrange(8), rng.randrange(8), rng.randint(1, 3)] for _ in range(4)], []
    for k in range(count):
        t += rng.choice([3600, 3600, 3600, 20000])
        label = {}
        for y, x, r in boxes:
            label |= {(b, a): 10 * y // 10 * 10 + x + 1 for b in range(y, y + r) for a in range(x, x + r)}
        ids = {v: n for n, v in enumerate(sorted(set(label.values())), 1)}
        out.append((k, t, [(b, a, ids[v]) for (b, a), v in label.items()]))
        boxes = [[max(0, y + rng.choice([-1, 0, 0, 1])), max(0, x + rng.choice([-1, 0, 0, 1])), r] for y, x, r in boxes if rng.random() < 0.9] + [[rng.randrange(8), rng.randrange(8), rng.randint(1, 3)] for _ in range(rng.choice([0, 0, 1]))]
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_streamed_numbers_are_those_of_a_whole_run(rocks, tmp_path, seed):
    """Whatever the cuts between batches; the query is stopped and started again from its checkpoint on the way."""
    spark, rng = rocks, random.Random(seed)
    given = {d: frames(rng) for d in ("a", "b")}
    rows = [(d, k, t, y, x, f, dt.datetime.fromtimestamp(t)) for d, fs in given.items() for k, t, px in fs for y, x, f in px or [(0, 0, None)]]
    rows.sort(key=lambda r: (r[2], r[0]))
    end = max(r[2] for r in rows)
    source, out = tmp_path / "in", []
    source.mkdir()
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    # Late enough that the watermark passes every gap; the second one lets the timers run.
    parts += [[("z", 0, end + 200000 + k, 0, 0, None, dt.datetime.fromtimestamp(end + 200000 + k))] for k in (0, 1)]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if n in (2, len(parts) - 2, len(parts) - 1):  # three runs from one checkpoint
            read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(source))
            q = numbers.numbered(read, 0.3, 1.5, late="1 day").writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(120)
    for d, fs in given.items():
        f = spark.createDataFrame([(k, t) for k, t, _ in fs], "frame_id long, base_time long")
        labels = spark.createDataFrame([(k, y, x, n) for k, _, px in fs for y, x, n in px], "frame_id long, y int, x int, feature long")
        features = labels.groupBy("frame_id", "feature").count().withColumnRenamed("count", "npix")
        want = number.track_numbers(f, features, link.overlaps(labels, link.frame_pairs(f, 1.5), 0.3), 1.5)
        want = sorted(((r.frame_id, r.feature, r.track, r.status, r.merge_track, r.split_track, r.reset) for r in want.collect()), key=str)
        got = sorted((r[1:] for r in out if r[0] == d), key=str)
        assert got == want
