import json
import os
import zlib

import numpy as np
import pytest
from gridtrack.sources import arrays

SCHEMA = "frame_id long, y int, x int, tb double, n long"


def cube(seed, shape, frames):
    rng = np.random.default_rng(seed)
    return [(int(frames[t]), y, x, None if rng.random() < 0.1 else float(rng.random()), int(rng.integers(9))) for t, y, x in np.ndindex(shape) if rng.random() < 0.7]


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_and_ranges(spark, tmp_path):
    frames = [3, 4, 9, 20, 21]
    rows, path = cube(1, (5, 7, 10), frames), f"file://{tmp_path}/store"
    arrays.write_arrays(spark.createDataFrame(rows, SCHEMA), path, (7, 10), (2, 3, 4), ["tb", "n"])
    got = arrays.read_arrays(spark, path, ["tb", "n"])
    want = [(f, y, x, tb, float(n)) for f, y, x, tb, n in rows]
    order = lambda r: (r[:3], str(r[3]))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    for frames, ys, xs in (((4, 20), None, None), (None, (2, 2), (4, 99)), ((9, 9), (0, 3), (1, 1)), ((100, 200), None, None)):
        box = arrays.read_arrays(spark, path, ["tb", "n"], frames=frames, rows=ys, columns=xs)
        inside = lambda r: all(k is None or k[0] <= v <= k[1] for k, v in zip((frames, ys, xs), r))
        assert sorted(map(tuple, box.collect()), key=order) == sorted(filter(inside, want), key=order)
        assert sorted(map(tuple, box.where("n = 3 OR y > 5").collect()), key=order) == sorted((r for r in want if inside(r) and (r[4] == 3 or r[1] > 5)), key=order)
    assert as_rows(arrays.read_arrays(spark, path, ["n"], per_task=5)) == sorted((f, y, x, float(n)) for f, y, x, _, n in rows)


def test_a_box_reads_its_chunks_only(spark, tmp_path):
    rows, path = [(t, y, x, 1.0 * t, 0) for t, y, x in np.ndindex(4, 6, 6)], str(tmp_path / "store")
    arrays.write_arrays(spark.createDataFrame(rows, SCHEMA), path, (6, 6), (2, 3, 3), ["tb"])
    assert len([n for n in os.listdir(f"{path}/tb") if n[0] != "."]) == 8
    for name in os.listdir(f"{path}/tb"):
        if name[0] != "." and name != "1.0.1":
            with open(f"{path}/tb/{name}", "wb") as f:
                f.write(b"not a chunk")
    box = arrays.read_arrays(spark, path, ["tb"], frames=(2, 9), rows=(0, 2), columns=(3, 4))
    assert box.count() == 12 and box.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="incorrect header"):
        arrays.read_arrays(spark, path, ["tb"]).count()


def test_stores_of_others(spark, tmp_path):
    """Whole numbers with a fill value, no compression, columns first, a chunk that is not there."""
    a = np.arange(2 * 3 * 5, dtype="<i2").reshape(2, 3, 5)
    os.makedirs(tmp_path / "v"), os.makedirs(tmp_path / "step")
    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    (tmp_path / "v/.zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 3, 5], "chunks": [2, 3, 3], "dtype": "<i2", "compressor": None, "fill_value": 7, "order": "F", "filters": None}))
    (tmp_path / "v/0.0.0").write_bytes(a[:, :, :3].tobytes(order="F"))
    (tmp_path / "step/.zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2], "chunks": [1], "dtype": "<i4", "compressor": {"id": "gzip", "level": 1}, "fill_value": 0, "order": "C", "filters": None}))
    for k in range(2):
        (tmp_path / f"step/{k}").write_bytes(zlib.compress(np.array([10 + k], "<i4").tobytes(), wbits=31))
    got = arrays.read_arrays(spark, str(tmp_path), ["v"], frame="step")
    assert got.columns == ["step", "y", "x", "v"]
    assert as_rows(got) == [(10 + t, y, x, int(a[t, y, x])) for t, y, x in np.ndindex(2, 3, 3) if a[t, y, x] != 7]


def test_errors_and_empty(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(Exception, match="two rows for one pixel"):
        arrays.write_arrays(make([(1, 0, 0, 1.0, 1), (1, 0, 0, 2.0, 1)]), str(tmp_path / "a"), (2, 2), (1, 2, 2), ["tb"])
    with pytest.raises(Exception, match="not written to its end"):
        arrays.read_arrays(spark, str(tmp_path / "a"), ["tb"]).count()
    with pytest.raises(Exception, match="outside the array"):
        arrays.write_arrays(make([(1, 2, 0, 1.0, 1)]), str(tmp_path / "b"), (2, 2), (1, 2, 2), ["tb"])
    arrays.write_arrays(make([]), str(tmp_path / "c"), (2, 2), (1, 2, 2), ["tb"])
    assert arrays.read_arrays(spark, str(tmp_path / "c"), ["tb"]).count() == 0
    with pytest.raises(ValueError, match="there already"):
        arrays.write_arrays(make([]), str(tmp_path / "c"), (2, 2), (1, 2, 2), ["tb"])
    arrays.write_arrays(make([(1, 1, 0, 1.0, 1)]), str(tmp_path / "c"), (2, 2), (1, 2, 2), ["tb"], overwrite=True)
    assert as_rows(arrays.read_arrays(spark, str(tmp_path / "c"), ["tb"])) == [(1, 1, 0, 1.0)]
    with pytest.raises(Exception, match="name the variables"):
        arrays.read_arrays(spark, str(tmp_path / "c"), []).count()
