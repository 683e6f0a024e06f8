import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.operators import climatology, tracks


def test_as_numpy(spark):
    """Groups of one to many values, with ties, missing values and a null key."""
    rng = np.random.default_rng(0)
    groups = {k: rng.normal(0, 5, n).round(d).tolist() for k, (n, d) in enumerate([(1, 3), (2, 3), (7, 0), (500, 1), (3000, 6)])} | {None: [4.0, 1.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(9, None)]
    got = climatology.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], F.col("v"), {"a": 0.0, "b": 0.25, "c": 0.95, "d": 1.0}).collect()
    want = {k: np.quantile(v, [0, 0.25, 0.95, 1]).tolist() for k, v in groups.items()}
    assert {r.k: pytest.approx([r.a, r.b, r.c, r.d]) for r in got} == want


def test_one_large_group(spark):
    """A million values of one group, spread over ranges; no aggregate's buffer grows with the group."""
    rows = spark.range(10**6).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 999983 / 3).alias("v"))
    out = climatology.quantiles(rows, ["k"], F.col("v"), {"q10": 0.1, "q50": 0.5})
    assert "percentile" not in out._jdf.queryExecution().toString().lower() and "collect_" not in out._jdf.queryExecution().toString()
    (r,) = out.collect()
    v = np.arange(10**6, dtype=np.int64) * 7919 % 999983 / 3
    assert (r.q10, r.q50) == pytest.approx(tuple(np.quantile(v, [0.1, 0.5])))


def test_nearest_in_time_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, 100, "a"), (1, 100, "a"), (1, 100, "b"), (2, 5, "c")], "k int, t long, x string")
    right = spark.createDataFrame([(1, 90, 1), (1, 111, 2), (2, 900, 3)], "k int, t long, w int")
    got = sorted((r.k, r.t, r.x, r.nearest.w) for r in tracks.nearest_in_time(left, right, ["k"], "t", 60).collect())
    assert got == [(1, 100, "a", 1), (1, 100, "a", 1), (1, 100, "b", 1)]
