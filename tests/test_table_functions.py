import numpy as np
import pytest

from gridtrack.functions import table_functions
from gridtrack.operators import identify


def test_identifiers_in_sql(spark):
    """The table function gives what the operators give, with settings of all kinds."""
    table_functions.register(spark)
    a = np.random.default_rng(2).random((4, 9, 11)) * 100
    rows = [(f, y, x, None if a[f, y, x] > 95 else float(a[f, y, x])) for f, y, x in np.ndindex(a.shape)]
    pixels = spark.createDataFrame(rows, "frame_id long, y int, x int, v double")
    pixels.createOrReplaceTempView("some_pixels")
    ask = "SELECT * FROM label_frames(TABLE(some_pixels) PARTITION BY frame_id, identifier => '{}', ny => 9, nx => 11, {})"
    wants = [
        ("threshold", "low => 40.0, eight => true, wrap => 'xy'", identify.threshold_labels(pixels, (9, 11), 40, eight=True, wrap="xy")),
        ("watershed", "least => 20.5, peak => 60, distance => 1", identify.watershed_labels(pixels, (9, 11), 20.5, 60, 1)),
        ("label_grow", "core => 15, cold => 50, least_core => 1, least_cold => 2", identify.label_and_grow(pixels, (9, 11), 15, 50, 1, 2)),
        ("convective", "radius => 3, truncation => 60, weak => 10, least => 0, dilate => array(1.0, 2.0)", identify.convective_cells(pixels, (9, 11), 3, 60, 10, 0, (1.0, 2.0))),
    ]
    for name, settings, want in wants:
        assert sorted(map(tuple, spark.sql(ask.format(name, settings)).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="identifier has to be one of"):
        spark.sql(ask.format("nothing", "low => 1.0"))
    with pytest.raises(Exception, match="unexpected keyword"):
        spark.sql(ask.format("threshold", "lower => 1.0"))
