"""Identifiers as table functions, for those who write SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class LabelFrames:
    """``SELECT * FROM label_frames(TABLE(pixels) PARTITION BY frame_id, identifier => 'threshold', ny => 480, nx => 690, low => 3.0)``.

    The table has frame_id, y, x and v; the other arguments are the identifier's own (a list as an array).  Rows are (frame_id,
    y, x, feature).  A partition is a frame, or several, and one frame's pixels are held at a time if they come in order.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, identifier: AnalyzeArgument, ny: AnalyzeArgument, nx: AnalyzeArgument, **settings: AnalyzeArgument) -> AnalyzeResult:
        from gridtrack.operators.identify import KERNELS

        if not table.isTable or not {"frame_id", "y", "x", "v"} <= {f.name.lower() for f in table.dataType.fields}:
            raise ValueError("the first argument has to be a table with frame_id, y, x and v")
        if identifier.value not in KERNELS:
            raise ValueError(f"identifier has to be one of {', '.join(sorted(KERNELS))}")
        KERNELS[identifier.value](**{k: _plain(a.value) for k, a in settings.items()})
        return AnalyzeResult(StructType().add("frame_id", LongType()).add("y", IntegerType()).add("x", IntegerType()).add("feature", LongType()))

    def __init__(self):
        self.frame, self.rows = None, []

    def eval(self, table, identifier, ny, nx, **settings):
        if self.frame is not None and table["frame_id"] != self.frame:
            yield from self._labelled()
        if self.frame is None:
            from gridtrack.operators.identify import KERNELS

            self.kernel, self.shape = KERNELS[identifier](**{k: _plain(v) for k, v in settings.items()}), (ny, nx)
        self.frame = table["frame_id"]
        self.rows.append((table["y"], table["x"], table["v"]))

    def terminate(self):
        if self.frame is not None:
            yield from self._labelled()

    def _labelled(self):
        y, x, v = zip(*self.rows)
        a = np.full(self.shape, np.nan)
        a[list(y), list(x)] = np.array(v, float)
        got = self.kernel(a)
        for b, c in zip(*(p.tolist() for p in np.nonzero(got))):
            yield self.frame, b, c, int(got[b, c])
        self.rows = []


def _plain(v):
    """A setting as Python has it: decimals of SQL as floats."""
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def register(spark: SparkSession) -> None:
    """Makes ``label_frames`` known to the session's SQL."""
    spark.udtf.register("label_frames", udtf(LabelFrames))
