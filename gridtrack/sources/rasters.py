"""Gridded fields: from tables of the driver, and synthetic ones with a known answer.

A raster is a long table (frame_id, y, x, v); absent pixels are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, sf_dir: str, size: int = 24) -> DataFrame:
    """Monthly frames of shipped quantity (v) and number of items (v2) on a square grid of suppliers and parts."""
    d = F.col("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select((F.year(d) * 12 + F.month(d)).cast("long").alias("frame_id"), (F.col("l_suppkey") % size).cast("int").alias("y"), (F.col("l_partkey") % size).cast("int").alias("x"), "l_quantity")
    return rows.groupBy("frame_id", "y", "x").agg(F.sum("l_quantity").cast("long").alias("v"), F.count("*").alias("v2"))


SHIP_SQL = """ship AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS frame_id, CAST(l_suppkey % 24 AS INTEGER) AS y,
  CAST(l_partkey % 24 AS INTEGER) AS x, CAST(sum(l_quantity) AS BIGINT) AS v, count(*) AS v2 FROM lineitem GROUP BY ALL)"""


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hourly frames of event values in hundredths; y is the user modulo 12, x the twelfth of the hour."""
    rows = table(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.groupBy(F.floor(seconds / 21600).alias("frame_id"), (F.col("user_id") % 12).cast("int").alias("y"), F.floor(F.minute("ts") / 5).cast("int").alias("x")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))


EVT_SQL = """evt AS (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS frame_id, CAST(user_id % 12 AS INTEGER) AS y, CAST(minute(ts) // 5 AS INTEGER) AS x,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY ALL)"""


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 frame for each vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("p", "f")).select("frame_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("f").cast("double").alias("v"))


EMB_SQL = """emb AS (SELECT vec_id AS frame_id, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS v
  FROM embeddings, generate_series(1, 64) AS g(p))"""


def blobs(spark: SparkSession, centres: list[tuple[int, int, int, int]], ny: int, nx: int, periodic: bool = False) -> DataFrame:
    """Integer paraboloids: (frame, cy, cx, r) gives r*r less the squared distance where that is positive; the highest counts."""
    c = spark.createDataFrame(centres, "frame_id long, cy int, cx int, r int")
    grid = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x"))
    near = lambda a, b, n: F.least(F.abs(a - b), n - F.abs(a - b)) if periodic else F.abs(a - b)
    dy, dx = near(F.col("y"), F.col("cy"), ny), near(F.col("x"), F.col("cx"), nx)
    v = F.col("r") * F.col("r") - dy * dy - dx * dx
    return grid.join(F.broadcast(c), (F.abs(F.col("y") - F.col("cy")) <= F.col("r")) if not periodic else F.lit(True)).groupBy("frame_id", "y", "x").agg(F.max(F.greatest(v, F.lit(0))).cast("long").alias("v"))
