"""Scans and sinks: time ranges, file tokens, Parquet layouts, and the sparse and dense forms of track tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Columns of the published layouts.
PRESETS = {
    "mask": ["frame_id", "y", "x", "tracknumber"],
    "tbpr": ["frame_id", "y", "x", "tracknumber", "tb", "precipitation"],
    "full": None,
}


def scan(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, time: str = "base_time", columns: list[str] | None = None) -> DataFrame:
    """Parquet with a time range, both ends included (yyyyMMdd.HHmm), and only the columns asked for; both reach the scan."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col(time) >= epoch(start))
    if end:
        df = df.where(F.col(time) <= epoch(end))
    return df.select(*columns) if columns else df


def epoch(text: str) -> Column:
    """Seconds since 1970 of yyyyMMdd.HHmm."""
    return F.unix_timestamp(F.lit(text), "yyyyMMdd.HHmm")


def scan_named(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Parquet files whose names hold the time at a fixed place; files without one get a null base_time."""
    df = spark.read.parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select("*", S.token_time(name, token).alias("base_time"))


def time_span(df: DataFrame, time: str = "base_time") -> DataFrame:
    return df.agg(F.min(time).alias("start_basetime"), F.max(time).alias("end_basetime"))


def sampled_hourly(df: DataFrame, minute: int, within: float, time: str = "base_time") -> DataFrame:
    """Frames within ``within`` minutes of a minute of the hour."""
    return df.where(F.abs(F.pmod(F.floor(F.col(time) / 60), F.lit(60)) - minute) < within)


def hourly_mean(df: DataFrame, keys: list[str], value: str, time: str = "base_time") -> DataFrame:
    """Half-hourly or finer values averaged over the hour."""
    return df.groupBy(*keys, (F.floor(F.col(time) / 3600) * 3600).alias(time)).agg(F.avg(value).alias(value))


def write(df: DataFrame, path: str, partition: list[str] | None = None, sort: list[str] | None = None, mode: str = "overwrite", rows: int = 5_000_000) -> None:
    """Parquet, by partition columns; sorted inside files so that row groups prune by place."""
    if partition:
        df = df.repartition(*partition)
    if sort:
        df = df.sortWithinPartitions(*(partition or []), *sort)
    w = df.write.mode(mode).option("maxRecordsPerFile", rows)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_run(tables: dict[str, DataFrame], frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each table of a run in a folder of its own: those with frames by date, sorted by frame inside files; the others as they are.

    ``frames`` (frame_id, base_time); a mode of ``ignore`` leaves tables that are there already.
    """
    days = frames.select("frame_id", F.to_date(F.timestamp_seconds("base_time")).alias("date"))
    for name, df in tables.items():
        if "frame_id" in df.columns:
            write(df.join(days, "frame_id"), f"{path}/{name}", ["date"], ["frame_id"], mode)
        else:
            write(df, f"{path}/{name}", mode=mode)


def published(df: DataFrame, preset: str, rename: dict[str, str] | None = None) -> DataFrame:
    """The columns of a preset, renamed."""
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    return df.select(*PRESETS[preset]) if PRESETS[preset] else df


def dense(rows: DataFrame, values: list[str], times: int | None = None) -> DataFrame:
    """One row for each track with an array of ``times`` entries (as many as the longest track has, if not given) for each value, missing times null."""
    if times is None:
        times = (rows.agg(F.max("t_idx")).first()[0] or 0) + 1
    slot = F.sequence(F.lit(0), F.lit(times - 1))
    out = rows.groupBy("track").agg(*[F.map_from_entries(F.collect_list(F.struct("t_idx", c))).alias(c) for c in values])
    return out.select("track", *[F.transform(slot, _lookup(c)).alias(c) for c in values])


def _lookup(column: str):
    return lambda t: F.try_element_at(F.col(column), t.cast("long"))


def sparse(table: DataFrame, values: list[str]) -> DataFrame:
    """The long form of :func:`dense`; times at which all values are null are left out."""
    each = table.select("track", F.posexplode(F.arrays_zip(*values)).alias("t_idx", "z"))
    long = each.select("track", F.col("t_idx").cast("long").alias("t_idx"), *[F.col(f"z.{c}").alias(c) for c in values])
    return long.dropna("all", subset=values)
