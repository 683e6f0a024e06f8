"""Intermediate tables in the folder that driver and executors share, and numbers by order without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_own: str | None = None


def folder(setting: str | None, master: str) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a temporary one, which is right for a local master only, and an error for others."""
    if setting:
        return setting.rstrip("/")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="gridtrack-")
    return f"file://{_own}"


def stored(df: DataFrame, name: str = "tracks") -> DataFrame:
    """Writes to the shared folder and reads back, so that lineage stays short and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder(spark.sparkContext.getConf().get('spark.checkpoint.dir'), spark.sparkContext.master)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: list[str], name: str = "tracks") -> DataFrame:
    """As :func:`stored`, in buckets of the columns ``by``, sorted by them: joins and groups by these columns read the table as it lies, without a shuffle.

    The files are in the shared folder; the session's catalog knows the table by a name of its own.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"scratch_{name}_{uuid.uuid4().hex}"
    path = f"{folder(spark.sparkContext.getConf().get('spark.checkpoint.dir'), spark.sparkContext.master)}/{table}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(table)
    return spark.table(table)


def numbered(rows: DataFrame, by: str | list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 1 in the order of the columns ``by`` (distinct values).

    Rows are dealt by ranges, counted by range, and only the counts, a row for each
    range, are summed in one task.
    """
    by = [by] if isinstance(by, str) else by
    dealt = stored(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.withColumn("_place", inside).join(F.broadcast(base), "_range").withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_range", "_place", "_base")


def accumulated(rows: DataFrame, by: list[str], group: list[str], of: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the running sum of column ``of`` in the order of ``by`` (which begins with ``group``), from each group's first row on.

    Rows are dealt by ranges, so a group of any size is spread over tasks; a range takes over the sum of its first group
    in earlier ranges, which is a row for each range at most: that is what is broadcast.
    """
    dealt = stored(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", *group).agg(F.sum(of).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.sum("_sum").over(earlier)).where("_base IS NOT NULL").drop("_sum")
    inside = Window.partitionBy("_range", *group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_range", *group)]
    out = dealt.withColumn(name, F.sum(of).over(inside)).alias("a").join(F.broadcast(base).alias("b"), same, "left")
    return out.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col(f"a.{name}") + F.coalesce("b._base", F.lit(0))).alias(name))
