"""Exact top-k by a total order, without funnelling k rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import materialize

def ranked(df: DataFrame, order: list[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank under ``order`` (which must be a total order).

    Rows are range-partitioned on the full sort key, so equal leading values
    (a hot score) still split across partitions by the tie-breaker; the
    partition assignment is pinned by a checkpoint, each partition is numbered
    locally, and partition offsets come from the small table of partition counts.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pinned = df.repartitionByRange(n_parts, *order).withColumn("__pid", F.spark_partition_id())
    pinned = materialize(pinned)
    counts = pinned.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    local = pinned.withColumn("__local", F.row_number().over(Window.partitionBy("__pid").orderBy(*order)))
    out_df = local.join(F.broadcast(offsets), "__pid")  # one row per partition: bounded by n_parts
    return out_df.withColumn(out, F.col("__off") + F.col("__local")).drop("__pid", "__off", "__local")


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows under ``order`` (a total order), exactly; no task holds k rows."""
    if k <= 0:
        return df.limit(0)
    return ranked(df, order, "__rank").filter(F.col("__rank") <= k).drop("__rank")
