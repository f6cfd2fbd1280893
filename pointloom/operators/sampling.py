"""Samples, limits and windows over frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.session import cut


def stride_sample(points: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every stride-th point of each key, stride = max(1, n div max(1, k)); may exceed k."""
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    met = points.join(n, list(keys)) if keys else points.join(F.broadcast(n))
    return met.where(F.col("idx") % F.greatest(F.lit(1), F.floor(F.col("_n") / max(1, k))) == 0).drop("_n")


def with_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with the place of each row in the order, from 0. Rows are range-partitioned and ranked within partitions; only partition sizes meet in one task."""
    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.join(before, "_p").withColumn(name, (F.col("_b") + within).cast("long")).drop("_p", "_b")


def even_select(df: DataFrame, order: str, limit: int) -> DataFrame:
    """Rows at positions floor(i * n / limit) of the order; all rows if there are no more than limit."""
    n = df.agg(F.count("*").alias("_n"))
    r = with_rank(df, [order], "_r").join(F.broadcast(n))  # a single row
    # the position r is taken if some i has floor(i n / limit) = r
    i = F.ceil(F.col("_r") * limit / F.col("_n"))
    return r.where((F.col("_n") <= limit) | (F.floor(i * F.col("_n") / limit) == F.col("_r")) & (i < limit)).drop("_r", "_n")


def random_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all, if fewer) without replacement."""
    return df.orderBy(F.rand(seed)).limit(n)


def accumulate_until(frames: DataFrame, count: str, target: int, keys: Sequence[str] = ()) -> DataFrame:
    """Frames in order while the points of the earlier ones don't reach the target."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("_b", F.coalesce(F.sum(count).over(w), F.lit(0))).where(F.col("_b") < target).drop("_b")


def hopping_frames(frames: DataFrame, window: int = 10, stride: int = 15, limit: int = 32, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, sample, frame): windows of consecutive listed frames that start every stride frames; incomplete ones are left out."""
    w = Window.partitionBy(*keys).orderBy("frame")
    pos = frames.select(*keys, "frame").distinct().withColumn("p", F.row_number().over(w) - 1)
    n = pos.groupBy(*keys).agg(F.count("*").alias("n"))
    met = pos.join(n, list(keys)) if keys else pos.join(F.broadcast(n))
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - (window - 1)) / stride))
    last = F.floor(F.col("p") / stride)
    s = met.where(first <= last).withColumn("sample", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return s.where((F.col("sample") * stride + window <= F.col("n")) & (F.col("sample") < limit)).select(*keys, "sample", "frame")


def frame_range(df: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of frames within [start, end], of the first ``limit`` such frames of each key."""
    if start is not None:
        df = df.where(F.col("frame") >= start)
    if end is not None:
        df = df.where(F.col("frame") <= end)
    if limit is None:
        return df
    return df.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("frame"))).where(F.col("_r") <= limit).drop("_r")
