"""Fusion of frames as they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pointloom.functions.geometry import finite, with_cells


def stream_points(spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """Parquet files of points as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def fuse(points: DataFrame, voxel: float, semantic: str = "semantic") -> DataFrame:
    """The accepted points of a stream (frame, idx, semantic, x, y, z): the first of each class and voxel.

    Frames must arrive in order; within a micro-batch the smallest (frame, idx) wins. The state is one flag for each class and voxel, so it grows with the mapped space, not with the points.
    """
    cols = ["frame", "idx", semantic, "x", "y", "z"]
    p = with_cells(finite(points), voxel).select(*cols, "vx", "vy", "vz")
    types = ", ".join(f"`{c}` {p.schema[c].dataType.simpleString()}" for c in cols)

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = None
        for b in batches:  # the group may come in parts
            best = b.sort_values(["frame", "idx"]).iloc[:1]
            first = best if first is None else pd.concat([first, best]).sort_values(["frame", "idx"]).iloc[:1]
        if first is not None and not state.exists:
            state.update((True,))
            yield first[cols]

    return p.groupBy(semantic, "vx", "vy", "vz").applyInPandasWithState(accept, types, "taken boolean", "append", GroupStateTimeout.NoTimeout)


def fuse_any(points: DataFrame, voxel: float, keys: Sequence[str] = ("semantic",)) -> DataFrame:
    """One point of each class and voxel, whichever comes first within a micro-batch; needs no Python."""
    return with_cells(finite(points), voxel).dropDuplicates([*keys, "vx", "vy", "vz"]).drop("vx", "vy", "vz")


def watch_counts(points: DataFrame, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Points of each event-time window and class, once the watermark has passed it."""
    return points.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "semantic").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "semantic", "n")
