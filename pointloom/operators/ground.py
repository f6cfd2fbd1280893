"""Ground removal by a falling cloth."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import AXES, finite
from pointloom.operators import kernels
from pointloom.session import prepare


def cloth_ground(points: DataFrame, keys: Sequence[str] = ("seq", "frame"), resolution: float = 1.0, rigidness: int = 3, iterations: int = 500, step: float = 0.65, threshold: float = 0.5, slope_smooth: bool = False) -> DataFrame:
    """points (finite ones) with the boolean column ground; one cloud a task."""
    prepare(points.sparkSession)
    cols = points.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows["ground"] = kernels.cloth(rows[list(AXES)].to_numpy("float64"), resolution, rigidness, iterations, step, threshold, slope_smooth)
        return rows[[*cols, "ground"]]

    return finite(points).groupBy(*keys).applyInPandas(run, f"{types}, ground boolean")


def off_ground(points: DataFrame, ground: DataFrame, keys: Sequence[str] = ("seq", "frame")) -> DataFrame:
    """All points minus the ground."""
    return points.join(ground.where(F.col("ground")), [*keys, "idx"], "left_anti")
