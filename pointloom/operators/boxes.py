"""Points in oriented boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inside(points: DataFrame, boxes: DataFrame, keys: Sequence[str] = (), box_axes: str = "width_first", size: float = 8.0) -> DataFrame:
    """(keys, idx, box) of every point in every box it lies in.

    points in camera coordinates (x, y, z); boxes: keys, box, h, w, l, x, y, z (bottom centre), ry. box_axes="width_first" bounds the local x axis by w and z by l, "length_first" the other way round. Boxes are spread over the ground cells (x, z) that their circle touches, so points meet only nearby boxes.
    """
    if box_axes not in ("width_first", "length_first"):
        raise ValueError("box_axes must be width_first or length_first")
    r = F.sqrt(F.col("w") * F.col("w") + F.col("l") * F.col("l")) / 2
    b = boxes.select(*keys, "box", "h", "w", "l", "ry", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    for c in ("x", "z"):
        b = b.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"b{c}") - r) / size).cast("long"), F.floor((F.col(f"b{c}") + r) / size).cast("long"))))
    p = points.select(*keys, "idx", *(F.col(c).cast("double").alias(c) for c in "xyz")).withColumns({f"c{c}": F.floor(F.col(c) / size).cast("long") for c in ("x", "z")})
    dx, dz = F.col("x") - F.col("bx"), F.col("z") - F.col("bz")
    lx, lz = F.cos("ry") * dx - F.sin("ry") * dz, F.sin("ry") * dx + F.cos("ry") * dz
    ex, ez = ("w", "l") if box_axes == "width_first" else ("l", "w")
    hit = (F.abs(lx) <= F.col(ex) / 2) & (F.abs(lz) <= F.col(ez) / 2) & (F.col("y") <= F.col("by")) & (F.col("y") >= F.col("by") - F.col("h"))
    return p.join(b, [*keys, "cx", "cz"]).where(hit).select(*keys, "idx", "box")


def first_box(hits: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(keys, idx, gt_key) by the first box of each point, and (keys, gt_key, gt_size) with all points of each box, those lost to an earlier one too."""
    first = hits.groupBy(*keys, "idx").agg(F.min("box").alias("gt_key"))
    return first, hits.groupBy(*keys, F.col("box").alias("gt_key")).agg(F.count("*").alias("gt_size"))
