"""Packed point labels and label vocabularies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semantic ids of two public road datasets.
POSS = {"car": 7, "trunk": 8, "plants": 9, "building": 15, "ground": 22}
KITTI = {"car": 10, "building": 50, "vegetation": 70, "trunk": 71}
KITTI_GROUND = (40, 44, 48, 49, 60, 72)
KITTI_STATIC, KITTI_ANCHORS = (10, 50, 70, 71), (50, 70, 71)


def semantic(label: str = "label") -> Column:
    """The low 16 bits."""
    return F.col(label).cast("long").bitwiseAND(F.lit(0xFFFF))


def instance(label: str = "label") -> Column:
    """The high 16 bits of the unsigned 32-bit label."""
    return F.shiftrightunsigned(F.col(label).cast("long"), 16).bitwiseAND(F.lit(0xFFFF))


def unpack(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumns({"semantic": semantic(label), "instance": instance(label)})


def without(df: DataFrame, ids: Iterable[int], column: str = "semantic") -> DataFrame:
    """Removes ground or other classes by label."""
    return df.where(~F.col(column).isin(*ids))


def only(df: DataFrame, ids: Iterable[int], column: str = "semantic") -> DataFrame:
    """Keeps a set of classes; an empty set keeps all."""
    ids = list(ids)
    return df.where(F.col(column).isin(*ids)) if ids else df


def ground_truth(df: DataFrame, classes: Iterable[int] = (), min_points: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, idx, gt_key): points with semantic and instance other than 0 (and in classes), of instances with at least min_points points. gt_key is the packed label."""
    valid = only(df.where("semantic <> 0 and instance <> 0"), classes)
    valid = valid.select(*keys, "idx", (F.col("instance") * 65536 + F.col("semantic")).alias("gt_key"))
    if min_points <= 1:
        return valid
    large = valid.groupBy(*keys, "gt_key").count().where(F.col("count") >= min_points)
    return valid.join(large.drop("count"), [*keys, "gt_key"], "left_semi")
