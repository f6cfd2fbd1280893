"""Neighbour search as grid equi-joins with a residual distance test."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import AXES, cell, finite, squared_distance
from pointloom.operators import kernels
from pointloom.session import cut, prepare

ALL_OFFSETS = tuple(product((-1, 0, 1), repeat=3))
#: The own cell and one of each pair of opposite neighbours.
HALF_OFFSETS = tuple(o for o in ALL_OFFSETS if o >= (0, 0, 0))


def _offsets(which: Sequence[tuple[int, int, int]]):
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz"), strict=True)), F.lit(k).alias("k")) for k, o in enumerate(which)))


def _celled(points: DataFrame, size: float, keys: Sequence[str]) -> DataFrame:
    p = finite(points).select(*keys, "idx", *AXES)
    return p.withColumns({f"c{a}": cell(a, size) for a in AXES})


def radius_pairs(points: DataFrame, tol: float, keys: Sequence[str] = (), max_n: int = 0, cap: str = "nearest", precision: str = "f64", strict: bool = False) -> DataFrame:
    """(keys, i, j, d2): directed pairs within tol (<=, or < if strict) of the same key, the point itself included.

    points: keys, idx, x, y, z; rows with null, NaN or infinite coordinates have no neighbours. max_n > 0 keeps of each i the point itself and its nearest others (ties by j) up to max_n in all; with cap="scan_order" the first max_n in the order of cells (dx, dy, dz from -1 up), then of j, the point itself possibly left out.
    """
    if max_n < 0:
        raise ValueError("max_n must not be negative")
    if tol <= 0:
        raise ValueError("tol must be positive")
    p = _celled(points, tol, keys)
    left = p.withColumn("o", F.explode(_offsets(ALL_OFFSETS)))
    left = left.select(*keys, F.col("idx").alias("i"), *(F.col(a).alias(f"a_{a}") for a in AXES), *((F.col(f"c{a}") + F.col(f"o.d{a}")).alias(f"c{a}") for a in AXES), F.col("o.k").alias("k"))
    right = p.select(*keys, F.col("idx").alias("j"), *(F.col(a).alias(f"b_{a}") for a in AXES), *(f"c{a}" for a in AXES))
    dtype = "float" if precision == "f32" else "double"
    d2 = squared_distance("a_", "b_", dtype)
    near = d2 < tol * tol if strict else d2 <= tol * tol
    pairs = left.join(right, [*keys, *(f"c{a}" for a in AXES)]).withColumn("d2", d2).where(near | (F.col("i") == F.col("j")))
    if max_n:
        order = ["k", "j"] if cap == "scan_order" else [(F.col("j") != F.col("i")), "d2", "j"]
        pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "i").orderBy(*order))).where(F.col("_r") <= max_n)
    return pairs.select(*keys, "i", "j", "d2")


def half_pairs(points: DataFrame, tol: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, d2): each unordered pair of different points within tol once, i < j; 14 of 27 cells are probed."""
    p = _celled(points, tol, keys)
    left = p.withColumn("o", F.explode(_offsets(HALF_OFFSETS)))
    left = left.select(*keys, F.col("idx").alias("p"), *(F.col(a).alias(f"a_{a}") for a in AXES), *((F.col(f"c{a}") + F.col(f"o.d{a}")).alias(f"c{a}") for a in AXES), F.col("o.k").alias("k"))
    right = p.select(*keys, F.col("idx").alias("q"), *(F.col(a).alias(f"b_{a}") for a in AXES), *(f"c{a}" for a in AXES))
    d2 = squared_distance("a_", "b_")
    met = left.join(right, [*keys, *(f"c{a}" for a in AXES)]).where((F.col("k") > 0) | (F.col("p") < F.col("q"))).withColumn("d2", d2).where(F.col("d2") <= tol * tol)
    return met.select(*keys, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "d2")


#: Points of a cloud whose nearest neighbours are searched in one task.
KNN_POINTS = 20_000


def _extent(points: DataFrame) -> float:
    """The longest side of the box around all points, 0 without any."""
    low_high = points.agg(*(f(F.col(a).cast("double")) for a in AXES for f in (F.min, F.max))).first()
    return max((high - low for low, high in zip(low_high[::2], low_high[1::2], strict=True) if low is not None), default=0.0)


def _probed(left: DataFrame, points: DataFrame, size: float, keys: Sequence[str]) -> DataFrame:
    """left (keys, i, a_x, a_y, a_z) with each point j of its 27 cells and their squared distance."""
    probe = left.withColumns({f"c{a}": cell(f"a_{a}", size) for a in AXES}).withColumn("o", F.explode(_offsets(ALL_OFFSETS)))
    probe = probe.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"o.d{a}") for a in AXES}).drop("o")
    right = _celled(points, size, keys).select(*keys, F.col("idx").alias("j"), *(F.col(a).alias(f"b_{a}") for a in AXES), *(f"c{a}" for a in AXES))
    return probe.join(right, [*keys, *(f"c{a}" for a in AXES)]).withColumn("d2", squared_distance("a_", "b_"))


def knn_pairs(points: DataFrame, k: int, keys: Sequence[str] = (), strategy: str = "auto", first: float | None = None) -> DataFrame:
    """(keys, i, j, d2, rank): the k nearest points of each point of the same key, itself included, by (d2, j).

    Clouds of at most KNN_POINTS are searched in one task each (strategy "kernel"). In larger ones ("distributed") cells of the size ``first`` (by default such that a cell would hold k points of an even cloud) are doubled until a point has k others, or all of its key, within the cell size.
    """
    prepare(points.sparkSession)
    types = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys)
    points = finite(points).select(*keys, "idx", *(F.col(a).cast("double").alias(a) for a in AXES))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if strategy == "distributed" or strategy == "auto" and largest > KNN_POINTS:
        extent = _extent(points)
        size = first or max(extent, 1e-9) * (k / max(1, largest)) ** (1 / 3)
        wanted = F.least(F.col("_n"), F.lit(k))
        left = points.join(sizes, list(keys)) if keys else points.crossJoin(F.broadcast(sizes))  # one row without keys
        left = cut(left.select(*keys, F.col("idx").alias("i"), *(F.col(a).alias(f"a_{a}") for a in AXES), wanted.alias("_k")))
        done = None
        while True:
            near = _probed(left, points, size, keys).where(F.col("d2") <= size * size)
            order = Window.partitionBy(*keys, "i").orderBy("d2", "j")
            near = near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= F.col("_k"))
            full = cut(near.withColumn("_m", F.count("*").over(Window.partitionBy(*keys, "i"))).where(F.col("_m") == F.col("_k")))
            hit = full.select(*keys, "i", "j", "d2", "rank")
            done = hit if done is None else done.unionByName(hit)
            left = cut(left.join(full.select(*keys, "i").distinct(), [*keys, "i"], "left_anti"))
            if size > 2 * extent or left.isEmpty():
                return done
            size *= 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable").reset_index(drop=True)
        near, d2 = kernels.knn(rows[list(AXES)].to_numpy(np.float64), k)
        idx = rows["idx"].to_numpy()
        out = pd.DataFrame({"i": np.repeat(idx, near.shape[1]), "j": idx[near.ravel()], "d2": d2.ravel(), "rank": np.tile(np.arange(1, near.shape[1] + 1), len(idx))})
        for n, c in enumerate(keys):
            out.insert(n, c, rows[c].iloc[0])
        return out

    return points.groupBy(*keys).applyInPandas(run, f"{types}{', ' if keys else ''}i long, j long, d2 double, rank long")


def nearest_distance(queries: DataFrame, points: DataFrame, keys: Sequence[str] = (), first: float = 0.25) -> DataFrame:
    """(keys, i, d2): distance of each query point to the nearest point of its key; none for a query whose key has no points.

    Cells are doubled until every query has a hit within the cell size, which is then surely the nearest; at the latest when they are larger than the box around all points. What is left after each round is written to the checkpoint folder.
    """
    points = finite(points).select(*keys, "idx", *(F.col(a).cast("double").alias(a) for a in AXES))
    left = finite(queries).select(*keys, F.col("idx").alias("i"), *(F.col(a).cast("double").alias(f"a_{a}") for a in AXES))
    if keys:
        left = left.join(points.select(*keys).distinct(), list(keys), "left_semi")
    left = cut(left)
    around = points.select(*AXES).unionByName(left.select(*(F.col(f"a_{a}").alias(a) for a in AXES)))
    done, size, extent = None, first, _extent(around)
    while True:
        hit = cut(_probed(left, points, size, keys).groupBy(*keys, "i").agg(F.min("d2").alias("d2")).where(F.col("d2") <= size * size))
        done = hit if done is None else done.unionByName(hit)
        left = cut(left.join(hit.select(*keys, "i"), [*keys, "i"], "left_anti"))
        if size > 2 * extent or left.isEmpty():
            return done
        size *= 2


def radius_probe(points: DataFrame, tol: float, max_n: int, samples: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: neighbours of every stride-th point: searched, mean and largest number, the share with more than max_n; and mean and largest number once capped."""
    n = points.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else points.agg(F.count("*").alias("_n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / max(1, samples)))
    chosen = (points.join(n, list(keys)) if keys else points.join(F.broadcast(n))).where((F.col("idx") % stride == 0) & (F.col("idx") < stride * samples)).select(*keys, F.col("idx").alias("i"))
    counts = radius_pairs(points, tol, keys).join(chosen, [*keys, "i"], "left_semi").groupBy(*keys, "i").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.count("*").alias("searched"), F.avg("n").alias("avg_neighbors"), F.max("n").alias("max_neighbors"), F.avg((F.col("n") > max_n).cast("double")).alias("over_rate"), F.avg(F.least("n", F.lit(max_n))).alias("avg_capped"), F.max(F.least("n", F.lit(max_n))).alias("max_capped"))
