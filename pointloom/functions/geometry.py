"""Column expressions on coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def finite(points: DataFrame) -> DataFrame:
    """Rows whose coordinates are neither null, NaN nor infinite."""
    return points.where(is_finite())


def is_finite() -> Column:
    """Whether the coordinates are neither null, NaN nor infinite; never null itself."""
    x, y, z = (F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")) for a in AXES)
    return x & y & z


def cell(axis: str | Column, size: float, origin: Column | float = 0.0) -> Column:
    """floor((axis - origin) / size) as a long."""
    c = F.col(axis) if isinstance(axis, str) else axis
    return F.floor((c.cast("double") - origin) / F.lit(float(size))).cast("long")


def with_cells(points: DataFrame, size: float, names: Sequence[str] = ("vx", "vy", "vz")) -> DataFrame:
    """Voxel keys with origin 0."""
    return points.withColumns({n: cell(a, size) for n, a in zip(names, AXES, strict=True)})


def with_cells_from_min(points: DataFrame, size: float, keys: Sequence[str] = (), names: Sequence[str] = ("bx", "by", "bz")) -> DataFrame:
    """Voxel keys counted from the smallest coordinate of each cloud (one row for each combination of keys)."""
    low = points.groupBy(*keys).agg(*(F.min(a).cast("double").alias(f"_{a}") for a in AXES))
    met = points.join(low, list(keys)) if keys else points.join(F.broadcast(low))  # without keys a single row
    return met.withColumns({n: cell(a, size, F.col(f"_{a}")) for n, a in zip(names, AXES, strict=True)}).drop(*(f"_{a}" for a in AXES))


def squared_distance(a: str = "", b: str = "b_", dtype: str = "double") -> Column:
    """Squared distance of two prefixed coordinate triples, evaluated in dtype."""
    parts = [(F.col(f"{a}{c}").cast(dtype) - F.col(f"{b}{c}").cast(dtype)) for c in AXES]
    return (parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]).cast("double")


def _affine(m: str, row: int) -> Column:
    at = [F.element_at(m, 4 * row + k + 1) for k in range(4)]
    return at[0] * F.col("x").cast("double") + at[1] * F.col("y").cast("double") + at[2] * F.col("z").cast("double") + at[3]


def transform(points: DataFrame, m: str, dtype: str = "float") -> DataFrame:
    """Coordinates multiplied by the row-major 3x4 or 4x4 matrix in column m, in double precision, then cast."""
    return points.withColumns({a: _affine(m, r).cast(dtype) for r, a in enumerate(AXES)})


def matrix_product(a: str, b: str) -> Column:
    """Product of two affine 3x4 matrices held as arrays of 12 doubles (the last row is 0 0 0 1)."""
    cells = []
    for r in range(3):
        for c in range(4):
            s = sum((F.element_at(a, 4 * r + k + 1) * F.element_at(b, 4 * k + c + 1) for k in range(3)), F.lit(0.0))
            cells.append(s + F.element_at(a, 4 * r + 4) if c == 3 else s)
    return F.array(*cells)


def apply_poses(points: DataFrame, poses: DataFrame, tr: Sequence[float] | None = None, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """points moved by pose * Tr of their frame; a frame without a pose by Tr alone; no Tr: identity.

    poses: keys and m (12 doubles). Missing poses leave the point in the file, as a left join does.
    """
    base = [float(v) for v in (tr or (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0))]
    both = poses.select(*keys, F.col("m").alias("_p")).withColumn("_t", F.array(*map(F.lit, base))).withColumn("_m", matrix_product("_p", "_t")).select(*keys, "_m")
    met = points.join(both, list(keys), "left").withColumn("_m", F.coalesce("_m", F.array(*map(F.lit, base))))
    return transform(met, "_m").drop("_m").select(*points.columns)


def to_camera(points: DataFrame, calib: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Velodyne to rectified camera: R0 * (Tr * p); calib has r0 (9 doubles) and tr (12 doubles) for each combination of keys."""
    met = points.join(calib.select(*keys, "r0", "tr"), list(keys)) if keys else points.join(F.broadcast(calib.select("r0", "tr").limit(1)))
    met = transform(met, "tr", "double")
    rows = {a: sum((F.element_at("r0", 3 * r + k + 1) * F.col(c) for k, c in enumerate(AXES)), F.lit(0.0)) for r, a in enumerate(AXES)}
    return met.withColumns(rows).drop("r0", "tr")


def colour(cluster: str | Column, seed: int = 42) -> list[Column]:
    """r, g, b in 64..255, a fixed function of the cluster id."""
    return [(F.pmod(F.xxhash64(F.lit(seed + k), F.col(cluster) if isinstance(cluster, str) else cluster), F.lit(192)) + 64).cast("smallint").alias(n) for k, n in enumerate("rgb")]
