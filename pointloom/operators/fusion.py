"""Multi-frame fusion with voxel de-duplication, ghost rejection and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import AXES, apply_poses, finite, with_cells
from pointloom.functions.stats import nearest_rank
from pointloom.operators.neighbors import nearest_distance, radius_pairs
from pointloom.session import cut

ARRIVAL = ("frame", "idx")


def voxel_first(points: DataFrame, size: float, keys: Sequence[str] = ("semantic",), order: Sequence[str] = ARRIVAL) -> DataFrame:
    """The first point to arrive in each (keys, voxel); map-side minima before the shuffle, so a crowded voxel is no large group."""
    v = with_cells(finite(points), size)
    rest = [c for c in points.columns if c not in (*keys, *order)]
    first = v.groupBy(*keys, "vx", "vy", "vz").agg(F.min(F.struct(*order, *rest)).alias("p"))
    return first.select(*keys, *(F.col(f"p.{c}").alias(c) for c in (*order, *rest)), "vx", "vy", "vz")


def decide(points: DataFrame, voxel: float, ghost_radius: float = 0.0, semantic: str = "semantic") -> DataFrame:
    """points with seq_no (arrival over frame, idx, from 0) and status: accepted, ghost or density.

    In order of arrival a point is a ghost if an accepted point of its class lies within ghost_radius, else it is rejected for density if its class already has an accepted point in its voxel. Without a radius the first of each voxel is accepted; with one, rounds settle the points that no undecided one before them can rule out. Points that aren't finite are left out.
    """
    p = with_cells(finite(points), voxel)
    # arrival numbers by frame: counts of earlier frames plus the rank within the frame
    per_frame = p.groupBy("frame").agg(F.count("*").alias("n"))
    before = per_frame.withColumn("b", F.coalesce(F.sum("n").over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("frame", "b")
    p = p.join(before, "frame").withColumn("seq_no", F.col("b") + F.row_number().over(Window.partitionBy("frame").orderBy("idx")) - 1).drop("b")
    if ghost_radius <= 0:
        cells = [semantic, "vx", "vy", "vz"]
        first = p.groupBy(*cells).agg(F.min("seq_no").alias("f"))
        return p.join(first, cells).withColumn("status", F.when(F.col("seq_no") == F.col("f"), "accepted").otherwise("density")).drop("f", "vx", "vy", "vz")
    p = cut(p)
    near = radius_pairs(p.select(semantic, F.col("seq_no").alias("idx"), *AXES), ghost_radius, (semantic,)).where("i < j").select("i", "j")
    near = cut(near)
    accepted = _accepted(p.select("seq_no", semantic, "vx", "vy", "vz"), near, (semantic, "vx", "vy", "vz"))
    ghosts = near.join(accepted.withColumnRenamed("seq_no", "i"), "i", "left_semi").select(F.col("j").alias("seq_no")).distinct()
    met = p.join(accepted.withColumn("seed", F.lit(True)), "seq_no", "left").join(ghosts.withColumn("ghost", F.lit(True)), "seq_no", "left")
    status = F.when(F.col("seed"), "accepted").when(F.col("ghost"), "ghost").otherwise("density")
    return met.withColumn("status", status).drop("seed", "ghost", "vx", "vy", "vz")


def _accepted(points: DataFrame, near: DataFrame, cells: Sequence[str]) -> DataFrame:
    """(seq_no) of the points that no earlier accepted one rules out, by nearness (near: i, j with i < j) or by standing in the same cell.

    Rounds over the undecided points: the first of its cell that no undecided point before it is near to is accepted, and what it rules out is decided. A cell counts by its first point only, so a crowded one makes no pairs.
    """
    open_, out = points, None
    while True:
        first = open_.groupBy(*cells).agg(F.min("seq_no").alias("seq_no"))
        new = cut(first.join(near.select(F.col("j").alias("seq_no")).distinct(), "seq_no", "left_anti"))
        out = new.select("seq_no") if out is None else out.unionByName(new.select("seq_no"))
        reached = near.join(new.select(F.col("seq_no").alias("i")), "i", "left_semi").select(F.col("j").alias("seq_no")).distinct()
        open_ = cut(open_.join(new.select(*cells), list(cells), "left_anti").join(reached, "seq_no", "left_anti"))
        if open_.isEmpty():
            return out
        near = cut(near.join(open_.select(F.col("seq_no").alias("i")), "i", "left_semi").join(open_.select(F.col("seq_no").alias("j")), "j", "left_semi"))


def _cut_at(decided: DataFrame, target: int) -> DataFrame:
    """One row: stop, the arrival of the target-th accepted point (null if fewer)."""
    per_frame = decided.where("status = 'accepted'").groupBy("frame").agg(F.count("*").alias("n"))
    run = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    frames = per_frame.withColumn("b", F.coalesce(F.sum("n").over(run), F.lit(0)))
    last = frames.where((F.col("b") < target) & (F.col("b") + F.col("n") >= target)).select("frame", "b")
    inside = decided.where("status = 'accepted'").join(F.broadcast(last), "frame")  # one row at most
    r = inside.withColumn("k", F.col("b") + F.row_number().over(Window.partitionBy("frame").orderBy("idx")))
    return r.where(F.col("k") == target).agg(F.max("seq_no").alias("stop"))


def prefix(decided: DataFrame, target: int) -> DataFrame:
    """The first target accepted points by arrival."""
    stop = _cut_at(decided, target)
    return decided.where("status = 'accepted'").join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("seq_no") <= F.col("stop"))).drop("stop")


def counters(decided: DataFrame, raw: DataFrame, target: int | None = None) -> DataFrame:
    """Per frame up to the one that reaches the target: raw points of the whole frame (raw: frame, raw_points), and static, accepted, ghost and density counts up to the stop."""
    d = decided
    if target is not None:
        d = d.join(F.broadcast(_cut_at(decided, target))).where(F.col("stop").isNull() | (F.col("seq_no") <= F.col("stop"))).drop("stop")
    per = d.groupBy("frame").agg(F.count("*").alias("static_points"), F.count_if(F.col("status") == "accepted").alias("accepted_points"), F.count_if(F.col("status") == "ghost").alias("ghost_rejected"), F.count_if(F.col("status") == "density").alias("density_rejected"))
    run = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.join(raw, "frame", "left").withColumn("fused_total", F.sum("accepted_points").over(run)).select("frame", "raw_points", "static_points", "accepted_points", "ghost_rejected", "density_rejected", "fused_total")


def cloud_stats(points: DataFrame, classes: dict[str, Sequence[int]], keys: Sequence[str] = ()) -> DataFrame:
    """points, frames_used (largest frame + 1), one count for each named class set, and the extent along each axis."""
    counts = [F.count_if(F.col("semantic").isin(*ids)).alias(name) for name, ids in classes.items()]
    return points.groupBy(*keys).agg(F.count("*").alias("points"), (F.max("frame") + 1).alias("frames_used"), *counts, *((F.max(a).cast("double") - F.min(a).cast("double")).alias(f"bbox_{a}") for a in AXES))


def gap_pairs(frames: DataFrame, gaps: Sequence[int] = (1, 5, 10), first: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, frame, gap, other): each frame with the one ``gap`` frames on, for the first frames of each key."""
    w = Window.partitionBy(*keys).orderBy("frame")
    f = frames.select(*keys, "frame").distinct().withColumn("_r", F.row_number().over(w))
    parts = [f.withColumns({"gap": F.lit(g), "other": F.lead("frame", g).over(w)}).where(F.col("_r") <= first) for g in gaps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("other is not null").drop("_r")


def alignment(points: DataFrame, poses: DataFrame, tr: Sequence[float] | None, gaps: Sequence[int] = (1, 5, 10), samples: int = 200, first: int = 30) -> DataFrame:
    """(mode, gap, n, median, p90, p95): distances from a stride sample of each frame to the nearest point of a later one, with poses and without (ego)."""
    pairs = cut(gap_pairs(points, gaps, first))
    out = None
    for mode, cloud in (("pose", apply_poses(points, poses, tr)), ("ego", points)):
        size = cloud.groupBy("frame").agg(F.count("*").alias("n"))
        stride = F.greatest(F.lit(1), F.floor(F.col("n") / max(1, samples)))
        sample = cloud.join(size, "frame").where(F.col("idx") % stride == 0).select("frame", "idx", *AXES)
        q = pairs.join(sample, "frame").select(F.concat_ws(":", "frame", "other").alias("pair"), "gap", "idx", *AXES)
        p = pairs.join(cloud.withColumnRenamed("frame", "other"), "other").select(F.concat_ws(":", "frame", "other").alias("pair"), "idx", *AXES)
        d = nearest_distance(q, p, ("pair",)).join(pairs.select(F.concat_ws(":", "frame", "other").alias("pair"), "gap"), "pair").select(F.lit(mode).alias("mode"), "gap", F.sqrt("d2").alias("d"))
        s = d.groupBy("mode", "gap").agg(F.count("*").alias("n")).join(nearest_rank(d, ("mode", "gap"), "d", {"p90": 0.9, "p95": 0.95}), ["mode", "gap"])
        out = s if out is None else out.unionByName(s)
    return out


def make_sample(points: DataFrame, frames: DataFrame, classes: Sequence[int] = (), ground: Sequence[int] = (), poses: DataFrame | None = None, tr: Sequence[float] | None = None) -> DataFrame:
    """Chosen frames as one cloud: filtered by class, without ground, moved by their poses, with a new dense idx by (frame, idx); frames: (sample, frame)."""
    p = points.join(frames, "frame")
    if classes:
        p = p.where(F.col("semantic").isin(*classes))
    if ground:
        p = p.where(~F.col("semantic").isin(*ground))
    if poses is not None:
        p = apply_poses(p, poses, tr)
    return p.withColumn("idx", (F.row_number().over(Window.partitionBy("sample").orderBy("frame", "idx")) - 1).cast("long"))


def stride_filter(n: Column, k: int, idx: str = "idx") -> Column:
    """Every stride-th idx, stride = max(1, n div max(1, k))."""
    return F.col(idx) % F.greatest(F.lit(1), F.floor(n / max(1, k))) == 0
