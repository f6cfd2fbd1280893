"""Experiment drivers composed of the operators: timing runs, evaluations, fusion builds and tuning."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry, labels, stats
from pointloom.operators import boxes, evaluate, fusion, sampling
from pointloom.operators.cluster import cluster, seed_profile, stage_times
from pointloom.operators.ground import cloth_ground, off_ground
from pointloom.operators.neighbors import radius_probe
from pointloom.session import cut

RUNS = "dataset string, method string, tol double, max_n int, run int, points long, ms double, clusters long"


def timed_runs(spark: SparkSession, clouds: dict[str, DataFrame], methods: Iterable[str], tolerances: Iterable[float], min_size: int = 100, max_n: Iterable[int] = (50,), repeats: int = 7) -> DataFrame:
    """One row for each run of each method on each cloud; wall clock of the whole clustering."""
    rows = []
    for name, cloud in clouds.items():
        cloud = cut(cloud)
        n = cloud.count()
        for tol in tolerances:
            for method in methods:
                for cap in max_n:
                    options = {"tol": tol, "min_size": min_size} | _cap(method, cap)
                    for run in range(repeats):
                        began = time.perf_counter()
                        found = cluster(cloud, method, **options).agg(F.countDistinct("cluster_id")).first()[0]
                        rows.append((name, method, float(tol), int(cap), run, n, (time.perf_counter() - began) * 1000, found))
    return spark.createDataFrame(rows, RUNS)


KEYS = ("dataset", "method", "tol", "max_n")
RATIOS, COUNTS = ("pq", "sq", "rq", "rc50", "miou"), ("gt", "pred", "tp", "fp", "fn")


def benchmark_table(runs: DataFrame, warmup: int = 1) -> DataFrame:
    """Warm-up and extremes dropped, then means; fps from the mean."""
    kept = stats.drop_extremes(stats.drop_warmup(runs, KEYS, "run", warmup), KEYS, "ms", "run")
    return kept.groupBy(*KEYS).agg(F.avg("ms").alias("ms"), F.round(F.avg("clusters")).cast("long").alias("clusters")).withColumn("fps", stats.fps("ms"))


def tolerance_table(runs: DataFrame, base: str, other: str, trim: int = 1) -> DataFrame:
    """Per cloud and tolerance: trimmed mean, median, speed-up and winner of two methods."""
    k = ("dataset", "tol", "method")
    two = runs.where(F.col("method").isin(base, other))
    t = stats.trimmed_mean(two, k, "ms", trim, ("run",)).join(stats.nearest_rank(two, k, "ms", {}), list(k))
    return stats.speedups(t, ("dataset", "tol"), "method", base, "trimmed_mean")


def with_targets(table: DataFrame, manifest: DataFrame, key: str = "points") -> DataFrame:
    """Timing rows with the manifest row of their number of points; a number without one is an error."""
    met = table.join(F.broadcast(manifest.withColumnRenamed("target_points", key)), key, "left")  # a manifest has one row for each target
    missing = F.raise_error(F.concat(F.lit("target not in manifest: "), F.col(key).cast("string")))
    return met.withColumn("ply_path", F.when(F.col("ply_path").isNull(), missing).otherwise(F.col("ply_path")))


def cloth_timing(spark: SparkSession, frames: dict[str, DataFrame], tol: float = 0.2, min_size: int = 100, max_n: int = 50, **cloth) -> DataFrame:
    """One row for each frame (seq, frame, idx, x, y, z): points before and after the cloth filter, its time, the time of seeded clustering, their sum, and clusters."""
    rows = []
    for name, points in frames.items():
        points = cut(points)
        began = time.perf_counter()
        rest = cut(off_ground(points, cloth_ground(points, **cloth)))
        n = rest.count()
        filtered = time.perf_counter()
        found = cluster(rest, "seeded", tol=tol, min_size=min_size, max_n=max_n, keys=("seq", "frame")).agg(F.countDistinct("cluster_id")).first()[0]
        rows.append((name, points.count(), n, (filtered - began) * 1000, (time.perf_counter() - filtered) * 1000, found))
    out = spark.createDataFrame(rows, "dataset string, raw_points long, nonground_points long, csf_ms double, cluster_ms double, clusters long")
    return out.withColumn("total_ms", F.col("csf_ms") + F.col("cluster_ms")).withColumns({"cluster_fps": stats.fps("cluster_ms"), "total_fps": stats.fps("total_ms")})


def frame_timing(runs: DataFrame, trim: int = 0) -> DataFrame:
    """Per frame (dataset = sequence/frame) trimmed means, then per-sequence and overall rows."""
    t = stats.trimmed_mean(runs, ("dataset", "method", "max_n"), "ms", trim, ("run",), "ms").withColumn("sequence", F.substring_index("dataset", "/", 1))
    return t.cube("sequence", "method").agg(F.count("*").alias("frames"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")).where("method is not null").withColumn("avg_fps", stats.fps("avg_ms"))


def compare_caps(table: DataFrame, caps: Sequence[int] = (0, 50)) -> DataFrame:
    """One row for each cloud, method and tolerance, with the time and clusters of each cap side by side."""
    return table.groupBy("dataset", "method", "tol").pivot("max_n", list(caps)).agg(F.first("ms").alias("ms"), F.first("clusters").alias("clusters"))


def mode_means(table: DataFrame, columns: Sequence[str] = ("total_ms", "search_ms", "search_calls"), caps: Sequence[int] = (0, 50), by: Sequence[str] = ("mode",)) -> DataFrame:
    """Per mode: rows, the mean of each column at either cap (named column_cap), and the second less the first."""
    a, b = caps
    means = table.groupBy(*by).agg(F.count("*").alias("count"), *(F.avg(f"{c}_{k}").alias(f"avg_{c}_{k}") for c in columns for k in caps))
    return means.withColumns({f"avg_delta_{c}_{b}_minus_{a}": F.col(f"avg_{c}_{b}") - F.col(f"avg_{c}_{a}") for c in columns})


def stage_table(points: DataFrame, tolerances: Iterable[float], caps: Sequence[int] = (0, 50), min_size: int = 100, repeats: int = 7, keys: Sequence[str] = ("seq", "frame")) -> DataFrame:
    """Per cloud, tolerance and cap: the median time of each stage over the runs, frames a second, clusters, and the counters of the searches."""
    points, out = cut(points), None
    stages = ("build_ms", "search_ms", "merge_ms", "final_ms", "total_ms")
    for tol in tolerances:
        for cap in caps:
            runs = stage_times(points, tol, min_size, cap, keys, repeats)
            times = runs.groupBy(*keys).agg(F.max("points").alias("points"), *(F.median(s).alias(s) for s in stages))
            both = times.join(seed_profile(points, tol, cap, min_size, keys), list(keys)).withColumns({"tol": F.lit(float(tol)), "max_n": F.lit(cap), "fps": stats.fps("total_ms"), "avg_search_ms": F.col("search_ms") / F.col("search_calls")})
            out = both if out is None else out.unionByName(both)
    return out


def evaluate_frames(frames: DataFrame, method: str = "seeded", ground: Sequence[int] = (), classes: Sequence[int] = (), min_gt: int = 30, keys: Sequence[str] = ("seq", "frame"), **options) -> dict[str, DataFrame]:
    """frames: keys, idx, x, y, z, label. Ground is removed by label, points are clustered per frame and scored against instances of at least min_gt points: best overlaps, per-frame means, and panoptic counts per frame and overall."""
    p = labels.without(labels.unpack(frames), ground) if ground else labels.unpack(frames)
    p = cut(p)
    found = cut(cluster(p, method, keys=keys, **options))
    gt = labels.ground_truth(p, classes, min_gt, tuple(keys))
    pairs = cut(evaluate.overlaps(found, gt, keys))
    best = evaluate.best_matches(pairs, gt, keys)
    counts = evaluate.panoptic(evaluate.greedy_matches(pairs, keys), best, found, keys)
    return {"clusters": found, "best": best, "frames": evaluate.frame_scores(best, keys), "counts": evaluate.ratios(counts), "overall": evaluate.merged(counts, ())}


def evaluate_boxes(points: DataFrame, calib: DataFrame, box_labels: DataFrame, method: str = "seeded", box_axes: str = "width_first", **options) -> dict[str, DataFrame]:
    """Clusters of each frame against the points inside its labelled boxes; instance sizes count all points of a box."""
    keys = ("frame",)
    camera = geometry.to_camera(points, calib, keys)
    gt, sizes = boxes.first_box(boxes.inside(camera, box_labels, keys, box_axes), keys)
    found = cut(cluster(points, method, keys=keys, **options))
    pairs = evaluate.overlaps(found, gt, keys, sizes)
    best = evaluate.best_matches(pairs, gt, keys)
    return {"best": best, "frames": evaluate.frame_scores(best, keys)}


def build_fusion(points: DataFrame, poses: DataFrame, tr: Sequence[float] | None, targets: Sequence[int], voxel: float, ghost_radius: float = 0.0, static: Sequence[int] = labels.KITTI_STATIC) -> dict[str, DataFrame]:
    """points: frame, idx, x, y, z, semantic. Static classes are moved into the common system and fused up to the largest target: the decisions, the counters per frame, and one prefix with its statistics for each target."""
    raw = points.groupBy("frame").agg(F.count("*").alias("raw_points"))
    moved = geometry.apply_poses(labels.only(points, static), poses, tr)
    decided = cut(fusion.decide(moved, voxel, ghost_radius))
    out = {"decided": decided, "counters": fusion.counters(decided, raw, max(targets))}
    classes = {"car": [10], "tree": [70, 71], "building": [50]}
    for t in sorted(targets):
        out[f"prefix_{t}"] = fusion.prefix(decided, t)
        out[f"stats_{t}"] = fusion.cloud_stats(out[f"prefix_{t}"], classes).withColumn("target_points", F.lit(t))
    return out


def profile_caps(points: DataFrame, tol: float, caps: Sequence[int] = (0, 50), min_size: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """Search counters of the seeded method for each cap."""
    parts = [seed_profile(points, tol, c, min_size, keys).withColumn("max_n", F.lit(c)) for c in caps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def probe(points: DataFrame, tol: float, max_n: int = 50, samples: int = 1000) -> DataFrame:
    return radius_probe(points, tol, max_n, samples)


def compare_ground(frames: DataFrame, ground: Sequence[int] = labels.KITTI_GROUND, keys: Sequence[str] = ("seq", "frame"), **cloth) -> DataFrame:
    """Per frame: points, those the labels call ground, those the cloth does, and both."""
    p = cloth_ground(labels.unpack(frames), keys, **cloth)
    named = F.col("semantic").isin(*ground)
    return p.groupBy(*keys).agg(F.count("*").alias("points"), F.count_if(named).alias("by_label"), F.count_if("ground").alias("by_cloth"), F.count_if(named & F.col("ground")).alias("by_both"))


def snapshot(points: DataFrame, tol: float, min_size: int = 100, max_n: int = 50, cloth: bool = False, keys: Sequence[str] = ("seq", "frame")) -> DataFrame:
    """Clustered points with a colour for each cluster, noise left out."""
    p = off_ground(points, cloth_ground(points, keys), keys) if cloth else points
    found = cluster(p, "seeded", tol=tol, min_size=min_size, max_n=max_n, keys=keys).where("cluster_id is not null")
    return p.join(found, [*keys, "idx"]).withColumns(dict(zip("rgb", geometry.colour("cluster_id"), strict=True)))


def tune(samples: DataFrame, gt: DataFrame, candidates: DataFrame, drop: float = 0.02, keep: int | None = 15, key: str = "sample") -> DataFrame:
    """Ranks parameter candidates (id, tol, min_size, max_n) over all samples (sample, idx, x, y, z) by panoptic quality and time.

    Each candidate is one distributed job over all samples; tune_stages() goes on with what is kept.
    """
    rows = []
    for c in candidates.collect():  # a table of parameters, not data
        began = time.perf_counter()
        found = cut(cluster(samples, "seeded", tol=c["tol"], min_size=c["min_size"], max_n=c["max_n"], keys=(key,)))
        ms = (time.perf_counter() - began) * 1000
        pairs = cut(evaluate.overlaps(found, gt, (key,)))
        counts = evaluate.panoptic(evaluate.greedy_matches(pairs, (key,)), evaluate.best_matches(pairs, gt, (key,)), found, (key,))
        r = evaluate.merged(counts, ()).first()
        rows.append((c["id"], c["tol"], c["min_size"], c["max_n"], float(ms), *(float(r[m]) for m in RATIOS), *(int(r[m] or 0) for m in COUNTS)))
    types = ", ".join(["id long, tol double, min_size int, max_n int, ms double", *(f"{m} double" for m in RATIOS), *(f"{m} long" for m in COUNTS)])
    return stats.rank_candidates(samples.sparkSession.createDataFrame(rows, types), "ms", "pq", drop, keep)


def random_candidates(spark: SparkSession, n: int = 60, seed: int = 20240501, tol: tuple[float, float] = (0.12, 0.35), min_size: tuple[int, int] = (40, 240), max_n: tuple[int, int] = (20, 100)) -> DataFrame:
    """n parameter candidates (id, tol, min_size, max_n): the defaults as id 0, the others uniform in the ranges, ends included."""

    def within(bounds: tuple[int, int], salt: int):
        low, high = bounds
        return F.least(F.lit(high), F.floor(F.lit(low) + F.rand(seed + salt) * (high - low + 1))).cast("int")

    drawn = spark.range(0, n, 1, 1).select("id", (F.lit(tol[0]) + F.rand(seed) * (tol[1] - tol[0])).alias("tol"), within(min_size, 1).alias("min_size"), within(max_n, 2).alias("max_n"))
    first = F.col("id") == 0
    return drawn.select("id", *(F.when(first, F.lit(d)).otherwise(F.col(c)).alias(c) for c, d in (("tol", 0.2), ("min_size", 100), ("max_n", 50))))


def tune_stages(stages: Sequence[tuple[DataFrame, DataFrame]], candidates: DataFrame, keep: Sequence[int] = (15, 5), drop: float = 0.02, key: str = "sample") -> DataFrame:
    """The candidates over the (samples, ground truth) of each stage in turn; after a stage only its best ``keep`` go on. All ranked rows with the number of their stage; rank 1 of the last is the recommendation."""
    out = None
    for k, (samples, gt) in enumerate(stages):
        ranked = cut(tune(samples, gt, candidates, drop, None, key))
        rows = ranked.withColumn("stage", F.lit(k + 1))
        out = rows if out is None else out.unionByName(rows)
        if k < len(keep):
            candidates = ranked.where(F.col("rank") <= keep[k]).select("id", "tol", "min_size", "max_n").orderBy("id")
    return out


def _scored(samples: DataFrame, method: str, classes: Sequence[int], min_gt: int, keys: Sequence[str], **options) -> dict[str, float]:
    """Counts and ratios over all samples (keys, idx, x, y, z, semantic, instance), their number and points, and the mean time of one."""
    n = samples.groupBy(*keys).agg(F.count("*").alias("points")).agg(F.count("*").alias("samples"), F.coalesce(F.sum("points"), F.lit(0)).alias("points")).first().asDict()
    began = time.perf_counter()
    found = cut(cluster(samples, method, keys=keys, **options))
    ms = (time.perf_counter() - began) * 1000 / max(1, n["samples"])
    gt = labels.ground_truth(samples, classes, min_gt, tuple(keys))
    pairs = cut(evaluate.overlaps(found, gt, keys))
    best = evaluate.best_matches(pairs, gt, keys)
    r = evaluate.merged(evaluate.panoptic(evaluate.greedy_matches(pairs, keys), best, found, keys), ()).first()
    return n | {"ms": ms} | {m: float(r[m] or 0) for m in RATIOS} | {m: int(r[m] or 0) for m in COUNTS}


def four_sections(points: DataFrame, poses: DataFrame, tr: Sequence[float] | None, methods: Iterable[str], target: Sequence[int], others: Sequence[int], ground: Sequence[int], first: str, tol: float = 0.2, min_size: int = 100, max_n: int = 50, min_gt: int = 30, window: int = 10, stride: int = 15, samples: int = 32, sizes: Sequence[int] = (1_000_000, 2_000_000, 3_000_000), shift: int = 30, repeats: int = 7) -> dict[str, DataFrame]:
    """The full experiment over points (seq, frame, idx, x, y, z, semantic, instance) and poses of the sequence ``first``.

    speed: each method's times on the first frame of ``first`` without ground; frames: scores over every frame's points of the target classes; fusion: over windows of consecutive frames of ``first``, fused by their poses; hard: over fused runs of frames that reach ``sizes`` points of target and other classes, each beginning ``shift`` frames after the one before, with the target classes as ground truth.
    """
    spark, methods = points.sparkSession, list(methods)
    own = cut(points.where(F.col("seq") == first).drop("seq"))
    start = own.agg(F.min("frame")).first()[0]
    runs = timed_runs(spark, {first: own.where((F.col("frame") == start) & ~F.col("semantic").isin(*ground)).drop("frame")}, methods, [tol], min_size, [max_n], repeats)
    wanted = own.where(F.col("semantic").isin(*target, *others)).groupBy("frame").agg(F.count("*").alias("n"))
    listed = own.select("frame").distinct().join(wanted, "frame", "left").fillna(0, ["n"])
    place = F.row_number().over(Window.orderBy("frame")) - 1  # a row a frame
    listed = cut(listed.withColumn("place", place))
    chosen = None
    for k, size in enumerate(sizes):
        part = sampling.accumulate_until(listed.where(F.col("place") >= k * shift), "n", size).select(F.lit(k).cast("long").alias("sample"), "frame")
        chosen = part if chosen is None else chosen.unionByName(part)
    inputs = {
        "frames": (points.where(F.col("semantic").isin(*target)), ("seq", "frame")),
        "fusion": (fusion.make_sample(own, sampling.hopping_frames(listed, window, stride, samples), target, (), poses, tr), ("sample",)),
        "hard": (fusion.make_sample(own, chosen, (*target, *others), (), poses, tr), ("sample",)),
    }
    out = {"speed": stats.spread(runs, ("dataset", "method"), "ms").withColumn("fps", stats.fps("mean"))}
    types = ", ".join(["method string, samples long, points long, ms double", *(f"{m} double" for m in RATIOS), *(f"{m} long" for m in COUNTS)])
    for name, (cloud, keys) in inputs.items():
        cloud = cut(cloud)
        scored = [(m, _scored(cloud, m, target, min_gt, keys, tol=tol, min_size=min_size, **_cap(m, max_n))) for m in methods]
        out[name] = spark.createDataFrame([(m, *(r[c] for c in ("samples", "points", "ms", *RATIOS, *COUNTS))) for m, r in scored], types)
    return out


def cloud_report(spark: SparkSession, clouds: dict[str, DataFrame], methods: Iterable[str], tol: float = 0.2, min_size: int = 100, max_n: int = 50, min_gt: int = 30, repeats: int = 7) -> DataFrame:
    """Clouds (idx, x, y, z, scalar_instance), as PLY files hold them: for each and each method the scores against instances of at least min_gt points (ids above 0, rounded), and times over the runs."""
    rows, methods = [], list(methods)
    for name, cloud in clouds.items():
        cloud = cut(cloud.withColumns({"dataset": F.lit(name), "semantic": F.lit(1), "instance": F.greatest(F.lit(0), F.round("scalar_instance").cast("int"))}))
        rows += [(name, m, _scored(cloud, m, (), min_gt, ("dataset",), tol=tol, min_size=min_size, **_cap(m, max_n))) for m in methods]
    types = ", ".join(["dataset string, method string, points long", *(f"{m} double" for m in RATIOS), *(f"{m} long" for m in COUNTS)])
    scores = spark.createDataFrame([(d, m, *(r[c] for c in ("points", *RATIOS, *COUNTS))) for d, m, r in rows], types)
    runs = timed_runs(spark, {n: c.drop("scalar_instance") for n, c in clouds.items()}, methods, [tol], min_size, [max_n], repeats)
    times = stats.spread(runs, ("dataset", "method"), "ms").select("dataset", "method", F.col("mean").alias("mean_ms"), stats.fps("mean").alias("fps"))
    return scores.join(times, ["dataset", "method"])


def _cap(method: str, max_n: int) -> dict[str, int]:
    return {"max_n": max_n} if method.startswith(("seeded", "capped")) else {}
