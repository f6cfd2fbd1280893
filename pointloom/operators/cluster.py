"""Point-cloud clustering: exact Euclidean, order-dependent seeded, capped-graph, block-wise and region growing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import AXES, cell, finite, is_finite, with_cells, with_cells_from_min
from pointloom.graph import connected_components
from pointloom.operators import kernels
from pointloom.operators.neighbors import radius_pairs
from pointloom.session import cut, prepare

#: Points of one cloud (combination of keys) up to which a task clusters it alone; larger clouds go the distributed way.
KERNEL_POINTS = 200_000
#: Cells along each side of a tile of a large cloud, and points that a task takes together, about, from one tile or many.
TILE, TASK_POINTS = 24, 50_000


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _node(keys: Sequence[str], idx: str) -> F.Column:
    """What names a point among all clouds."""
    return F.struct(*keys, F.col(idx).alias("idx")) if keys else F.col(idx)


def emit(points: DataFrame, keys: Sequence[str], found: DataFrame, min_size: int) -> DataFrame:
    """(keys, idx, cluster_id, cluster_size): every point; noise and clusters of fewer than min_size points have nulls. found: (keys, idx, cluster_id) of all finite points, and cluster_size if it is known."""
    if "cluster_size" not in found.columns:
        found = found.join(found.groupBy(*keys, "cluster_id").agg(F.count("*").alias("cluster_size")), [*keys, "cluster_id"])
    large = F.col("cluster_size") >= min_size
    named = _all_set([*keys, "idx"])
    out = found.where(named).select(*keys, "idx", F.when(large, F.col("cluster_id").cast("long")).alias("cluster_id"), F.when(large, F.col("cluster_size")).alias("cluster_size"))
    rest = points.where(~(named & is_finite())).select(*keys, "idx", F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("long").alias("cluster_size"))
    return out.unionByName(rest)


def _all_set(columns: Sequence[str]) -> F.Column:
    """Whether none of the columns is null."""
    return reduce(and_, (F.col(c).isNotNull() for c in columns))


def _named(edges: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, cluster_id) of all finite points from edges (keys, i, j): components, single points included."""
    comp = _components(edges, keys)
    return finite(points).select(*keys, "idx").join(comp, [*keys, "idx"], "left").withColumn("cluster_id", F.coalesce("cluster_id", "idx"))


def _components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, cluster_id) of the points that have an edge (keys, i, j) to another."""
    e = edges.where("i <> j").select(_node(keys, "i").alias("src"), _node(keys, "j").alias("dst"))
    comp = connected_components(e)
    if keys:
        return comp.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.idx").alias("idx"), F.col("component.idx").alias("cluster_id"))
    return comp.select(F.col("node").alias("idx"), F.col("component").alias("cluster_id"))


def tiled(points: DataFrame, tol: float, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """(keys, idx, carry, cluster_id, cluster_size): components of the radius graph (<= tol) of all finite points, tile by tile.

    Tiles are blocks of TILE cells along each axis, with REACH more cells at their upper sides, so that each pair within tol lies in one of them. Points of a cell go to the same tiles and are always linked, so the cells that tiles share tell which of their components are one; only components that share a cell, not points, become edges. A task's memory grows with its points, not with pairs. Rows with null keys or idx are left out.
    """
    side, at, far = kernels.cell_side(tol), ("hx", "hy", "hz"), TILE
    placed = finite(points).where(_all_set([*keys, "idx"])).select(*keys, "idx", *(F.col(a).cast("double").alias(a) for a in AXES))
    lanes = max(1, points.count() // TASK_POINTS)
    for a, h in zip(AXES, at, strict=True):
        c = F.greatest(F.least(cell(a, side), F.lit(kernels.FARTHEST)), F.lit(-kernels.FARTHEST))
        own = F.floor(c / F.lit(far)).cast("long")
        placed = placed.withColumn(h, F.explode(F.when(F.pmod(c, F.lit(far)) < kernels.REACH, F.array(own - 1, own)).otherwise(F.array(own))))
    placed = placed.withColumn("lane", F.pmod(F.xxhash64(*keys, *at), F.lit(lanes)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows.column("idx").to_numpy(), kind="stable"))
        xyz, tile = (np.stack([rows.column(c).to_numpy() for c in names], axis=1) for names in (AXES, at))
        group = np.zeros(len(rows), np.int64)
        for code in (*(rows.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in keys), *tile.T):
            code = np.unique(code, return_inverse=True)[1]
            group = np.unique(group * (code.max() + 1) + code, return_inverse=True)[1]
        cells = np.floor(xyz / side).clip(-kernels.FARTHEST, kernels.FARTHEST).astype(np.int64) - tile * far
        found, first = kernels.cell_components(xyz, tol, cells, group)
        own = np.flatnonzero((cells < far).all(axis=1))
        shared = np.flatnonzero(((cells < kernels.REACH) | (cells >= far)).any(axis=1) & (first == np.arange(len(rows))))
        chosen = np.concatenate([own, shared])
        out = rows.select([*keys, "idx", *carry]).take(chosen)
        return out.append_column("local", rows.column("idx").cast(pa.int64()).take(found[chosen])).append_column("link", pa.array(np.arange(len(chosen)) >= len(own)))

    types = ", ".join([_types(points, [*keys, "idx"]), *(f"{a} double" for a in carry)])
    local = cut(placed.groupBy("lane").applyInArrow(run, f"{types}, local long, link boolean"))
    met = local.where("link").groupBy(*keys, "idx").agg(F.collect_set("local").alias("met")).where(F.size("met") > 1)
    edges = met.select(*keys, F.array_min("met").alias("i"), F.explode("met").alias("j")).distinct()
    comp = _components(edges, keys).withColumnRenamed("idx", "local")
    parts = local.where("not link").groupBy(*keys, "local").agg(F.count("*").alias("n")).join(comp, [*keys, "local"], "left").withColumn("cluster_id", F.coalesce("cluster_id", "local"))
    sizes = parts.groupBy(*keys, "cluster_id").agg(F.sum("n").alias("cluster_size"))
    parts = cut(parts.join(sizes, [*keys, "cluster_id"]).select(*keys, "local", "cluster_id", "cluster_size"))
    return local.where("not link").join(parts, [*keys, "local"]).select(*keys, "idx", *carry, "cluster_id", "cluster_size")


def first_independent_set(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str] = (), max_rounds: int = 10_000) -> DataFrame:
    """(keys, idx): the seeds of ``nodes`` (keys, idx) under directed pairs (keys, i, j): in idx order, each point that no earlier seed covers.

    Rounds over shrinking sets, each written to the checkpoint folder: a point is covered if an earlier seed reaches it, and becomes a seed once all earlier points that reach it are covered.
    """
    back = cut(pairs.where("i < j").select(*keys, "i", "j").distinct())
    open_ = nodes.select(*keys, "idx")
    seeds = None
    for _ in range(max_rounds):
        blocked = back.select(*keys, F.col("j").alias("idx")).distinct()
        new = cut(open_.join(blocked, [*keys, "idx"], "left_anti"))
        if new.isEmpty():
            return seeds if seeds is not None else new
        seeds = new if seeds is None else seeds.unionByName(new)
        reached = back.join(new.withColumnRenamed("idx", "i"), [*keys, "i"]).select(*keys, F.col("j").alias("idx")).distinct()
        open_ = cut(open_.join(new, [*keys, "idx"], "left_anti").join(reached, [*keys, "idx"], "left_anti"))
        # edges from covered points block no more; edges to covered points are done
        back = back.join(reached.withColumnRenamed("idx", "i"), [*keys, "i"], "left_anti").join(reached.withColumnRenamed("idx", "j"), [*keys, "j"], "left_anti")
        back = cut(back.join(new.withColumnRenamed("idx", "i"), [*keys, "i"], "left_anti"))
        if open_.isEmpty():
            return seeds
    raise RuntimeError("seeds did not settle")


def seed_stars(points: DataFrame, tol: float, keys: Sequence[str] = (), max_n: int = 0, cap: str = "nearest", precision: str = "f64") -> DataFrame:
    """(keys, i, j, d2) of all seeds i and the neighbours they cover, by rounds over the whole cloud."""
    pairs = cut(radius_pairs(points, tol, keys, max_n, cap, precision))
    seeds = first_independent_set(pairs, finite(points), keys)
    return pairs.join(seeds.withColumnRenamed("idx", "i"), [*keys, "i"], "left_semi")


def _by_group(points: DataFrame, keys: Sequence[str], group: Sequence[str], label: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
    """(keys, idx, cluster_id, cluster_size) from a kernel over each group's points in idx order; the kernel returns row numbers."""
    out = [*keys, "idx", "cluster_id", "cluster_size"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable").reset_index(drop=True)
        found = label(rows[list(AXES)].to_numpy(np.float64), rows)
        rows["cluster_id"] = rows["idx"].to_numpy()[found]
        rows["cluster_size"] = np.bincount(found, minlength=len(rows))[found]
        return rows[out]

    return finite(points).groupBy(*group).applyInPandas(run, f"{_types(points, [*keys, 'idx'])}, cluster_id long, cluster_size long")


def _largest(points: DataFrame, keys: Sequence[str]) -> int:
    n = points.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else points.count()
    return n or 0


def euclidean(points: DataFrame, tol: float, min_size: int = 1, keys: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """Connected components of the radius graph (<= tol); cluster_id is the smallest idx."""
    prepare(points.sparkSession)
    if strategy == "kernel" or strategy == "auto" and _largest(points, keys) <= KERNEL_POINTS:
        found = _by_group(points, keys, keys, lambda xyz, _: kernels.cluster_cloud(xyz, tol, "euclidean"))
    else:
        found = tiled(points, tol, keys)
    return emit(points, keys, found, min_size)


def seeded(points: DataFrame, tol: float, min_size: int = 1, max_n: int = 0, keys: Sequence[str] = (), cap: str = "nearest", strategy: str = "auto") -> DataFrame:
    """Order-dependent clustering: see operators.kernels.seeded_labels; max_n caps each search.

    Small clouds are walked in one task each. In large ones seeds and stars never leave a component of the radius graph, so components are found first and walked many to a task; components above KERNEL_POINTS get their seeds by rounds.
    """
    prepare(points.sparkSession)
    method = "seeded_scan_order" if cap == "scan_order" else "seeded"

    def walk(xyz, _):
        return kernels.cluster_cloud(xyz, tol, method, max_n)

    if strategy == "rounds":
        found = _named(seed_stars(points, tol, keys, max_n, cap), points, keys)
    elif strategy == "kernel" or strategy == "auto" and _largest(points, keys) <= KERNEL_POINTS:
        found = _by_group(points, keys, keys, walk)
    else:
        located = cut(tiled(points, tol, keys, AXES).withColumnsRenamed({"cluster_id": "comp", "cluster_size": "n"}))
        total = max(1, located.count() // TASK_POINTS)
        small = located.where(F.col("n") <= KERNEL_POINTS).withColumn("lane", F.pmod(F.xxhash64(*keys, "comp"), F.lit(total)))

        def many(rows: pd.DataFrame) -> pd.DataFrame:
            # components of a cloud are walked together: none has a point within tol of another's
            parts = []
            for _, g in rows.groupby(list(keys), sort=False) if keys else [(None, rows)]:
                g = g.sort_values("idx", kind="stable").reset_index(drop=True)
                label = walk(g[list(AXES)].to_numpy(np.float64), g)
                g["cluster_id"] = g["idx"].to_numpy()[label]
                g["cluster_size"] = np.bincount(label, minlength=len(g))[label]
                parts.append(g[[*keys, "idx", "cluster_id", "cluster_size"]])
            return pd.concat(parts)

        found = small.groupBy("lane").applyInPandas(many, f"{_types(points, [*keys, 'idx'])}, cluster_id long, cluster_size long")
        large = located.where(F.col("n") > KERNEL_POINTS)
        if not large.isEmpty():
            rest = _named(seed_stars(large, tol, keys, max_n, cap), large, keys)
            found = found.unionByName(rest.join(rest.groupBy(*keys, "cluster_id").agg(F.count("*").alias("cluster_size")), [*keys, "cluster_id"]))
    return emit(points, keys, found, min_size)


def capped_graph(points: DataFrame, tol: float, min_size: int = 1, max_n: int = 50, keys: Sequence[str] = (), strict: bool = False, strategy: str = "auto") -> DataFrame:
    """Components of the graph that links each point with its max_n nearest neighbours within tol (itself counted), in either direction."""
    prepare(points.sparkSession)
    if strategy == "kernel" or strategy == "auto" and _largest(points, keys) <= KERNEL_POINTS:
        found = _by_group(points, keys, keys, lambda xyz, _: kernels.cluster_cloud(xyz, tol, "capped_graph", max_n, strict))
    else:
        found = _named(radius_pairs(points, tol, keys, max_n, strict=strict), points, keys)
    return emit(points, keys, found, min_size)


def voxel_centroids(points: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, idx, x, y, z, n): mean of each voxel; idx numbers the voxels of a key by their smallest point."""
    v = with_cells(finite(points), size).groupBy(*keys, "vx", "vy", "vz").agg(F.min("idx").alias("first"), *(F.avg(a).alias(a) for a in AXES), F.count("*").alias("n"))
    return v.select(*keys, F.col("first").alias("idx"), *AXES, "n")


def centroid_graph(points: DataFrame, tol: float, min_size: int = 1, voxel: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """Euclidean clusters of voxel means."""
    return euclidean(voxel_centroids(points, voxel, keys), tol, min_size, keys)


def block_size(tol: float) -> float:
    return max(8 * tol, tol + 1e-6)


def block_seeded(points: DataFrame, tol: float, min_size: int = 1, max_n: int = 0, keys: Sequence[str] = (), size: float | None = None) -> DataFrame:
    """Seeded clustering of each block and a halo of tol, clusters that share a point united; each point counts for the block that owns it.

    Blocks are counted from the cloud's smallest coordinates; a point goes to every existing block that its +-tol box touches. Within a block points keep their idx order.
    """
    prepare(points.sparkSession)
    size = size or block_size(tol)
    owned = with_cells_from_min(finite(points).select(*keys, "idx", *AXES), size, keys)
    low = points.groupBy(*keys).agg(*(F.min(a).cast("double").alias(f"m{a}") for a in AXES))
    placed = owned.join(low, list(keys)) if keys else owned.join(F.broadcast(low))
    for a in AXES:
        near = F.sequence(F.floor((F.col(a) - tol - F.col(f"m{a}")) / size).cast("long"), F.floor((F.col(a) + tol - F.col(f"m{a}")) / size).cast("long"))
        placed = placed.withColumn(f"h{a}", F.explode(near))
    blocks = owned.select(*keys, *(F.col(f"b{a}").alias(f"h{a}") for a in AXES)).distinct()
    spread = placed.join(blocks, [*keys, "hx", "hy", "hz"], "left_semi").select(*keys, "idx", *AXES, "hx", "hy", "hz")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable").reset_index(drop=True)
        rows["local"] = rows["idx"].to_numpy()[kernels.cluster_cloud(rows[list(AXES)].to_numpy(np.float64), tol, "seeded", max_n)]
        return rows[[*keys, "idx", "hx", "hy", "hz", "local"]]

    local = cut(spread.groupBy(*keys, "hx", "hy", "hz").applyInPandas(run, f"{_types(points, [*keys, 'idx'])}, hx long, hy long, hz long, local long"))
    # a local cluster's points hang on its smallest one in this block, so sharing a point unites clusters
    edges = local.where("idx <> local").select(*keys, F.col("idx").alias("i"), F.col("local").alias("j"))
    return emit(points, keys, _named(edges, points, keys), min_size)


def block_euclidean(points: DataFrame, tol: float, min_size: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Block-wise Euclidean clustering, which equals the global one: each tile by itself, then components that share a cell united."""
    return euclidean(points, tol, min_size, keys, "distributed")


def region_growing(points: DataFrame, min_size: int = 1, k: int = 30, smooth_deg: float = 30.0, curvature: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Regions of similar surface normals, one cloud a task."""
    prepare(points.sparkSession)
    found = _by_group(points, keys, keys, lambda xyz, _: kernels.region_growing(xyz, k, smooth_deg, curvature))
    return emit(points, keys, found, min_size)


#: Name -> clustering function; further ones come by register_algorithm.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "euclidean": euclidean,
    "euclidean_block": block_euclidean,
    "seeded": seeded,
    "seeded_voxel": lambda points, tol, min_size=1, max_n=0, keys=(): seeded(points, tol, min_size, max_n, keys, "scan_order"),
    "seeded_block": block_seeded,
    "capped_graph": capped_graph,
    "centroid_graph": centroid_graph,
    "region_growing": region_growing,
}


def register_algorithm(name: str, fn: Callable[..., DataFrame]) -> None:
    if name in ALGORITHMS:
        raise ValueError(f"{name} is registered already")
    ALGORITHMS[name] = fn


def cluster(points: DataFrame, method: str, **options) -> DataFrame:
    """(keys, idx, cluster_id, cluster_size) by a registered algorithm."""
    if method not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {method!r}; known: {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[method](points, **options)


def seed_profile(points: DataFrame, tol: float, max_n: int = 0, min_size: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: searches made, neighbours returned (all, mean, most), searches that reached the cap, clusters and clustered points, and how often a walk that labels points would rename a label.

    A search whose points carry no label yet opens one, and each renaming makes one label fewer, so there are as many as labels opened beyond the final ones; a renaming visits every point.
    """
    stars = cut(seed_stars(points, tol, keys, max_n))
    first = stars.groupBy(*keys, "j").agg(F.min("i").alias("first"))
    per_seed = stars.join(first, [*keys, "j"]).groupBy(*keys, "i").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    full = F.col("n") >= max_n if max_n else F.lit(False)
    calls = per_seed.groupBy(*keys).agg(F.count("*").alias("search_calls"), F.sum("n").alias("total_neighbors_returned"), F.avg("n").alias("avg_neighbors_returned"), F.max("n").alias("max_neighbors_returned"), F.count_if(full).alias("saturation_count"), F.avg(full.cast("double")).alias("saturation_rate"), F.count_if(F.col("first") == F.col("i")).alias("_opened"))
    named = cut(_named(stars, points, keys))
    final = named.groupBy(*keys).agg(F.countDistinct("cluster_id").alias("_final"), F.count("*").alias("_points"))
    made = emit(points, keys, named, min_size).where("cluster_id is not null").groupBy(*keys).agg(F.countDistinct("cluster_id").alias("clusters"), F.count("*").alias("clustered_points"))
    if keys:
        out = calls.join(final, list(keys)).join(made, list(keys), "left")
    else:
        out = calls.join(F.broadcast(final)).join(F.broadcast(made))  # single rows
    renamed = F.col("_opened") - F.col("_final")
    return out.withColumns({"relabel_trigger_count": renamed, "relabel_point_visits": renamed * F.col("_points")}).drop("_opened", "_final", "_points")


def stage_times(points: DataFrame, tol: float, min_size: int = 1, max_n: int = 0, keys: Sequence[str] = (), repeats: int = 1) -> DataFrame:
    """(keys, run, points, clusters, clustered_points, build_ms, search_ms, merge_ms, final_ms, total_ms): the seeded clustering of each cloud timed stage by stage within its task. Clouds of more than KERNEL_POINTS are an error, since their stages are spread over many tasks."""
    prepare(points.sparkSession)
    if _largest(points, keys) > KERNEL_POINTS:
        raise ValueError(f"a cloud has more than {KERNEL_POINTS} points")
    stages = ("build_ms", "search_ms", "merge_ms", "final_ms")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        xyz, out = rows[list(AXES)].to_numpy(np.float64), []
        for k in range(repeats):
            found, ms = kernels.staged_cloud(xyz, tol, max_n, min_size)
            kept = found[found >= 0]
            out.append({**{c: rows[c].iloc[0] for c in keys}, "run": k, "points": len(xyz), "clusters": len(np.unique(kept)), "clustered_points": len(kept), **ms, "total_ms": sum(ms.values())})
        return pd.DataFrame(out)

    types = [f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys]
    schema = ", ".join([*types, "run int", "points long", "clusters long", "clustered_points long", *(f"{s} double" for s in (*stages, "total_ms"))])
    return finite(points).select(*keys, "idx", *(F.col(a).cast("double").alias(a) for a in AXES)).groupBy(*keys).applyInPandas(run, schema)


def noise(points: DataFrame, clusters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points that belong to no cluster."""
    return points.join(clusters.where("cluster_id is not null"), [*keys, "idx"], "left_anti")


def rank_neighbors(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys, "i").orderBy("d2", "j")
    return pairs.withColumn("rank", F.row_number().over(w))
