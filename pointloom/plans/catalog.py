"""Registered queries over the test tables, with their DuckDB oracles.

The tables hold no LiDAR data, so clouds are derived: points are the first three components of the embeddings (idx is
vec_id, label is the instance), labelled frames come from events, and timing runs from lineitem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry, labels, stats, text
from pointloom.operators import boxes, cluster, evaluate, fusion, neighbors, sampling
from pointloom.operators.ground import cloth_ground
from pointloom.plans import experiments
from pointloom.session import prepare, table

TOL, MIN_SIZE = 0.05, 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """idx, x, y, z, label of the embeddings."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")), "label")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """frame (day), idx, x, y, z, semantic of the events."""
    e = table(spark, sf, "events")
    kinds = F.when(F.col("event_type") == "click", 10).when(F.col("event_type") == "view", 50).when(F.col("event_type") == "purchase", 70).otherwise(71)
    return e.select(F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("frame"), F.col("event_id").alias("idx"), (F.col("value") / 10).alias("x"), (F.col("user_id") % 20).cast("double").alias("y"), (F.hour("ts") / 4).cast("double").alias("z"), kinds.alias("semantic"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """method, run, ms of lineitem: suppliers as methods, prices as times."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("method"), F.row_number().over(order).cast("long").alias("run"), F.col("l_extendedprice").cast("double").alias("ms"), F.col("l_quantity").cast("long").alias("clusters"))


PTS = "pts as (select vec_id as idx, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z, label from embeddings)"
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
ALL = f"allp as (select a.idx as i, b.idx as j, {D2} as d2, (floor(b.x / {TOL}) - floor(a.x / {TOL}) + 1) * 9 + (floor(b.y / {TOL}) - floor(a.y / {TOL}) + 1) * 3 + (floor(b.z / {TOL}) - floor(a.z / {TOL}) + 1) as k from pts a, pts b where {D2} <= {TOL} * {TOL})"
FRAMES = "fr as (select datediff('day', date '2024-01-01', cast(ts as date)) as frame, event_id as idx, value / 10 as x, cast(user_id % 20 as double) as y, hour(ts) / 4.0 as z, case event_type when 'click' then 10 when 'view' then 50 when 'purchase' then 70 else 71 end as semantic from events)"
RUNS = "rn as (select l_suppkey as method, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey) as run, cast(l_extendedprice as double) as ms, cast(l_quantity as bigint) as clusters from lineitem)"


def capped_sql(n: int, order: str = "(j <> i), d2, j") -> str:
    return f"prs as (select i, j, d2 from (select *, row_number() over (partition by i order by {order}) as r from allp) where r <= {n})"


UNCAPPED = "prs as (select i, j, d2 from allp)"
SEEDS = "nb as (select j, list(i) as prev from prs where i < j group by j), w(n, seeds) as (select cast(-1 as bigint), cast([] as bigint[]) union all select n + 1, case when list_has_any(coalesce(prev, cast([] as bigint[])), seeds) then seeds else list_append(seeds, n + 1) end from w left join nb on nb.j = n + 1 where n + 1 <= (select max(idx) from pts)), sd as (select unnest(seeds) as s from (select seeds from w order by n desc limit 1)), st as (select * from prs where i in (select s from sd))"


def clusters_sql(edges: str) -> str:
    return f"ed as (select i, j from {edges} union select j, i from {edges}), re(i, j) as (select idx, idx from pts union select re.i, ed.j from re join ed on ed.i = re.j), cl as (select i as idx, min(j) as c from re group by i), sz as (select c, count(*) as n from cl group by c)"


EMIT = f"select cl.idx, case when n >= {MIN_SIZE} then cl.c end as cluster_id, case when n >= {MIN_SIZE} then n end as cluster_size from cl join sz on sz.c = cl.c"


@query(f"with {PTS}, {ALL} select i, j, round(d2, 9) as d2 from allp")
def radius_pairs(spark, sf):
    return neighbors.radius_pairs(cloud(spark, sf), TOL).select("i", "j", F.round("d2", 9).alias("d2"))


@query(f"with {PTS}, {ALL}, {capped_sql(4)} select i, j, round(d2, 9) as d2 from prs")
def radius_pairs_capped(spark, sf):
    return neighbors.radius_pairs(cloud(spark, sf), TOL, max_n=4).select("i", "j", F.round("d2", 9).alias("d2"))


@query(f"with {PTS}, {ALL} select i, j, round(d2, 9) as d2 from allp where i < j")
def half_space_pairs(spark, sf):
    return neighbors.half_pairs(cloud(spark, sf), TOL).select("i", "j", F.round("d2", 9).alias("d2"))


@query(f"with recursive {PTS}, {ALL}, {UNCAPPED}, {clusters_sql('prs')} {EMIT}")
def euclidean_clusters(spark, sf):
    return cluster.euclidean(cloud(spark, sf), TOL, MIN_SIZE)


@query(ORACLES["euclidean_clusters"])
def euclidean_clusters_halfspace(spark, sf):
    return cluster.euclidean(cloud(spark, sf), TOL, MIN_SIZE, strategy="distributed")


@query(ORACLES["euclidean_clusters"])
def block_euclidean_clusters(spark, sf):
    return cluster.cluster(cloud(spark, sf), "euclidean_block", tol=TOL, min_size=MIN_SIZE)


@query(f"with recursive {PTS}, {ALL}, {UNCAPPED}, {SEEDS}, {clusters_sql('st')} {EMIT}")
def seeded_clusters(spark, sf):
    return cluster.seeded(cloud(spark, sf), TOL, MIN_SIZE)


@query(ORACLES["seeded_clusters"])
def seeded_clusters_by_component(spark, sf):
    return cluster.seeded(cloud(spark, sf), TOL, MIN_SIZE, strategy="components")


@query(ORACLES["seeded_clusters"])
def seeded_clusters_by_rounds(spark, sf):
    return cluster.seeded(cloud(spark, sf), TOL, MIN_SIZE, strategy="rounds")


@query(f"with recursive {PTS}, {ALL}, {capped_sql(4)}, {SEEDS}, {clusters_sql('st')} {EMIT}")
def seeded_clusters_capped(spark, sf):
    return cluster.seeded(cloud(spark, sf), TOL, MIN_SIZE, max_n=4)


@query(f"with recursive {PTS}, {ALL}, {capped_sql(4)}, {clusters_sql('prs')} {EMIT}")
def capped_graph_clusters(spark, sf):
    return cluster.capped_graph(cloud(spark, sf), TOL, MIN_SIZE, 4)


@query(f"with recursive {PTS}, {ALL}, {capped_sql(4, 'k, j')}, {SEEDS}, {clusters_sql('st')} {EMIT}")
def voxel_scan_order_clusters(spark, sf):
    return cluster.cluster(cloud(spark, sf), "seeded_voxel", tol=TOL, min_size=MIN_SIZE, max_n=4)


@query()
def block_seeded_clusters(spark, sf):
    return cluster.block_seeded(cloud(spark, sf), 0.03, MIN_SIZE, size=0.1)


@query(f"with recursive {PTS}, {ALL}, lt as (select * from allp where d2 < {TOL} * {TOL} or i = j), prs as (select i, j, d2 from (select *, row_number() over (partition by i order by (j <> i), d2, j) as r from lt) where r <= 5), {clusters_sql('prs')} {EMIT}")
def capped_graph_strict(spark, sf):
    return cluster.capped_graph(cloud(spark, sf), TOL, MIN_SIZE, 5, strict=True)


KNN = "a as (select a.idx as i, b.idx as j, {} as d2 from pts a, pts b) select i, j, round(d2, 9) as d2, rank from (select *, row_number() over (partition by i order by d2, j) as rank from a) where rank <= 5".format(D2)
COARSE = "pts as (select idx, floor(x * 8) / 8 as x, floor(y * 8) / 8 as y, floor(z * 8) / 8 as z from (select vec_id as idx, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings))"


def coarse(spark, sf):
    """The cloud on a grid of eighths, where many points coincide."""
    return cloud(spark, sf).withColumns({a: F.floor(F.col(a) * 8) / 8 for a in "xyz"})


@query(f"with {PTS}, {KNN}")
def knn(spark, sf):
    return neighbors.knn_pairs(cloud(spark, sf), 5).select("i", "j", F.round("d2", 9).alias("d2"), "rank")


@query(f"with {COARSE}, {KNN}")
def knn_coincident(spark, sf):
    return neighbors.knn_pairs(coarse(spark, sf), 5).select("i", "j", F.round("d2", 9).alias("d2"), "rank")


@query(f"with {COARSE}, {KNN}")
def knn_distributed(spark, sf):
    return neighbors.knn_pairs(coarse(spark, sf), 5, strategy="distributed").select("i", "j", F.round("d2", 9).alias("d2"), "rank")


@query(f"with recursive f as (select vec_id as idx, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z, cast(label as bigint) as frame from embeddings), prs as (select a.idx as i, b.idx as j from f a, f b where a.frame = b.frame and {D2} <= 0.01), ed as (select i, j from prs union select j, i from prs), re(i, j) as (select idx, idx from f union select re.i, ed.j from re join ed on ed.i = re.j), cl as (select i as idx, min(j) as c from re group by i), sz as (select c, count(*) as n from cl group by c) select frame, cl.idx, case when n >= 3 then cl.c end as cluster_id, case when n >= 3 then n end as cluster_size from cl join sz on sz.c = cl.c join f on f.idx = cl.idx")
def clusters_by_frame(spark, sf):
    p = cloud(spark, sf).withColumn("frame", F.col("label").cast("long"))
    return cluster.euclidean(p, 0.1, 3, ("frame",), "distributed")


VOX = "vx as (select min(idx) as idx, round(avg(x), 9) as x, round(avg(y), 9) as y, round(avg(z), 9) as z, count(*) as n from pts group by floor(x / 0.1), floor(y / 0.1), floor(z / 0.1))"


@query(f"with {PTS}, {VOX} select * from vx")
def voxel_centroid(spark, sf):
    return cluster.voxel_centroids(cloud(spark, sf), 0.1).select("idx", *(F.round(a, 9).alias(a) for a in "xyz"), "n")


@query(f"with recursive {PTS}, v0 as (select min(idx) as idx, avg(x) as x, avg(y) as y, avg(z) as z from pts group by floor(x / 0.02), floor(y / 0.02), floor(z / 0.02)), prs as (select a.idx as i, b.idx as j from v0 a, v0 b where {D2} <= 0.0025), {clusters_sql('prs').replace('from pts', 'from v0')} {EMIT}")
def centroid_clusters(spark, sf):
    return cluster.centroid_graph(cloud(spark, sf), TOL, MIN_SIZE, 0.02)


@query(f"with recursive {PTS}, {ALL}, {UNCAPPED}, {clusters_sql('prs')} select idx from cl join sz on sz.c = cl.c where n < {MIN_SIZE}")
def noise_points(spark, sf):
    p = cloud(spark, sf)
    return cluster.noise(p, cluster.euclidean(p, TOL, MIN_SIZE)).select("idx")


@query(f"with recursive {PTS}, {ALL}, {capped_sql(4)}, {SEEDS}, per as (select i, count(*) as n from st group by i), {clusters_sql('st')}, fo as (select j, min(i) as f from st group by j), opn as (select count(*) - (select count(*) from sz) as r from (select st.i, min(f) as f from st join fo on fo.j = st.j group by st.i) where f = i) select (select r from opn) as relabel_trigger_count, (select r from opn) * (select count(*) from pts) as relabel_point_visits, (select count(*) from per) as search_calls, cast((select sum(n) from per) as bigint) as total_neighbors_returned, (select round(avg(n), 9) from per) as avg_neighbors_returned, (select max(n) from per) as max_neighbors_returned, (select count(*) from per where n >= 4) as saturation_count, (select round(avg(case when n >= 4 then 1.0 else 0.0 end), 9) from per) as saturation_rate, (select count(*) from sz where n >= {MIN_SIZE}) as clusters, cast((select sum(n) from sz where n >= {MIN_SIZE}) as bigint) as clustered_points")
def seed_profile(spark, sf):
    p = cluster.seed_profile(cloud(spark, sf), TOL, 4, MIN_SIZE)
    return p.withColumns({c: F.round(c, 9) for c in ("avg_neighbors_returned", "saturation_rate")})


@query(f"with {PTS}, {ALL}, n as (select i, count(*) as n from allp where i % 10 = 0 group by i) select count(*) as searched, round(avg(n), 9) as avg_neighbors, max(n) as max_neighbors, round(avg(case when n > 4 then 1.0 else 0.0 end), 9) as over_rate, round(avg(least(n, 4)), 9) as avg_capped, max(least(n, 4)) as max_capped from n where i < (select count(*) from pts) // ((select count(*) from pts) // 10) * ((select count(*) from pts) // 10)")
def radius_probe(spark, sf):
    p = cloud(spark, sf)
    r = neighbors.radius_probe(p, TOL, 4, p.count() // 10)
    return r.select("searched", F.round("avg_neighbors", 9).alias("avg_neighbors"), "max_neighbors", F.round("over_rate", 9).alias("over_rate"), F.round("avg_capped", 9).alias("avg_capped"), F.col("max_capped").cast("long").alias("max_capped"))


@query(f"with {PTS}, tn as (select idx, y as x, z as y, x as z from pts) select a.idx as i, round(min({D2}), 9) as d2 from pts a, tn b group by a.idx")
def nearest_distance(spark, sf):
    p = cloud(spark, sf)
    turned = p.select("idx", F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z"))
    return neighbors.nearest_distance(p, turned, first=0.02).select("i", F.round("d2", 9).alias("d2"))


@query(f"with {FRAMES} select frame, idx, semantic, cast(floor(x / 2) as bigint) as vx, cast(floor(y / 2) as bigint) as vy, cast(floor(z / 2) as bigint) as vz from (select *, row_number() over (partition by semantic, floor(x / 2), floor(y / 2), floor(z / 2) order by frame, idx) as r from fr) where r = 1")
def voxel_first(spark, sf):
    return fusion.voxel_first(frames(spark, sf), 2.0).select("frame", "idx", "semantic", "vx", "vy", "vz")


DEC = f"{FRAMES}, dec as (select *, row_number() over (order by frame, idx) - 1 as seq_no, case when row_number() over (partition by semantic, floor(x / 2), floor(y / 2), floor(z / 2) order by frame, idx) = 1 then 'accepted' else 'density' end as status from fr)"


@query(f"with {DEC} select seq_no, frame, idx, status from dec")
def fusion_decisions(spark, sf):
    return fusion.decide(frames(spark, sf), 2.0).select("seq_no", "frame", "idx", "status")


GHOST = "ap as (select *, row_number() over (order by label, idx) - 1 as n0 from pts), cf as (select a.idx as i, b.idx as j, bool_or(d) as g from (select a, b, d from (select a, b, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.05 * 0.05 as d from pts a, pts b where a.idx < b.idx and a.label = b.label and (((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.05 * 0.05 or (floor(a.x / 0.1) = floor(b.x / 0.1) and floor(a.y / 0.1) = floor(b.y / 0.1) and floor(a.z / 0.1) = floor(b.z / 0.1))))) group by a.idx, b.idx)"


@query(f"with recursive {PTS}, {GHOST}, prs as (select i, j from cf), nb as (select j, list(i) as prev from prs group by j), w(n, seeds) as (select cast(-1 as bigint), cast([] as bigint[]) union all select n + 1, case when list_has_any(coalesce(prev, cast([] as bigint[])), seeds) then seeds else list_append(seeds, n + 1) end from w left join nb on nb.j = n + 1 where n + 1 <= (select max(idx) from pts)), sd as (select unnest(seeds) as s from (select seeds from w order by n desc limit 1)), hit as (select j, bool_or(g) as g from cf where i in (select s from sd) group by j) select pts.idx, case when s is not null then 'accepted' when g then 'ghost' else 'density' end as status from pts left join sd on s = pts.idx left join hit on hit.j = pts.idx")
def ghost_fusion(spark, sf):
    p = cloud(spark, sf).withColumns({"frame": F.lit(0), "semantic": F.col("label")})
    return fusion.decide(p, 0.1, 0.05).select("idx", "status")


@query(f"with {DEC}, acc as (select *, row_number() over (order by seq_no) as k from dec where status = 'accepted') select frame, idx, semantic from acc where k <= 150")
def fusion_targets(spark, sf):
    return fusion.prefix(fusion.decide(frames(spark, sf), 2.0), 150).select("frame", "idx", "semantic")


@query(f"with {DEC}, acc as (select seq_no, row_number() over (order by seq_no) as k from dec where status = 'accepted'), cut as (select max(seq_no) as s from acc where k = 150), raw as (select frame, count(*) as raw_points from fr group by frame), per as (select frame, count(*) as static_points, count(*) filter (status = 'accepted') as accepted_points, cast(0 as bigint) as ghost_rejected, count(*) filter (status = 'density') as density_rejected from dec, cut where s is null or seq_no <= s group by frame) select per.frame, raw_points, static_points, accepted_points, ghost_rejected, density_rejected, cast(sum(accepted_points) over (order by per.frame) as bigint) as fused_total from per join raw on raw.frame = per.frame")
def fusion_counters(spark, sf):
    p = frames(spark, sf)
    return fusion.counters(fusion.decide(p, 2.0), p.groupBy("frame").agg(F.count("*").alias("raw_points")), 150)


@query(f"with {FRAMES} select count(*) as points, max(frame) + 1 as frames_used, count(*) filter (semantic = 10) as car, count(*) filter (semantic in (70, 71)) as tree, count(*) filter (semantic = 50) as building, max(x) - min(x) as bbox_x, max(y) - min(y) as bbox_y, max(z) - min(z) as bbox_z from fr")
def cloud_stats(spark, sf):
    return fusion.cloud_stats(frames(spark, sf), {"car": [10], "tree": [70, 71], "building": [50]})


MOVED = "(0.6 * x - 0.8 * y + 0.25)", "(0.8 * x + 0.6 * y)"


@query(f"with {PTS}, f as (select 'ego' as mode, idx, idx % 6 as frame, x, y, z from pts union all select 'pose', idx, idx % 6, cast(cast(case when idx % 6 = 1 then {MOVED[0]} else x end as float) as double), cast(cast(case when idx % 6 = 1 then {MOVED[1]} else y end as float) as double), z from pts), p as (select a.frame as fa, b.frame as fb, g as gap from (select distinct frame from f) a, (select distinct frame from f) b, (values (cast(1 as bigint)), (cast(5 as bigint))) v(g) where b.frame = a.frame + g), d as (select mode, gap, fa, a.idx, sqrt(min({D2})) as d from p join f a on a.frame = fa join f b on b.frame = fb and a.mode = b.mode group by mode, gap, fa, a.idx), r as (select mode, gap, d, row_number() over (partition by mode, gap order by d) as r, count(*) over (partition by mode, gap) as n from d) select mode, gap, max(n) as n, round(max(case when r = n // 2 + 1 then d end), 9) as median, round(max(case when r = cast(floor((n - 1) * 0.9::double) as bigint) + 1 then d end), 9) as p90, round(max(case when r = cast(floor((n - 1) * 0.95::double) as bigint) + 1 then d end), 9) as p95 from r group by mode, gap".replace("select mode, gap, fa, a.idx, sqrt", "select a.mode as mode, gap, fa, a.idx, sqrt").replace("group by mode, gap, fa, a.idx)", "group by a.mode, gap, fa, a.idx)"))
def alignment_nn(spark, sf):
    p = cloud(spark, sf).withColumn("frame", F.col("idx") % 6)
    poses = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]), (1, [0.6, -0.8, 0.0, 0.25, 0.8, 0.6, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "frame long, m array<double>")
    a = fusion.alignment(p, poses, None, (1, 5), samples=1_000_000)
    return a.select("mode", F.col("gap").cast("long").alias("gap"), "n", *(F.round(c, 9).alias(c) for c in ("median", "p90", "p95")))


@query(f"with {FRAMES}, sf as (select * from (values (0, 0), (0, 1), (0, 2), (1, 2), (1, 4)) v(sample, f)), p as (select sample, frame, idx as old, x, y, z, semantic from fr join sf on f = frame where semantic in (10, 50, 71) and semantic <> 71) select sample, frame, row_number() over (partition by sample order by frame, old) - 1 as idx, round(cast(cast(case when frame = 1 then x + 3 else x end as float) as double), 6) as x, round(cast(cast(case when frame = 1 then y - 1 else y end as float) as double), 6) as y, semantic from p")
def make_sample(spark, sf):
    chosen = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 2), (1, 4)], "sample int, frame long")
    poses = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 3.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 1.0, 0.0])], "frame long, m array<double>")
    out = fusion.make_sample(frames(spark, sf), chosen, (10, 50, 71), (71,), poses)
    return out.select("sample", "frame", "idx", *(F.round(F.col(a).cast("double"), 6).alias(a) for a in "xy"), "semantic")


@query(f"with recursive {FRAMES}, prs as (select a.idx as i, b.idx as j from fr a join fr b on a.frame = b.frame and a.y = b.y where {D2} <= 0.3 * 0.3), ed as (select i, j from prs union select j, i from prs), re(i, j) as (select idx, idx from fr union select re.i, ed.j from re join ed on ed.i = re.j), cl as (select i as idx, min(j) as c from re group by i), sz as (select c, count(*) as n from cl group by c) select frame, cl.idx, case when n >= 2 then cl.c end as cluster_id, case when n >= 2 then n end as cluster_size from cl join sz on sz.c = cl.c join fr on fr.idx = cl.idx")
def daily_clusters(spark, sf):
    return cluster.euclidean(frames(spark, sf), 0.3, 2, ("frame",))


@query(ORACLES["daily_clusters"])
def daily_clusters_distributed(spark, sf):
    return cluster.euclidean(frames(spark, sf), 0.3, 2, ("frame",), "distributed")


@query(
    f"with recursive {FRAMES}, prs as (select i, j, fa as frame from (select a.idx as i, b.idx as j, a.frame as fa, row_number() over (partition by a.idx order by (b.idx <> a.idx), {D2}, b.idx) as r from fr a join fr b on a.frame = b.frame and a.y = b.y where {D2} <= 0.3 * 0.3) where r <= 8), nb as (select j, list(i) as prev from prs where i < j group by j), rk as (select frame, idx, row_number() over (partition by frame order by idx) as r from fr), "
    "w(frame, n, seeds) as (select distinct frame, cast(0 as bigint), cast([] as bigint[]) from fr union all select w.frame, n + 1, case when list_has_any(coalesce(prev, cast([] as bigint[])), seeds) then seeds else list_append(seeds, idx) end from w join rk on rk.frame = w.frame and r = n + 1 left join nb on nb.j = idx), "
    "sd as (select unnest(seeds) as s from (select *, row_number() over (partition by frame order by n desc) as last from w) where last = 1), st as (select i, j from prs where i in (select s from sd)), "
    "ed as (select i, j from st union select j, i from st), re(i, j) as (select idx, idx from fr union select re.i, ed.j from re join ed on ed.i = re.j), cl as (select i as idx, min(j) as c from re group by i), sz as (select c, count(*) as n from cl group by c) select frame, cl.idx, case when n >= 2 then cl.c end as cluster_id, case when n >= 2 then n end as cluster_size from cl join sz on sz.c = cl.c join fr on fr.idx = cl.idx"
)
def daily_seeded_clusters(spark, sf):
    return cluster.seeded(frames(spark, sf), 0.3, 2, 8, ("frame",))


PACKED = "pk as (select vec_id as idx, cast(label as bigint) * 65536 + vec_id % 30 as packed from embeddings)"


def packed(spark, sf):
    return cloud(spark, sf).withColumn("packed", F.col("label").cast("long") * 65536 + F.col("idx") % 30)


@query(f"with {PACKED} select idx, packed & 65535 as semantic, packed >> 16 as instance from pk")
def label_unpack(spark, sf):
    return labels.unpack(packed(spark, sf), "packed").select("idx", "semantic", "instance")


@query(f"with {PACKED} select idx, packed & 65535 as semantic from pk where (packed & 65535) not in (9, 22)")
def ground_filter(spark, sf):
    return labels.without(labels.unpack(packed(spark, sf), "packed"), (9, 22)).select("idx", "semantic")


@query(f"with {PACKED}, v as (select idx, packed as gt_key from pk where packed & 65535 <> 0 and packed >> 16 <> 0) select idx, gt_key from v where gt_key in (select gt_key from v group by gt_key having count(*) >= 2)")
def gt_min_points(spark, sf):
    return labels.ground_truth(labels.unpack(packed(spark, sf), "packed"), min_points=2).select("idx", "gt_key")


MATCH = f"with recursive {PTS}, {ALL}, {UNCAPPED}, {clusters_sql('prs')}, pc as (select idx, cl.c as cluster_id from cl join sz on sz.c = cl.c where n >= {MIN_SIZE}), gt as (select idx, cast(idx // 50 as bigint) as gt_key from pts), ov as (select gt_key, cluster_id, count(*) as common from gt join pc on pc.idx = gt.idx group by all), gs as (select gt_key, count(*) as gt_size from gt group by gt_key), ps as (select cluster_id, count(*) as pred_size from pc group by cluster_id), io as (select ov.*, gt_size, pred_size, common / (gt_size + pred_size - common) as iou, common / gt_size as recall, common / pred_size as prec from ov join gs on gs.gt_key = ov.gt_key join ps on ps.cluster_id = ov.cluster_id)"


def matching(spark, sf):
    p = cloud(spark, sf)
    gt = p.select("idx", F.floor(F.col("idx") / 50).alias("gt_key"))
    found = cluster.euclidean(p, TOL, MIN_SIZE)
    return found, gt, evaluate.overlaps(found, gt)


@query(f"{MATCH} select gt_key, cluster_id, common, gt_size, pred_size, round(iou, 9) as iou, round(recall, 9) as recall, round(prec, 9) as \"precision\" from io")
def overlap_iou(spark, sf):
    return matching(spark, sf)[2].withColumns({c: F.round(c, 9) for c in ("iou", "recall", "precision")})


@query(f"{MATCH}, be as (select *, row_number() over (partition by gt_key order by iou desc, cluster_id) as r from io) select gs.gt_key, cluster_id, round(coalesce(iou, 0), 9) as best_iou, round(coalesce(recall, 0), 9) as recall, round(coalesce(prec, 0), 9) as \"precision\" from gs left join be on be.gt_key = gs.gt_key and r = 1")
def best_iou(spark, sf):
    _, gt, pairs = matching(spark, sf)
    return evaluate.best_matches(pairs, gt).withColumns({c: F.round(c, 9) for c in ("best_iou", "recall", "precision")})


@query(f"{MATCH}, be as (select gt_key, max(iou) as b from io group by gt_key), m as (select * from io where iou > 0.5), c as (select (select count(*) from gs) as gt, (select count(*) from ps) as pred, (select count(*) from m) as tp, (select coalesce(sum(iou), 0) from m) as s, (select sum(b) from be) as bs) select gt, pred, tp, pred - tp as fp, gt - tp as fn, round(case when tp > 0 then s / tp else 0 end, 9) as sq, round(case when tp > 0 then tp / (tp + 0.5 * (pred - tp) + 0.5 * (gt - tp)) else 0 end, 9) as rq, round(bs / gt, 9) as miou from c")
def greedy_match_pq(spark, sf):
    found, gt, pairs = matching(spark, sf)
    c = evaluate.ratios(evaluate.panoptic(evaluate.greedy_matches(pairs), evaluate.best_matches(pairs, gt), found))
    return c.select("gt", "pred", "tp", "fp", "fn", *(F.round(n, 9).alias(n) for n in ("sq", "rq", "miou")))


@query(f"{MATCH}, be as (select *, row_number() over (partition by gt_key order by iou desc, cluster_id) as r from io), b as (select coalesce(iou, 0) as iou, coalesce(recall, 0) as rec, coalesce(prec, 0) as prec from gs left join be on be.gt_key = gs.gt_key and r = 1) select count(*) as gt, count(*) filter (iou >= 0.3) as matched_30, count(*) filter (iou >= 0.5) as matched_50, round(avg(iou), 9) as mean_iou, round(avg(rec), 9) as mean_recall, round(avg(prec), 9) as mean_precision from b")
def frame_scores(spark, sf):
    _, gt, pairs = matching(spark, sf)
    return evaluate.frame_scores(evaluate.best_matches(pairs, gt)).select("gt", "matched_30", "matched_50", *(F.round(c, 9).alias(c) for c in ("mean_iou", "mean_recall", "mean_precision")))


@query("with c as (select l_suppkey % 7 as k, l_partkey % 4 as sample, count(*) as gt, count(*) filter (l_quantity > 10) as tp, count(*) filter (l_quantity > 40) as fp, count(*) filter (l_quantity <= 10) as fn, sum(case when l_quantity > 10 then cast(l_discount as double) end) as s, sum(cast(l_tax as double)) as bs, avg(cast(l_extendedprice as double)) as ms from lineitem group by all), m as (select k, sum(gt) as gt, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(s) as s, sum(bs) as bs, avg(ms) as ms from c group by k) select k, cast(gt as bigint) as gt, cast(tp + fp as bigint) as pred, round(ms, 6) as ms, round(case when tp > 0 then s / tp else 0 end, 9) as sq, round(tp / (tp + 0.5::double * fp + 0.5::double * fn), 9) as rq, round(case when tp > 0 then s / tp else 0 end * (tp / (tp + 0.5::double * fp + 0.5::double * fn)), 9) as pq, round(tp / (tp + fn), 9) as rc50, round(bs / gt, 9) as miou from m")
def merged_scores(spark, sf):
    """Counts of four samples, here from lineitem, summed by key before the ratios."""
    q = F.col("l_quantity")
    c = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("k"), (F.col("l_partkey") % 4).alias("sample")).agg(
        F.count("*").alias("gt"), (F.count_if(q > 10) + F.count_if(q > 40)).alias("pred"), F.count_if(q > 10).alias("tp"), F.count_if(q > 40).alias("fp"), F.count_if(q <= 10).alias("fn"),
        F.sum(F.when(q > 10, F.col("l_discount").cast("double"))).alias("iou_sum"), F.sum(F.col("l_tax").cast("double")).alias("best_iou_sum"), F.avg(F.col("l_extendedprice").cast("double")).alias("ms"),
    )
    m = evaluate.merged(c, ("k",), "ms")
    return m.select("k", "gt", "pred", F.round("ms", 6).alias("ms"), *(F.round(n, 9).alias(n) for n in ("sq", "rq", "pq", "rc50", "miou")))


@query("with p as (select vec_id as idx, (cast(label as bigint) * 65536 + vec_id % 30) & 65535 as semantic from embeddings) select idx, semantic from p where semantic in (3, 10, 25)")
def semantic_set(spark, sf):
    return labels.only(labels.unpack(packed(spark, sf), "packed"), (3, 10, 25)).select("idx", "semantic")


@query("with t as (select l_returnflag as mode, cast(l_extendedprice as double) as t0, cast(l_quantity as double) as t50, cast(l_tax as double) as s0, cast(l_discount as double) as s50 from lineitem) select mode, count(*) as count, round(avg(t0), 6) as avg_total_ms_0, round(avg(t50), 6) as avg_total_ms_50, round(avg(s0), 9) as avg_search_ms_0, round(avg(s50), 9) as avg_search_ms_50, round(avg(t50) - avg(t0), 6) as avg_delta_total_ms_50_minus_0, round(avg(s50) - avg(s0), 9) as avg_delta_search_ms_50_minus_0 from t group by mode")
def mode_means(spark, sf):
    """Means by mode of two caps side by side, here of lineitem's columns by return flag."""
    named = {"total_ms_0": "l_extendedprice", "total_ms_50": "l_quantity", "search_ms_0": "l_tax", "search_ms_50": "l_discount"}
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), *(F.col(c).cast("double").alias(n) for n, c in named.items()))
    m = experiments.mode_means(t, ("total_ms", "search_ms"))
    return m.select("mode", "count", *(F.round(c, 6 if "total" in c else 9).alias(c) for c in m.columns[2:]))


BOX = f"{PTS}, bx as (select s_suppkey as box, (s_suppkey * 37 % 41) - 20.0 as x, 2.0 as y, (s_suppkey * 53 % 43) - 21.0 as z, 6.0 as h, 4.0 + s_suppkey % 5 as w, 3.0 + s_suppkey % 7 as l, (s_suppkey % 7) * 0.4::double as ry from supplier), cp as (select idx, x * 60 as x, y * 6 as y, z * 60 as z from pts), hit as (select idx, box from cp, bx where abs(cos(ry) * (cp.x - bx.x) - sin(ry) * (cp.z - bx.z)) <= w / 2 and abs(sin(ry) * (cp.x - bx.x) + cos(ry) * (cp.z - bx.z)) <= l / 2 and cp.y <= bx.y and cp.y >= bx.y - h)"


def boxed(spark, sf):
    s = table(spark, sf, "supplier")
    b = s.select(F.col("s_suppkey").alias("box"), (F.col("s_suppkey") * 37 % 41 - 20.0).alias("x"), F.lit(2.0).alias("y"), (F.col("s_suppkey") * 53 % 43 - 21.0).alias("z"), F.lit(6.0).alias("h"), (F.col("s_suppkey") % 5 + 4.0).alias("w"), (F.col("s_suppkey") % 7 + 3.0).alias("l"), (F.col("s_suppkey") % 7 * F.lit(0.4)).alias("ry"))
    p = cloud(spark, sf).select("idx", (F.col("x") * 60).alias("x"), (F.col("y") * 6).alias("y"), (F.col("z") * 60).alias("z"))
    return boxes.first_box(boxes.inside(p, b))


@query(f"with {BOX} select idx, min(box) as gt_key from hit group by idx")
def box_membership(spark, sf):
    return boxed(spark, sf)[0]


@query(f"with {BOX} select box as gt_key, count(*) as gt_size from hit group by box")
def box_sizes(spark, sf):
    return boxed(spark, sf)[1]


@query(f"with {RUNS}, r as (select *, row_number() over (partition by method order by ms, run) as r, count(*) over (partition by method) as n from rn) select method, round(coalesce(avg(case when r > 2 and r <= n - 2 then ms end), avg(ms)), 6) as trimmed_mean from r group by method")
def trimmed_mean(spark, sf):
    return stats.trimmed_mean(runs(spark, sf), ("method",), "ms", 2, ("run",)).select("method", F.round("trimmed_mean", 6).alias("trimmed_mean"))


@query(f"with {RUNS}, r as (select *, row_number() over (partition by method order by ms, run) as a, row_number() over (partition by method order by ms desc, run) as z, count(*) over (partition by method) as n from rn) select method, run, ms from r where n <= 2 or (a > 1 and z > 1)")
def drop_minmax(spark, sf):
    return stats.drop_extremes(runs(spark, sf), ("method",), "ms", "run").select("method", "run", "ms")


@query(f"with {RUNS}, r as (select *, row_number() over (partition by method order by ms) as r, count(*) over (partition by method) as n from rn) select method, max(case when r = n // 2 + 1 then ms end) as median, max(case when r = cast(floor((n - 1) * 0.9::double) as bigint) + 1 then ms end) as p90, max(case when r = cast(floor((n - 1) * 0.95::double) as bigint) + 1 then ms end) as p95 from r group by method")
def nearest_rank_percentiles(spark, sf):
    return stats.nearest_rank(runs(spark, sf), ("method",), "ms", {"p90": 0.9, "p95": 0.95})


@query(f"with {RUNS} select method, round(avg(ms), 6) as mean, round(coalesce(stddev_samp(ms), 0), 6) as sd_sample, round(stddev_pop(ms), 6) as sd_population, min(ms) as low, max(ms) as high from rn group by method")
def stage_summary(spark, sf):
    return stats.spread(runs(spark, sf), ("method",), "ms").withColumns({c: F.round(c, 6) for c in ("mean", "sd_sample", "sd_population")})


@query(f"with {RUNS}, r as (select *, row_number() over (partition by method order by run) as r from rn) select method, min(ms) as best_ms, round(avg(ms), 6) as mean_ms, arg_max(clusters, run) as clusters, round(1000.0 / min(ms), 9) as fps from r where r > 1 group by method")
def best_and_mean(spark, sf):
    return stats.best_and_mean(runs(spark, sf), ("method",), "ms", "run", 1).withColumns({"mean_ms": F.round("mean_ms", 6), "fps": F.round("fps", 9)})


@query(f"with {RUNS} select method, count(*) as frames, round(avg(ms), 6) as avg_ms, min(ms) as min_ms, max(ms) as max_ms, round(avg(1000.0 / ms), 9) as mean_of_fps, round(1000.0 / avg(ms), 9) as fps_of_mean from rn group by rollup(method)")
def sequence_rollup(spark, sf):
    return stats.summary_by_sequence(runs(spark, sf), "method", "ms").withColumns({"avg_ms": F.round("avg_ms", 6), "mean_of_fps": F.round("mean_of_fps", 9), "fps_of_mean": F.round("fps_of_mean", 9)})


CAND = f"{RUNS}, cd as (select method, cast(round(avg(ms) * 100) as bigint) / 100.0 as ms, cast(sum(clusters) % 97 as double) / 97 as pq from rn group by method)"


@query(f"with {CAND}, e as (select *, pq + 1e-12 >= (select max(pq) from cd) * 0.9::double as eligible from cd) select method, eligible, row_number() over (order by eligible desc, case when eligible then ms end nulls last, pq desc, ms, method) as rank from e")
def candidate_rank(spark, sf):
    c = runs(spark, sf).groupBy("method").agg((F.round(F.avg("ms") * 100).cast("long") / 100.0).alias("ms"), ((F.sum("clusters") % 97).cast("double") / 97).alias("pq"))
    return stats.rank_candidates(c, "ms", "pq", 0.1).select("method", "eligible", F.col("rank").cast("long").alias("rank"))


@query(f"with {RUNS}, t as (select run % 5 as dataset, method % 3 as m, min(ms) as ms from rn group by all), b as (select dataset, ms as base from t where m = 0) select t.dataset, m, ms, base as base_ms, round(base / ms, 9) as speedup, round(base - ms, 6) as difference, row_number() over (partition by t.dataset order by ms, m) = 1 as wins from t join b on b.dataset = t.dataset")
def speedups(spark, sf):
    t = runs(spark, sf).groupBy((F.col("run") % 5).alias("dataset"), (F.col("method") % 3).alias("m")).agg(F.min("ms").alias("ms"))
    return stats.speedups(t, ("dataset",), "m", 0, "ms").withColumns({"speedup": F.round("speedup", 9), "difference": F.round("difference", 6)})


@query(f"with {RUNS} select run % 5 as dataset, arg_min(method, (ms, method)) as method, min(ms) as ms from rn group by 1")
def fastest_method(spark, sf):
    return stats.fastest(runs(spark, sf).withColumn("dataset", F.col("run") % 5), ("dataset",), "method", "ms")


@query(f"with {RUNS} select method, count(*) filter (run % 2 = 0) as \"0\", count(*) filter (run % 2 = 1) as \"50\" from rn group by method")
def maxn_pivot(spark, sf):
    return runs(spark, sf).withColumn("max_n", F.when(F.col("run") % 2 == 0, 0).otherwise(50)).groupBy("method").pivot("max_n", [0, 50]).agg(F.count("run")).fillna(0)


def frame_list(spark, sf):
    return frames(spark, sf).groupBy("frame").agg(F.count("*").alias("n"))


FL = f"{FRAMES}, fl as (select frame, count(*) as n from fr group by frame)"


@query(f"with {FL}, p as (select frame, row_number() over (order by frame) - 1 as p, count(*) over () as n from fl) select s as sample, frame from p, (select unnest(range(0, 32)) as s) where p >= s * 3 and p < s * 3 + 5 and s * 3 + 5 <= n")
def hopping_frames(spark, sf):
    return sampling.hopping_frames(frame_list(spark, sf), 5, 3, 32).select("sample", "frame")


@query(f"with {FL}, l as (select frame, lead(frame, 1) over (order by frame) as a, lead(frame, 5) over (order by frame) as b, row_number() over (order by frame) as r from fl) select frame, cast(1 as bigint) as gap, a as other from l where a is not null and r <= 30 union all select frame, cast(5 as bigint), b from l where b is not null and r <= 30")
def frame_gap_pairs(spark, sf):
    return fusion.gap_pairs(frame_list(spark, sf), (1, 5)).select("frame", F.col("gap").cast("long").alias("gap"), "other")


@query(f"with {FL}, a as (select *, coalesce(sum(n) over (order by frame rows between unbounded preceding and 1 preceding), 0) as b from fl) select frame, n from a where b < (select sum(n) from fl) / 3")
def accumulate_until(spark, sf):
    f = frame_list(spark, sf)
    total = f.agg(F.sum("n")).first()[0] or 0
    return sampling.accumulate_until(f, "n", total / 3)


@query("with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders) select o_orderkey from o where n <= 37 or r in (select cast(floor(i * n / 37) as bigint) from (select unnest(range(0, 37)) as i), (select count(*) as n from orders))")
def even_select(spark, sf):
    return sampling.even_select(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 37)


@query(f"with {PTS} select idx from pts where idx % greatest(1, (select count(*) from pts) // 60) = 0")
def stride_sample(spark, sf):
    return sampling.stride_sample(cloud(spark, sf), 60).select("idx")


@query(f"with {FL} select frame, n from (select *, row_number() over (order by frame) as r from fl where frame >= 2) where r <= 7")
def frame_range(spark, sf):
    return sampling.frame_range(frame_list(spark, sf), start=2, limit=7)


@query(f"with {PTS} select idx, round(cast(cast(case when idx % 3 = 0 then 0.6::double * (x + 0.1::double) - 0.8::double * y + 1.5::double else x + 0.1::double end as float) as double), 5) as x, round(cast(cast(case when idx % 3 = 0 then 0.8::double * (x + 0.1::double) + 0.6::double * y - 2 else y end as float) as double), 5) as y, round(z, 5) as z from pts")
def pose_transform(spark, sf):
    poses = spark.createDataFrame([(0, [0.6, -0.8, 0.0, 1.5, 0.8, 0.6, 0.0, -2.0, 0.0, 0.0, 1.0, 0.0])], "frame long, m array<double>")
    p = cloud(spark, sf).withColumn("frame", F.col("idx") % 3)
    moved = geometry.apply_poses(p, poses, (1, 0, 0, 0.1, 0, 1, 0, 0, 0, 0, 1, 0))
    return moved.select("idx", *(F.round(F.col(a).cast("double"), 5).alias(a) for a in "xyz"))


@query(f"with {PTS} select idx, round(-y, 9) as x, round(-z - 0.08, 9) as y, round(x - 0.27, 9) as z from pts")
def camera_transform(spark, sf):
    calib = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, -0.08, 1.0, 0.0, 0.0, -0.27])], "r0 array<double>, tr array<double>")
    return geometry.to_camera(cloud(spark, sf), calib).select("idx", *(F.round(a, 9).alias(a) for a in "xyz"))


@query(f"with {PTS}, m as (select min(x) as mx, min(y) as my, min(z) as mz from pts) select idx, cast(floor((x - mx) / 0.1) as bigint) as bx, cast(floor((y - my) / 0.1) as bigint) as \"by\", cast(floor((z - mz) / 0.1) as bigint) as bz from pts, m")
def block_keys(spark, sf):
    return geometry.with_cells_from_min(cloud(spark, sf), 0.1).select("idx", "bx", "by", "bz")


@query("select p_partkey, case when p_partkey * 500 % 1000000 = 0 then (p_partkey * 500 // 1000000) || 'M' when p_partkey * 500 % 1000 = 0 then (p_partkey * 500 // 1000) || 'k' else cast(p_partkey * 500 as varchar) end as name from part")
def target_names(spark, sf):
    return table(spark, sf, "part").withColumn("t", F.col("p_partkey") * 500).select("p_partkey", text.target_name_column("t").alias("name"))


@query()
def cluster_colour(spark, sf):
    c = cluster.euclidean(cloud(spark, sf), TOL, MIN_SIZE).where("cluster_id is not null")
    return c.select("idx", *geometry.colour("cluster_id"))


@query()
def region_growing(spark, sf):
    return cluster.region_growing(cloud(spark, sf), MIN_SIZE, 10, 30.0, 0.2)


@query()
def cloth_ground_points(spark, sf):
    prepare(spark)
    return cloth_ground(frames(spark, sf), ("frame",), resolution=2.0).select("frame", "idx", "ground")
