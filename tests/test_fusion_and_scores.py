import random

from pyspark.sql import functions as F

from pointloom.operators import evaluate, fusion, sampling
from pointloom.operators.ground import cloth_ground, off_ground
from pointloom.plans import experiments
from pointloom.streaming import fusion as stream

P = "frame long, idx long, x double, y double, z double, semantic long"


def by_hand(points, voxel, radius):
    out, kept, cells = [], [], set()
    for f, i, x, y, z, s in sorted(points):
        cell = (s, x // voxel, y // voxel, z // voxel)
        if radius > 0 and any(t == s and (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 <= radius * radius for a, b, c, t in kept):
            out.append("ghost")
        elif cell in cells:
            out.append("density")
        else:
            out.append("accepted")
            kept.append((x, y, z, s))
            cells.add(cell)
    return out


def test_decisions_against_a_walk(spark):
    random.seed(4)
    rows = [(f, i, random.uniform(-1, 1), random.uniform(-1, 1), 0.0, random.choice([1, 2])) for f in range(4) for i in range(20)]
    for radius in (0.0, 0.15, 0.4):
        got = [r.status for r in fusion.decide(spark.createDataFrame(rows, P), 0.3, radius).orderBy("seq_no").collect()]
        assert got == by_hand(rows, 0.3, radius)


def test_a_crowded_voxel_makes_no_pairs(spark):
    random.seed(18)
    rows = [(0, i, random.uniform(0, 2.9), random.uniform(0, 2.9), 0.0, 1) for i in range(300)]
    got = [r.status for r in fusion.decide(spark.createDataFrame(rows, P), 3.0, 0.05).orderBy("seq_no").collect()]
    assert got == by_hand(rows, 3.0, 0.05) and {"density", "ghost"} & set(got)


def test_stop_in_the_middle_of_a_frame(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0, 1), (0, 1, 0.1, 0.0, 0.0, 1), (1, 0, 5.0, 0.0, 0.0, 1), (1, 1, 9.0, 0.0, 0.0, 1), (1, 2, 13.0, 0.0, 0.0, 1)]
    p = spark.createDataFrame(rows, P)
    d = fusion.decide(p, 1.0)
    assert [r.x for r in fusion.prefix(d, 2).orderBy("seq_no").collect()] == [0.0, 5.0]
    c = fusion.counters(d, p.groupBy("frame").agg(F.count("*").alias("raw_points")), 2).orderBy("frame").collect()
    assert [tuple(r) for r in c] == [(0, 2, 2, 1, 0, 1, 1), (1, 3, 1, 1, 0, 0, 2)]


def test_stream_accepts_the_first_of_each_voxel(spark, tmp_path):
    rows = [(0, 0, 0.1, 0.0, 0.0, 1), (0, 1, 0.2, 0.0, 0.0, 1), (0, 2, 3.0, 0.0, 0.0, 1), (0, 3, 0.1, 0.0, 0.0, 2)]
    spark.createDataFrame(rows, P).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream.fuse(stream.stream_points(spark, str(tmp_path / "in"), P), 1.0)
    q = s.writeStream.format("memory").queryName("fused").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.semantic, r.idx) for r in spark.table("fused").collect()) == [(1, 0), (1, 2), (2, 3)]


def test_an_iou_of_exactly_one_half_goes_once(spark):
    pairs = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (2, 11, 0.5), (3, 12, 0.9), (4, 12, 0.5)], "gt_key long, cluster_id long, iou double")
    assert sorted((r.gt_key, r.cluster_id) for r in evaluate.greedy_matches(pairs).collect()) == [(1, 10), (2, 11), (3, 12)]


def test_empty_ground_truth(spark):
    clusters = spark.createDataFrame([(0, 0)], "idx long, cluster_id long")
    gt = spark.createDataFrame([], "idx long, gt_key long")
    pairs = evaluate.overlaps(clusters, gt)
    c = evaluate.ratios(evaluate.panoptic(evaluate.greedy_matches(pairs), evaluate.best_matches(pairs, gt), clusters)).first()
    assert (c.gt, c.pred, c.tp, c.fp, c.fn, c.pq, c.miou) == (0, 1, 0, 1, 0, 0.0, 0.0)


def test_evaluation_of_frames(spark):
    rows = [("s", 0, i, float(i // 4) * 10 + i % 4 * 0.1, 0.0, 0.0, ((i // 4 + 1) << 16) | 10) for i in range(8)] + [("s", 0, 8, 5.0, 0.0, 0.0, 22)]
    f = spark.createDataFrame(rows, "seq string, frame long, idx long, x double, y double, z double, label long")
    r = experiments.evaluate_frames(f, ground=(22,), min_gt=2, tol=0.5, min_size=2)["overall"].first()
    assert (r.gt, r.pred, r.tp, r.pq, r.miou) == (2, 2, 2, 1.0, 1.0)


def test_cloth_finds_flat_ground(spark):
    rows = [("s", 0, i, x * 0.5, y * 0.5, 0.0) for i, (x, y) in enumerate((x, y) for x in range(20) for y in range(20))] + [("s", 0, 400 + k, 5.0, 5.0, 1.0 + k * 0.2) for k in range(5)]
    p = spark.createDataFrame(rows, "seq string, frame long, idx long, x double, y double, z double")
    g = cloth_ground(p)
    assert sorted(r.idx for r in off_ground(p, g).collect()) == list(range(400, 405))


def test_timing_tables(spark):
    p = spark.createDataFrame([(i, i * 0.1, 0.0, 0.0) for i in range(50)], "idx long, x double, y double, z double")
    runs = experiments.timed_runs(spark, {"s/0": p}, ["euclidean", "seeded"], [0.2], min_size=5, repeats=4)
    t = experiments.benchmark_table(runs).collect()
    assert {r.method for r in t} == {"euclidean", "seeded"} and all(r.clusters == 1 and r.ms > 0 for r in t)
    assert experiments.tolerance_table(runs, "euclidean", "seeded").count() == 2
    assert experiments.frame_timing(runs).count() == 4
    assert experiments.profile_caps(p, 0.2, (0, 3), 5).count() == 2
    c = spark.createDataFrame([(0, 0.2, 5, 50), (1, 0.05, 5, 50)], "id long, tol double, min_size int, max_n int")
    s = p.withColumn("sample", F.lit(0).cast("long"))
    best = experiments.tune(s, s.select("sample", "idx", F.lit(1).cast("long").alias("gt_key")), c).orderBy("rank").first()
    assert best.id == 0 and best.pq == 1.0


def test_fusion_build(spark):
    rows = [(f, i, float(i), 0.0, 0.0, 10) for f in range(3) for i in range(5)]
    poses = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "frame long, m array<double>")
    out = experiments.build_fusion(spark.createDataFrame(rows, P), poses, None, [4, 7], 0.5)
    assert out["prefix_7"].count() == 7 and out["stats_4"].first().car == 4


def test_samples(spark):
    f = spark.createDataFrame([(i, 10) for i in range(7)], "frame long, n long")
    assert [r.frame for r in sampling.accumulate_until(f, "n", 25).orderBy("frame").collect()] == [0, 1, 2]
    assert sampling.random_sample(f, 3, 1).count() == 3
    assert sorted((r.sample, r.frame) for r in sampling.hopping_frames(f, 3, 2).collect()) == [(s, s * 2 + k) for s in range(3) for k in range(3)]


def test_tuning_in_stages(spark):
    c = experiments.random_candidates(spark, 40, 3).collect()
    assert tuple(c[0]) == (0, 0.2, 100, 50) and [tuple(r) for r in c] == [tuple(r) for r in experiments.random_candidates(spark, 40, 3).collect()]
    assert all(0.12 <= r.tol <= 0.35 and 40 <= r.min_size <= 240 and 20 <= r.max_n <= 100 for r in c) and len({r.tol for r in c}) == 40
    s = spark.createDataFrame([(0, i, float(i // 5) * 10 + i % 5 * 0.1, 0.0, 0.0) for i in range(10)], "sample long, idx long, x double, y double, z double")
    gt = s.select("sample", "idx", F.floor(F.col("idx") / 5).alias("gt_key"))
    few = spark.createDataFrame([(0, 0.05, 2, 50), (1, 0.15, 2, 50), (2, 20.0, 2, 50)], "id long, tol double, min_size int, max_n int")
    out = experiments.tune_stages([(s, gt), (s, gt)], few, keep=(1,)).collect()
    assert sorted((r.stage, r["id"]) for r in out) == [(1, 0), (1, 1), (1, 2), (2, 1)]
    assert [(r.pq, r.gt, r.tp) for r in out if r.stage == 2] == [(1.0, 2, 2)]


def test_full_experiment_and_cloud_report(spark):
    rows = [("a", f, i, float(i // 4) * 10 + i % 4 * 0.1, 0.0, 0.0, 7 if i < 8 else 15 if i < 12 else 22, i // 4 + 1) for f in range(4) for i in range(16)]
    p = spark.createDataFrame(rows, "seq string, frame long, idx long, x double, y double, z double, semantic int, instance int")
    poses = spark.createDataFrame([(f, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for f in range(4)], "frame long, m array<double>")
    out = experiments.four_sections(p, poses, None, ["euclidean", "seeded"], (7,), (15,), (22,), "a", 0.5, 2, 50, 2, window=2, stride=1, samples=9, sizes=(20, 1000), shift=1, repeats=2)
    assert {(r.method, r.samples, r.points, r.gt, r.pq) for r in out["frames"].collect()} == {(m, 4, 32, 8, 1.0) for m in ("euclidean", "seeded")}
    assert {(r.samples, r.points, r.gt, r.pq) for r in out["fusion"].collect()} == {(3, 48, 6, 1.0)}
    # 12 points a frame: two frames reach 20; from the second on, three frames never reach 1000
    assert {(r.samples, r.points, r.gt, r.pred, r.tp) for r in out["hard"].collect()} == {(2, 60, 4, 6, 4)}
    assert out["speed"].count() == 2
    cloud = p.where("frame = 0").select("idx", "x", "y", "z", F.when(F.col("idx") < 8, F.col("instance") + 0.2).otherwise(0.0).alias("scalar_instance"))
    r = experiments.cloud_report(spark, {"c": cloud}, ["euclidean"], 0.5, 2, 50, 2, 2).first()
    assert (r.points, r.gt, r.pred, r.tp, r.rc50, r.miou) == (16, 2, 4, 2, 1.0, 1.0) and r.fps > 0
