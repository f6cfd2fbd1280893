import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import graph
from pointloom.operators import cluster, kernels, neighbors
from pointloom.operators.cluster import cluster as run
from pointloom.plans import experiments

SCHEMA = "idx long, x double, y double, z double"


def line(spark, xs):
    return spark.createDataFrame([(i, float(x), 0.0, 0.0) for i, x in enumerate(xs)], SCHEMA)


def groups(df):
    out = {}
    for r in df.collect():
        if r.cluster_id is not None:
            out.setdefault(r.cluster_id, set()).add(r.idx)
    return sorted(map(sorted, out.values()))


CASES = [
    ([0, 0.9, 1.8, 2.7], 0, [[0, 1, 2, 3]], [[0, 1, 2, 3]]),
    ([0, 2.7, 0.9, 1.8], 0, [[0, 1, 2, 3]], [[0, 2], [1, 3]]),
    ([0, 1.0], 0, [[0, 1]], [[0, 1]]),
    ([0, 1.0001], 0, [[0], [1]], [[0], [1]]),
    ([0, 0.1, 0.5, 0.6], 2, [[0, 1, 2, 3]], [[0, 1], [2, 3]]),
]


@pytest.mark.parametrize("xs,cap,exact,walk", CASES)
@pytest.mark.parametrize("strategy", ["kernel", "distributed"])
def test_hand_made_lines(spark, xs, cap, exact, walk, strategy):
    p = line(spark, xs)
    assert groups(cluster.euclidean(p, 1.0, strategy=strategy)) == exact
    assert groups(cluster.seeded(p, 1.0, max_n=cap, strategy="kernel" if strategy == "kernel" else "components")) == walk


def test_seeds_by_rounds_agree(spark):
    for xs, cap, _, walk in CASES:
        assert groups(cluster.seeded(line(spark, xs), 1.0, max_n=cap, strategy="rounds")) == walk


def test_minimum_size_gives_noise(spark):
    p = line(spark, [0, 0.5, 9])
    rows = {r.idx: (r.cluster_id, r.cluster_size) for r in cluster.euclidean(p, 1.0, 2).collect()}
    assert rows == {0: (0, 2), 1: (0, 2), 2: (None, None)}
    assert groups(cluster.euclidean(p, 1.0, 5)) == []


def test_coincident_points_beyond_the_cap_and_bad_coordinates(spark):
    p = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0), (3, float("nan"), 0.0, 0.0), (4, None, 0.0, 0.0), (5, float("inf"), 0.0, 0.0)], SCHEMA)
    got = {r.idx: r.cluster_id for r in cluster.seeded(p, 0.5, max_n=1).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None}
    for strategy in ("kernel", "distributed"):
        assert groups(cluster.euclidean(p, 0.5, strategy=strategy)) == [[0, 1, 2]]


def test_negative_cells_use_floor(spark):
    assert groups(cluster.euclidean(line(spark, [-0.1, 0.1, -0.95, 1.05]), 1.0, strategy="distributed")) == [[0, 1, 2, 3]]


def test_frames_never_merge(spark):
    p = spark.createDataFrame([(f, i, float(i), 0.0, 0.0) for f in (0, 1) for i in range(3)], "frame long, " + SCHEMA)
    for strategy in ("kernel", "distributed"):
        rows = cluster.euclidean(p, 1.0, keys=("frame",), strategy=strategy).collect()
        assert sorted((r.frame, r.cluster_id, r.cluster_size) for r in rows) == [(0, 0, 3)] * 3 + [(1, 0, 3)] * 3


def test_strategies_agree_on_random_clouds(spark):
    rng = np.random.default_rng(1)
    xyz = np.round(rng.random((300, 3)) * 3, 2)
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xyz)], SCHEMA)
    for cap in (0, 4):
        want = groups(cluster.seeded(p, 0.4, max_n=cap, strategy="kernel"))
        assert groups(cluster.seeded(p, 0.4, max_n=cap, strategy="components")) == want
        assert groups(cluster.seeded(p, 0.4, max_n=cap, strategy="rounds")) == want
    for strict in (False, True):
        assert groups(cluster.capped_graph(p, 0.4, max_n=4, strict=strict)) == groups(cluster.capped_graph(p, 0.4, max_n=4, strict=strict, strategy="distributed"))
    assert groups(cluster.block_euclidean(p, 0.4)) == groups(cluster.euclidean(p, 0.4))


def test_dense_clouds_make_few_edges(spark, monkeypatch):
    # 20 frames of clumps of 300 points each, whose pairs are 900,000
    rng, made = np.random.default_rng(2), []
    rows = [(f, i, float(i % 2 * 40 + v[0]), float(v[1]), float(v[2])) for f in range(20) for i, v in enumerate(rng.random((300, 3)))]
    p = spark.createDataFrame(rows, "frame long, " + SCHEMA)

    def counted(edges, *rest):
        made.append(edges.count())
        return graph.connected_components(edges, *rest)

    monkeypatch.setattr(cluster, "connected_components", counted)
    got = cluster.euclidean(p, 2.0, keys=("frame",), strategy="distributed").groupBy("cluster_id", "cluster_size").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 150, 3000), (1, 150, 3000)]
    assert sum(made) < 1000


@pytest.mark.parametrize("tile", [3, 24])
def test_large_frames_agree_with_the_pairs(spark, monkeypatch, tile):
    # the cloud is cut into tiles, and its components are walked many to a task
    monkeypatch.setattr(cluster, "KERNEL_POINTS", 250)
    monkeypatch.setattr(cluster, "TASK_POINTS", 100)
    monkeypatch.setattr(cluster, "TILE", tile)
    rng, rows, exact, walk = np.random.default_rng(3), [], {}, {}
    for f in range(3):
        xyz = np.round(rng.normal(size=(300, 3)) * (1.5, 1.5, 0.2), 1)
        rows += [(f, 1000 * f + i, *map(float, v)) for i, v in enumerate(xyz)]
        a, b, _, _ = kernels.half_pairs(xyz, 0.3)
        i, j = kernels.capped(*kernels.directed_pairs(xyz, 0.3), 4, "nearest")
        for found, label in ((exact, kernels.components(300, a, b)), (walk, kernels.seeded_labels(300, i, j)[0])):
            found |= {(f, 1000 * f + i): (1000 * f + int(c), int((label == c).sum())) for i, c in enumerate(label)}
    rows += [(3, 9000, 1e20, -1e300, 0.0), (3, 9001, 1e20, -1e300, 0.0), (3, 9002, 2e20, -1e300, 0.2), (3, 9003, None, 0.0, 0.0)]
    far = {(3, 9000): (9000, 2), (3, 9001): (9000, 2), (3, 9002): (9002, 1), (3, 9003): (None, None)}
    p = spark.createDataFrame(rows, "frame long, " + SCHEMA)
    result = lambda df: {(r.frame, r.idx): (r.cluster_id, r.cluster_size) for r in df.collect()}
    assert result(cluster.euclidean(p, 0.3, keys=("frame",))) == exact | far
    assert result(cluster.seeded(p, 0.3, max_n=4, keys=("frame",))) == walk | far


def test_kernels_hold_no_pairs_of_dense_clouds():
    # 3,000 points within reach of each other have 9,000,000 directed pairs, over 300 MB
    xyz = np.random.default_rng(4).random((3000, 3)) * 0.1
    tracemalloc.start()
    whole = kernels.cluster_cloud(xyz, 0.3, "euclidean")
    i, j = kernels.nearest_capped(xyz, 0.3, 8)
    walk = kernels.cluster_cloud(xyz, 0.3, "seeded", 8)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert not whole.any()
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    assert (np.sort(j.reshape(-1, 8)) == np.sort(np.argsort(d2, axis=1, kind="stable")[:, :8])).all()
    assert (walk == kernels.seeded_labels(3000, i, j)[0]).all()


@pytest.mark.parametrize("kind", range(4))
def test_cells_and_nearest_agree_with_all_pairs(kind):
    rng = np.random.default_rng(kind)
    for chunk in (7, 500_000):
        xyz = rng.normal(size=(200, 3)) * (1, 1, 0.3)
        xyz = (xyz, np.round(xyz, 1), xyz[rng.integers(0, 30, 200)], xyz.round(1) + 1e15)[kind]
        a, b, _, _ = kernels.half_pairs(xyz, 0.3)
        cells = kernels.squeezed(np.floor(xyz / kernels.cell_side(0.3)), kernels.REACH)
        assert (kernels.cell_components(xyz, 0.3, cells, chunk=chunk)[0] == kernels.components(200, a, b)).all()
        for strict in (False, True):
            for n in (1, 3, 8):
                i, j = kernels.capped(*kernels.directed_pairs(xyz, 0.3, strict), n, "nearest")
                p, q = kernels.nearest_capped(xyz, 0.3, n, strict, chunk)
                assert (np.diff(p) >= 0).all() and set(zip(i, j)) == set(zip(p, q)) and len(p) == len(i)


def test_euclidean_kernel_holds_no_pairs():
    # 5,000 points within reach of each other have 12,500,000 pairs, over 300 MB
    xyz = np.random.default_rng(5).random((5000, 3)) * 0.1
    tracemalloc.start()
    assert not kernels.cluster_cloud(xyz, 0.3, "euclidean").any()
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def blocks_by_hand(xyz, tol, size):
    key = np.floor((xyz - xyz.min(axis=0)) / size).astype(int)
    parent = list(range(len(xyz)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in {tuple(k) for k in key}:
        low, high = xyz.min(axis=0) + np.array(b) * size, None
        lo = np.floor((xyz - tol - xyz.min(axis=0)) / size)
        hi = np.floor((xyz + tol - xyz.min(axis=0)) / size)
        rows = np.flatnonzero(((lo <= b) & (hi >= b)).all(axis=1))
        found = kernels.cluster_cloud(xyz[rows], tol, "seeded")
        for r, f in zip(rows, rows[found], strict=True):
            a, z = root(int(r)), root(int(f))
            parent[max(a, z)] = min(a, z)
        del low, high
    out = {}
    for i in range(len(xyz)):
        out.setdefault(root(i), []).append(i)
    return sorted(out.values())


def test_blocks_against_a_walk_by_hand(spark):
    rng = np.random.default_rng(2)
    xyz = rng.random((200, 3)) * 2
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xyz)], SCHEMA)
    assert groups(cluster.block_seeded(p, 0.25, size=0.5)) == blocks_by_hand(xyz, 0.25, 0.5)


def test_kernel_walk_equals_a_plain_walk():
    random.seed(3)
    for _ in range(30):
        n = random.randint(1, 60)
        xyz = np.array([[random.random() * 2 for _ in range(3)] for _ in range(n)])
        d = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
        label = np.full(n, -1)
        for i in range(n):
            if label[i] < 0:
                near = np.flatnonzero(d[i] <= 0.25)
                old = {label[j] for j in near if label[j] >= 0}
                new = min(old | {i})
                for j in range(n):
                    if label[j] in old:
                        label[j] = new
                label[near] = new
        want = sorted(sorted(np.flatnonzero(label == c).tolist()) for c in set(label.tolist()))
        got = kernels.cluster_cloud(xyz, 0.5, "seeded")
        assert sorted(sorted(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())) == want


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown algorithm"):
        run(line(spark, [0]), "none")
    cluster.register_algorithm("all_in_one", lambda points, **_: points)
    assert run(line(spark, [0]), "all_in_one").count() == 1
    del cluster.ALGORITHMS["all_in_one"]


def test_region_growing_separates_two_planes(spark):
    a = [(i, x * 0.1, y * 0.1, 0.0) for i, (x, y) in enumerate((x, y) for x in range(8) for y in range(8))]
    b = [(64 + i, 5.0, y * 0.1, z * 0.1) for i, (y, z) in enumerate((y, z) for y in range(8) for z in range(8))]
    got = groups(cluster.region_growing(spark.createDataFrame(a + b, SCHEMA), 5, 8, 10.0, 0.1))
    assert got == [list(range(64)), list(range(64, 128))]


def test_nearest_distance_beyond_the_first_radius(spark):
    q, p = line(spark, [0.0, 50.0]), line(spark, [3.0, 1000.0])
    assert sorted((r.i, r.d2) for r in neighbors.nearest_distance(q, p, first=0.5).collect()) == [(0, 9.0), (1, 47.0**2)]


def test_nearest_distance_by_key_without_points(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "seq string, idx long, x double, y double, z double")
    q, p = rows(("a", 0, 0.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0), ("c", 2, 1e6, 0.0, 0.0)), rows(("a", 0, 0.0, 3.0, 4.0), ("c", 1, 0.0, 0.0, 0.0), ("a", 2, None, 0.0, 0.0))
    assert sorted((r.seq, r.i, r.d2) for r in neighbors.nearest_distance(q, p, ("seq",)).collect()) == [("a", 0, 25.0), ("c", 2, 1e12)]
    assert neighbors.nearest_distance(q, p.limit(0), ("seq",)).count() == 0


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_knn_of_coincident_and_distant_points(spark, offset):
    rng = np.random.default_rng(21)
    xyz = np.concatenate([rng.random((140, 3)), np.full((60, 3), 0.5)]) + offset
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    want = [[(j, d2[i, j]) for j in np.lexsort((np.arange(200), d2[i]))[:5]] for i in range(200)]
    near, dist = kernels.knn(xyz, 5)
    assert [list(zip(a, b)) for a, b in zip(near.tolist(), dist.tolist())] == want
    assert kernels.knn(xyz[:2], 5)[0].tolist() == [[0, 1], [1, 0]] and kernels.knn(xyz[:0], 5)[0].shape == (0, 0)
    p = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(xyz[60:])] + [("b", 1, 0.0, 0.0, 0.0), ("b", 2, 9.0, 0.0, 0.0)], "seq string, idx long, x double, y double, z double")
    one, many = (sorted(map(tuple, neighbors.knn_pairs(p, 5, ("seq",), strategy).collect())) for strategy in ("kernel", "distributed"))
    assert one == many and len(one) == 140 * 5 + 4


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        neighbors.radius_pairs(line(spark, [0]), 1.0, max_n=-1)
    with pytest.raises(ValueError):
        neighbors.radius_pairs(line(spark, [0]), 0.0)


@pytest.mark.parametrize("one_task, many", [(100_000, 1_000_000), (0, 1_000_000), (0, 10)])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, one_task, many):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    monkeypatch.setattr(graph, "MANY", many)
    random.seed(22)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(90)] + [(500, k) for k in range(300, 420)] + [(k, k + 1) for k in range(600, 640)] + [(7, 7), (None, 3)]
    low = {}
    for a, b in pairs:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == low
    named = edges.selectExpr("named_struct('k', 'x', 'idx', src) as src", "named_struct('k', 'x', 'idx', dst) as dst").where("src.idx is not null")
    assert {r.node.idx: r.component.idx for r in graph.connected_components(named).collect()} == low
    assert graph.connected_components(edges.limit(0)).count() == 0


def renamings(xyz, tol, max_n):
    """Of a walk that labels points: how often a label is replaced in the whole cloud."""
    n = len(xyz)
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    label, fresh, count = [0] * n, 1, 0
    for p in range(n):
        if label[p]:
            continue
        near = [j for j in np.lexsort((np.arange(n), d2[p], np.arange(n) != p)) if d2[p, j] <= tol * tol][: max_n or n]
        low = min([label[j] for j in near if label[j]], default=fresh)
        fresh += low == fresh
        for j in near:
            if label[j] > low:
                count += 1
                label = [low if x == label[j] else x for x in label]
            label[j] = low
    return count


@pytest.mark.parametrize("max_n", [0, 4])
def test_renamings_against_a_walk(spark, max_n):
    rng = np.random.default_rng(23)
    xyz = rng.random((150, 3)) * [3, 3, 0.1]
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], SCHEMA)
    r = cluster.seed_profile(p, 0.4, max_n).first()
    assert r.relabel_trigger_count == renamings(xyz, 0.4, max_n) > 0
    assert r.relabel_point_visits == r.relabel_trigger_count * 150


def test_stage_times(spark):
    rng = np.random.default_rng(24)
    p = spark.createDataFrame([("a" if i % 3 else "b", i, *map(float, v)) for i, v in enumerate(rng.random((120, 3)))], "frame string, " + SCHEMA)
    got = cluster.stage_times(p, 0.2, 2, 8, ("frame",), 3).collect()
    found = {r.frame: r for r in run(p, "seeded", tol=0.2, min_size=2, max_n=8, keys=("frame",)).where("cluster_id is not null").groupBy("frame").agg(F.countDistinct("cluster_id").alias("c"), F.count("*").alias("n")).collect()}
    assert sorted((r.frame, r.run) for r in got) == [(f, k) for f in "ab" for k in range(3)]
    assert all((r.clusters, r.clustered_points) == (found[r.frame].c, found[r.frame].n) for r in got)
    assert all(r.total_ms == pytest.approx(r.build_ms + r.search_ms + r.merge_ms + r.final_ms) and r.total_ms > 0 for r in got)
    t = experiments.stage_table(p, (0.2,), (0, 8), 2, 2, ("frame",))
    assert t.count() == 4 and {"avg_search_ms", "relabel_point_visits", "fps", "merge_ms"} <= set(t.columns)
