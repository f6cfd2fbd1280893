"""Embedding near-duplicates: pigeonhole over low-dimensional blocks of rotated vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.graph import connected_components
from pointloom.operators.kernels import components
from pointloom.session import cut, prepare, table

#: Dimensions of a block, and members of a strip that one task compares with as many.
BLOCK_DIMS, TILE_ROWS = 8, 4096
#: Allows for rounding where candidates are chosen; links are decided in double precision.
SLACK = 1e-5
_STEPS = np.random.default_rng(13).integers(0, 1 << 63, BLOCK_DIMS, dtype=np.int64) * 2 + 1


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix: it keeps distances and spreads them evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _strips(threshold: float):
    """Arrow stage: (label, dim, block, strip, home, key, part, norms) for each block of each unit vector.

    Unit vectors with cosine >= t differ by a squared distance of at most 2 - 2 t; so in some block of d of D dimensions by at most (2 - 2 t) d / D. Strips are cut along the block's first coordinate, twice as wide as that distance; a vector also visits the next strip if it lies within reach of it.
    """
    budget = 2 - 2 * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                some = b.take(pa.array(at))
                x = np.array(some.column("v").to_pylist(), dtype=np.float64).reshape(len(at), dim)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y = x @ rotation(dim)
                cuts = list(range(0, dim, BLOCK_DIMS))
                norms = np.stack([np.linalg.norm(y[:, c : c + BLOCK_DIMS], axis=1) for c in cuts], axis=1).astype(np.float32)
                packed = [r.tobytes() for r in norms]
                labels, keys = some.column("label").to_pylist(), some.column("key").to_pylist()
                for k, c in enumerate(cuts):
                    part = y[:, c : c + BLOCK_DIMS]
                    reach = np.sqrt(budget * part.shape[1] / dim) + SLACK
                    strip = np.floor(part[:, 0] / (2 * reach)).astype(np.int64)
                    visits = part[:, 0] + reach >= (strip + 1) * 2 * reach
                    bits = [r.tobytes() for r in part.astype(np.float32)]
                    for i in range(len(at)):
                        for home in (True, False) if visits[i] else (True,):
                            for column, value in zip(out, (labels[i], dim, k, int(strip[i]) + (not home), home, keys[i], bits[i], packed[i]), strict=True):
                                column.append(value)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["label", "dim", "block", "strip", "home", "key", "part", "norms"])

    return run


class _Spanning:
    """Groups of linked rows, kept as one edge a row however many links are added."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > 500_000:
            a, b = self.edges()
            self.a, self.b, self.held = [a], [b], len(a)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = components(self.n, np.concatenate(self.a), np.concatenate(self.b))
        at = np.flatnonzero(low != np.arange(self.n))
        return at, low[at]


def _cells(part: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) sorted by cell: cells of width 2 reach in all coordinates but the first, named by a hash. A row stands in its own cell and, along each coordinate, in the next one if it lies within reach of it; so rows within reach of each other share a cell."""
    at = part[:, 1:].astype(np.float64) / (2 * reach)
    home = np.floor(at)
    visits = at + 0.5 >= home + 1
    row, cell = np.arange(len(part)), (home.astype(np.int64) * _STEPS[: at.shape[1]]).sum(axis=1)
    for d in range(at.shape[1]):
        more = np.flatnonzero(visits[row, d])
        row, cell = np.concatenate([row, row[more]]), np.concatenate([cell, cell[more] + _STEPS[d]])
    order = np.argsort(cell, kind="stable")
    return row[order], cell[order]


def _range_join(threshold: float):
    """Pairs of a tile within the block's budget whose block norms don't already differ by more than the whole budget, as edges that span their groups."""
    budget = 2 - 2 * threshold

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, i, j = (key[k].as_py() for k in (1, 4, 5))
        keys = np.array(rows.column("key").to_pylist(), dtype=object)
        part = np.frombuffer(b"".join(rows.column("part").to_pylist()), np.float32).reshape(len(keys), -1)
        norms = np.frombuffer(b"".join(rows.column("norms").to_pylist()), np.float32).reshape(len(keys), -1)
        home, side = rows.column("home").to_numpy(zero_copy_only=False), rows.column("tile").to_numpy()
        reach = np.sqrt(budget * part.shape[1] / dim) + SLACK
        row, cell = _cells(part, reach)
        found, low = _Spanning(len(keys)), np.arange(len(keys))
        at, step = np.arange(len(row)), 0
        while True:
            # members of a cell against those that stand step places behind them
            step += 1
            at = at[: np.searchsorted(at, len(row) - step)]
            at = at[cell[at] == cell[at + step]]
            if not len(at):
                break
            p, q = row[at], row[at + step]
            open_ = (low[p] != low[q]) & (home[p] | home[q])
            if i != j:
                open_ &= side[p] != side[q]
            p, q = p[open_], q[open_]
            d = part[p] - part[q]
            near = (d * d).sum(axis=1) <= reach * reach
            p, q = p[near], q[near]
            d = norms[p] - norms[q]
            near = (d * d).sum(axis=1) <= budget + SLACK
            if near.any():
                found.add(p[near], q[near])
                if step < 8 or step % 64 == 0:  # rows that are linked already need no comparison
                    left, right = found.edges()
                    low = components(len(keys), left, right)
        left, right = found.edges()
        return pa.table([pa.array(keys[left], pa.string()), pa.array(keys[right], pa.string())], ["a", "b"])

    return run


def _verify(threshold: float):
    """(key, other, links) from the vectors of candidate groups: with other null, links that a class gains in this tile; else an edge that spans linked classes."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        keys, weight, side = np.array(rows.column("key").to_pylist(), dtype=object), rows.column("weight").to_numpy(), rows.column("tile").to_numpy()
        groups: dict[str, list[int]] = {}
        for r, c in enumerate(rows.column("comp").to_pylist()):
            groups.setdefault(c, []).append(r)
        vectors = rows.column("v").combine_chunks()
        flat, at = vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        links, found = np.zeros(len(keys), dtype=np.int64), _Spanning(len(keys))
        for members in groups.values():
            g = np.array(members)
            x = np.stack([flat[at[r] : at[r + 1]] for r in members])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            n = np.sqrt((x * x).sum(axis=1))
            a, b = np.flatnonzero(side[g] == i), np.flatnonzero(side[g] == j)
            for k in range(0, len(a), 256):
                part = a[k : k + 256]
                near = x[part] @ x[b].T / (n[part][:, None] * n[b]) >= threshold
                if i == j:
                    near &= b[None] > part[:, None]
                links[g[part]] += near @ weight[g[b]]
                links[g[b]] += weight[g[part]] @ near
                p, q = np.nonzero(near)
                found.add(g[part[p]], g[b[q]])
        left, right = found.edges()
        some = np.flatnonzero(links)
        return pa.table([pa.array([*keys[left], *keys[some]], pa.string()), pa.array([*keys[right], *[None] * len(some)], pa.string()), pa.array([*[0] * len(left), *links[some].tolist()], pa.int64())], ["key", "other", "links"])

    return run


def _tiles(rows: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """rows of groups with n members, dealt over the tiles (i, j) of their group: each pair of members meets in one tile."""
    dealt = rows.withColumn("_t", F.ceil(F.col(n) / TILE_ROWS).cast("int")).withColumn("tile", F.pmod(F.xxhash64("key", *group), F.col("_t")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    return dealt.withColumns({"i": F.least("tile", "_o"), "j": F.greatest("tile", "_o")})


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and the cosine of their embeddings in double precision is at least the threshold. Null, empty or zero embeddings, those with a null, infinite or NaN component, and such of unequal length link with nothing. n_links counts the other linked rows; component_id is the smallest vec_id reachable by links; kept: it is the row's own. Repeated rows are rows of their own (and link); a null vec_id is never the smallest unless all are null. Extra columns are ignored.
    Equal vectors of a label become one weighted class first. The range joins give groups of candidates (connected components), within which every pair is verified in tiles of bounded size; pairs never become rows.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    biggest = F.array_max(F.transform("v", F.abs))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (biggest > 0), F.lit(False))
    name = F.concat(*(F.hex(F.xxhash64(F.lit(s), "label", "v")) for s in (1, 2)))
    rows = base.withColumn("key", F.when(sound, name))
    classes = cut(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")))
    strips = classes.select("key", "label", "v", F.size("v").alias("dim")).mapInArrow(_strips(threshold), "label long, dim int, block int, strip long, home boolean, key string, part binary, norms binary")
    cell = ["label", "dim", "block", "strip"]
    counts = strips.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1")
    near = _tiles(strips.join(counts, cell), cell).select(*cell, "i", "j", "tile", "home", "key", "part", "norms").groupBy(*cell, "i", "j").applyInArrow(_range_join(threshold), "a string, b string").distinct()
    candidates = connected_components(near, "a", "b").withColumnRenamed("node", "key").withColumnRenamed("component", "comp")
    members = classes.join(candidates, "key").select("key", "comp", "weight", "v")
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # small groups share a tile, large ones have several
    lane = F.when(F.col("n") <= TILE_ROWS, F.pmod(F.xxhash64("comp"), F.lit(max(1, total // TILE_ROWS)))).otherwise(F.xxhash64("comp"))
    tiles = _tiles(members.join(sizes, "comp"), ["comp"]).withColumn("lane", lane).select("lane", "i", "j", "tile", "comp", "key", "weight", "v")
    found = cut(tiles.groupBy("lane", "i", "j").applyInArrow(_verify(threshold), "key string, other string, links long"))
    more = found.where("other is null").groupBy("key").agg(F.sum("links").alias("w"))
    links = found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    least = groups.join(classes.select("key", "rep"), "key").groupBy("component").agg(F.min("rep").alias("least"))
    state = classes.select("key", "rep", "weight").join(more, "key", "left").join(groups.join(least, "component").select("key", "least"), "key", "left")
    state = state.select("key", F.coalesce("least", "rep").alias("least"), (F.coalesce("w", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = rows.select("vec_id", "key").join(state, "key", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as s, b.vec_id as t from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
r(s, t) as (select vec_id, vec_id from embeddings union select r.s, l.t from r join l on r.t = l.s),
c as (select s as vec_id, min(t) as component_id from r group by s),
n as (select s as vec_id, count(*) as n_links from l group by s)
select e.vec_id, coalesce(n_links, 0) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join c on c.vec_id = e.vec_id left join n on n.vec_id = e.vec_id
"""
