"""Connected components: small edge sets in one task, others by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.session import cut, prepare

#: Edges up to which one task settles all components, and from which frequent nodes are joined apart.
ONE_TASK, MANY = 100_000, 1_000_000
#: A node is frequent with more than 1 / SHARE of all edges; there are at most 2 * SHARE of them.
SHARE = 64


def _settle(rows: pa.Table) -> pa.Table:
    """(u, v): each node with the smallest one of its component, itself left out."""
    number: dict = {}
    nodes: list = []

    def numbered(column: str) -> list[int]:
        out = []
        for x in rows.column(column).to_pylist():
            key = tuple(x.values()) if isinstance(x, dict) else x
            if key not in number:
                number[key] = len(nodes)
                nodes.append((key, x))
            out.append(number[key])
        return out

    ends = zip(numbered("u"), numbered("v"), strict=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in ends:
        a, b = root(a), root(b)
        if a != b:
            low, high = (a, b) if nodes[a][0] < nodes[b][0] else (b, a)
            parent[high] = low
    up = [root(k) for k in range(len(nodes))]
    some = [k for k, r in enumerate(up) if r != k]
    kind = rows.schema.field("u").type
    if pa.types.is_struct(kind):  # results are nullable in all their fields
        kind = pa.struct([pa.field(f.name, f.type) for f in kind])
    return pa.table([pa.array([nodes[k][1] for k in some], kind), pa.array([nodes[up[k]][1] for k in some], kind)], ["u", "v"])


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One step over n edges. Minima are pre-aggregated map-side and joined back; those of frequent nodes are broadcast, so that no task receives all edges of one node."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    if n > MANY:
        often = cut(low.where(F.col("n") > n // SHARE).drop("n"), 2 * SHARE)
        apart = both.join(F.broadcast(often), "u")  # 2 * SHARE rows at most
        rest = both.join(F.broadcast(often.select("u")), "u", "left_anti").join(low.drop("n"), "u")
        near = rest.unionByName(apart)
    else:
        near = both.join(low.drop("n"), "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; component = the smallest node reachable.

    Up to ONE_TASK edges are settled by one task, more in rounds that are each written to the checkpoint folder. Nodes with null ends and self loops are dropped.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        # an order-free digest of the edge set
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    if before[0] <= ONE_TASK:
        prepare(e.sparkSession)
        kind = e.schema["u"].dataType.simpleString()
        e = cut(e.groupBy().applyInArrow(_settle, f"u {kind}, v {kind}"), 1)
        before = (0,)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = cut(_stars(_stars(e, True, before[0]), False, before[0]), before[0])
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
