"""Clusters against ground-truth instances: overlaps, IoU, matching and panoptic scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.session import prepare


def overlaps(clusters: DataFrame, gt: DataFrame, keys: Sequence[str] = (), gt_sizes: DataFrame | None = None) -> DataFrame:
    """(keys, gt_key, cluster_id, common, gt_size, pred_size, iou, recall, precision) of each pair that shares a point.

    clusters: keys, idx, cluster_id (null: noise); gt: keys, idx, gt_key. gt_sizes (keys, gt_key, gt_size) replaces the sizes counted from gt.
    """
    c = clusters.where("cluster_id is not null").select(*keys, "idx", "cluster_id")
    common = gt.select(*keys, "idx", "gt_key").join(c, [*keys, "idx"]).groupBy(*keys, "gt_key", "cluster_id").agg(F.count("*").alias("common"))
    gs = gt_sizes if gt_sizes is not None else gt.groupBy(*keys, "gt_key").agg(F.count("*").alias("gt_size"))
    ps = c.groupBy(*keys, "cluster_id").agg(F.count("*").alias("pred_size"))
    met = common.join(gs, [*keys, "gt_key"]).join(ps, [*keys, "cluster_id"])
    i, g, p = F.col("common"), F.col("gt_size"), F.col("pred_size")
    return met.withColumns({"iou": i / (g + p - i), "recall": i / g, "precision": i / p})


def best_matches(pairs: DataFrame, gt: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, gt_key, cluster_id, best_iou, recall, precision) for every instance: its cluster of greatest IoU (smallest cluster_id on ties), zeros without any."""
    best = pairs.groupBy(*keys, "gt_key").agg(F.max_by(F.struct("cluster_id", "iou", "recall", "precision"), F.struct("iou", -F.col("cluster_id"))).alias("b"))
    every = gt.select(*keys, "gt_key").distinct()
    return every.join(best, [*keys, "gt_key"], "left").select(*keys, "gt_key", F.col("b.cluster_id").alias("cluster_id"), F.coalesce("b.iou", F.lit(0.0)).alias("best_iou"), F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.coalesce("b.precision", F.lit(0.0)).alias("precision"))


def frame_scores(best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Instances, matches at 0.3 and 0.5, and means over instances."""
    return best.groupBy(*keys).agg(F.count("*").alias("gt"), F.count_if(F.col("best_iou") >= 0.3).alias("matched_30"), F.count_if(F.col("best_iou") >= 0.5).alias("matched_50"), F.avg("best_iou").alias("mean_iou"), F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"))


def greedy_matches(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs by descending IoU from 0.5 on (ties: gt_key, cluster_id).

    Above 0.5 a pair is alone on both sides, as clusters and instances are partitions; only exact halves can compete, and only these meet in a sequential step.
    """
    prepare(pairs.sparkSession)
    sure = pairs.where("iou > 0.5")
    cols = pairs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        gts, preds, keep = set(), set(), []
        for r in rows.sort_values(["gt_key", "cluster_id"]).itertuples():
            ok = r.gt_key not in gts and r.cluster_id not in preds
            keep.append(r.Index) if ok else None
            if ok:
                gts.add(r.gt_key)
                preds.add(r.cluster_id)
        return rows.loc[keep, cols]

    halves = pairs.where("iou = 0.5").join(sure.select(*keys, "gt_key"), [*keys, "gt_key"], "left_anti").join(sure.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_anti").select(*cols)
    return sure.unionByName(halves.groupBy(*keys).applyInPandas(settle, types))


def panoptic(matches: DataFrame, best: DataFrame, clusters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: GT, Pred, TP, FP, FN, the sum of matched IoU and the sum of each instance's best IoU. best: from best_matches()."""
    g = best.groupBy(*keys).agg(F.count("*").alias("gt"), F.sum("best_iou").alias("best_iou_sum"))
    p = clusters.where("cluster_id is not null").groupBy(*keys).agg(F.countDistinct("cluster_id").alias("pred"))
    m = matches.groupBy(*keys).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    if keys:
        out = g.join(p, list(keys), "full").join(m, list(keys), "left")
    else:
        out = g.join(F.broadcast(p)).join(F.broadcast(m))
    out = out.fillna(0, ["gt", "pred", "tp"]).fillna(0.0, ["iou_sum", "best_iou_sum"])
    return out.withColumns({"fp": F.col("pred") - F.col("tp"), "fn": F.col("gt") - F.col("tp")})


def ratios(counts: DataFrame) -> DataFrame:
    """SQ, RQ, PQ, RC50 and mIoU from summed counts; 0 where a denominator is 0."""

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"sq": div(F.col("iou_sum"), tp), "rq": div(tp, tp + 0.5 * fp + 0.5 * fn), "rc50": div(tp, tp + fn)})
    return out.withColumns({"pq": F.col("sq") * F.col("rq"), "miou": div(F.col("best_iou_sum"), F.col("gt"))})


def merged(counts: DataFrame, by: Sequence[str], ms: str | None = None) -> DataFrame:
    """Sums of the counts over samples, the mean time, and the ratios of the sums."""
    sums = [F.sum(c).alias(c) for c in ("gt", "pred", "tp", "fp", "fn", "iou_sum", "best_iou_sum")]
    return ratios(counts.groupBy(*by).agg(*sums, *([F.avg(ms).alias(ms)] if ms else [])))
