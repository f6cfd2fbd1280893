"""Statistics of timing runs. The percentile, trimming and deviation conventions are not Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fps(ms: str | Column) -> Column:
    """Frames a second; 0 where the time is not positive."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.when(c > 1e-12, F.lit(1000.0) / c).otherwise(0.0)


def _ranked(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(value, *ties)
    return df.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys))})


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], median: str | None = "median") -> DataFrame:
    """Per key: sorted[n div 2] as ``median`` and sorted[floor((n - 1) q)] for each named quantile."""
    r = _ranked(df.where(F.col(value).isNotNull()), keys, value, ())
    picks = {name: F.floor((F.col("_n") - 1) * F.lit(q)) + 1 for name, q in quantiles.items()}
    if median:
        picks[median] = F.floor(F.col("_n") / 2) + 1
    return r.groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == at, F.col(value))).alias(name) for name, at in picks.items()))


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, trim: int, ties: Sequence[str] = (), name: str = "trimmed_mean") -> DataFrame:
    """Mean without the ``trim`` smallest and largest values of each key; of all, where nothing would be left."""
    r = _ranked(df, keys, value, ties)
    inner = (F.col("_r") > trim) & (F.col("_r") <= F.col("_n") - trim)
    return r.groupBy(*keys).agg(F.coalesce(F.avg(F.when(inner, F.col(value))), F.avg(value)).alias(name))


def drop_extremes(df: DataFrame, keys: Sequence[str], total: str, order: str) -> DataFrame:
    """Rows without the first of the smallest and the first of the largest totals of each key, if it has more than two."""
    up = Window.partitionBy(*keys).orderBy(total, order)
    down = Window.partitionBy(*keys).orderBy(F.desc(total), order)
    w = df.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down), "_n": F.count("*").over(Window.partitionBy(*keys))})
    return w.where("_n <= 2 or (_a > 1 and _z > 1)").drop("_a", "_z", "_n")


def drop_warmup(df: DataFrame, keys: Sequence[str], order: str, runs: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > runs).drop("_r")


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, sample deviation (0 for one value), population deviation, min and max."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("sd_sample"), F.stddev_pop(value).alias("sd_population"), F.min(value).alias("low"), F.max(value).alias("high"))


def best_and_mean(df: DataFrame, keys: Sequence[str], ms: str, run: str, warmup: int, clusters: str = "clusters") -> DataFrame:
    """After the warm-up runs: best and mean time, fps of the best, and the clusters of the last run."""
    r = drop_warmup(df, keys, run, warmup)
    return r.groupBy(*keys).agg(F.min(ms).alias("best_ms"), F.avg(ms).alias("mean_ms"), F.max_by(clusters, run).alias("clusters")).withColumn("fps", fps("best_ms"))


def summary_by_sequence(df: DataFrame, sequence: str, value: str) -> DataFrame:
    """One row for each sequence and one over all frames (sequence null), not over sequences; both meanings of mean fps."""
    return df.rollup(sequence).agg(F.count("*").alias("frames"), F.avg(value).alias("avg_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), F.avg(fps(value)).alias("mean_of_fps")).withColumn("fps_of_mean", fps("avg_ms"))


def speedups(df: DataFrame, keys: Sequence[str], name: str, base: str, ms: str) -> DataFrame:
    """Each algorithm's time against the base algorithm of its key, the difference, and whether it wins the key (first name on ties)."""
    b = df.where(F.col(name) == base).select(*keys, F.col(ms).alias("base_ms"))
    out = df.join(b, list(keys)).withColumns({"speedup": F.when(F.col(ms) > 0, F.col("base_ms") / F.col(ms)).otherwise(0.0), "difference": F.col("base_ms") - F.col(ms)})
    w = Window.partitionBy(*keys).orderBy(ms, name)
    return out.withColumn("wins", F.row_number().over(w) == 1)


def fastest(df: DataFrame, keys: Sequence[str], name: str, ms: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(name, F.struct(ms, name)).alias(name), F.min(ms).alias(ms))


def rank_candidates(df: DataFrame, ms: str, pq: str, drop: float, k: int | None = None) -> DataFrame:
    """Candidates whose quality is at least best * (1 - drop) first, by time then quality; the others by quality then time. rank from 1; k keeps the best k."""
    best = df.agg(F.max(pq).alias("_best"))
    w = df.join(F.broadcast(best)).withColumn("eligible", F.col(pq) + 1e-12 >= F.col("_best") * (1 - drop)).drop("_best")
    order = [F.desc("eligible"), F.when(F.col("eligible"), F.col(ms)).asc_nulls_last(), F.desc(pq), F.asc(ms), *(F.asc(c) for c in df.columns if c not in (ms, pq))]
    ranked = w.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank") <= k) if k else ranked
