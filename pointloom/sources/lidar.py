"""LiDAR frames, labels, poses and calibrations, read by Spark's own file readers."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FLOATS = r"[ \t]+"


def _from_path(path: str = "path") -> list[Column]:
    """seq and frame of .../<seq>/<kind>/<frame>.<ext>."""
    return [F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("seq"), F.regexp_extract(path, r"/(\d+)\.[^./]+$", 1).cast("int").alias("frame")]


def _files(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(*_from_path(), "path", "content")


def decode_points(content: bytes, strict: bool = True, name: str = "") -> np.ndarray:
    """(n, 4) float32 x, y, z, intensity; a size that is no multiple of 16 is an error, or is cut off."""
    if strict and len(content) % 16:
        raise ValueError(f"size of point file is not a multiple of 16: {name}")
    return np.frombuffer(content, "<f4", len(content) // 16 * 4).reshape(-1, 4)


def decode_labels(content: bytes, strict: bool = True, name: str = "") -> np.ndarray:
    if strict and len(content) % 4:
        raise ValueError(f"size of label file is not a multiple of 4: {name}")
    return np.frombuffer(content, "<u4", len(content) // 4).astype(np.int64)


def read_points(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """points(seq, frame, idx, x, y, z) of all .bin files below path; the intensity is dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seq, frame, name, content in b.itertuples(index=False):
                p = decode_points(content, strict, name)
                yield pd.DataFrame({"seq": seq, "frame": np.int32(frame), "idx": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return _files(spark, path, "*.bin").mapInPandas(run, "seq string, frame int, idx long, x float, y float, z float")


def read_labels(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """labels(seq, frame, idx, label): unsigned 32-bit labels as longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seq, frame, name, content in b.itertuples(index=False):
                v = decode_labels(content, strict, name)
                yield pd.DataFrame({"seq": seq, "frame": np.int32(frame), "idx": np.arange(len(v)), "label": v})

    return _files(spark, path, "*.label").mapInPandas(run, "seq string, frame int, idx long, label long")


def read_frames(spark: SparkSession, points: str | list[str], labels: str | list[str], on_error: str = "raise") -> DataFrame:
    """(seq, frame, idx, x, y, z, label, valid). Both files of a frame are decoded together; a missing or mismatching one raises, or gives one row with valid false (on_error="mark"), so that skipped frames can be counted."""
    p = _files(spark, points, "*.bin").select("seq", "frame", F.col("content").alias("p"))
    both = p.join(_files(spark, labels, "*.label").select("seq", "frame", F.col("content").alias("l")), ["seq", "frame"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seq, frame, pc, lc in b.itertuples(index=False):
                try:
                    if lc is None:
                        raise ValueError("no label file")
                    p, v = decode_points(pc, True, f"{seq}/{frame}"), decode_labels(lc, True, f"{seq}/{frame}")
                    if len(p) != len(v):
                        raise ValueError(f"{len(p)} points and {len(v)} labels in {seq}/{frame}")
                except ValueError:
                    if on_error == "raise":
                        raise
                    yield pd.DataFrame({"seq": [seq], "frame": [np.int32(frame)], "idx": [None], "x": [None], "y": [None], "z": [None], "label": [None], "valid": [False]})
                    continue
                yield pd.DataFrame({"seq": seq, "frame": np.int32(frame), "idx": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "label": v, "valid": True})

    return both.mapInPandas(run, "seq string, frame int, idx long, x float, y float, z float, label long, valid boolean")


def skipped_frames(frames: DataFrame) -> DataFrame:
    return frames.groupBy("seq").agg(F.countDistinct(F.when(~F.col("valid"), F.col("frame"))).alias("skipped_frames"))


def _numbers(line: Column) -> Column:
    return F.transform(F.split(F.trim(line), _FLOATS), lambda v: v.try_cast("double") if hasattr(v, "try_cast") else v.cast("double"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, frame, line): lines with their numbers from 0."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("frame", "line"))
    return text


def read_poses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """poses(seq, frame, m): 12 numbers a line, the line number is the frame; seq is the folder's name; other lines are left out."""
    rows = _lines(spark, path).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("seq"), "frame", _numbers(F.col("line")).alias("m"))
    return rows.where(F.size("m") == 12).where(F.forall("m", lambda v: v.isNotNull()))


def read_tr(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq, m) of the last ``Tr:`` line of each calib.txt."""
    rows = _lines(spark, path).where(F.ltrim("line").startswith("Tr:")).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("seq"), "frame", _numbers(F.regexp_replace("line", r"^\s*Tr:", "")).alias("m"))
    return rows.where(F.size("m") == 12).groupBy("seq").agg(F.max_by("m", "frame").alias("m"))


def read_kitti_calib(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(frame, r0, tr): rectification (R0_rect or R_rect, 9 numbers; identity without) and Tr_velo_to_cam (12, required) of each calibration file."""
    rows = _lines(spark, path).select(F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("int").alias("file"), F.trim(F.substring_index("line", ":", 1)).alias("name"), _numbers(F.regexp_replace("line", r"^[^:]*:", "")).alias("v"))
    unit = F.array(*(F.lit(float(i in (0, 4, 8))) for i in range(9)))
    calib = rows.groupBy(F.col("file").alias("frame")).agg(F.coalesce(F.max(F.when(F.col("name").isin("R0_rect", "R_rect") & (F.size("v") == 9), F.col("v"))), unit).alias("r0"), F.max(F.when((F.col("name") == "Tr_velo_to_cam") & (F.size("v") == 12), F.col("v"))).alias("tr"))
    return calib.withColumn("tr", F.when(F.col("tr").isNull(), F.raise_error(F.concat(F.lit("no Tr_velo_to_cam in frame "), F.col("frame").cast("string")))).otherwise(F.col("tr")))


def read_kitti_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(frame, box, type, h, w, l, x, y, z, ry) of lines with 15 fields and sound numbers; box numbers the lines; DontCare and Misc are left out."""
    rows = _lines(spark, path).select(F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("int").alias("file"), F.col("frame").alias("box"), F.split(F.trim("line"), r"\s+").alias("f")).where(F.size("f") >= 15)
    names = ("h", "w", "l", "x", "y", "z", "ry")
    out = rows.select(F.col("file").alias("frame"), "box", F.element_at("f", 1).alias("type"), *(F.expr(f"try_cast(f[{8 + k}] as double)").alias(n) for k, n in enumerate(names)))
    return out.dropna(subset=list(names)).where(~F.col("type").isin("DontCare", "Misc"))


MANIFEST = "target_points int, frames_used int, car int, tree int, building int, bbox_x double, bbox_y double, bbox_z double, ply_path string"


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The target manifest; a malformed row fails, or is left out."""
    return spark.read.csv(path, schema=MANIFEST, header=True, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_coloured(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="x double, y double, z double, r int, g int, b int", header=True)


def require_targets(manifest: DataFrame, targets: Iterable[int]) -> DataFrame:
    """Manifest rows of the targets; a target without a row is an error."""
    wanted = manifest.sparkSession.createDataFrame([(int(t),) for t in targets], "target_points int")
    met = F.broadcast(wanted).join(manifest, "target_points", "left")
    missing = F.raise_error(F.concat(F.lit("target not in manifest: "), F.col("target_points").cast("string")))
    return met.withColumn("ply_path", F.when(F.col("ply_path").isNull(), missing).otherwise(F.col("ply_path")))


def sequences_root(path: str, variables: Iterable[str] = (), candidates: Iterable[str] = ()) -> str:
    """The folder that holds the sequences: path, path/sequences or path/dataset/sequences; else by environment variables, else candidates."""
    for base in (path, *(os.environ.get(v, "") for v in variables), *candidates):
        for root in (base, os.path.join(base, "sequences"), os.path.join(base, "dataset", "sequences")) if base else ():
            if os.path.isdir(root) and any(os.path.isdir(os.path.join(root, d, "velodyne")) for d in os.listdir(root)):
                return root
    raise FileNotFoundError(f"no sequences below {path!r}")


def list_sequences(root: str, need: Iterable[str] = ("velodyne",)) -> list[str]:
    return sorted(d for d in os.listdir(root) if all(os.path.isdir(os.path.join(root, d, n)) for n in need))


def list_frames(folder: str, start: int | None = None, end: int | None = None, limit: int | None = None) -> list[str]:
    """Stems of the .bin files, sorted, within [start, end], the first ``limit`` of them."""
    stems = sorted(f[:-4] for f in os.listdir(folder) if f.endswith(".bin"))
    stems = [s for s in stems if (start is None or int(s) >= start) and (end is None or int(s) <= end)]
    return stems if limit is None else stems[:limit]


def resolve_path(path: str, base: str) -> str:
    """A manifest's path: as it is, below base, or by its name below base."""
    for p in (path, os.path.join(base, path), os.path.join(base, os.path.basename(path))):
        if os.path.exists(p):
            return p
    raise FileNotFoundError(path)
