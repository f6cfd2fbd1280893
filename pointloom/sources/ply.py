"""PLY point clouds: reading through Spark's binaryFile, a writer as a Python data source."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Names of PLY scalars.
SCALARS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_header(content: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str]]]], int]:
    """(format, elements as (name, count, properties), where the data begins)."""
    end = content.find(b"end_header")
    if not content.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    kind, elements = "", []
    for line in content[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            if w[1] == "list":
                if elements[-1][0] == "vertex":
                    raise ValueError("list properties are not supported")
                elements[-1][2].append((w[-1], "list"))
            elif w[1] not in SCALARS:
                raise ValueError(f"unsupported type {w[1]}")
            else:
                elements[-1][2].append((w[2], SCALARS[w[1]]))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"unsupported format {kind!r}")
    return kind, elements, content.index(b"\n", end) + 1


def decode(content: bytes) -> pd.DataFrame:
    """The vertices: x, y, z as double and, if there, scalar_instance rounded to instance (0 and less: background, null)."""
    kind, elements, at = parse_header(content)
    for name, count, props in elements:
        if name == "vertex":
            break
        if kind == "ascii":
            for _ in range(count):
                at = content.index(b"\n", at) + 1
        else:
            if any(t == "list" for _, t in props):
                raise ValueError("list properties before the vertices are not supported")
            at += count * sum(np.dtype(t).itemsize for _, t in props)
    else:
        raise ValueError("no vertices")
    if kind == "ascii":
        rows = [line.split()[: len(props)] for line in content[at:].splitlines()[:count]]
        data = {n: np.array([float(r[k]) for r in rows]) for k, (n, _) in enumerate(props)}
    else:
        dtype = np.dtype([(n, "<" + t) for n, t in props])
        if len(content) - at < count * dtype.itemsize:
            raise ValueError("the file ends early")
        table = np.frombuffer(content, dtype, count, at)
        data = {n: table[n] for n, _ in props}
    if any(a not in data for a in "xyz"):
        raise ValueError("x, y or z is missing")
    out = pd.DataFrame({a: np.asarray(data[a], np.float64) for a in "xyz"})
    inst = np.asarray(data["scalar_instance"], np.float64) if "scalar_instance" in data else None
    out["instance"] = pd.array([None] * len(out) if inst is None else [int(v) if v > 0 else None for v in np.floor(np.abs(inst) + 0.5) * np.sign(inst)], dtype="Int64")
    return out


def read_ply(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, idx, x, y, z, instance) of all .ply files below path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in b.itertuples(index=False):
                d = decode(content)
                d.insert(0, "file", os.path.basename(name))
                d.insert(1, "idx", np.arange(len(d)))
                yield d

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, idx long, x double, y double, z double, instance long")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        data = [tuple(r) for r in rows]
        colour = [n for n in ("r", "g", "b") if n in self.names]
        dtype = np.dtype([(a, "<f4") for a in "xyz"] + [(c, "u1") for c in colour])
        at = [self.names.index(n) for n in ("x", "y", "z", *colour)]
        table = np.array([tuple(r[k] for k in at) for r in data], dtype=dtype)
        long = {"r": "red", "g": "green", "b": "blue"}
        head = "".join([f"ply\nformat binary_little_endian 1.0\nelement vertex {len(table)}\n", *(f"property float {a}\n" for a in "xyz"), *(f"property uchar {long[c]}\n" for c in colour), "end_header\n"])
        temp = f"{self.path}.{os.getpid()}.part"
        with open(temp, "wb") as f:
            f.write(head.encode() + table.tobytes())
        os.replace(temp, self.path)
        return WriterCommitMessage()


class PlySink(DataSource):
    """df.write.format("pointloom_ply").mode("append").option("path", file): one cloud, x y z and optionally r g b."""

    @classmethod
    def name(cls) -> str:
        return "pointloom_ply"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [f.name for f in schema.fields])


def write_ply(points: DataFrame, path: str, order: str = "idx") -> None:
    """One binary file in the order of ``order``; a file holds one cloud, so one task writes it."""
    points.sparkSession.dataSource.register(PlySink)
    keep = [c for c in ("x", "y", "z", "r", "g", "b") if c in points.columns]
    points.orderBy(order).coalesce(1).select(*(F.col(c) for c in keep)).write.format("pointloom_ply").mode("append").option("path", path).save()
