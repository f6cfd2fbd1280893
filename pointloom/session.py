"""Session helpers: checkpoint folder, shipping of this package to Python workers, Arrow batch bounds."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that a Python stage receives; bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: Rows of one checkpoint file, about, where their number is known.
FILE_ROWS = 100_000

#: Column of row numbers, beside a table's own columns.
ROW = "__row"

_shipped: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: ``spark.checkpoint.dir``; a new local one where it is unset and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pointloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later steps neither recompute nor depend on lost executors. rows: about how many there will be, if known; small results then become few files."""
    checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """df, materialised with a number for each row in the column ROW, so that a decision on a row can be joined back whatever its id."""
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()))


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors and bound the Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        name = os.path.join(tempfile.mkdtemp(prefix="pointloom-"), f"{root.name}.zip")
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
        _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame; the path is read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
