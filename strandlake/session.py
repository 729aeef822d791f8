"""Getting the package to Python workers that don't have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import weakref
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors: once per context, unless PYTHONPATH already leads to it."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    _SHIPPED.add(context)
    given = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in given:
        return
    held = tempfile.mkdtemp(prefix="strandlake-ship-")
    context.addPyFile(shutil.make_archive(f"{held}/strandlake", "zip", ROOT, "strandlake"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that driver and executors share.

    It lies in ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests, a temporary
    folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within the block, jobs give Python batches bounded by rows alone.

    Spark's bound on a batch's bytes sums up all columns' buffers after each row, which for nested columns takes longer
    than the work: maps of tags went 18 times faster without it.
    """
    with _conf(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1), "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        yield


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within the block, a job's shuffle files are deleted when its query ends, and not when the driver next collects garbage.

    Tasks of many small partitions write three small files each in every shuffle, which add up over the rounds of an operator.
    """
    with _conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextmanager
def partitions_of(spark: SparkSession, size: str):
    """Within the block, shuffles are read in partitions of about that size, so that tasks which do much for a byte are many."""
    with _conf(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": size}):
        yield


@contextmanager
def _conf(spark: SparkSession, wanted: dict[str, str]):
    """Settings that hold within the block."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: its rows are fixed then, whatever is computed anew."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
