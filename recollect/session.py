"""Session helpers: local sessions for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("recollect")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("RECOLLECT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says; a folder of our own only where it is unset and there is one machine."""
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is not None or context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="recollect-checkpoint-"))


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_deleted(spark: SparkSession) -> AbstractContextManager[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it ends; they are the larger part of a job's disk."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, most: str = "4m") -> AbstractContextManager[None]:
    """What runs inside gets its rows in Arrow batches of about that size, or of one row; Spark's own limit is 64 MB, and a task holds two of them."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, in the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        # The plan is made anew, as a plan keeps the setting that it was made under.
        return df.select("*").checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same by a Parquet table in that folder, which takes less disk than a checkpoint; rows may come back in other partitions."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    with shuffles_deleted(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """All rows with their number in that order, which must be one without ties: ranges of it are counted, and each goes on from those before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    counts = {r["part"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}
    before, n = {}, start
    for part in sorted(counts):
        before[part] = n
        n += counts[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = before.get(TaskContext.get().partitionId(), start)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n + np.arange(batch.num_rows))], names=[*batch.schema.names, name])
            n += batch.num_rows

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType(), False)]))


def ship(spark: SparkSession) -> None:
    """Let the Python workers of every executor import this package, as spark-submit --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_recollect_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="recollect-package-"), "recollect")
    with zipfile.ZipFile(f"{base}.zip", "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("recollect", os.path.relpath(path, package)))
    context.addPyFile(f"{base}.zip")
    context._recollect_shipped = True
