"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir.

    Where none is set, a local folder is used if the session runs in one process, as in tests; on a cluster, whose
    machines would each write to a disk of their own, that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there, and executors may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one piece of work in the shared folder. On leaving, all are removed but those that were kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = shared_folder(self.spark, name)
        if not keep:
            self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, before: int = 0) -> None:
        """Remove the tables made so far, but the last ``before`` ones."""
        gone = self.paths[: len(self.paths) - before]
        self.paths = self.paths[len(self.paths) - before :]
        for path in gone:
            remove(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def size_of(df: DataFrame) -> int:
    """About the bytes of a table: for files the planner's estimate, which is their sizes; what it knows nothing of, as
    rows that were never in a file, is measured by its texts."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 60:
        return estimate
    texts = [F.sum(F.octet_length(F.col(f"`{c}`"))) for c, kind in df.dtypes if kind in ("string", "binary")]
    found = df.agg(F.count(F.lit(1)), *texts).first()
    return 16 * found[0] + sum(x or 0 for x in found[1:])
