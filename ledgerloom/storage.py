"""Scratch tables in the folder the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether a query's shuffle files are deleted when it ends (Spark 4).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows of a table for each task of a shuffle that grows with it, and such tasks at most.
TASK_ROWS, MOST_TASKS = 500_000, 20_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all runs in one process, as in tests, one of our own.

    On a cluster executors and driver share no local folder, so there the setting must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_ledgerloom_scratch", None)
        if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not root:
            root = tempfile.mkdtemp(prefix="ledgerloom-")
            spark._ledgerloom_scratch = root
            atexit.register(shutil.rmtree, root, True)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def tasks_for_rows(spark: SparkSession, n_rows: int) -> int:
    """Partitions of a shuffle so that each gets about TASK_ROWS rows, at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-n_rows // TASK_ROWS)))


def saved(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared scratch folder and read it back.

    The shuffle files of the write go at its end, not when the driver happens to collect its memory. tasks: partitions of
    its shuffles, if not the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    wanted = {CLEANUP: "true"} | ({PARTITIONS: str(tasks)} if tasks else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
