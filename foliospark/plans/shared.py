"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode (tests) a folder is made where that is unset; on a cluster, whose machines would each
    write to their own, that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed (a checkout, tests). A cluster ships it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


#: Rows of an Arrow batch on its way to Python, unless the session has its own number. Documents are long: at Spark's default of
#: 10,000 rows, a task's batches take hundreds of megabytes outside the heap.
BATCH_ROWS = 1000


def for_long_rows(spark: SparkSession) -> None:
    """Make sure that workers can import this package and get batches of long rows in small pieces."""
    ensure_importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


#: Bytes of a table, as Spark estimates them, that a partition gets.
PART_BYTES = 1 << 24


def dealt(df: DataFrame, like: DataFrame, *by: str) -> DataFrame:
    """df by the columns `by`, in more partitions than the session has if the table `like` is so large that these would be sorted on disk."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-size // PART_BYTES)
    return df.repartition(n, *by) if session < n < 1 << 16 else df  # of what isn't a file Spark knows no size
