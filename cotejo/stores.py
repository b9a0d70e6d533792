"""Tables and files that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What is still there, with the session that wrote it.
MADE: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names; only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(named or tempfile.mkdtemp(prefix='cotejo-')).rstrip('/')}/files-{uuid.uuid4().hex}"
    MADE[path] = spark
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so it is worked out once and lost executors don't matter."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cotejo_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables, which nothing that is still to run may read."""
    for df in tables:
        deleted(MADE.pop(df._cotejo_path), df._cotejo_path)


def deleted(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def all_deleted() -> None:
    for path, spark in MADE.items():
        deleted(spark, path)
