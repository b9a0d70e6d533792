"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shared folder made where the session names none.
OWN: dict[str, str] = {}
#: The tables that are saved, with their sessions.
SAVED: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local session may go without one and gets a temporary folder; on a cluster each
    machine would write to its own disk and rows would be lost, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return OWN.setdefault("folder", tempfile.mkdtemp(prefix="cotejo-"))


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage.

    The files go when ``discarded`` is told so, or when the session's Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cotejo-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SAVED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cotejo_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes saved tables, which nothing that is still to run may read."""
    for df in tables:
        removed(SAVED.pop(df._cotejo_path), df._cotejo_path)


@atexit.register
def all_removed() -> None:
    for path, spark in SAVED.items():
        removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def slices(batch, text: int = 0, rows: int = 256, size: int = 8 << 20):
    """Parts of an Arrow batch, to bound what a task holds at once: of at most so many rows, and bytes in the column of texts.

    A longer text is a part of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at, before = 0, 0
    while at < batch.num_rows:
        end = min(at + rows, batch.num_rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])
