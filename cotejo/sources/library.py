"""Listings of audio and lyrics files; contents are not read for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.rollup import relative_path


def listing(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, file, length, modified) of files under a folder; hidden ones are left out."""
    options = {"pathGlobFilter": glob, "recursiveFileLookup": str(recursive).lower()}
    return spark.read.format("binaryFile").options(**options).load(root).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "length", F.col("modificationTime").alias("modified"))


def indexed(spark: SparkSession, root: str) -> DataFrame:
    """The library: every file with its format (null: not taggable), relative path, base name and its normal form.

    Files in packages (folders with an extension of their own that hold one document) and
    below hidden folders are left out.
    """
    plain_root = root.split(":", 1)[-1].rstrip("/") if "://" not in root else root.rstrip("/")
    files = listing(spark, root)
    path = F.regexp_replace("path", "^file:/*", "/") if "://" not in root else F.col("path")
    rows = files.select("path", "file", "length", "modified", relative_path(path, plain_root).alias("relative_path"))
    rows = rows.where(~F.rlike("relative_path", F.lit(r"(^|/)\.|\.(app|bundle|band|logicx)/")))
    base = T.stem(F.col("file"))
    return rows.select("*", base.alias("base_name"), T.simplify_full(base).alias("normalized_base_name"), T.file_format(F.col("file")).alias("format"))


def taggable(index: DataFrame) -> DataFrame:
    """The library's files that tags can be written to, in natural order of their paths."""
    return index.where("format is not null").orderBy(T.natural_order(F.col("relative_path")), "relative_path")


def skipped(index: DataFrame) -> DataFrame:
    """One row: how many files were left out for their format."""
    return index.agg(F.count_if(F.col("format").isNull()).alias("skipped"))


def lyrics_files(spark: SparkSession, root: str) -> DataFrame:
    """The XML files of one folder in natural order."""
    rows = listing(spark, root, recursive=False).where(F.rlike("file", F.lit(r"(?i)\.xml$")))
    return rows.orderBy(T.natural_order(F.col("file")), "file")


def catalogue_file(spark: SparkSession, root: str) -> DataFrame:
    """One row: a folder's first catalogue by name."""
    return listing(spark, root, recursive=False).where(F.rlike("file", F.lit(r"(?i)\.xml$"))).agg(F.min("path").alias("path"))


def admitted(current: DataFrame, dropped: DataFrame, readable: DataFrame, append: bool) -> DataFrame:
    """The files to work on: the dropped ones that can be read, with the current ones before them if they are kept."""
    new = dropped.join(readable, "path", "left_semi")
    return current.unionByName(new) if append else new
