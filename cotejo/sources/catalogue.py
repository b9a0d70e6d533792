"""Catalogue and translation files in XML, each file one small document; it may hold several catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: A track's attributes.
TRACK = ("name", "vocal", "year", "genre", "composer", "author", "label", "duration", "popularity")


def fields(*names: str) -> t.StructType:
    return t.StructType([t.StructField(n, t.StringType()) for n in names])


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, orchestra, source, name, ... popularity) of the tracks of all catalogues under a path.

    An attribute that is missing is ''; a popularity that is no number is 0.  A catalogue
    that is not well-formed has no tracks.  pos counts a file's tracks from 0.
    """
    schema = t.StructType([*fields("_orchestra", "_source"), t.StructField("track", t.ArrayType(fields(*(f"_{n}" for n in TRACK))))])
    rows = (
        spark.read.format("xml").options(rowTag="discography", attributePrefix="_", mode="DROPMALFORMED").schema(schema).load(path)
        .select(F.col("_metadata.file_path").alias("file"), "_orchestra", "_source", F.posexplode("track").alias("pos", "t"))
    )
    text = [F.coalesce(f"t._{n}", F.lit("")).alias(n) for n in TRACK[:-1]]
    return rows.select("file", "pos", F.coalesce("_orchestra", F.lit("")).alias("orchestra"), F.coalesce("_source", F.lit("")).alias("source"), *text, F.coalesce(F.col("t._popularity").try_cast("int"), F.lit(0)).alias("popularity"))


def in_catalogue_order() -> list[Column]:
    """Longest names first, then longest singers; tracks of equal lengths as they stand in the file."""
    return [F.length("name").desc(), F.length("vocal").desc(), F.col("file"), F.col("pos")]


def translations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, pos, name, language, source, translator, year, contents) of all translations under a path.

    The author stands in for a missing translator.  strict: a file that is not well-formed
    raises an error; otherwise it has no translations.
    """
    attributes = ("_lang", "_name", "_source", "_translator", "_author", "_year")
    schema = t.StructType([t.StructField("translation", t.ArrayType(fields(*attributes, "contents")))])
    rows = (
        spark.read.format("xml").options(rowTag="lyrics", attributePrefix="_", valueTag="contents", ignoreSurroundingSpaces="false", mode="FAILFAST" if strict else "DROPMALFORMED").schema(schema).load(path)
        .select(F.col("_metadata.file_path").alias("file"), F.posexplode("translation").alias("pos", "t"))
    )
    or_empty = lambda *names: F.coalesce(*(F.col(f"t.{n}") for n in names), F.lit(""))
    return rows.select("file", "pos", or_empty("_name").alias("name"), or_empty("_lang").alias("language"), or_empty("_source").alias("source"), or_empty("_translator", "_author").alias("translator"), or_empty("_year").alias("year"), or_empty("contents").alias("contents"))
