"""Queries over files that are made of the tables first: catalogues, translations and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import order, rollup
from ..sources import catalogue, library, sinks
from ..stores import scratch, stored
from .registry import query, read

def attribute(name: str, value: Column) -> Column:
    """An XML attribute with a space before it; null is none."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), sinks.quoted(value), F.lit('"')), F.lit(""))


#: Tracks of one file, which has a catalogue for each orchestra and source, and translations of one, about.
TRACKS = 5000


@query(
    """SELECT p_brand || ' & "co"' AS orchestra, CASE WHEN p_partkey % 2 = 0 THEN 'made' ELSE '' END AS source, p_name || ' | ' || p_type AS name, p_type AS vocal, CASE WHEN p_size % 3 = 0 THEN '?' ELSE '1955-06-30' END AS year, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Arr. en Vals' END AS genre,
'' AS composer, CAST(p_partkey AS VARCHAR) AS author, '' AS label, '2:59' AS duration, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS INTEGER) AS popularity FROM part"""
)
def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as catalogue files, some without a genre or with a popularity that is no number, and read again."""
    size = F.col("p_size")
    track = F.concat(
        F.lit("<track"), attribute("name", F.concat_ws(" | ", "p_name", "p_type")), attribute("vocal", F.col("p_type")), attribute("year", F.when(size % 3 == 0, "?").otherwise("1955-06-30")), attribute("genre", F.when(size % 4 != 0, "Arr. en Vals")),
        attribute("author", F.col("p_partkey").cast("string")), attribute("duration", F.lit("2:59")), attribute("popularity", F.when(size % 5 == 0, "x").otherwise(size.cast("string"))), F.lit("/>"),
    )
    rows = read(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_partkey") % 2).alias("odd"), F.floor(F.col("p_partkey") / TRACKS).alias("part")).agg(F.array_join(F.collect_list(track), "\n").alias("tracks"))
    opening = F.concat(F.lit("<discography"), attribute("orchestra", F.concat("p_brand", F.lit(' & "co"'))), attribute("source", F.when(F.col("odd") == 0, "made")), F.lit(">"))
    path = scratch(spark)
    # Catalogues go many to a file: opening a file takes longer than reading hundreds of tracks.
    made = rows.select("part", F.concat(opening, "tracks", F.lit("</discography>")).alias("made"))
    files = made.groupBy("part").agg(F.concat(F.lit("<catalogues>"), F.array_join(F.collect_list("made"), "\n"), F.lit("</catalogues>")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return catalogue.tracks(spark, path).orderBy(*catalogue.in_catalogue_order()).drop("file", "pos")


@query(
    """SELECT conv_id, turn, role || ' <1>' AS name, CASE WHEN turn % 2 = 0 THEN '' ELSE 'spa' END AS language, CASE WHEN turn % 3 = 0 THEN 'T' WHEN turn % 3 = 1 THEN 'A' ELSE '' END AS translator, chr(10) || '  ' || text || chr(10) AS contents FROM conversations"""
)
def translation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as translations, with the author in the translator's place or neither, and read again."""
    turn = F.col("turn")
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    opening = F.concat(
        F.lit("<translation"), attribute("lang", F.when(turn % 2 != 0, "spa")), attribute("name", F.concat("role", F.lit(" <1>"))), attribute("source", F.col("conv_id").cast("string")), attribute("year", turn.cast("string")),
        attribute("translator", F.when(turn % 3 == 0, "T")), attribute("author", F.when(turn % 3 < 2, "A")), F.lit(">"),
    )
    path, turns = scratch(spark), read(spark, sf_dir, "conversations")
    made = turns.select(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(turns.count() // TRACKS + 1)).alias("at"), F.concat(opening, F.lit("\n  "), escaped(F.col("text")), F.lit("\n</translation>")).alias("made"))
    made.groupBy("at").agg(F.concat(F.lit("<lyrics>"), F.array_join(F.collect_list("made"), ""), F.lit("</lyrics>")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return catalogue.translations(spark, path).select(F.col("source").cast("long").alias("conv_id"), F.col("year").cast("long").alias("turn"), "name", "language", "translator", "contents")


@query("SELECT r_name AS folder, 1 AS files, lower(r_name) AS normalized FROM region")
def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each region with one file, as a library: folders, how many files, and the folders' names in their normal form."""
    path = scratch(spark)
    read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("text")).repartition(1).write.partitionBy("name").text(path)
    folder = F.regexp_extract("relative_path", "^name=([^/]*)/", 1)
    index = library.indexed(spark, path).where("length > 0").withColumn("folder", folder).where("folder <> ''")
    return index.groupBy("folder").agg(F.count("*").cast("int").alias("files"), F.first(T.simplify_full(F.col("folder"))).alias("normalized"))


#: Parts whose names are the content of one file.
NAMES = 50


@query(
    f"""SELECT 'Partes ' || n || CASE WHEN n % 2 = 0 THEN '.xml' ELSE '.XML' END AS file, row_number() OVER (ORDER BY n) AS place, content
FROM (SELECT p_partkey // {NAMES} AS n, string_agg(p_name, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY n)"""
)
def replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts' names, put in the place of shorter ones, as the folder lists them: by name, with 9 before 10, and without what is no XML."""
    folder = scratch(spark)
    n = F.floor(F.col("p_partkey") / NAMES).alias("n")
    groups = read(spark, sf_dir, "part").groupBy(n).agg(F.array_join(rollup.in_order(F.col("p_name"), F.col("p_partkey")), "\n").alias("content"))
    name = F.concat(F.lit("Partes "), F.col("n").cast("string"), F.when(F.col("n") % 2 == 0, ".xml").otherwise(".XML"))
    files = groups.select(F.concat(F.lit(f"{folder}/"), name).alias("path"), F.col("content"))
    files.select("content").write.text(folder)
    for content in (F.substring("content", 1, 5), F.col("content")):
        stored(sinks.replace_files(files.select("path", F.encode(content, "UTF-8").alias("content"))))
    found = library.lyrics_files(spark, folder).select("file", "path")
    texts = spark.read.format("binaryFile").load(folder).select("path", F.decode("content", "UTF-8").alias("content"))
    keyed = found.withColumn("key", T.natural_order(F.col("file")))
    return order.placed(keyed, F.col("key"), F.col("file")).join(texts, "path").select("file", "place", "content")
