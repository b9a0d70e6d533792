"""Queries for the kept index and for the job that writes all, and the same in SQL."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from ..sources import index
from ..stores import stored
from .registry import LITERAL, query, read, sql_bare, sql_segments, sql_simplify_full

# A library of parts, of which some are renamed and some removed after it was indexed.

NAMED: list[tuple[SparkSession, str]] = []


@atexit.register
def removed() -> None:
    for spark, name in NAMED:
        with contextlib.suppress(Exception):  # the session may have ended before
            index.dropped(spark, name, index.version(spark, name))


#: Parts that were ordered in the last days there are: their files have changed.
CHANGED = "SELECT l_partkey, max(o_orderdate) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 20 DAY"
NAME = "p_brand || ' - ' || p_name || ' ' || p_size"


@query(
    f"""WITH changed AS ({CHANGED}), library AS (SELECT p_partkey AS path, {NAME} || CASE WHEN day IS NULL THEN '' ELSE ' Última versión' END AS name FROM part LEFT JOIN changed ON l_partkey = p_partkey WHERE p_size <> 50),
titles AS (SELECT DISTINCT p_name || ' ' || p_size AS title FROM part UNION SELECT DISTINCT 'Versión' FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT title, path FROM titles JOIN library ON contains({sql_simplify_full('name')}, {sql_simplify_full('title')})"""
)
def index_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles matched with an index that was built over all parts and refreshed by orders: the same as from scratch."""
    parts, orders, lines = (read(spark, sf_dir, t) for t in ("part", "orders", "lineitem"))
    name = F.concat_ws(" ", F.concat_ws(" - ", "p_brand", "p_name"), F.col("p_size").cast("string"))
    since = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 20 DAY")).alias("since"))
    # A part's last day is among the last days there are, or is not asked for.
    last = stored(orders.join(F.broadcast(since)).where("o_orderdate >= since").select("o_orderkey", "o_orderdate"))
    changed = lines.join(last, lines["l_orderkey"] == last["o_orderkey"]).groupBy(F.col("l_partkey").alias("path")).agg(F.max("o_orderdate").alias("day"))
    first = parts.select(F.col("p_partkey").alias("path"), F.lit(None).cast("timestamp_ntz").alias("modified"), F.concat(name, F.lit(".mp3")).alias("name"))
    own = f"library_{uuid.uuid4().hex[:12]}"
    NAMED.append((spark, own))
    index.built(spark, own, first)
    now = parts.where("p_size <> 50").select(F.col("p_partkey").alias("path")).join(changed, "path", "left").select("path", F.col("day").cast("timestamp_ntz").alias("modified"))
    names = first.select("path", F.concat(F.expr("substr(name, 1, length(name) - 4)"), F.lit(" Última versión.mp3")).alias("name"))
    index.refreshed(spark, own, now, lambda rows: rows.join(names, "path"))
    titles = parts.select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("title")).union(parts.select(F.lit("Versión"))).union(parts.select("p_brand"))
    return index.matches(spark, own, titles)


# Parts as documents whose titles have marks, and as files; conversations as their translations.

TITLE = "CASE p_partkey % 4 WHEN 0 THEN '- ' || p_name || ' ' || p_size WHEN 1 THEN p_name || ' ' || p_size || ' -' WHEN 2 THEN '- ' || p_name || ' ' || p_size || '__ -' ELSE p_name || ' ' || p_size || '_' END"
BARE = sql_simplify_full(sql_bare("title"))
AIMS = f"""WITH texts AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS value FROM conversations WHERE lower(trim(role)) = 'assistant' GROUP BY conv_id),
docs AS (SELECT doc, title, bare FROM (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY doc) AS k FROM (SELECT doc, title, {BARE} AS bare FROM (SELECT p_partkey AS doc, {TITLE} AS title FROM part))) WHERE k = 1),
plans AS (SELECT *, starts_with(title, '- ') AS s, ends_with(title, ' -') AS e FROM docs WHERE bare <> ''),
files AS (SELECT p_partkey AS path, {NAME} AS name FROM part),
n AS MATERIALIZED (SELECT DISTINCT name, {sql_simplify_full('name')} AS f FROM files),
held AS MATERIALIZED (SELECT name, f, doc, bare, s, e FROM n JOIN plans ON contains(n.f, bare)),
literal AS (SELECT name, doc FROM held n WHERE {LITERAL}),
parts AS MATERIALIZED (SELECT DISTINCT name, unnest({sql_segments('n.f')}) AS part FROM n),
pairs AS MATERIALIZED (SELECT part, doc, bare FROM (SELECT DISTINCT part FROM parts) JOIN plans ON 5 * abs(length(part) - length(bare)) < length(bare)),
near AS (SELECT DISTINCT name, doc FROM pairs JOIN parts USING (part) WHERE 5 * levenshtein(part, bare) < length(bare)),
aims AS MATERIALIZED (SELECT doc, path, t.value, CASE path % 3 WHEN 1 THEN o.value WHEN 2 THEN 'Old text' END AS old
  FROM (SELECT * FROM literal UNION SELECT * FROM near) JOIN files USING (name) LEFT JOIN texts t ON t.conv_id = doc % 128 LEFT JOIN texts o ON o.conv_id = path % 128)"""
JOB = f"""{AIMS},
turns AS (SELECT *, lag(value) OVER w AS before, first_value(value) OVER w AS first FROM aims WHERE value IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY doc)),
met AS (SELECT overwrite, value, CASE WHEN before IS NULL THEN old WHEN overwrite THEN before ELSE coalesce(old, first) END AS met FROM turns, (VALUES (true), (false)) AS o(overwrite)),
counts AS (SELECT overwrite, count(*) FILTER (met IS DISTINCT FROM value AND (met IS NULL OR overwrite)) AS written, count(*) FILTER (met IS DISTINCT FROM value AND met IS NOT NULL AND NOT overwrite) AS skipped,
  count(*) FILTER (met IS NOT DISTINCT FROM value) AS unchanged, CAST(0 AS BIGINT) AS failed FROM met GROUP BY overwrite)
SELECT counts.*, (SELECT count(DISTINCT doc) FROM aims) AS jobs, (SELECT count(*) FROM aims) AS targets, (SELECT count(DISTINCT doc) FROM aims WHERE value IS NULL) AS without,
'Lyrics: ' || written || ' written' || CASE WHEN skipped > 0 THEN ', ' || skipped || ' skipped (already tagged)' ELSE '' END || CASE WHEN unchanged > 0 THEN ', ' || unchanged || ' unchanged' ELSE '' END
  || CASE WHEN (SELECT count(DISTINCT doc) FROM aims WHERE value IS NULL) > 0 THEN ', ' || (SELECT count(DISTINCT doc) FROM aims WHERE value IS NULL) || ' titles have no Spanish lyrics' ELSE '' END || '.' AS line FROM counts"""


def documents_and_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part as a document with a marked title, and as a file."""
    k, plain = F.col("p_partkey"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    title = F.when(k % 4 == 0, F.concat(F.lit("- "), plain)).when(k % 4 == 1, F.concat(plain, F.lit(" -"))).when(k % 4 == 2, F.concat(F.lit("- "), plain, F.lit("__ -"))).otherwise(F.concat(plain, F.lit("_")))
    parts = read(spark, sf_dir, "part")
    return parts.select(k.alias("doc"), title.alias("title")), parts.select(k.alias("path"), F.concat_ws(" - ", "p_brand", plain).alias("name"))


@query(f"{AIMS} SELECT doc, title, count(*) AS targets FROM aims JOIN docs USING (doc) GROUP BY doc, title")
def write_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of writing all: documents whose title no earlier one has and that have any match, with the number of their files."""
    documents, files = documents_and_files(spark, sf_dir)
    listed = jobs.listed(documents)
    return jobs.counted(jobs.named(listed, files), files).join(listed, "doc").select("doc", "title", "targets")


@query(JOB)
def write_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of writing all documents' texts to all matching files, with and without overwriting.  The wanted language is a role."""
    parts, turns = read(spark, sf_dir, "part"), read(spark, sf_dir, "conversations")
    k, (documents, files) = F.col("p_partkey"), documents_and_files(spark, sf_dir)
    translations = turns.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("language"), "text")
    of = parts.select(k.alias("doc"), (k % 128).alias("conv_id")).join(translations, "conv_id")
    own = jobs.contents(translations.withColumnRenamed("conv_id", "doc"), "assistant").withColumnRenamed("doc", "conv_id")
    tags = files.select("path", (F.col("path") % 128).alias("conv_id")).join(own, "conv_id", "left").select("path", F.when(F.col("path") % 3 == 1, F.col("value")).when(F.col("path") % 3 == 2, "Old text").alias("old"))
    made = jobs.reports(documents, files, of, tags, "assistant")
    return made[True].withColumn("overwrite", F.lit(True)).unionByName(made[False].withColumn("overwrite", F.lit(False)))
