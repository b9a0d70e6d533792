"""The job that writes every document's translations to the files that match it, from titles to its report, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..stores import stored
from . import match, rollup


def listed(documents: DataFrame) -> DataFrame:
    """Documents (doc, title) with a title whose bare, normal form no document before has."""
    stem = T.simplify_full(T.bare_title(F.col("title")))
    return match.first_of(documents.select("doc", "title"), stem, ["doc"]).select("doc", "title")


def targets(documents: DataFrame, files: DataFrame, always: bool = False, allow_fuzzy: bool = True, part: str = "") -> DataFrame:
    """(doc, path, distance): a row for each file that a document's translations go to.

    documents: doc and title; files: path and name, without its folder and its format; part:
    what paths must hold.  Equal names and titles are matched once.
    """
    chosen = holding(files, part)
    return named(documents, chosen, always, allow_fuzzy).join(chosen.select("path", "name"), "name").select("doc", "path", "name", "distance")


def holding(files: DataFrame, part: str) -> DataFrame:
    return files.where(rollup.holds(F.col("path").cast("string"), part)) if part else files


def named(documents: DataFrame, files: DataFrame, always: bool = False, allow_fuzzy: bool = True) -> DataFrame:
    """(doc, name, distance): the different names of files that match a document, however many files have each."""
    found = match.tiered(files.select("name"), documents.select("title"), always, allow_fuzzy)
    return found.join(documents, "title").select("doc", "name", "distance")


def counted(matches: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, targets): how many files each document's translations go to; files are counted by name and not listed.

    matches: doc and name, each pair once.
    """
    own = files.groupBy("name").agg(F.count("*").alias("_files"))
    return matches.select("doc", "name").join(own, "name").groupBy("doc").agg(F.sum("_files").alias("targets"))


def contents(translations: DataFrame, wanted: str = "spa") -> DataFrame:
    """(doc, value): what is written for each document that has a translation in the wanted language.

    translations: doc, pos, language, text.
    """
    own = translations.where(rollup.in_language(F.col("language"), wanted))
    return own.groupBy("doc").agg(F.array_join(rollup.in_order(F.col("text"), F.col("pos")), "\n\n").alias("value"))


def outcomes(rows: DataFrame, overwrite: bool) -> DataFrame:
    """rows with outcome: what becomes of each document's value at each path, documents in order.

    rows: doc, path, value, old (what the file had before the job).  A document meets what
    those before it have left: without overwriting the first value that came, with it the
    value of the one before, equal or written.
    """
    turn = Window.partitionBy("path").orderBy("doc")
    before = F.lag("value").over(turn)
    first = F.first("value").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    met = F.when(before.isNull(), F.col("old")).otherwise(before if overwrite else F.coalesce("old", first))
    return rows.withColumn("outcome", rollup.upsert(met, F.col("value"), F.lit(overwrite)))


def same(value: Column) -> Column:
    """What stands for a text where texts are only compared: 16 bytes of its hash, or null."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def reports(documents: DataFrame, files: DataFrame, translations: DataFrame, tags: DataFrame, wanted: str = "spa", prefix: str = "Lyrics", part: str = "", **how) -> dict[bool, DataFrame]:
    """By whether values are overwritten the job's report (``written``); titles and names are matched once for both.

    A document's texts are put together once, and only if it has a job; what goes on to
    files are their hashes.
    """
    chosen = holding(files, part)
    matches = stored(named(listed(documents), chosen, **how).select("doc", "name"))
    jobs = counted(matches, chosen)
    texts = translations.join(matches.select("doc").distinct(), "doc", "left_semi")
    values = contents(texts, wanted).select("doc", same(F.col("value")).alias("value"))
    with_values = stored(jobs.join(values, "doc", "left"))
    totals = with_values.agg(F.count("*").alias("jobs"), F.coalesce(F.sum("targets"), F.lit(0)).alias("targets"), F.count_if(F.col("value").isNull()).alias("without"))
    aims = matches.join(with_values.where("value is not null").select("doc", "value"), "doc").join(chosen.select("path", "name"), "name").select("doc", "path", "value")
    rows = aims.join(tags.select("path", same(F.col("old")).alias("old")), "path", "left")
    # Nothing fails here, so no order is needed to find the first failure.
    none = F.lit(None).cast("string").alias("message")
    made = {}
    for overwrite in (True, False):
        report = rollup.write_report(outcomes(rows, overwrite).select("outcome", none, F.lit(0).alias("pos")))
        # Both sides are one row.
        made[overwrite] = totals.join(F.broadcast(report)).withColumn("line", rollup.summary_line(prefix)).drop("first_failure")
    return made


def written(documents: DataFrame, files: DataFrame, translations: DataFrame, tags: DataFrame, overwrite: bool = False, wanted: str = "spa", prefix: str = "Lyrics", **how) -> DataFrame:
    """One row: jobs, targets, without (documents without a translation in the wanted language), the outcomes' numbers, and the line that is shown.

    documents: doc, title; files: path, name; translations: doc, pos, language, text; tags:
    path and old, the values that files have.  how: always, allow_fuzzy, part (``targets``).
    Documents without a matching file have no job.
    """
    return reports(documents, files, translations, tags, wanted, prefix, **how)[overwrite]
