"""Summaries, display columns and status rules over matched rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T

#: Flags of a row's status.
NO_GENRE, TIME, FUZZY, RENAME, RETAG = "NOGENREINFILENAME ", "TIMEDIFF=%02d ", "FUZZY ", "REALLYNEEDSRENAME ", "NEEDSTAGWRITE "


def or_unknown(c: Column) -> Column:
    return F.when(c == "", "????").otherwise(c)


def display_name(orchestra: Column, vocal: Column, name: Column, year: Column, genre: Column) -> Column:
    return F.concat_ws(" - ", orchestra, vocal, name, or_unknown(year), or_unknown(genre))


def files_shown(exact: Column, fuzzy: Column) -> Column:
    """Exact matches, or else fuzzy ones, one a line."""
    return F.array_join(F.when(F.size(exact) > 0, exact).otherwise(fuzzy), "\n")


def popularity_shown(c: Column) -> Column:
    """Right-aligned to two characters; longer numbers whole."""
    shown = c.cast("string")
    return F.when(F.length(shown) >= 2, shown).otherwise(F.lpad(shown, 2, " "))


def any_column_has(columns: Iterable[str], part: str, collation: str | None = None) -> Column:
    """Whether any column holds a text, in any case or as a collation has it; null holds nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(holds(F.col(c).cast("string"), part, collation), F.lit(False)) for c in columns])


def holds(c: Column, part: str, collation: str | None = None) -> Column:
    """Whether a name or path has a part, in any case.

    Under a collation letters are alike as it has them: with UNICODE_CI composed and
    decomposed accents are one, with UNICODE_CI_AI accents make no difference.
    """
    if collation:
        return F.contains(F.collate(c, collation), F.collate(F.lit(part), collation))
    return F.contains(F.lower(c), F.lit(part.lower()))


def match_counts(matches: DataFrame) -> DataFrame:
    """One row: how many matches there are, and how many of them are near ones only."""
    return matches.agg(F.count("*").alias("total"), F.count_if(F.col("distance").isNotNull()).alias("fuzzy"))


def without_translation(documents: DataFrame, translations: DataFrame, key: str = "file", wanted: str = "spa") -> DataFrame:
    """One row: how many documents have no translation in the wanted language, and so nothing to write."""
    has = translations.where(in_language(F.col("language"), wanted)).select(key).distinct()
    return documents.join(has, key, "left_anti").agg(F.count("*").alias("without"))


def in_language(language: Column, wanted: str = "spa") -> Column:
    """Whether a language is the wanted one; none counts as it."""
    given = F.trim(F.coalesce(language, F.lit("")))
    return F.lower(F.when(given == "", wanted).otherwise(given)) == wanted


def primary_name(preferred: Column, name: Column, position: Column) -> Column:
    """Aggregate: the first preferred name, or else the first, or ''."""
    return F.coalesce(F.min_by(name, F.when(preferred, position)), F.min_by(name, position), F.lit(""))


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def relative_path(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root)), F.ltrim(F.substring(path, F.lit(len(root) + 1), F.length(path)), F.lit("/"))).otherwise(path)


def in_order(value: Column, *order: Column) -> Column:
    """Aggregate: values that are not null, by order."""
    rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("value"))))
    return F.filter(F.transform(rows, lambda r: r["value"]), lambda v: v.isNotNull())


def lines(value: Column, *order: Column) -> Column:
    """Aggregate: values that are not null, one a line, by order."""
    return F.array_join(in_order(value, *order), "\n")


def coverage(tracks: DataFrame, files: DataFrame, exact: DataFrame, fuzzy: DataFrame, track: str, file: str) -> DataFrame:
    """One row: unmatched files, fuzzily matched files, tracks with an exact match, tracks, and percent of tracks.

    The percentage adds exactly matched tracks and fuzzily matched files, as the summary it
    stands for does.
    """
    counts = (
        files.select(F.countDistinct(file).alias("files"))
        .join(exact.select(F.countDistinct(file).alias("taken"), F.countDistinct(track).alias("matched")))
        .join(fuzzy.select(F.countDistinct(file).alias("fuzzy")))
        .join(tracks.select(F.countDistinct(track).alias("total")))
    )
    return counts.select((F.col("files") - F.col("taken") - F.col("fuzzy")).alias("unmatched"), "fuzzy", "matched", "total", numbers.percent(F.col("matched") + F.col("fuzzy"), F.col("total")).alias("percent"))


def most_popular(c: Column) -> Column:
    return F.greatest(F.max(c), F.lit(0))


def largest_deviation(expected: Column, duration: Column) -> Column:
    """Aggregate: the largest difference in seconds between a duration and those of files; what is no duration differs by 0."""
    return F.max(F.coalesce(F.abs(numbers.seconds(duration) - numbers.seconds(expected)), F.lit(0)))


REMARK = r" \([a-z0-9 \-]+\)"


def status(name: Column, genre: Column, deviation: Column, exact: Column, fuzzy: Column, composer: Column, file_composers: Column) -> Column:
    """A row's flags, each with a space behind it.

    name: the display name; deviation: the largest one of the files' durations, 0 if none is
    expected, null if they were not read; exact and fuzzy: file names.
    """
    lacks = lambda files: F.exists(files, lambda f: ~F.contains(F.lower(f), F.lower(genre)))
    plain = lambda c: T.simplify(F.regexp_replace(c, REMARK, ""))
    rename = F.when(F.size(exact) > 0, plain(T.stem(F.get(exact, F.lit(0)))) != plain(name)).otherwise(False)
    retag = deviation.isNotNull() & ~F.startswith(F.coalesce(file_composers, F.lit("")), composer)
    flag = lambda test, text: F.when(test, text).otherwise("")
    return F.concat(
        flag(lacks(exact), NO_GENRE),
        flag(lacks(fuzzy), NO_GENRE),
        F.when(deviation >= 10, F.format_string(TIME, deviation)).otherwise(""),
        flag(F.size(fuzzy) > 0, FUZZY),
        flag(~lacks(exact) & rename, RENAME),
        flag(~lacks(exact) & retag, RETAG),
    )


def upsert(old: Column, new: Column, overwrite: Column) -> Column:
    """What becomes of a value that is to be written: unchanged if equal, skipped if another is there, or written."""
    return F.when(old.eqNullSafe(new), "unchanged").when(old.isNotNull() & ~overwrite, "skipped").otherwise("written")


def write_report(outcomes: DataFrame, outcome: str = "outcome", message: str = "message", order: str = "pos") -> DataFrame:
    """One row: how many were written, skipped (unsupported ones too), unchanged and failed, and the first failure's message."""
    o = F.col(outcome)
    return outcomes.agg(
        F.count_if(o == "written").alias("written"),
        F.count_if(o.isin("skipped", "unsupported")).alias("skipped"),
        F.count_if(o == "unchanged").alias("unchanged"),
        F.count_if(o == "failed").alias("failed"),
        F.min_by(F.when(o == "failed", F.col(message)), F.when(o == "failed", F.col(order))).alias("first_failure"),
    )


def report_line(prefix: str) -> Column:
    """A report's row as a sentence; counts of nothing are left out."""
    part = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    failed = F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" failed — "), F.col("first_failure")))
    written = F.concat(F.lit(f"{prefix}: "), F.col("written").cast("string"), F.lit(" written"))
    return F.concat(F.concat_ws(", ", written, part("skipped", " skipped (already tagged)"), part("unchanged", " unchanged"), failed), F.lit("."))


def summary_line(prefix: str) -> Column:
    """A job's row (report and without) as a sentence; a job that has nothing to write says why."""
    several = F.col("without").cast("string")
    part = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    failed = F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" failed — "), F.col("first_failure")))
    written = F.concat(F.lit(f"{prefix}: "), F.col("written").cast("string"), F.lit(" written"))
    done = F.concat_ws(", ", written, part("skipped", " skipped (already tagged)"), part("unchanged", " unchanged"), part("without", " titles have no Spanish lyrics"), failed)
    none = F.when(F.col("without") > 0, F.concat(F.lit(f"{prefix}: nothing to write — "), several, F.lit(" titles have no Spanish lyrics."))).otherwise(f"{prefix}: nothing to write.")
    return F.when(F.col("written") + F.col("skipped") + F.col("unchanged") + F.col("failed") > 0, F.concat(done, F.lit("."))).otherwise(none)


def targets(jobs: DataFrame, files: str = "targets") -> DataFrame:
    """One row: how many files all jobs together write, and null or 0 of them done as a fraction of 1."""
    return jobs.agg(F.coalesce(F.sum(F.size(files)), F.lit(0)).cast("long").alias("targets"))


def progress(done: Column, total: Column) -> Column:
    """The part that is done; null of nothing."""
    return F.try_divide(done.cast("double"), F.nullif(total, F.lit(0)))


def tag_fields(rows: DataFrame, key: str) -> DataFrame:
    """(key, field, value): what standard tags say of a track, without empty values.

    rows: name, remark, orchestra, vocal, genre, year, composer, author, label, old_album.
    """
    artist = F.when(F.col("orchestra") == "", F.col("vocal")).otherwise(F.concat_ws(" - ", "orchestra", "vocal"))
    fields = {
        "title": F.concat("name", "remark"),
        "artist": artist,
        "album_artist": F.col("orchestra"),
        "genre": T.capitalised(F.col("genre")),
        "year": numbers.year(F.col("year")).cast("string"),
        "composer": F.col("composer"),
        "lyricist": F.col("author"),
        "publisher": F.col("label"),
        "date": F.col("year"),
        "original_album": F.col("old_album"),
    }
    long = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()))
    return rows.select(key, F.inline(long)).where("value <> ''")
