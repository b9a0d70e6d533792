"""Exports, and plans of what is to be renamed, copied or written."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T
from ..operators.match import first_of

#: Settings that hold where nothing else is said.
SETTINGS = {"add_minuses": "true", "overwrite": "false", "allow_fuzzy": "false", "spanish_only": "false", "title_template": "%tit%", "include_alternatives": "false", "force_replace": "false"}


def setting(spark: SparkSession, name: str) -> str:
    """A setting of the session (cotejo.<name>), or its default."""
    return spark.conf.get(f"cotejo.{name}", SETTINGS[name])


def quoted(c: Column) -> Column:
    """A text as the value of an XML attribute."""
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        c = F.replace(c, F.lit(mark), F.lit(f"&{name};"))
    return c


def tempo_lines(files: DataFrame) -> DataFrame:
    """(orchestra, n, line): the lines of each orchestra's tempo export as XML, in order by n and then by what follows it.

    files: orchestra, track_pos, file_pos, file, bpm.  An orchestra without any file to list has the empty element.
    """
    names = files.select("orchestra").distinct()
    mark = lambda track, n, line: [F.lit(track).cast("long").alias("track"), F.lit(n).cast("long").alias("n"), line.alias("line")]
    first = names.select("orchestra", *mark(-1, 0, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<bpm orchestra="'), quoted(F.col("orchestra")), F.lit('">'))))
    last = names.select("orchestra", *mark((1 << 62), 0, F.lit("</bpm>")))
    line = F.concat(F.lit('    <file name="'), quoted(F.col("file")), F.lit('" bpm="'), quoted(F.col("bpm")), F.lit('"/>'))
    rows = files.where("bpm <> '' and not contains(bpm, '.')").select("orchestra", F.col("track_pos").cast("long").alias("track"), (-F.col("file_pos")).cast("long").alias("n"), line.alias("line"))
    return first.unionAll(rows).unionAll(last)


def tempo_documents(files: DataFrame) -> DataFrame:
    """(orchestra, xml): one document for each orchestra; an orchestra's catalogue is one small file."""
    rows = tempo_lines(files).groupBy("orchestra").agg(F.array_sort(F.collect_list(F.struct("track", "n", "line"))).alias("rows"))
    return rows.select("orchestra", F.array_join(F.col("rows.line"), "\n").alias("xml"))


def write_tempo(files: DataFrame, path: str) -> None:
    """Each orchestra's tempo export as a file of its own below path, in a folder that is named after it."""
    tempo_documents(files).write.partitionBy("orchestra").mode("overwrite").text(path)


def pages(translations: DataFrame) -> DataFrame:
    """(file, html) of documents whose first title no earlier document has; the first translation has a larger heading.

    translations: file, pos, name, contents.
    """
    heading = F.when(F.col("pos") == 0, "h3").otherwise("h4")
    part = F.concat(F.lit("<"), heading, F.lit(">"), "name", F.lit("</"), heading, F.lit("><p>"), T.paragraphs(F.col("contents")), F.lit("</p>"))
    whole = translations.groupBy("file").agg(F.min_by("name", "pos").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda r: r["part"]), "\n").alias("html"))
    return first_of(whole, F.col("title"), ["file"]).select("file", "html")


def write_pages(translations: DataFrame, path: str) -> None:
    pages(translations).orderBy("file").select("html").write.mode("overwrite").text(path)


def name_lines(names: Column, order: Column) -> Column:
    """Aggregate: one name without accents, or several with a line end behind each."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, names.alias("name")))), lambda r: r["name"])
    return F.when(F.size(rows) > 1, F.concat(F.array_join(rows, "\n"), F.lit("\n"))).otherwise(T.deaccent(F.get(rows, F.lit(0))))


def renames(files: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(old, new, allowed): files whose name changes; not allowed is a name that two get, or that another file has."""
    wanted = files.select(F.col(old).alias("old"), F.col(new).alias("new"))
    twice = wanted.groupBy("new").agg((F.count("*") > 1).alias("twice"))
    taken = wanted.where("old = new").select(F.col("new").alias("kept"))
    rows = wanted.where("old <> new").join(twice, "new").join(taken, F.col("new") == F.col("kept"), "left")
    return rows.select("old", "new", (~F.col("twice") & F.col("kept").isNull()).alias("allowed"))


def copies(sources: DataFrame, targets: DataFrame, force: bool = False, alternatives: bool = False) -> DataFrame:
    """Sources (file, name, modified, alternative) whose copy must be made again; target is the copy's name.

    targets: name and modified of the copies there are.
    """
    rows = sources.where(F.lit(alternatives) | ~F.col("alternative")).withColumn("target", T.copy_name(F.col("name")))
    there = targets.select(F.col("name").alias("target"), F.col("modified").alias("made"))
    return rows.join(there, "target", "left").where(F.lit(force) | numbers.stale(F.col("modified"), F.col("made"))).drop("made")


def written_once(old: Column, new: Column) -> Column:
    """A value that is written only where there is none."""
    return F.coalesce(old, new)


def changed(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose value differs from what is there."""
    return rows.where(~F.col(old).eqNullSafe(F.col(new)))


def replace_files(written: DataFrame) -> DataFrame:
    """(path, outcome): each row's content put in the place of the file at its path, all of it or nothing.

    A task that runs again writes the same content; paths must be reachable by all
    executors, and each must stand in one row.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                at, beside = path.removeprefix("file:"), None
                try:
                    handle, beside = tempfile.mkstemp(dir=os.path.dirname(at))
                    with os.fdopen(handle, "wb") as f:
                        f.write(content)
                    os.replace(beside, at)
                    out.append("written")
                except OSError as e:
                    if beside:
                        os.unlink(beside)
                    out.append(f"failed: {e.strerror}")
            yield pd.DataFrame({"path": batch["path"], "outcome": out})

    return written.where("content is not null").select("path", "content").mapInPandas(run, "path string, outcome string")


def send_batches(stream: DataFrame, send, checkpoint: str):
    """A streaming query that hands each micro-batch's rows to send(rows, batch id).

    A batch that was sent has a mark in the checkpoint's folder, so one that is replayed
    after a restart is left out.  A run that ends between sending and marking sends again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/sent/{batch_id}")
        files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(mark):
            send(batch, batch_id)
            files.create(mark, True).close()

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).start()


def keep_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Stores a batch of results below path, under its number: a batch that is replayed takes its own place again."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def keep_results(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that stores all results as they come, whatever the order of their generations; it ends with the files there are."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.foreachBatch(lambda batch, batch_id: keep_batch(batch, batch_id, path)).start()


def newest_results(spark: SparkSession, path: str, key: str, generation: str) -> DataFrame:
    """The stored results of each key's newest generation; older ones that came in later change nothing."""
    rows = spark.read.parquet(path).drop("batch")
    newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max(generation).alias("_newest"))
    return rows.join(newest, F.col(key).eqNullSafe(F.col("_key")) & (F.col(generation) == F.col("_newest"))).drop("_key", "_newest")
