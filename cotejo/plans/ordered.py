"""Queries in one order over all rows, and over streams in the order of event time, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff
from ..functions import text as T
from ..operators import order
from ..sources import messages, sinks
from ..stores import deleted, scratch
from ..streaming import ordered, sessions, tempo
from .more import MESSAGE, message_rows
from .registry import PAIRS, SQL, TAPS, event_code, passage_pairs, query, read, sql_digits

# One order over all rows.


@query(f"""{PAIRS}, m AS (SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = d.doc_id) THEN doc_id END AS hit FROM d)
SELECT doc_id, min(hit) OVER (ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m""")
def next_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the next one behind it that holds a passage."""
    return order.next_matches(read(spark, sf_dir, "documents").select("doc_id"), passage_pairs(spark, sf_dir), "doc_id", "doc_id")


@query(
    f"""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY k, l_orderkey, l_linenumber) AS place
FROM (SELECT *, 'track ' || {sql_digits('CAST(l_linenumber AS VARCHAR)')} || ' no ' || {sql_digits('CAST(l_partkey AS VARCHAR)')} AS k FROM lineitem)"""
)
def natural_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every line in the natural order of names, which begin with one of seven numbers."""
    name = F.concat(F.lit("Track "), F.col("l_linenumber").cast("string"), F.lit(" no "), F.col("l_partkey").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.natural_key(name).alias("key"))
    found = order.placed(rows, F.col("key"), F.col("l_orderkey"), F.col("l_linenumber"))
    return found.select("l_orderkey", "l_linenumber", "place")


KEY = f"array_to_string(list_transform(regexp_extract_all(lower(text), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN {sql_digits('t')} ELSE t END), '')"


@query(f"SELECT conv_id, turn, row_number() OVER (ORDER BY k COLLATE fr, conv_id, turn) AS place FROM (SELECT *, {KEY} AS k FROM conversations)")
def locale_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every turn among all by its text, in natural order as a locale has it: accented letters stand with plain ones."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.natural_order(F.col("text")).alias("key"))
    return order.placed(rows, F.col("key"), F.col("conv_id"), F.col("turn")).select("conv_id", "turn", "place")


@query("SELECT event_id, user_id, lag(event_id) OVER (ORDER BY ts, event_id) AS before_event_id, lag(user_id) OVER (ORDER BY ts, event_id) AS before_user_id FROM events")
def events_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event the one before it, whoever's that was."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return order.with_previous(rows, ["event_id", "user_id"], F.col("ts"), F.col("event_id")).drop("ts")


#: Characters at the beginning of a text that its versions share.
BEGINNING = 40


@query()
def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the one before it that begins alike, word by word over the whole texts.

    Only ids and beginnings are put in order; texts meet in joins on the id.
    """
    docs = read(spark, sf_dir, "documents").where("text is not null")
    beginnings = docs.select("doc_id", F.lower(F.substring("text", 1, BEGINNING)).alias("beginning"))
    pairs = order.with_previous(beginnings, ["doc_id", "beginning"], F.col("beginning"), F.col("doc_id")).where("beginning = before_beginning")
    texts = docs.select("doc_id", "text")
    both = pairs.select("doc_id", "before_doc_id").join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("before_doc_id"), F.col("text").alias("old")), "before_doc_id")
    return both.select("doc_id", "before_doc_id", diff.word_diff(F.col("old"), F.col("text")).alias("marked"))


@query(SQL["genre_history"].replace("FROM events", "FROM (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)"))
def history_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What genre_history gives where one user has half of all events."""
    hot = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).alias("user_id")
    events = read(spark, sf_dir, "events").select(hot, "event_id", "ts", "event_type")
    rows = sessions.histories_in_ranges(events, "user_id", ["ts", "event_id"], event_code())
    return rows.where("code <> ''").select("user_id", "event_id", sessions.shown(F.col("history")).alias("sessions"))


#: One user has half of all events.
HOT = "(SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)"


def hot_user() -> Column:
    return F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).cast("long")


@query(SQL["session_leads"].replace("FROM events", f"FROM {HOT}"))
def leads_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What session_leads gives where one user has half of all events."""
    events = read(spark, sf_dir, "events").select(hot_user().alias("user_id"), "event_id", "ts", "event_type")
    rows = sessions.histories_in_ranges(events, "user_id", ["ts", "event_id"], event_code())
    return rows.select("user_id", "event_id", sessions.previous(F.col("history"), 0).alias("now"), sessions.previous(F.col("history"), 1).alias("before"))


@query(SQL["valid_messages"].replace("FROM events", f"FROM {HOT}"))
def repeats_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What valid_messages gives where one user has half of all events."""
    rows = message_rows(spark, sf_dir).withColumn("user_id", hot_user())
    return sessions.valid(sessions.without_repeats_in_ranges(rows, "user_id", ["ts", "event_id"])).select("event_id", "user_id")


# Streams.  Events come up to a day late and in several arrivals, each a run that goes on from the checkpoint of the one before.

DELAY, ARRIVALS = timedelta(days=1), 3


def arrived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events with arrival, the number of the run that they come in, and the row that ends their stream."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), event_code().alias("code"))
    seconds = F.unix_micros("ts") / 1e6
    late = F.pmod(F.xxhash64("event_id"), F.lit(int(DELAY.total_seconds())))
    ends = events.agg(F.min(seconds).alias("_first"), (F.max(seconds) + DELAY.total_seconds() + 1).alias("_last"))
    share = (seconds + late - F.col("_first")) / (F.col("_last") - F.col("_first"))
    given = events.join(F.broadcast(ends)).withColumn("arrival", F.floor(share * ARRIVALS)).drop("_first", "_last")
    return given, ordered.closing(events, "ts", DELAY)


def streamed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream over the arrivals of all events has written when its source ends."""
    own = ordered.with_rocksdb(spark)
    source, checkpoint, out = (scratch(own) for _ in range(3))
    events, end = arrived(own, sf_dir)
    schema = end.schema
    for i in [*range(ARRIVALS), None]:
        rows = end if i is None else events.where(F.col("arrival") == i).select(*schema.names)
        rows.write.mode("append").parquet(source)
        stream = make(own.readStream.schema(schema).parquet(source))
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(SQL["tap_tempo"])
def tempo_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tap_tempo gives, from a stream whose taps come out of order."""
    rows = streamed(spark, sf_dir, lambda s: tempo.tempo_stream(s, "1 day", "user_id", "ts", "event_id", TAPS))
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("taps", "total_bpm", "last_bpm", "resets"), "n").alias("last"))
    return last.select("user_id", "last.*")


@query(SQL["genre_history"])
def history_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What genre_history gives, from a stream whose events come out of order."""
    return streamed(spark, sf_dir, lambda s: sessions.history_stream(s, "1 day", "user_id", "ts", "event_id", "code"))


@query(SQL["current_results"])
def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What current_results gives, from a stored table that a stream of results fills in any order, one batch of it twice."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 5).alias("generation"))
    source, checkpoint, out = (scratch(spark) for _ in range(3))
    for i in range(ARRIVALS):
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS)) == i)
        part.write.mode("append").parquet(source)
        sinks.keep_results(spark.readStream.schema(events.schema).parquet(source), out, checkpoint).awaitTermination()
    sinks.keep_batch(part, ARRIVALS - 1, out)
    return sinks.newest_results(spark, out, "user_id", "generation").select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, {MESSAGE} AS text FROM events WHERE contains({MESSAGE}, '|')")
def sent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid messages as they came in at the other end of a stream that sends them framed; its last batch is replayed after a restart."""
    rows = message_rows(spark, sf_dir).select("event_id", "text")
    source, checkpoint, out = (scratch(spark) for _ in range(3))

    def send(batch: DataFrame, batch_id: int) -> None:
        framed = messages.framed(F.col("event_id").cast("string"), F.col("text"))
        sessions.valid(batch).select(framed.alias("frame")).write.mode("append").parquet(out)

    def run() -> None:
        stream = sinks.send_batches(spark.readStream.schema(rows.schema).parquet(source), send, checkpoint)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    for i in range(ARRIVALS):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS)) == i).write.mode("append").parquet(source)
        run()
    # As after a run that ended before its last batch was committed.
    deleted(spark, f"{checkpoint}/commits/{ARRIVALS - 1}")
    run()
    texts = messages.unframed(F.col("frame"), ["id", "text"])
    return spark.read.schema("frame binary").parquet(out).select(texts["id"].cast("long").alias("event_id"), texts["text"].alias("text"))
