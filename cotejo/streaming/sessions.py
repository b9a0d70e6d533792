"""Now-playing messages: dropping repeats, a rolling history of dances, and the sessions between breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import order as ranges
from . import ordered

#: Codes that a history holds at most, bytes of a message that are remembered, and sessions that are shown.
HISTORY, REMEMBERED, SHOWN = 30, 249, 6


def without_repeats(messages: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """Messages that differ from the one before; a message longer than what is remembered always does."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(*order))
    repeated = before.eqNullSafe(F.col(text)) & (F.octet_length(text) <= REMEMBERED)
    return messages.withColumn("_repeated", repeated).where("not _repeated").drop("_repeated")


def without_repeats_in_ranges(messages: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """What ``without_repeats`` gives, for keys that may have any share of all messages: these are dealt into ranges by key and order.

    Of the message before each no more is carried than what is remembered.  A key's first message stays, even without a text.
    """
    short = F.when(F.octet_length(text) <= REMEMBERED, F.col(text))
    known = messages.withColumns({"_key": F.col(key), "_short": short, "_null": F.col(text).isNull()})
    rows = ranges.with_previous(known, ["_key", "_short", "_null"], F.col(key), *map(F.col, order))
    same_key = F.col("before__null").isNotNull() & F.col("_key").eqNullSafe(F.col("before__key"))
    repeated = same_key & F.coalesce(F.col("_short") == F.col("before__short"), F.col("_null") & F.col("before__null"))
    return rows.where(~repeated).drop("_key", "_short", "_null", "before__key", "before__short", "before__null")


def valid(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.where(F.contains(text, F.lit("|")))


def histories(events: DataFrame, key: str, order: list[str], code: Column) -> DataFrame:
    """events with history, the codes up to and with each, an array of HISTORY at most.

    '' is a break; breaks in a row are one, and before the first event stands one.  Events
    that only repeat a break have the history of the one before and are left out.
    """
    w = Window.partitionBy(key).orderBy(*order)
    kept = events.withColumn("code", code).withColumn("_before", F.coalesce(F.lag("code").over(w), F.lit(""))).where("code <> '' or _before <> ''")
    frame = w.rowsBetween(-(HISTORY - 1), 0)
    n = F.row_number().over(w)
    codes = F.collect_list("code").over(frame)
    return kept.withColumn("history", F.when(n < HISTORY, F.concat(F.array(F.lit("")), codes)).otherwise(codes)).drop("_before")


def histories_in_ranges(events: DataFrame, key: str, order: list[str], code: Column) -> DataFrame:
    """What ``histories`` gives, for keys that may have any share of all events.

    Events are dealt into ranges by key and order, so a hot key's lie in many tasks.  What a
    range must know of those before it is the last event's key and code, and the last codes
    of the key that goes on into it: HISTORY of them at most, one row for each range.
    """
    coded = events.withColumn("code", code)
    columns = [F.col(key), *map(F.col, order)]
    before = ranges.with_previous(coded, [key, "code"], *columns)
    same = F.col(key).eqNullSafe(F.col(f"before_{key}"))
    kept = before.where((F.col("code") != "") | F.coalesce(same & (F.col("before_code") != ""), F.lit(False))).drop(f"before_{key}", "before_code")
    dealt = ranges.ranged(kept, *columns)
    ends = dealt.groupBy("_range").agg(F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last")).select("_range", "first", "last")
    newest = Window.partitionBy("_range").orderBy(F.desc("_at"))
    tails = dealt.withColumn("_newest", F.row_number().over(newest)).where(F.col("_newest") <= HISTORY).groupBy("_range").agg(F.sort_array(F.collect_list(F.struct("_at", F.col(key).alias("key"), "code"))).alias("tail"))
    carried, codes, owner = {}, [], None
    for r in sorted(ends.join(tails, "_range").collect()):
        carried[r["_range"]] = codes if codes and r["first"] == owner else None
        own = [x["code"] for x in r["tail"] if x["key"] == r["last"]]
        codes = ((codes if r["first"] == r["last"] == owner else []) + own)[-HISTORY:]
        owner = r["last"]
    told = ranges.per_range(dealt, carried, "_carried array<string>")
    firsts = F.broadcast(ends.select("_range", F.col("first").alias("_first")))
    rows = dealt.join(told, "_range").join(firsts, "_range")
    local = F.collect_list("code").over(Window.partitionBy("_range", key).orderBy("_at").rowsBetween(-(HISTORY - 1), 0))
    goes_on = F.col("_carried").isNotNull() & F.col(key).eqNullSafe(F.col("_first"))
    every = F.concat(F.when(goes_on, F.col("_carried")).otherwise(F.array().cast("array<string>")), local)
    short = F.when(F.size(every) < HISTORY, F.concat(F.array(F.lit("")), every)).otherwise(F.slice(every, -HISTORY, HISTORY))
    return rows.withColumn("history", short).drop("_range", "_at", "_carried", "_first")


def session_starts(history: Column) -> Column:
    """The first code behind each break, oldest first; '' behind a break at the end."""
    after = F.transform(history, lambda x, i: F.when(x == "", F.coalesce(F.get(history, i + 1), F.lit(""))))
    return F.filter(after, lambda x: x.isNotNull())


def shown(history: Column) -> Column:
    """The first codes of the latest SHOWN sessions, oldest first."""
    starts = session_starts(history)
    return F.array_join(F.slice(starts, F.greatest(F.size(starts) - SHOWN + 1, F.lit(1)), F.lit(SHOWN)), "")


def previous(history: Column, skip: int) -> Column:
    """The first code of the session that began skip breaks ago, or ''."""
    starts = session_starts(history)
    return F.coalesce(F.get(starts, F.size(starts) - 1 - skip), F.lit(""))


def with_images(messages: DataFrame, images: DataFrame, artist: str = "artist") -> DataFrame:
    """messages with image: that of the artist without accents, or else the default one, or null."""
    wanted = messages.withColumn("_file", F.concat(T.fold_accents(F.col(artist)), F.lit(".jpg")))
    own = images.select(F.col("file").alias("_file"), F.col("file").alias("_image")).distinct()
    default = images.agg(F.max(F.when(F.col("file") == "default.jpg", F.col("file"))).alias("_default"))
    return wanted.join(own, "_file", "left").join(F.broadcast(default)).withColumn("image", F.coalesce("_image", "_default")).drop("_file", "_image", "_default")


def advanced(history: list[str], code: str) -> list[str]:
    """A history after one more code; plain Python for streams."""
    if code or history[-1]:
        history = [*history, code]
    return history[-HISTORY:]


def starts_of(history: list[str]) -> str:
    """What ``shown`` gives, in plain Python for streams."""
    starts = [history[i + 1] if i + 1 < len(history) else "" for i, x in enumerate(history) if x == ""]
    return "".join(starts[-SHOWN:])


def history_stream(events: DataFrame, delay: str, key: str = "key", at: str = "at", ident: str = "id", code: str = "code") -> DataFrame:
    """(key, ident, sessions) for each dance of a stream of codes ('': a break), in order of event time, then ident."""

    def fold(owner: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        history, out = state[0][1:].split(","), []
        for _, own, c in rows:
            history = advanced(history, c or "")
            if c:
                out.append((owner[0], own, starts_of(history)))
        return ("," + ",".join(history),), out

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    output = f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, sessions string"
    return ordered.folded(events, key, at, [ident, code], fold, (",",), "history string", output, delay)


def code_of(message: str) -> str:
    """The dance's code of a message, in plain Python for streams."""
    at_bar = message.find(" | ")
    low = message[at_bar + 3 if at_bar >= 0 else 2 :].lower()
    return next((c for part, c in (("tangon", "M"), ("tango", "T"), ("vals", "V"), ("milong", "M"), ("nuev", "M")) if part in low), "")


def display_stream(messages: DataFrame, delay: str, key: str = "key", at: str = "at", ident: str = "id", text: str = "text") -> DataFrame:
    """(key, ident, display, sessions) for each dance of a stream of messages: repeats are dropped, breaks kept in the state."""

    def fold(owner: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        last, history, out = state[0], state[1][1:].split(","), []
        for _, own, message in rows:
            message = message or ""
            if message == last:
                continue
            last = message.encode()[:REMEMBERED].decode("utf-8", "ignore")
            if "|" not in message:
                continue
            code = code_of(message)
            history = advanced(history, code)
            if code:
                out.append((owner[0], own, message.partition(" | ")[0], starts_of(history)))
        return (last, "," + ",".join(history)), out

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    output = f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, display string, sessions string"
    return ordered.folded(messages, key, at, [ident, text], fold, ("", ","), "last string, history string", output, delay)
