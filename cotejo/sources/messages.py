"""Streams of now-playing messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def socket_messages(spark: SparkSession, host: str, port: int = 1945) -> DataFrame:
    """(text, at) of lines that come in over a socket, at being when each was read, in milliseconds."""
    lines = spark.readStream.format("socket").options(host=host, port=port, includeTimestamp=True).load()
    return lines.select(F.col("value").alias("text"), F.unix_millis("timestamp").alias("at"))


#: Fixed value: the length that a null text has in a frame.
NONE = "FFFFFFFF"


def framed(*texts: Column) -> Column:
    """Texts in the binary form that messages are sent in: for each the number of its bytes, in four bytes, and UTF-16 with high bytes first."""

    def frame(c: Column) -> Column:
        body = F.encode(c, "UTF-16BE")
        return F.coalesce(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), body), F.unhex(F.lit(NONE)))

    return F.concat(*map(frame, texts))


def unframed(c: Column, names: list[str]) -> dict[str, Column]:
    """The texts of a framed message by name, in order; null for one that was null and for what is cut off."""
    at, out = F.lit(1), {}
    for name in names:
        head = F.hex(F.substring(c, at, F.lit(4)))
        size = F.when((F.length(head) == 8) & (head != NONE), F.conv(head, 16, 10).cast("long")).otherwise(0)
        size = F.least(size, F.octet_length(c).cast("long") + 1).cast("int")
        body = F.substring(c, at + 4, size)
        out[name] = F.when((F.length(head) == 8) & (head != NONE) & (F.octet_length(body) == size), F.decode(body, "UTF-16BE"))
        at = at + 4 + size
    return out


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with artist, display and code (of the dance; '' is a break) of 'artist - title | genre'."""
    c = F.col(text)
    return messages.withColumns({"artist": T.message_artist(c), "display": T.message_display(c), "code": T.short_genre(T.message_genre(c))})
