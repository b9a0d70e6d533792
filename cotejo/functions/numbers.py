"""Durations, years and tempo, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fastest tempo that a tap counts as, and the ratios to the mean that warn and that start afresh.
FASTEST, WARN, RESET = 220.0, 1.5, 2.0


def seconds(c: Column) -> Column:
    """Seconds of a duration 'm:ss'; null if it is none."""
    parsed = F.regexp_extract(c, r"^([0-9]{1,2}):([0-9]{2})$", 1).try_cast("int") * 60 + F.regexp_extract(c, r"^([0-9]{1,2}):([0-9]{2})$", 2).try_cast("int")
    return F.when(F.rlike(c, F.lit(r"^[0-5]?[0-9]:[0-5][0-9]$")), parsed)


def duration(c: Column) -> Column:
    """Seconds as 'm:ss', minutes within the hour."""
    return F.format_string("%d:%02d", (F.floor(c / 60) % 60).cast("int"), (c % 60).cast("int"))


def year(c: Column) -> Column:
    """A year after 1800 at the start of a date in any form; null otherwise."""
    y = F.substring(c, 1, 4).try_cast("int")
    return F.when(y > 1800, y)


def instant_bpm(millis: Column) -> Column:
    """Beats a minute of two taps so many milliseconds apart, no more than FASTEST."""
    return F.least(F.lit(FASTEST), F.coalesce(F.try_divide(F.lit(60000.0), millis), F.lit(FASTEST)))


def deviation(value: Column, mean: Column) -> Column:
    """How many times the larger of two is the smaller."""
    return F.try_divide(F.greatest(value, mean), F.least(value, mean))


def verdict(value: Column, mean: Column) -> Column:
    """What becomes of a tap: 'reset' if it is too far from the mean, 'warn' if it is far, or 'accept'."""
    apart = deviation(value, mean)
    return F.when(apart > RESET, "reset").when(apart > WARN, "warn").otherwise("accept")


def rounded(c: Column, places: int = 0) -> Column:
    """Half away from zero."""
    return F.round(c, places)


def stale(source: Column, target: Column) -> Column:
    """Whether a target made from a source must be made again: it is missing, not newer, or was changed today."""
    return target.isNull() | (target <= source) | (F.to_date(target) == F.current_date())


def close(distance: Column, length: Column) -> Column:
    """Whether an edit distance is less than a fifth of a length."""
    return 5 * distance < length


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(100 * part / whole)).cast("long")
