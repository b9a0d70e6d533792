"""Places, neighbours and next matches in one total order over all rows.

A window without partitions would bring every row into one task.  Here rows are dealt into
ranges of the order and written once; what a range must know of the others is one row for
each range (its number of rows, its first match, its last row), a table as small as the
number of ranges, which is worked out on the driver and broadcast.

Rows that are equal in the order go to one range, so an order should end in a unique column.
What is more than a column should be made one first: a sort works its order out again for
every comparison.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stores import stored

#: Bits of an increasing id that count within a task.
WITHIN = 33


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with _range and _at: the number of the range they are in, ranges ascending by order, and their place in it from 0.

    The table is written before it is read, as ranges are sampled anew whenever they are worked out.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return stored(dealt.withColumn("_id", at).withColumns({"_range": F.shiftright("_id", WITHIN), "_at": F.col("_id").bitwiseAND((1 << WITHIN) - 1)}).drop("_id"))


def per_range(dealt: DataFrame, facts: dict, columns: str) -> DataFrame:
    """A broadcast table (_range, columns) of what each range is told, a value for each range."""
    rows = [(k, *v) if isinstance(v, tuple) else (k, v) for k, v in facts.items()]
    return F.broadcast(dealt.sparkSession.createDataFrame(rows, f"_range long, {columns}"))


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 1, as a long.  An empty table stays empty."""
    dealt = ranged(rows, *order)
    sizes = sorted(dealt.groupBy("_range").count().collect())
    before = dict(zip([r[0] for r in sizes], accumulate([0, *(r[1] for r in sizes)])))
    return dealt.join(per_range(dealt, before, "_before long"), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def next_matches(rows: DataFrame, matched: DataFrame, key: str, position: str, name: str = "next") -> DataFrame:
    """rows with the position of the next row behind each that has any match; null behind the last one.

    rows: key and position, which is unique and not null; matched: key, any number of times.
    """
    # Matches are found once: sampling ranges works their rows out again, and a test for nulls would move below what finds the matches.
    found = stored(matched.select(key).distinct()).where(F.col(key).isNotNull()).withColumn("_found", F.lit(True))
    dealt = ranged(rows.join(found, key, "left").withColumn("_match", F.when(F.col("_found"), F.col(position))).drop("_found"), F.col(position))
    firsts = sorted(dealt.groupBy("_range").agg(F.min("_match")).collect(), reverse=True)
    behind, following = {}, None
    for at, first in firsts:
        behind[at] = following
        following = first if first is not None else following
    kind = rows.schema[position].dataType.simpleString()
    # From the end, as a frame that only grows is gone through once; one that shrinks would be gone through again for every row.
    later = Window.partitionBy("_range").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("_near", F.min("_match").over(later))
    return near.join(per_range(dealt, behind, f"_behind {kind}"), "_range").withColumn(name, F.coalesce("_near", "_behind")).drop("_range", "_at", "_match", "_near", "_behind")


def with_previous(rows: DataFrame, columns: list[str], *order: Column) -> DataFrame:
    """rows with before_<column>: columns of the row before each in the order; null before the first one."""
    dealt = ranged(rows, *order)
    last = {r["_range"]: r["last"] for r in dealt.groupBy("_range").agg(F.max_by(F.struct(*columns), "_at").alias("last")).collect()}
    ranges = sorted(last)
    before = {k: tuple(last[j]) if j is not None else (None,) * len(columns) for j, k in zip([None, *ranges], ranges)}
    kinds = ", ".join(f"`_before_{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    one = Window.partitionBy("_range").orderBy("_at")
    near = dealt.withColumns({f"before_{c}": F.lag(c).over(one) for c in columns}).join(per_range(dealt, before, kinds), "_range")
    return near.withColumns({f"before_{c}": F.when(F.col("_at") > 0, F.col(f"before_{c}")).otherwise(F.col(f"_before_{c}")) for c in columns}).drop("_range", "_at", *(f"_before_{c}" for c in columns))
