"""Folds over streams in the order of event time, whatever the order of arrival.

Keys are dealt into BUCKETS buckets.  Rows wait in their bucket's list state until the watermark
has passed them; an event-time timer stands at the first of them.  When it goes off, all rows that the watermark has passed are
folded key by key in order and leave the list.  A row can be late by the watermark's delay, across any
number of micro-batches, and still counts where it belongs, so the stream gives what the same
fold gives over the sorted table.

State needs the RocksDB store (``with_rocksdb``): what waits lies on disk and is
checkpointed by changes.  If ``idle`` is given, a key's fold starts afresh where so much time
lies between two of its rows, and the state of a key without rows is deleted after that.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of keys (a checkpoint holds for one number of them), that of rows without a key, which only move the watermark, and rows of a piece of state.
BUCKETS, KEYLESS, CHUNK = 1024, -1, 10_000

#: A fold over some rows in order: (key, state, rows of (microseconds, *values)) -> (state, output rows).
Fold = Callable[[tuple, tuple, list[tuple]], tuple[tuple, list[tuple]]]


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; tables and files are shared."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


class Ordered(StatefulProcessor):
    """The waiting rows and the fold's states of the keys of one bucket, in few values: calls to the state cost more than its rows."""

    def __init__(self, fold: Fold, first: tuple, key: str, values: list[str], columns: list[str], idle: int | None):
        self.fold, self.first, self.key, self.values, self.columns, self.idle = fold, first, key, values, columns, idle

    def init(self, handle) -> None:
        self.handle = handle
        packed = t.StructType([t.StructField("packed", t.BinaryType())])
        #: (state, last millisecond) of each key, and pieces of CHUNK waiting rows (key, microseconds, *values).
        self.folded, self.rows = handle.getValueState("folded", packed), handle.getListState("rows", packed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if key[0] != KEYLESS and len(batch):
                given = self.given(batch)
                self.keep(given, self.rows.appendList)
                earliest = min(r[1] for r in given)
                first = earliest if first is None else min(first, earliest)
        # Timers have milliseconds: one goes off when the watermark has passed all of them.
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def given(self, batch: pd.DataFrame) -> list[tuple]:
        columns = [batch[self.key].tolist(), batch["moment_us"].tolist()]
        for v in self.values:
            if f"_none_{v}" in batch:
                columns.append([None if none else x for x, none in zip(batch[v].tolist(), batch[f"_none_{v}"].tolist())])
            else:
                columns.append(batch[v].astype(object).where(batch[v].notna(), None).tolist())
        return list(zip(*columns))

    def keep(self, rows: list[tuple], write: Callable[[list[tuple]], None]) -> None:
        write([(pickle.dumps(rows[i : i + CHUNK]),) for i in range(0, len(rows), CHUNK)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[object, list[tuple]] = {}
        rest = []
        for (packed,) in self.rows.get() if self.rows.exists() else ():
            for r in pickle.loads(packed):
                if r[1] <= passed:
                    ready.setdefault(r[0], []).append(r[1:])
                else:
                    rest.append(r)
        # Without ready rows nothing changes, and the timer at the first of the others stands.
        if ready and rest:
            self.keep(rest, self.rows.put)
            self.handle.registerTimer(-(-min(r[1] for r in rest) // 1000))
        elif ready:
            self.rows.clear()
        states = pickle.loads(self.folded.get()[0]) if self.folded.exists() else {}
        out, before = [], len(states)
        for owner, own in ready.items():
            state, last = states.get(owner, (self.first, None))
            for rows in self.without_gaps(in_order(own)):
                if self.idle is not None and last is not None and rows[0][0] // 1000 - last >= self.idle:
                    state = self.first
                state, more = self.fold((owner,), state, rows)
                out += more
                last = rows[-1][0] // 1000
            states[owner] = state, last
        if self.idle is not None:
            before = max(before, len(states))
            states = {k: v for k, v in states.items() if passed // 1000 < v[1] + self.idle}
            if states:
                self.handle.registerTimer(min(last for _, last in states.values()) + self.idle)
        if states and (ready or len(states) < before):
            self.folded.update((pickle.dumps(states),))
        elif before and not states:
            self.folded.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def without_gaps(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows in order, cut where idle lies between two of them."""
        start = 0
        for i in range(1, len(rows)):
            if self.idle is not None and (rows[i][0] - rows[i - 1][0]) // 1000 >= self.idle:
                yield rows[start:i]
                start = i
        yield rows[start:]

    def close(self) -> None:
        pass


def in_order(rows: list[tuple]) -> list[tuple]:
    """Sorted rows, nulls first."""
    try:
        return sorted(rows)
    except TypeError:
        return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def folded(events: DataFrame, key: str, at: str, values: list[str], fold: Fold, first: tuple, state: str, output: str, delay: str, idle: timedelta | None = None) -> DataFrame:
    """The output rows of a fold over each key's events in order of at (a timestamp), then values; an append-only stream.

    events: a stream; delay: how late a row may come.  Rows without a time or a key are left
    out: they have no place.  What lies behind the watermark when the source ends waits for
    the next row; ``closing`` makes one for sources that are over.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    # Whole numbers would become floating ones beside nulls.
    whole = [v for v in values if isinstance(kinds[v], t.IntegralType)]
    given = [F.coalesce(v, F.lit(0)).cast(kinds[v]).alias(v) if v in whole else F.col(v) for v in values]
    bucket = F.when(F.col(key).isNull(), KEYLESS).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).alias("_bucket")
    rows = events.withWatermark(at, delay).where(F.col(at).isNotNull()).select(bucket, key, at, F.unix_micros(at).alias("moment_us"), *given, *(F.col(v).isNull().alias(f"_none_{v}") for v in whole))
    schema = t.StructType.fromDDL(output)
    held = None if idle is None else int(idle.total_seconds() * 1000)
    return rows.groupBy("_bucket").transformWithStateInPandas(Ordered(fold, first, key, values, schema.names, held), schema, "append", "eventTime")


def closing(events: DataFrame, at: str, delay: timedelta) -> DataFrame:
    """One row with nothing but a time, so far behind all others that the watermark passes them."""
    last = events.agg((F.max(at) + F.expr(f"make_dt_interval(0, 0, 0, {delay.total_seconds() + 1})")).alias(at)).where(F.col(at).isNotNull())
    return last.select(*(F.col(at) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields))
