"""Tempo from taps: a running mean that starts afresh when a tap is far off."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FASTEST, RESET
from . import ordered

STATE = "count long, last long, total double, bpm double, resets long"


def tempo(taps: DataFrame, key: str, at: Column, order: list[str], scale: float = 60000.0) -> DataFrame:
    """Of each key: count, total, last tap's bpm and resets after all its taps.

    at: a tap's time as a long.  Rows are dealt by key, sorted, and folded as they come: a
    task holds one key's state and a batch of rows, however many taps a key has.  The
    taps of a key follow each other in one task, as a tap's effect depends on all before.
    """
    import pyarrow as pa

    kind = taps.select(key).schema[0].dataType.simpleString()
    rows = taps.select(key, at.cast("long").alias("_at"), *(F.col(c).alias(f"_order{i}") for i, c in enumerate(order)))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, *(f"_order{i}" for i in range(len(order))), "_at").select(key, "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, done, state = (0, 0, 0.0, 0.0, 0), [], None
        schema = []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*done), [schema[0], pa.int64(), pa.float64(), pa.float64(), pa.int64()])]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[key, "taps", "total_bpm", "last_bpm", "resets"])

        def end() -> None:
            done.append((owner, state[0], *state[2:]))

        owner = None
        for batch in batches:
            schema[:] = [batch.schema.field(0).type]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or k != owner:
                    if state is not None:
                        end()
                    owner, state = k, none
                state = step(state, t, scale)
            if done:
                yield packed()
        if state is not None:
            end()
            yield packed()

    return rows.mapInArrow(run, f"`{key}` {kind}, taps long, total_bpm double, last_bpm double, resets long")


def step(state: tuple, at: int | None, scale: float) -> tuple:
    """The state after one more tap, in plain Python."""
    count, last, total, bpm, resets = state
    if count == 0:
        return 1, at, 0.0, 0.0, resets
    bpm = FASTEST if at is None or last is None or at == last else min(FASTEST, scale / (at - last))
    total += bpm
    mean = total / count
    if max(bpm, mean) > RESET * min(bpm, mean):
        return 0, 0, 0.0, 0.0, resets + 1
    return count + 1, at, total, bpm, resets


def tempo_stream(taps: DataFrame, delay: str, key: str = "key", at: str = "at", ident: str = "id", scale: float = 60000.0) -> DataFrame:
    """(key, taps, total_bpm, last_bpm, resets, at_us, n) of a stream of taps: a key's state whenever the watermark passes taps of its own.

    at: a timestamp, of which microseconds count; taps of one moment follow each other by
    ident.  n grows with every row of a key, so the row with the largest n is the last.
    """

    def fold(owner: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        *s, n = state
        for us, _ in rows:
            s = step(tuple(s), us, scale)
        n += len(rows)
        return (*s, n), [(owner[0], s[0], s[2], s[3], s[4], rows[-1][0], n)]

    kind = taps.schema[key].dataType.simpleString()
    output = f"`{key}` {kind}, taps long, total_bpm double, last_bpm double, resets long, at_us long, n long"
    return ordered.folded(taps, key, at, [ident], fold, (0, 0, 0.0, 0.0, 0, 0), f"{STATE}, n long", output, delay)
