"""Vector codes by product quantisation, its codebooks fitted by Lloyd's steps with Hamerly's bounds.

Vectors of integers are cut into ``PARTS`` consecutive parts; every part position has a
codebook of ``ENTRIES`` entries.  A round assigns every part to its codebook's nearest entry
and moves each entry to the mean of its parts.

Hamerly's bounds: with each part an upper bound of the distance to its own entry and a
lower bound of that to the second-nearest are persisted from round to round.  When entries
move, the upper bound grows by the own entry's step and the lower one shrinks by the largest
step of another.  Where the upper bound lies strictly below the lower one, or below half the
distance from the own entry to the next, the part keeps its entry unread; where that fails,
the upper bound is made exact, and only where it fails again are all entries compared, in
integers, ties to the lower index.  Bounds are rounded away from each other, so equality in
doubt always leads to the comparison.

Rows are packed into blocks of about ``BLOCK`` vectors as they are read, without a shuffle.
A round reads the blocks and writes them with their new bounds and their sums to the shared
folder, so what an executor loses is worked out from a written table; the sums, one small
column of that table, are added up on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from . import integers
from .common import discarded, saved

#: What components are multiplied with, parts of a vector, entries of a codebook, rounds, and vectors of a block.
SCALE, PARTS, ENTRIES, ROUNDS, BLOCK = 4096, 8, 16, 6, 1024
#: Labels whose sums are broadcast to all rows; beyond that rows and sums are joined.
FEW = 10_000

STATE = "x binary, codes binary, upper binary, lower binary, sums binary, n_scanned long"


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists of numbers as a matrix of doubles; shorter lists are filled up with zeros."""
    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values.cast(pa.float64()))
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    column = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), column] = values[offsets[0] : offsets[-1]]
    return out


def up(x: np.ndarray) -> np.ndarray:
    """Floats that are surely no smaller."""
    return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Floats that are surely no larger, and not below zero."""
    return np.maximum(np.nextafter((x * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class Codebook:
    """The entries of one part position, how far each moved to get there, and half the distance to its nearest neighbour."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.exact = integers.fits(entries) and (before is None or integers.fits(before))
        n = len(entries)
        if not self.exact:
            return
        apart = roots(integers.squared(entries, entries)) if n else np.zeros((0, 0))
        np.fill_diagonal(apart, np.inf)
        self.half = down(apart.min(1, initial=np.inf) / 2)
        self.steps = np.zeros(n, np.float32) if before is None else up(np.array([roots(integers.squared(a[None], b[None]))[0, 0] for a, b in zip(entries, before)]))
        #: Of each entry the largest step that another one made.
        self.others = np.array([np.delete(self.steps, k).max(initial=0) for k in range(n)], np.float32)


def reassigned(x: np.ndarray, book: Codebook, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves one part position's codes and bounds on to a codebook, in place; returns how many parts were compared with all entries."""
    if not (book.exact and integers.fits(x, book.entries)):
        # Too large for bounds in floating point: all are compared, in Python integers.
        codes[:] = integers.squared(x, book.entries).argmin(1)
        upper[:], lower[:] = np.inf, 0
        return len(x)
    upper[:] = up(upper.astype(np.float64) + book.steps[codes])
    lower[:] = down(np.maximum(0, lower.astype(np.float64) - book.others[codes]))
    bound = np.maximum(lower, book.half[codes])
    doubted = np.flatnonzero(~(upper < bound))
    own = ((x[doubted] - book.entries[codes[doubted]]) ** 2).sum(1)
    upper[doubted] = up(roots(own))
    scanned = doubted[~(upper[doubted] < bound[doubted])]
    if len(scanned):
        d = integers.squared(x[scanned], book.entries)
        codes[scanned] = d.argmin(1)
        upper[scanned] = up(roots(d.min(1)))
        d[np.arange(len(d)), codes[scanned]] = np.iinfo(np.int64).max
        lower[scanned] = down(roots(d.min(1))) if d.shape[1] > 1 else np.inf
    return len(scanned)


def summed(x: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """For each entry the sum of its parts and how many they are."""
    out = np.zeros((n, x.shape[1] + 1), x.dtype)
    np.add.at(out[:, :-1], codes, x)
    np.add.at(out[:, -1], codes, 1)
    return out


def split(x: np.ndarray, part: int) -> np.ndarray:
    size = x.shape[1] // PARTS
    return x[:, part * size : (part + 1) * size]


def blocks(vectors: DataFrame, keep: list[str], vector: str, width: int) -> DataFrame:
    """keep's columns as lists, and the first state: no bounds, every code 0."""
    kinds = t.StructType([t.StructField(c, t.ArrayType(vectors.schema[c].dataType)) for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = integers.scaled(padded(part.column(len(keep)), width), SCALE)
                n = len(x)
                kept = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([part.column(i)])) for i in range(len(keep))]
                state = [integers.packed(x), bytes(n * PARTS), np.full(n * PARTS, np.inf, np.float32).tobytes(), bytes(4 * n * PARTS), b""]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([s], pa.binary()) for s in state), pa.array([0], pa.int64())], names=[*keep, "x", "codes", "upper", "lower", "sums", "n_scanned"])

    schema = t.StructType([*kinds.fields, *t.StructType.fromDDL(STATE).fields])
    return vectors.select(*keep, vector).mapInArrow(run, schema)


def stepped(state: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """The state after every part is assigned anew; n_scanned: parts that were compared with all entries."""
    known = state.sparkSession.sparkContext.broadcast(books)
    names = state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = integers.unpacked(row.column("x")[0].as_py(), width)
                codes = np.frombuffer(row.column("codes")[0].as_py(), np.uint8).reshape(-1, PARTS).copy()
                upper, lower = (np.frombuffer(row.column(c)[0].as_py(), np.float32).reshape(-1, PARTS).copy() for c in ("upper", "lower"))
                n_scanned, sums = 0, []
                for p, book in enumerate(known.value):
                    n_scanned += reassigned(split(x, p), book, codes[:, p], upper[:, p], lower[:, p])
                    sums.append(summed(split(x, p), codes[:, p], len(book.entries)))
                made = {"codes": codes.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "sums": integers.packed(np.concatenate(sums)), "n_scanned": n_scanned}
                yield pa.RecordBatch.from_arrays([pa.array([made[c]], row.schema.field(c).type) if c in made else row.column(c) for c in names], schema=row.schema)

    return state.mapInArrow(run, state.schema)


def first_books(vectors: DataFrame, key: str, vector: str, width: int) -> list[Codebook]:
    """The parts of the vectors with the smallest keys; rows without a key come behind all others, equal keys by their vectors."""
    # One row a task and key order: no more than ENTRIES rows come to the driver.
    rows = vectors.select(key, vector).orderBy(F.col(key).asc_nulls_last(), F.col(vector)).limit(ENTRIES).collect()
    x = np.zeros((len(rows), width))
    for row, r in zip(x, rows):
        row[: len(r[1])] = r[1]
    x = integers.scaled(x, SCALE)
    return [Codebook(split(x, p)) for p in range(PARTS)]


def moved(book: Codebook, sums: np.ndarray) -> Codebook:
    """The codebook with each entry at its parts' mean, rounded down; entries without parts stay."""
    means = [[s // n for s in row] if n else list(old) for (*row, n), old in zip(sums.tolist(), book.entries.tolist())]
    return Codebook(integers.narrowed(np.array(means, object).reshape(book.entries.shape)), book.entries)


def fitted(state: DataFrame, books: list[Codebook], width: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook], list[int]]:
    """The last state, the final codebooks, and how many parts each round compared with all entries.  state is discarded."""
    scanned, n = [], len(books[0].entries)
    for turn in range(rounds + 1):
        new = saved(stepped(state, books, width))
        discarded(state)
        state = new
        scanned.append(state.agg(F.sum("n_scanned")).first()[0] or 0)
        if turn < rounds:
            sums = integers.totals(state, "sums", (PARTS * n, width // PARTS + 1))
            books = [moved(book, sums[p * n : (p + 1) * n]) for p, book in enumerate(books)]
    return state, books, scanned


def coded(state: DataFrame, keep: list[str], books: list[Codebook], width: int) -> DataFrame:
    """keep's columns, code and error of every vector of the last state."""
    known = state.sparkSession.sparkContext.broadcast([b.entries for b in books])
    kept = [t.StructField(c, state.schema[c].dataType.elementType) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = integers.unpacked(batch.column("x")[i].as_py(), width)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(-1, PARTS)
                entries = np.concatenate([c[codes[:, p]] for p, c in enumerate(known.value)], axis=1)
                if not integers.fits(x, entries):
                    x, entries = x.astype(object), entries.astype(object)
                error = integers.as_longs(((x - entries) ** 2).sum(1))
                code = pa.array([row.tobytes().hex() for row in codes])
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i].values for c in keep), code, error], names=[*keep, "code", "error"])

    schema = t.StructType([*kept, t.StructField("code", t.StringType()), t.StructField("error", t.LongType())])
    return state.select(*keep, "x", "codes").mapInArrow(run, schema)


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def long_sum(c: str) -> Column:
    """The sum of longs; null if it exceeds 64 bits or a summand does."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c).cast("decimal(20,0)")).try_cast("long")).alias(f"{c}_sum")


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector.

    Components are taken times SCALE and rounded down.  code has two hexadecimal digits for
    each part; error is the squared distance to what the code stands for, label_error the
    sum of errors over the rows of an equal label, rows without a label together.

    Rows whose vector is null or holds a null or a component that is not finite take no part.
    Shorter vectors are filled up with zeros to the longest, and all to a multiple of PARTS.
    Repeated rows and repeated keys stay, each a vector of its own; rows without a key come
    behind all others when starting entries are chosen.  With fewer vectors than ENTRIES there
    are as many entries.  An error beyond 64 bits is null.  Other columns don't matter; an
    empty table gives an empty result.
    """
    given = vectors.where(integers.finite(F.col(vector))).select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.transform(vector, lambda x: x.cast("double")).alias("_vector"))
    longest = given.agg(F.max(F.size("_vector"))).first()[0] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    state = saved(blocks(given, ["_key", "_label"], "_vector", width))
    state, books, _ = fitted(state, first_books(given, "_key", "_vector", width), width)
    rows = saved(coded(state, ["_key", "_label"], books, width))
    discarded(state)
    sums = rows.groupBy(F.col("_label").alias("_of")).agg(long_sum("error"))
    if sums.limit(FEW + 1).count() <= FEW:
        sums = F.broadcast(sums)
    out = rows.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_key").alias(key), "code", "error", F.col("error_sum").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
