"""Vectors of integers: components times a power of two, rounded down, and exact whatever their size.

Matrices are of 64-bit integers while their squared distances surely fit, or else of Python
integers, which have no bounds.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums are sent as digits of so many bits, so that they stay within 64 bits over any number of rows.
DIGIT = 32
LONG = 1 << 63


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither nulls nor components that are not finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    return vector.isNotNull() & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def largest(*matrices: np.ndarray) -> float:
    return max(float(np.abs(m).max(initial=0)) for m in matrices)


def bound(dims: int, bits: int) -> float:
    """Below what all components must be for squared distances below 2^bits."""
    return math.sqrt(2.0 ** (bits - 2) / max(1, dims))


def fits(*matrices: np.ndarray) -> bool:
    """Whether squared distances between the matrices' rows surely fit 64 bits."""
    if any(m.dtype == object for m in matrices):
        return False
    return largest(*matrices) < bound(matrices[0].shape[1], 62)


def scaled(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of a matrix of finite doubles; factor is a power of two, so only rounding down changes a value."""
    if largest(x) * factor + 1 < bound(x.shape[1], 62):
        return np.floor(x * factor).astype(np.int64)
    whole = lambda v: int(v) * factor if abs(v) >= 2.0**53 else math.floor(v * factor)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    if not fits(x, c):
        x, c = x.astype(object), c.astype(object)
    elif largest(x, c) < bound(x.shape[1], 53):
        # Every step is an integer below 2^53, so floating point is exact.
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), x.dtype)
    for k, row in enumerate(c):
        out[:, k] = ((x - row) ** 2).sum(1)
    return out


def packed(m: np.ndarray) -> bytes:
    """A matrix of integers as bytes: the smallest type that holds it, in front of its values."""
    if m.dtype == object:
        return b"O" + pickle.dumps(m)
    kind = "h" if largest(m) < 1 << 15 else "i" if largest(m) < 1 << 31 else "q"
    return kind.encode() + m.astype(kind).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    if data[:1] == b"O":
        return pickle.loads(data[1:])
    return np.frombuffer(data, data[:1].decode(), offset=1).astype(np.int64).reshape(-1, width)


def digits(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as (place, digit) with digits of DIGIT bits, the last one signed."""
    place = 0
    while not -(1 << (DIGIT - 1)) <= value < 1 << (DIGIT - 1):
        yield place, value & ((1 << DIGIT) - 1)
        value >>= DIGIT
        place += 1
    yield place, value


def totals(blocks: DataFrame, column: str, shape: tuple[int, int]) -> np.ndarray:
    """The exact sum of a column of packed matrices of one shape, as Python integers.

    Each task adds up its own rows and sends the digits of the sum, whose number the shape bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += unpacked(data, shape[1])
        sent = [(at, place, digit) for at, v in enumerate(total.ravel()) if v for place, digit in digits(v)]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in sent], pa.int64()) for i in range(3)], names=["at", "place", "digit"])

    out = np.zeros(shape, object)
    for at, place, digit in blocks.select(column).mapInArrow(run, "at long, place long, digit long").groupBy("at", "place").agg(F.sum("digit")).collect():
        out[divmod(at, shape[1])] += digit << (DIGIT * place)
    return out


def narrowed(m: np.ndarray) -> np.ndarray:
    """A matrix of Python integers as one of 64-bit integers if its squared distances fit."""
    small = all(abs(v) < LONG for v in m.ravel())
    return m.astype(np.int64) if small and fits(m.astype(np.int64)) else m


def as_longs(values) -> pa.Array:
    """Whole numbers as an Arrow column; null where one exceeds 64 bits."""
    return pa.array([v if -LONG <= v < LONG else None for v in map(int, values)], pa.int64())
