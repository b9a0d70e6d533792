"""Hashed feature counts of texts, worked out with NumPy for a slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import slices

U = np.uint64
#: Dimensions of character n-grams, and of word shapes and their pairs.
GRAMS, SHAPES = 1 << 13, 1 << 10
#: After shapes and pairs of shapes: repeated neighbours, and a document's share of distinct words in so many steps.
STEPS = 24
STRETCH = 200
STYLE = 2 * SHAPES + 1 + STEPS


def counted(rows: np.ndarray, at: np.ndarray, n: int, dims: int) -> np.ndarray:
    return np.bincount(rows * dims + at, minlength=n * dims).reshape(n, dims)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, one space for anything between, and which text each belongs to."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    kinds, back = np.unique(points, return_inverse=True)
    points = np.where(np.array([chr(c).isalpha() for c in kinds])[back], points, 32).astype(np.uint64)
    kept = np.ones(len(points), bool)
    kept[1:] = (points[1:] != 32) | (points[:-1] != 32) | (rows[1:] != rows[:-1])
    return points[kept], rows[kept]


def grams(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed character n-grams, n from 1 to 3, of each text; none of a text without letters."""
    points, rows = code_points(texts)
    solid = points != 32
    out = np.zeros((len(texts), GRAMS), np.int64)
    h = np.zeros(len(points), U)
    for n in range(1, 4):
        part = h[: len(points) - n + 1] if n > 1 else h
        part = part * U(0x100000001B3) + points[n - 1 :]
        h = part
        inside = rows[: len(part)] == rows[n - 1 :]
        inside &= solid[: len(part)] | solid[n - 1 :]
        out += counted(rows[: len(part)][inside], (shingles.mixed(part[inside] + U(n)) % U(GRAMS)).astype(np.int64), len(texts), GRAMS)
    return out


def pieces(data: np.ndarray, size: int) -> Iterator[pa.Array]:
    """A text's bytes as texts of about so many bytes, cut before white space; where depends on the text alone."""
    a = 0
    while a < len(data):
        b = len(data) if a + size >= len(data) else shingles.cut_after(data, np.array([len(data)]), a + size)
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        yield pa.array([data[a:b].tobytes().decode(errors="replace")])
        a = b


def by_pieces(count: Callable, count_long: Callable, texts, dims: int, size: int = 1 << 20) -> np.ndarray:
    """count's rows for Arrow texts; one of more than so many bytes goes through count_long in pieces, which bounds memory and gives the same row."""
    data, offsets = shingles.buffers(texts)
    if not len(offsets) - 1 or np.diff(offsets).max() <= size:
        return count(texts)
    out = np.zeros((len(offsets) - 1, dims), np.int64)
    short = np.flatnonzero(np.diff(offsets) <= size)
    if len(short):
        out[short] = count(texts.take(pa.array(short)))
    for i in np.flatnonzero(np.diff(offsets) > size):
        out[i] = count_long(pieces(data[offsets[i] : offsets[i + 1]], size))
    return out


def long_grams(parts: Iterator[pa.Array]) -> np.ndarray:
    """grams of a text in pieces: the last letter of a piece goes before the next one, and its own grams are taken away again."""
    out, carried = np.zeros(GRAMS, np.int64), ""
    for part in parts:
        text = part[0].as_py()
        out += grams([f"{carried} {text}"])[0] - (grams([carried])[0] if carried else 0)
        letters = code_points([text])[0]
        letters = letters[letters != 32]
        carried = chr(int(letters[-1])) if len(letters) else carried
    return out


def byte_kinds() -> np.ndarray:
    """What a byte counts as in a word's shape: lower case, upper case, digit, mark, or a symbol of its own."""
    kinds = np.arange(256)
    kinds[97:123] = kinds[128:] = 1
    kinds[65:91], kinds[48:58] = 2, 3
    kinds[[ord(c) for c in ".,;:'\"()-?"]] = 4
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    return kinds


KINDS = byte_kinds()


def style(texts) -> np.ndarray:
    """Counts of word shapes (runs of one kind of character count once), of pairs of them, and of repetition."""
    return by_pieces(short_style, long_style, texts, STYLE)


def shapes_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, the number of words before each text, and the words' shapes."""
    data, offsets = shingles.buffers(texts)
    hashes, before = shingles.word_hashes(texts)
    kinds = KINDS[data]
    turn = np.ones(len(kinds), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    starts = kinds != 0
    starts[1:] &= kinds[:-1] == 0
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = kinds[first] != 0
    at = np.flatnonzero(starts)
    if not len(at):
        return hashes, before, np.empty(0, np.int64)
    turn[at] = True
    # A shape's hash: each kind times a number for its place among the word's runs.
    run = np.cumsum(turn)
    begins = run[np.append(0, at)] if at[0] else run[at]
    ends = np.concatenate([[0], at, [len(data)]]) if at[0] else np.append(at, len(data))
    place = np.minimum(run - np.repeat(begins, np.diff(ends)), 15)
    values = np.where(turn & (kinds != 0), shingles.BYTES[(kinds * 7 + 128) % 256] * shingles.PLACES[place], U(0))
    return hashes, before, (shingles.mixed(np.add.reduceat(values, at)) % U(SHAPES)).astype(np.int64)


def varied(words: np.ndarray) -> float:
    return len(np.unique(words)) / len(words)


def with_variety(row: np.ndarray, n_words: int, shares: list[float]) -> None:
    """Enters in a row of counts the mean share of distinct words; long texts repeat words anyway, so stretches of STRETCH words are compared."""
    if n_words:
        row[2 * SHAPES + 1 + min(STEPS - 1, int(np.mean(shares) * STEPS))] = n_words


def short_style(texts) -> np.ndarray:
    hashes, before, shapes = shapes_of(texts)
    n = len(before) - 1
    rows = np.repeat(np.arange(n), np.diff(before))
    out = np.zeros((n, STYLE), np.int64)
    out[:, :SHAPES] = counted(rows, shapes, n, SHAPES)
    same = rows[1:] == rows[:-1]
    pairs = (shapes[:-1] * 31 + shapes[1:]) % SHAPES
    out[:, SHAPES : 2 * SHAPES] = counted(rows[1:][same], pairs[same], n, SHAPES)
    again = same & (hashes[1:] == hashes[:-1])
    out[:, 2 * SHAPES] = np.bincount(rows[1:][again], minlength=n)
    for i in range(n):
        words = hashes[before[i] : before[i + 1]]
        with_variety(out[i], len(words), [varied(words[a : a + STRETCH]) for a in range(0, len(words), STRETCH)])
    return out


def long_style(parts: Iterator[pa.Array]) -> np.ndarray:
    """style of a text in pieces: the last word of a piece, and the words of a stretch that is not full, go on into the next one."""
    out = np.zeros(STYLE, np.int64)
    words, shape = np.empty(0, U), np.empty(0, np.int64)
    stretch, shares, n_words = np.empty(0, U), [], 0
    for part in parts:
        hashes, _, shapes = shapes_of(part)
        out[:SHAPES] += np.bincount(shapes, minlength=SHAPES)
        joined, near = np.append(shape, shapes), np.append(words, hashes)
        out[SHAPES : 2 * SHAPES] += np.bincount((joined[:-1] * 31 + joined[1:]) % SHAPES, minlength=SHAPES)
        out[2 * SHAPES] += (near[1:] == near[:-1]).sum()
        words, shape = near[-1:], joined[-1:]
        stretch, n_words = np.append(stretch, hashes), n_words + len(hashes)
        full = len(stretch) // STRETCH * STRETCH
        shares += [varied(stretch[a : a + STRETCH]) for a in range(0, full, STRETCH)]
        stretch = stretch[full:]
    with_variety(out, n_words, shares + ([varied(stretch)] if len(stretch) else []))
    return out


def frequencies(docs: DataFrame, text: str, count: Callable, dims: int) -> tuple[np.ndarray, int]:
    """In how many of docs each feature occurs, and how many docs there are; counted over all of them.

    Each task sends one row per feature, so what is summed has a fixed width.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                total += (count(part.column(0)) > 0).sum(0)
                n += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["at", "n"])

    out, n = np.zeros(dims), 0
    for at, k in docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        if at < 0:
            n = k
        else:
            out[at] = k
    return out, n


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length; a row without features is zero."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def counted_rows(docs: DataFrame, names: list[str], text: str, count: Callable) -> list:
    """Rows (names, at, n) with the sparse feature counts of docs, which the caller has bounded."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names)):
                counts = count(part.column(len(names)))
                at = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(names))), pa.array(at, pa.list_(pa.int32())), pa.array([c[a].astype(np.int32) for c, a in zip(counts, at)], pa.list_(pa.int32()))],
                    names=[*names, "at", "n"],
                )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "at array<int>, n array<int>"])
    return docs.select(*names, text).mapInArrow(run, schema).collect()


def dense(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for x, r in zip(out, rows):
        x[r["at"]] = r["n"]
    return out


def sampled(docs: DataFrame, key: str, label: str, each: int) -> DataFrame:
    """A bounded part of the distinct rows of docs (key, label), chosen by a hash of the key: of each label about ``each``, 1.5 times as many in all at most.

    A label's keys are counted by a sketch, so repeated rows don't make its share smaller.
    """
    sizes = {r[0]: r[1] for r in docs.groupBy(label).agg(F.approx_count_distinct(key)).collect()}
    if not sizes:
        return docs.limit(0)
    share = F.coalesce(*(F.when(F.col(label) == F.lit(k), F.lit(min(1.0, each / max(1, n)))) for k, n in sizes.items()))
    spot = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    chosen = docs.withColumn("_spot", spot).where(F.col("_spot") < share * (1 << 30)).distinct()
    return chosen.orderBy("_spot", key, label).limit(int(1.5 * each * len(sizes))).drop("_spot")
