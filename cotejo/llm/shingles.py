"""Word shingles as 64-bit hashes, worked out with NumPy for a whole Arrow batch at a time.

Words are runs of anything but the ASCII white space characters, with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed odd multipliers and seeds; any would do, but results must not change between tasks.
_SEED = np.random.default_rng(20240607)
BYTES = _SEED.integers(1, 1 << 63, 256, dtype=U) | U(1)
BYTES[[9, 10, 11, 12, 13, 32]] = 0
BYTES[65:91] = BYTES[97:123]
PLACES = _SEED.integers(1, 1 << 63, 64, dtype=U) | U(1)
STEP = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close ones end far apart."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, and where each text starts and the last ends; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP | U(1), U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts, size: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text after the other, and the number of words before each text.

    The bytes are taken in pieces of about so many, cut between words.
    """
    data, offsets = buffers(texts)
    hashes, starts, a = [np.empty(0, U)], [np.empty(0, np.int64)], 0
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    while a < len(data):
        b = len(data) if a + size >= len(data) else cut_after(data, edges, a + size)
        found, at = words_of(data[a:b], edges[(edges >= a) & (edges < b)] - a)
        hashes.append(found)
        starts.append(at + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def cut_after(data: np.ndarray, edges: np.ndarray, at: int) -> int:
    """The first place from at on where a word cannot go on: white space, or the start of a text, or the end."""
    nearest = np.searchsorted(edges, at)
    end = int(edges[nearest]) if nearest < len(edges) else len(data)
    while at < end:
        gap = np.flatnonzero(BYTES[data[at : min(at + 4096, end)]] == 0)
        if len(gap):
            return at + int(gap[0])
        at += 4096
    return end


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in some bytes, and where they start; edges: where texts start that are not empty."""
    values = BYTES[data]
    solid = values != 0
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    starts[edges] = solid[edges]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.empty(0, U), at
    values, solid, own = values[at[0] :], solid[at[0] :], at - at[0]
    place = np.arange(len(values)) - np.repeat(own, np.diff(np.append(own, len(values))))
    # White space adds nothing, so its place does not matter; cap it by the longest word.
    place[~solid] = 0
    sums = np.add.reduceat(values * powers(int(place.max()) + 1)[place], own)
    return mixed(sums), at


def shingle_sets(texts, words: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of so many words.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    hashes, before = word_hashes(texts)
    n = len(hashes)
    runs = np.zeros(max(0, n - words + 1), U)
    for k in range(words):
        runs += hashes[k : k + len(runs)] * PLACES[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * PLACES[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.empty(0, U))
    return out


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketching of a set of 64-bit hashes.

    In each round every item falls into one bin with a value; a bin keeps the smallest value
    of the earliest round that reached it.  From round ``size`` on all items fall into bin
    round - size, so that after 2 * size rounds every bin is full; usually one or two
    rounds do.  The share of equal bins of two sketches is concentrated about the sets'
    Jaccard similarity like that of independent samples.
    """
    out = np.full(size, ~U(0), U)
    at, n = 0, len(items)
    # Rounds that fill all bins but with a chance of e^-3 go together; more follow if need be.
    together = max(1, int(size * (np.log(size) + 3) / n))
    while at < 2 * size and (out == ~U(0)).any():
        rounds = np.arange(at, min(at + together, 2 * size)).astype(U)
        h = mixed(items[None, :] + (rounds * STEP + U(1))[:, None])
        bins = np.where(rounds[:, None] < U(size), (h >> U(32)) * U(size) >> U(32), rounds[:, None] - U(size))
        values = (rounds << U(48))[:, None] | (mixed(h) >> U(16))
        np.minimum.at(out, bins.ravel().astype(np.intp), values.ravel())
        at += len(rounds)
        together = max(1, together // 2)
    return out


def bands(items: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One hash for each band of the set's sketch."""
    parts = sketch(items, n_bands * rows).reshape(n_bands, rows)
    return mixed((mixed(parts) * PLACES[:rows]).sum(1) + np.arange(n_bands).astype(U) * STEP)
