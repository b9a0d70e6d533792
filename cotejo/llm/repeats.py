"""Removal of passages that an earlier document, or an earlier place of the same one, has already.

A text is cut into units (lines or sentences).  Runs of consecutive units are hashed; for
each hash that stands in more than one document the smallest doc_id is worked out over the
whole corpus.  Every run that is not that first occurrence is removed, and covered units
are merged, so overlapping runs remove each unit once.

Order is that of doc_id; rows without one come last, in the order of a hash of their text.
Rows that share a doc_id are one document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

#: (start, end) of each unit in the text, and (hash, first unit, last unit) of each run.
Cut = tuple[list[tuple[int, int]], list[tuple[int, int, int]]]

ID, SAME, OWN, LATER = "_cotejo_id", "_cotejo_same", "_cotejo_own", "_cotejo_later"
#: A word; a sentence with its end marks and the white space behind it, or what stands before a line's end.
WORD = re.compile(r"\S+")
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)\s*|[.!?]+|\n\s*|$)")


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def line_runs(text: str, lines: int = 3) -> Cut:
    """Runs of so many consecutive lines; lines of white space only are left out of runs."""
    units, solid, at = [], [], 0
    for line in text.split("\n"):
        if bare := line.strip(" \t\r"):
            solid.append((len(units), bare))
        units.append((at, at + len(line) + 1))
        at += len(line) + 1
    runs = []
    for i in range(len(solid) - lines + 1):
        part = solid[i : i + lines]
        runs.append((digest("\n".join(x for _, x in part)), part[0][0], part[-1][0]))
    return units, runs


def cut_behind(words: list[str], longest: int) -> list[int]:
    """Where a long sentence is cut, as numbers of words: behind words that a hash picks, or else after ``longest``.

    The words themselves say where to cut, so a passage inside of different sentences is
    cut alike but for its ends.
    """
    out, last = [], 0
    for k, w in enumerate(words, 1):
        if k - last >= longest or crc32(w.encode()) % 4 == 0:
            out.append(k)
            last = k
    if out and out[-1] == len(words):
        out.pop()
    return out


def sentence_runs(text: str, sentences: int = 3, words: int = 20, longest: int = 15) -> Cut:
    """From each sentence on, the shortest run of at least so many sentences.

    A sentence of more than ``longest`` words counts as several of at most as many, so that
    passages inside of long sentences are found, too.  These parts can be very short, so a
    run that has any of them needs ``words`` words as well; one that has a quarter more
    words than that may have one sentence less.  Words are compared lower-cased and
    without regard to the white space between them.
    """
    units, said, sizes, whole = [], [], [], []
    for m in SENTENCE.finditer(text):
        if m.start() == m.end():
            continue
        own = m[0].lower().split()
        if len(own) <= longest:
            units.append(m.span())
            said.append(" ".join(own))
            sizes.append(len(own))
            whole.append(True)
            continue
        starts = [w.start() for w in WORD.finditer(m[0])]
        edges = [0, *cut_behind(own, longest), len(own)]
        for a, b in zip(edges, edges[1:]):
            units.append((m.start() + (starts[a] if a else 0), m.start() + (starts[b] if b < len(own) else len(m[0]))))
            said.append(" ".join(own[a:b]))
            sizes.append(b - a)
            whole.append(False)
    solid = [u for u in range(len(units)) if sizes[u]]
    runs = []
    for at, first in enumerate(solid):
        total, parts = 0, False
        for n, u in enumerate(solid[at : at + max(sentences, words)], 1):
            total, parts = total + sizes[u], parts or not whole[u]
            if n >= sentences and (total >= words or not parts) or n >= sentences - 1 and 4 * total >= 5 * words:
                runs.append((digest(" ".join(said[v] for v in solid[at : at + n])), first, u))
                break
    return units, runs


def with_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    late = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62))
    return docs.withColumn(ID, F.coalesce(F.col(key).cast("long"), late))


def runs_of(docs: DataFrame, cut: Callable[[str], Cut], text: str) -> DataFrame:
    """(id, text, n_units, own, runs) of each row: a hash of its text, its units, whether it repeats itself, and its distinct runs."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                n_units, own, runs = [], [], []
                for t in part.column(2).to_pylist():
                    units, found = cut(t) if t else ([], [])
                    hashes = np.array(list({h for h, _, _ in found}), np.int64)
                    n_units.append(len(units))
                    own.append(len(hashes) < len(found))
                    runs.append(hashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n_units, pa.int64()), pa.array(own, pa.bool_()), pa.array(runs, pa.list_(pa.int64()))],
                    names=[ID, SAME, "n_units", OWN, "runs"],
                )

    return docs.select(ID, SAME, text).mapInArrow(run, f"{ID} long, {SAME} long, n_units long, {OWN} boolean, runs array<long>")


def without_repeats(docs: DataFrame, cut: Callable[[str], Cut], text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with its text cut, and n_units and n_removed (units) added.

    Texts are cut into runs once, and once more where a run has to go.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    docs = with_order(docs.drop("n_units", "n_removed"), key, text).withColumn(SAME, F.xxhash64(text))
    found = saved(runs_of(docs, cut, text))
    runs = found.select(ID, F.explode("runs").alias("run"))
    shared = saved(runs.groupBy("run").agg(F.min(ID).alias("first"), F.max(ID).alias("last")).where("first < last").select("run", "first"))
    later = runs.join(shared, "run").where(F.col(ID) > F.col("first")).groupBy(ID).agg(F.collect_set("run").alias(LATER))
    known = found.select(ID, SAME, "n_units", OWN).distinct().join(later, ID, "left")
    names = [c for c in docs.columns if c not in (ID, SAME)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at, n = names.index(text), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts, n_removed = part.column(at).to_pylist(), [0] * part.num_rows
                for k, (own, gone) in enumerate(zip(part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist())):
                    if not own and not gone:
                        continue
                    units, runs = cut(texts[k])
                    gone, met, covered = set(gone or ()), set(), set()
                    for h, i, j in runs:
                        if h in gone or h in met:
                            covered.update(range(i, j + 1))
                        met.add(h)
                    left = "".join(texts[k][a:b] for u, (a, b) in enumerate(units) if u not in covered)
                    texts[k] = left[:-1] if len(units) - 1 in covered and left.endswith("\n") else left
                    n_removed[k] = len(covered)
                columns = [part.column(i) for i in range(n + 1)]
                columns[at] = pc.cast(pa.array(texts, pa.string()), part.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_removed, pa.int64())], names=[*names, "n_units", "n_removed"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_units long, n_removed long"])
    return docs.join(known, [ID, SAME]).select(*(f"`{c}`" for c in names), "n_units", OWN, LATER).mapInArrow(run, schema)


def without_repeated_lines(docs: DataFrame, lines: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with every line removed that a later occurrence of a run of three lines covers.

    Lines are compared without spaces, tabs and carriage returns at their ends.  Lines that
    hold nothing else are not part of runs; they go only between lines of a removed run.  A text of fewer other lines stays as
    it is, as does an empty one; null stays null.  A text that loses all lines becomes ''.
    Adds n_units (lines) and n_removed in the place of columns of these names.  An empty
    table gives an empty result.
    """
    return without_repeats(docs, lambda t: line_runs(t, lines), text, key)


def without_repeated_sentences(docs: DataFrame, sentences: int = 3, words: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with every sentence removed that a run of sentences covers which stood before.

    See sentence_runs for what a run is.  Texts shorter than a run stay as they are; null
    stays null.  Adds n_units (sentences) and n_removed in the place of columns of these
    names.  An empty table gives an empty result.
    """
    return without_repeats(docs, lambda t: sentence_runs(t, sentences, words), text, key)
