"""Byte-pair encoding and decoding with a given byte-level vocabulary.

Each short word keeps its parts and the merge rank of every neighbouring pair side by
side in two arrays.  The smallest rank is looked up by a scan, its boundary is deleted,
and the two neighbouring ranks are refreshed, until no pair can merge.  Words longer
than ``SHORT`` bytes would make that scan quadratic, so they take the same merges in the
same order from a heap.

The vocabulary is the JSON file of a public byte-level tokenizer; it is read on the
driver and broadcast (its size is fixed, about 50,000 entries).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import slices

#: Bytes up to which a word is merged by scanning.
SHORT = 96
#: Above every rank.
NEVER = 1 << 60
#: Words remembered by a task; beyond this many it starts afresh.
REMEMBERED = 400_000
#: Single characters after a word that are words of their own (of no kind of letter).
ENDS = frozenset(".,;:!?")

ENCODED = "n_tokens long, ids array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file.

    ranks: pair of ids, as one number -> rank; wholes: id of the merged pair by rank; single:
    id of each byte; strings: bytes of each id; special: strings that become one id wherever
    they stand.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    symbols, vocab = byte_symbols(), model["model"]["vocab"]
    strings = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    strings |= {i: s.encode() for s, i in special.items()}
    ranks, wholes = {}, []
    for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]):
        ranks.setdefault(vocab[a] << 20 | vocab[b], len(wholes))
        wholes.append(vocab[a + b])
    single = [0] * 256
    for c, b in symbols.items():
        single[b] = vocab[c]
    return {"ranks": ranks, "wholes": wholes, "single": single, "strings": [strings.get(i, b"") for i in range(max(strings) + 1)], "special": special}


#: How byte-level vocabularies of this family cut text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_short(parts: list[int], ranks: dict[int, int], wholes: list[int]) -> list[int]:
    """Merges by scanning a contiguous array of the ranks of neighbouring pairs."""
    rank = ranks.get
    line = [rank(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
    best = min(line)
    while best != NEVER:
        i = line.index(best)
        parts[i] = whole = wholes[best]
        del parts[i + 1], line[i]
        if not line:
            break
        if i:
            line[i - 1] = rank(parts[i - 1] << 20 | whole, NEVER)
        if i < len(line):
            line[i] = rank(whole << 20 | parts[i + 1], NEVER)
        best = min(line)
    return parts


def merge_long(parts: list[int], ranks: dict[int, int], wholes: list[int]) -> list[int]:
    """The same merges in the same order: lowest rank first, leftmost among equals."""
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] << 20 | parts[i + 1], NEVER)) != NEVER]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        if parts[i] != a or (j := right[i]) >= n or parts[j] != b:
            continue
        parts[i], parts[j] = wholes[r], -1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (r := ranks.get(parts[x] << 20 | parts[y], NEVER)) != NEVER:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [p for p in parts if p >= 0]


class Encoder:
    """Encodes texts, and remembers the ids of words it has met."""

    def __init__(self, model: dict):
        import regex

        self.ranks, self.wholes, self.single, self.strings = (model[k] for k in ("ranks", "wholes", "single", "strings"))
        self.special = model["special"]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS).findall
        # A space before anything but white space always begins a new word, so text is cut
        # there; elsewhere (runs of white space) the word pattern decides.
        self.odd_space = re.compile(r" (?:\s|$)").search
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = out = outer.ids_of_word(word)
                return out

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if chunk.isalpha():
                    out = outer.ids_of_word(" " + chunk)
                elif chunk[-1:] in ENDS and chunk[:-1].isalpha():
                    return self[chunk[:-1]] + outer.of_word[chunk[-1]]
                else:
                    out = outer.ids_of(" " + chunk)
                if len(self) >= REMEMBERED:
                    self.clear()
                self[chunk] = out
                return out

        self.of_word, self.after_space = Words(), Chunks()

    def ids_of_word(self, word: str) -> bytes:
        parts = [self.single[b] for b in word.encode()]
        if len(parts) > 1:
            parts = (merge_short if len(parts) <= SHORT else merge_long)(parts, self.ranks, self.wholes)
        return array("I", parts).tobytes()

    def ids_of(self, text: str) -> bytes:
        """Ids of a text without special strings, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.of_word.__getitem__, self.words(text)))

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd_space(text):
            return self.ids_of(text)
        first, *rest = text.split(" ")
        return (self.ids_of(first) if first else b"") + b"".join(map(self.after_space.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        return b"".join(self.special[s].to_bytes(4, "little") if s in self.special else self.plain(s) for s in self.at_special.split(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def coded(docs: DataFrame, tokenizer: str, digests: bool, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns of docs, and either ids and decoded text or only their digests."""
    import numpy as np
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(load(tokenizer))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), DIGESTS if digests else ENCODED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in model.value:  # kept by a Python worker for its next tasks
            model.value["encoder"] = Encoder(model.value)
        encoder = model.value["encoder"]
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = part.column(len(keep)).to_pylist()
                n, ids, decoded = [], [], []
                for t in texts:
                    packed = encoder.encode(t or "")
                    numbers = np.frombuffer(packed, "<u4")
                    back = encoder.decode(numbers.tolist())
                    n.append(len(numbers))
                    ids.append(hashlib.sha256(packed).hexdigest() if digests else numbers.astype("i4"))
                    decoded.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
                made = [pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names = [*keep, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=names)

    return docs.select(*(f"`{c}`" for c in keep), f"`{text}`").mapInArrow(run, schema)


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Every row of docs with n_tokens, ids and decoded added.

    docs: any columns; ``text`` names the column to encode.  Columns of docs that are named
    like an added one are left out.  A null or empty text has no ids and decodes to ''.
    Repeated rows stay; an empty table gives an empty result.
    """
    return coded(docs, tokenizer, False, [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")], text)


def digests(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of every row: its key, n_tokens, and the SHA-256 of its ids and of the decoded text."""
    return coded(docs, tokenizer, True, [key], text)
