"""Secrets in texts: base patterns, and strings that compression finds nothing known in.

1. Base patterns give spans that always count: assignments to names like password, access
   keys, and long runs of hexadecimal digits.
2. Candidates are further runs of key characters that stand behind a sensitive word (WORDS)
   within ``REACH`` code points on their line, and share no place with a base span.
3. A candidate's novelty is the number of bytes that a zstandard frame grows by when the
   candidate is put behind its surroundings.  Every frame starts from dictionaries: the names
   that code of all kinds uses (NAMES), and the parts of identifiers that all texts have most
   often in candidates and their surroundings.  The name of a variable, a path or a word that
   stands elsewhere on the line costs few bytes; what was drawn at random costs nearly all
   of its own.
4. Candidates that cost at least ``LEAST`` bytes and at least the share ``SHARE`` of their
   length are reported as of the kind ``novel``.

Parts of identifiers are counted once for each different surrounding, so a text that has
thousands of copies does not teach the dictionary its own secret; parts are runs of letters,
which random strings have only short ones of.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .common import slices

#: The kinds with base patterns, in the order in which spans that start together are listed, and the method's own.
KINDS = ("assign", "access", "hex")
NOVEL = "novel"
#: The base patterns with the least length of what must be long (of assignments the value).  Matches are
#: those of the plain patterns: a run of hexadecimal digits is entered at its start only, and one
#: of capitals that is too short from its start is so from any later place.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGNED = 6

#: Words that make what follows sensitive, code points they reach, and surroundings on either side that count.
WORDS = re.compile(r"(?i:passw|pwd|passphrase|secret|token|api_?key|access_?key|private_?key|credential|auth|bearer|signature|client_?id|session)", re.A)
REACH, AROUND = 64, 96
#: Candidates: runs of key characters, at least so many, of two kinds at least.
KEY, KEYS, LONG = re.compile(r"[A-Za-z0-9+/_.=~$-]"), re.compile(r"[A-Za-z0-9+/_.=~$-]+"), 12
#: The least marginal bytes, and their least share of the length, of what is reported.
LEAST, SHARE = 10, 0.7
#: Bytes of the learned dictionary, and in how many different surroundings its parts occur at least.
LEARNED, OFTEN = 16 << 10, 3
PART = re.compile(r"[A-Za-z][a-z]{2,}|[A-Z]{3,}")

#: Names that code and configurations of all kinds use around keys; zstandard's frames start from them.
NAMES = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example placeholder changeme undefined null true false string "
    "public static final const export default return function class import from self this user username email address host port url uri path "
    "http:// https:// www. .com .org .net /usr/local/lib/ /etc/ssl/certs/ /home/user/ .json .yaml .yml .html .php .js .py .pem "
    "database server client service account config settings environment variable production development staging test application "
    "request response header content type authorization bearer session cookie signature algorithm certificate private public "
    "your_ my_ _name _value _id _file _path _url get set is has new create update delete find validate generate encrypt decrypt hash "
    "password passwd passphrase secret token api_key apikey access_key client_id client_secret private_key credential auth key "
)


def base(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGNED]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def varied(run: str) -> bool:
    """Whether a run has two of lower case, upper case, digits."""
    return (run.upper() != run) + (run.lower() != run) + any(c.isdigit() for c in run) > 1


class Covered:
    """Places that spans cover, for asking whether another one meets any."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, end, before, after) of runs behind a sensitive word that share no place with the spans taken; before and after: the surroundings."""
    out, last, covered = [], 0, Covered(taken)
    for word in WORDS.finditer(text):
        line_end = text.find("\n", word.end(), word.end() + REACH)
        reach = min(len(text), word.end() + REACH) if line_end < 0 else line_end
        # A run may go on from the word itself: "secret_handler" is one name.
        at = max(last, word.start())
        while at > last and word.start() - at < AROUND and KEY.match(text, at - 1):
            at -= 1
        while at < reach and (first := KEY.search(text, at, reach)):
            start, at = first.start(), KEYS.match(text, first.start()).end()
            last = at
            if at - start < LONG or not varied(text[start:at]) or covered.meets(start, at):
                continue
            begin = max(text.rfind("\n", max(0, start - AROUND), start) + 1, start - AROUND, 0)
            end = text.find("\n", at, at + AROUND)
            out.append((start, at, text[begin:start], text[at : at + AROUND if end < 0 else end]))
    return out


@lru_cache(4)
def compressor(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_dict_id=False)


def novelty(run: str, before: str, after: str, dictionary: bytes) -> int:
    """The bytes that the frame of a run's surroundings grows by with the run."""
    around = (before + "\n" + after + "\n").encode(errors="replace")
    size = lambda data: len(compressor(dictionary).compress(data))
    return size(around + run.encode()) - size(around)


def surroundings(docs: DataFrame, text: str) -> DataFrame:
    """(around): every candidate of docs with what stands about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [b + x[i:j] + a for x in part.column(0).to_pylist() if x for i, j, b, a in candidates(x, base(x))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["around"])

    return docs.select(text).mapInArrow(run, "around string")


def learned(docs: DataFrame, text: str) -> bytes:
    """The parts of identifiers that most surroundings have, commonest last, as zstandard finds what is near the end most cheaply.

    All texts are counted; how many parts are kept is bounded by the dictionary's size.
    """
    parts = F.array_distinct(F.expr(r"regexp_extract_all(around, '[A-Za-z][a-z]{2,}|[A-Z]{3,}', 0)"))
    counts = surroundings(docs, text).distinct().select(F.explode(parts).alias("part")).groupBy("part").count()
    often = counts.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "part").limit(LEARNED // 4).collect()
    chosen, size = [], 0
    for r in often:
        size += len(r.part) + 1
        if size > LEARNED:
            break
        chosen.append(r.part)
    return (" ".join(reversed(chosen)) + " ").encode()


def found(text: str, dictionary: bytes) -> tuple[list, list]:
    """The base spans, and all spans with (kind, start, end, novelty); base spans have no novelty."""
    own = base(text)
    added = []
    for start, end, before, after in candidates(text, own):
        bytes_more = novelty(text[start:end], before, after, dictionary)
        if bytes_more >= LEAST and bytes_more >= SHARE * (end - start):
            added.append((NOVEL, start, end, bytes_more))
    every = sorted([*((*s, None) for s in own), *added], key=lambda s: (s[1], (*KINDS, NOVEL).index(s[0])))
    return own, every


SPAN = t.ArrayType(t.StructType([t.StructField("kind", t.StringType()), t.StructField("start", t.IntegerType()), t.StructField("end", t.IntegerType()), t.StructField("novelty", t.IntegerType())]))
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.int32())]))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of docs with base and spans added: arrays of (kind, start, end, novelty) by start, then kind; ends are exclusive, in code points.

    base has the matches of the base patterns, spans these and what is novel.  A null text is
    empty and has none.  Repeated rows stay; columns of docs that are named base or spans are
    left out; an empty table gives an empty result.
    """
    docs = docs.drop("base", "spans")
    known = docs.sparkSession.sparkContext.broadcast(NAMES.encode() + learned(docs, text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                rows = [found(x or "", known.value) for x in part.column(at).to_pylist()]
                lists = ([[dict(zip(("kind", "start", "end", "novelty"), (*s, None)[:4])) for s in r[i]] for r in rows] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, ARROW_SPAN) for x in lists)], names=[*part.schema.names, "base", "spans"])

    return docs.mapInArrow(run, t.StructType([*docs.schema.fields, t.StructField("base", SPAN), t.StructField("spans", SPAN)]))


def listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each secret in text replaced by its kind in brackets; of spans that overlap the first counts."""
    put = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, c: F.when(c["start"] < a["at"], a).otherwise(
            F.struct(F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, c["start"] - a["at"]), F.lit("["), c["kind"], F.lit("]")).alias("out"), c["end"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)),
    )
    own = docs.withColumnsRenamed({n: f"_own_{n}" for n in ("base", "spans")})
    out = spans(own, text).withColumn(text, F.when(F.size("spans") > 0, put).otherwise(F.col(text))).drop("base", "spans")
    return out.withColumnsRenamed({f"_own_{n}": n for n in ("base", "spans")}).select(*docs.columns)
